"""Inversions of implied sensitivities and the rules of the findings."""

import numpy as np
import pytest

from loomline.operators import ladder


def test_inversions_against_their_definitions():
    rng = np.random.default_rng(2)
    c, gamma = rng.standard_normal((40, 6)), rng.standard_normal((7, 2))
    a, b = (m @ m.T for m in rng.standard_normal((2, 6, 6)))
    maps, shares = ladder.inversions(gamma, c.T @ c, a, b)
    x, sd, over = np.column_stack([np.ones(40), c]), np.sqrt(np.diag(a)), np.linalg.inv(a)
    beta, g = c @ gamma[1:], gamma[1:]
    u, s, v = np.linalg.svd(c, full_matrices=False)
    want = {"instruments_train": c @ over * sd, "instruments_kernel": c @ np.linalg.inv(b) * sd, "best_k": (u[:, :2] * s[:2]) @ v[:2] @ over * sd,
            "least_squares": beta @ np.linalg.lstsq(beta, c, rcond=None)[0] @ over * sd, "no_constant": beta @ np.linalg.pinv(g) @ over * sd, "production": x @ gamma @ np.linalg.pinv(g) @ over * sd, "zero": 0 * c}
    for name, w in want.items():
        assert x @ maps[name] == pytest.approx(w, rel=1e-6, abs=1e-8)
    assert shares["kept_instruments_train"] == pytest.approx(1) and shares["kept_best_k"] == pytest.approx((s[:2] ** 2).sum() / (s**2).sum())
    assert shares["kept_no_constant"] <= shares["kept_best_k"] + 1e-12 and shares["kept_least_squares"] <= shares["kept_best_k"] + 1e-12 and shares["random_share"] == 2 / 6


def test_weighted_covariance(spark):
    rng = np.random.default_rng(3)
    z, w = rng.standard_normal((50, 3)), rng.random(50)
    rows = spark.createDataFrame([([float(v) for v in r], float(k)) for r, k in zip(z, w)], "z array<double>, k double")
    assert ladder.weighted_covariance(rows, "k") == pytest.approx(np.cov(z.T, aweights=w, ddof=0))
    assert ladder.weighted_covariance(rows) == pytest.approx(np.cov(z.T, ddof=0))


def told(spark, facts, checks=None):
    table = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in facts.items()], "name string, value double")
    return [(r["step"], r["severity"], r["origin"], r["subject"]) for r in ladder.in_order(ladder.findings(table, checks)).collect()]


def test_rules_hold_on_their_facts_only(spark):
    assert told(spark, {"nothing": 1}) == []
    assert told(spark, {"kept_no_constant": 0.2, "kept_best_k": 0.5, "rmse_production": 1, "rmse_zero": None}) == [("implied", "departure", "method", None)]
    cover = {"history_share": 0.7, "spearman_instruments_kernel": 0.5, "spearman_instruments_train": 0.49, "median_r2_instruments_kernel": 0.1, "median_r2_instruments_train": 0.1}
    assert told(spark, cover) == [("implied", "note", "implementation", None)]
    assert told(spark, cover | {"spearman_instruments_train": 0.4}) == [("implied", "departure", "implementation", None)]
    noise = {"criterion_min": 0.4, "criterion_max": 0.5, "null_q05": 0.3, "null_q95": 0.9, "criterion_se": 1.0}
    assert told(spark, noise) == [("fit", "departure", "method", None)]
    assert len(told(spark, noise | {"null_q95": 0.45})) == 1 and told(spark, noise | {"null_q95": 0.45, "criterion_se": 0.01}) == []
    assert len(told(spark, {"converged": 0, "objective": 3, "zero_objective": 2, "factor_ratio": 1e-9})) == 3


def test_identity_checks_that_are_off_are_defects(spark):
    checks = spark.createDataFrame([("panel", "sum", "fail", "identity"), ("fit", "size", "fail", "info"), ("fit", "r2", "pass", "identity")], "step string, name string, status string, kind string")
    assert told(spark, {"pooled_r2": 0.1}, checks) == [("panel", "defect", "defect", "sum"), ("forecast", "note", "method", None)]

"""Estimator identities and the distributed pass."""

import numpy as np
import pandas as pd
import pytest

from loomline.functions import dense, group_lasso
from loomline.operators import factor_model as fm
from loomline.operators import moments, tuning


def make_panel(T=40, N=60, L=12, K=2, noise=0.3, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    gamma = np.zeros((L + 1, K))
    gamma[1:4] = rng.standard_normal((3, K))
    f = rng.standard_normal((T, K)) + 0.3
    t, x, y = [], [], []
    for i in range(T):
        c = np.column_stack([np.ones(N), rng.standard_normal((N, L))])
        t += [i] * N
        x.append(c * np.r_[1.0, np.full(L, scale)])
        y.append(c @ gamma @ f[i] + noise * rng.standard_normal(N))
    return np.array(t), np.concatenate(x), np.concatenate(y)


def as_moments(t, x, y):
    out = []
    for k in np.unique(t):
        a, b = x[t == k], y[t == k]
        out.append((k, len(b), b @ b, a.T @ b, a.T @ a, a.mean(0), ((a - a.mean(0)) ** 2).sum(0)))
    return moments.Moments(*[np.array(c) for c in zip(*out)])


CFG = fm.FitConfig(K=2, n_lambdas=8, ratio=1e-2)


def test_group_lasso_is_optimal_and_beats_perturbations():
    rng = np.random.default_rng(5)
    for rho in (0.0, 0.99):
        z = rng.standard_normal((80, 1)) * rho**0.5 + rng.standard_normal((80, 30)) * (1 - rho) ** 0.5
        z = z * np.exp(rng.standard_normal(30))
        gram, b = z.T @ z, z.T @ rng.standard_normal(80)
        pen = np.where(np.arange(10) % 4 == 0, 0.0, 0.2 * np.abs(b).max())
        x, _, gap = group_lasso.solve(gram, b.reshape(10, 3), np.zeros((10, 3)), pen, 200000, 1e-9)
        assert gap <= 1e-8 * np.abs(b).max()
        base = group_lasso.objective(gram, b, x, pen)
        for _ in range(50):
            assert group_lasso.objective(gram, b, x + 1e-3 * rng.standard_normal(x.shape), pen) >= base - 1e-12


def test_objective_never_rises_and_penalty_is_twice_the_ridge():
    per = fm.ArrayPeriods(as_moments(*make_panel()))
    lam = fm.largest_lambda(per, CFG) * 0.2
    fit = fm.fit_sparse(per, lam, fm.FitConfig(K=2, tol=1e-12, max_sweeps=3000))
    assert fit.converged and np.all(np.diff(fit.path) <= 1e-9 * fit.path[0])
    pen = lam * per.n_obs * np.linalg.norm(fit.gamma * per.sigma[:, None], axis=1).sum()
    assert pen == pytest.approx(2 * (fit.factors**2).sum(), rel=1e-4)


def test_units_do_not_matter():
    a = fm.fit_sparse(fm.ArrayPeriods(as_moments(*make_panel())), 1e-3, CFG)
    b = fm.fit_sparse(fm.ArrayPeriods(as_moments(*make_panel(scale=1e-6))), 1e-3, CFG)
    assert a.objective == pytest.approx(b.objective, rel=1e-7) and list(a.selected) == list(b.selected)
    assert a.gamma[1:] == pytest.approx(b.gamma[1:] * 1e-6, rel=1e-4, abs=1e-6)


def test_path_is_sparse_at_the_top_and_finds_the_relevant_rows():
    per = fm.ArrayPeriods(as_moments(*make_panel()))
    fits = fm.fit_path(per, CFG)
    assert fits[-1].selected.sum() <= 1 and list(np.flatnonzero(fits[3].selected))[:3] == [0, 1, 2]
    assert fits[0].total_r2 > 0.9 and fits[0].total_r2 >= fits[0].pred_r2


def test_plain_fit_normalisation_and_fit():
    t, x, y = make_panel(noise=0.0)
    fit = fm.fit_sparse(fm.ArrayPeriods(as_moments(t, x, y)), 0.0, CFG)
    assert fit.gamma.T @ fit.gamma == pytest.approx(np.eye(2), abs=1e-9)
    second = fit.factors.T @ fit.factors / len(fit.factors)
    assert second[0, 1] == pytest.approx(0, abs=1e-8) and second[0, 0] >= second[1, 1]
    assert fit.total_r2 == pytest.approx(1.0, abs=1e-6)


def test_canonical_form_keeps_the_fit():
    fit = fm.fit_sparse(fm.ArrayPeriods(as_moments(*make_panel())), 1e-3, CFG)
    c = fm.canonical(fit)
    assert c.gamma @ c.factors.T == pytest.approx(fit.gamma @ fit.factors.T, abs=1e-10)
    assert c.cov[0, 1] == pytest.approx(0, abs=1e-10) and np.all(c.mu >= 0) and c.sharpe() == pytest.approx(fit.sharpe())


def test_loading_map_inverts():
    rng = np.random.default_rng(2)
    a, cov = rng.standard_normal((8, 2)), np.array([[1.0, 0.2], [0.2, 0.5]])
    gamma = np.vstack([np.zeros(2), a @ np.linalg.inv(a.T @ a) @ np.linalg.inv(cov)])
    got, short = fm.loading_map(fm.Fit(gamma, np.zeros((0, 2)), np.zeros(2), cov, 0.1, 0.0))
    assert got == pytest.approx(a) and not short


def test_distributed_pass_and_fan_out_agree(spark, monkeypatch):
    t, x, y = make_panel(T=36, N=30, L=5)
    df = spark.createDataFrame(pd.DataFrame({"t_idx": t, "y": y, "x": x.tolist()}), "t_idx int, y double, x array<double>")
    table = moments.period_moments(df)
    arrays, remote = fm.ArrayPeriods(moments.collect_moments(table)), fm.TablePeriods(table, 3)
    gamma = fm.starting_loadings(arrays, CFG)
    one, two = arrays.run(gamma), remote.run(gamma, factors=True)
    assert two.gram == pytest.approx(one.gram) and two.ssr == pytest.approx(one.ssr) and two.factors == pytest.approx(one.factors)
    assert fm.fit_sparse(remote, 5e-3, fm.FitConfig(K=2, tol=1e-4)).objective == pytest.approx(fm.fit_sparse(arrays, 5e-3, fm.FitConfig(K=2, tol=1e-4)).objective, rel=1e-9)
    path, fit = tuning.tune_model(table, CFG)
    local = fm.fit_path(arrays, CFG)
    assert sorted(r["objective"] for r in path.collect()) == pytest.approx(sorted(f.objective for f in local), rel=1e-9)
    periods = spark.createDataFrame([(int(i), f"2020-01-{i % 28 + 1:02d}") for i in range(36)], "t_idx int, period string").selectExpr("t_idx", "cast(period as date) period")
    plan = tuning.refit_schedule(periods, tuning.OosConfig(min_train=20, refit_every=6, retune=False))
    out = tuning.run_out_of_sample(table, plan, fm.FitConfig(K=2), oos=tuning.OosConfig(min_train=20, refit_every=6, retune=False), lam=1e-3).toPandas()
    assert sorted(out["t_idx"]) == list(range(22, 36))
    small = fm.FitConfig(K=2, tol=1e-5)
    fast = tuning.run_out_of_sample(table, plan.where("refit = 0"), small, oos=tuning.OosConfig(min_train=20, refit_every=6, retune=False), lam=5e-3).toPandas().sort_values("t_idx")
    monkeypatch.setattr(tuning, "collect_moments", lambda *a, **k: None)
    slow = tuning.run_out_of_sample(table, plan.where("refit = 0"), small, oos=tuning.OosConfig(min_train=20, refit_every=6, retune=False), lam=5e-3).toPandas().sort_values("t_idx")
    assert slow["mve"].to_numpy() == pytest.approx(fast["mve"].to_numpy(), rel=1e-6)


def test_selection_rules_agree_in_and_out_of_tasks(spark):
    rows = [(1, 0.1, 1.00, 5), (1, 0.2, 0.99, 4), (2, 0.2, 0.99, 3), (1, 0.4, 0.90, 2), (1, 0.8, float("nan"), 0)]
    path = spark.createDataFrame(rows, "K int, lam double, criterion double, n_selected int")
    best = tuning.select_best(path, 0.02).first()
    assert (best["K"], best["lam"], best["n_selected"]) == (2, 0.2, 3)
    assert tuning.select_best(path, 0.0).first()["lam"] == 0.1
    fits = [fm.Fit(np.r_[np.zeros((1, r[0])), np.repeat(np.eye(1, r[0]), r[3], 0), np.zeros((6 - r[3], r[0]))], np.zeros((0, r[0])), np.zeros(r[0]), np.eye(r[0]), r[1], 0.0) for r in rows]
    assert tuning.chosen(tuning._points(fits, [r[2] for r in rows]), tuning.TuneConfig(tolerance=0.02)) == 2


def test_f_tail_identities():
    assert dense.f_survival(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert dense.f_survival(2.71089, 5, 20) == pytest.approx(0.05, abs=1e-5)
    assert dense.f_quantile(0.95, 3, 30) == pytest.approx(2.92228, abs=1e-4)
    assert dense.beta_tail(2, 3, 0.4) + dense.beta_tail(3, 2, 0.6) == pytest.approx(1.0)


def test_queries_run_the_default_grid(spark):
    """All factor counts and all penalties of the operator's defaults."""
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    path = entry.QUERIES["lambda_path"](spark, sf).toPandas()
    assert path.groupby("K")["lam"].nunique().to_dict() == {k: fm.FitConfig().n_lambdas for k in (1, 2, fm.FitConfig().K)}
    left_out = entry.QUERIES["loocv"](spark, sf).toPandas()
    assert set(left_out["K"]) == {fm.FitConfig().K} and left_out["lam"].nunique() == fm.FitConfig().n_lambdas

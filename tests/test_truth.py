"""Matching to a truth and implied betas."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import truth


def days(spark, *names):
    return spark.createDataFrame([(d,) for d in names], "period string").selectExpr("to_date(period) as period")


def test_dates_first_then_labels(spark):
    src = days(spark, "2001-01-31", "2001-02-28", "2001-03-30")
    got = lambda tgt, p="M": {str(r["period"]): (r["matched"] and str(r["matched"]), r["how"]) for r in truth.match_periods(src, tgt, p).collect()}
    exact = days(spark, "2001-01-31", "2001-02-28", "2001-03-30", "2001-04-30")
    assert set(v[1] for v in got(exact).values()) == {"date"}
    stamped = days(spark, "2001-01-31", "2001-02-28", "2001-03-31")
    assert got(stamped)["2001-03-30"] == ("2001-03-31", "label") and got(stamped, None)["2001-03-30"] == (None, None)
    twice = days(spark, "2001-01-31", "2001-01-15", "2001-03-31")  # two dates of one month: labels say nothing
    assert got(twice) == {"2001-01-31": ("2001-01-31", "date"), "2001-02-28": (None, None), "2001-03-30": (None, None)}
    gap = days(spark, "2001-02-01", "2001-03-31")
    assert got(gap) == {"2001-01-31": (None, None), "2001-02-28": ("2001-02-01", "label"), "2001-03-30": ("2001-03-31", "label")}


def test_positions_are_the_order(spark):
    names = [f"n{i:03d}" for i in np.random.default_rng(1).permutation(300)]
    got = truth.positions(spark.createDataFrame([(n,) for n in names + names[:50]], "asset string"), "asset").collect()
    assert {r["asset"]: r["at"] for r in got} == {n: i for i, n in enumerate(sorted(names))}


def test_assets_by_position_need_equal_counts(spark):
    a = spark.createDataFrame([("b",), ("a",)], "asset string")
    match = lambda names: {r["asset"]: r["true_asset"] for r in truth.match_assets(a, spark.createDataFrame([(n,) for n in names], "asset string"), ids=False).collect()}
    assert match(["y", "x"]) == {"a": "x", "b": "y"} and match(["x"]) == {"a": None, "b": None}


def test_three_betas_against_numpy(spark):
    rng = np.random.default_rng(6)
    gamma, rows, true = rng.standard_normal((5, 3)), [], []
    want = {}
    for t in range(9):
        x = np.column_stack([np.ones(30), rng.standard_normal((30, 4))])
        b = x @ gamma @ rng.standard_normal((3, 2)) + 0.5 * rng.standard_normal((30, 2))
        day = f"2001-{t + 1:02d}-28"
        if t == 4:
            b[:] = 0.0
        if t == 6:
            b[:27] = np.nan  # too few rows
        rows += [(t, pd.Timestamp(day).date(), f"a{i:02d}", [float(v) for v in x[i]]) for i in range(30)]
        true += [(pd.Timestamp(day).date(), f"a{i:02d}", [float(v) for v in b[i]]) for i in range(30)]
        if t % 2 == 0 and t not in (4, 6):
            basis = [np.linalg.svd(m - m.mean(0), full_matrices=False)[0] for m in (x @ gamma, b)]
            want[t] = np.linalg.svd(basis[0].T @ basis[1], compute_uv=False)
    panel = spark.createDataFrame(rows, "t_idx int, period date, asset string, x array<double>")
    summary, periods = truth.beta_canonical_corr(panel, gamma.tolist(), spark.createDataFrame(true, "period date, asset string, b array<double>"), 2, every=2)
    got = {r["t_idx"]: r for r in periods.collect()}
    assert set(got) == set(want)
    for t, rho in want.items():
        assert got[t]["first"] == pytest.approx(rho[0], abs=1e-8) and got[t]["mean"] == pytest.approx(rho.sum() / 2, abs=1e-8) and got[t]["n"] == 30
    assert summary.first()["beta_canonical_corr"] == pytest.approx(np.mean([r[0] for r in want.values()]))


def test_sample_is_widened(spark):
    rows = spark.createDataFrame([(t,) for t in range(10)], "t_idx int")
    assert [r[0] for r in truth.sampled_periods(rows, 3, 3).orderBy("t_idx").collect()] == [0, 3, 6, 9]
    assert [r[0] for r in truth.sampled_periods(rows, 12, 5).orderBy("t_idx").collect()] == [0, 2, 4, 7, 9]


def test_topic_sets(spark):
    from loomline.operators import links

    registry = spark.createDataFrame([("S1", "one", "Sector", "sector", None, 5), ("A1", "two", "Macro", "economic", "x", 2), ("S2", "three", "Sector", "sector", "y", 9)], "topic_id string, name string, group string, ontology string, scope string, order int")
    ids = lambda which, n: [(r["topic_id"], r["order"], r["scope"]) for r in links.topic_table(registry, which, n).orderBy("order").collect()]
    assert ids("both", 1) == [("A1", 1, "x"), ("S1", 2, ""), ("S2", 3, "y"), ("G001", 4, "")]
    assert ids("sector", 0) == [("S1", 1, ""), ("S2", 2, "y")] and ids("none", 2) == [("G001", 1, ""), ("G002", 2, "")]
    assert links.topic_table(registry, "none", 1001).where("topic_id = 'G1001'").count() == 1
    with pytest.raises(ValueError):
        links.topic_table(registry, "other")

"""Direct regressions, designed attention, inference and cleaning on small cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from loomline.functions.ranking import average_rank, spearman
from loomline.operators import cleaning, designed, direct, inference, links, scoring, weekly
from loomline.operators.calendar import trading_calendar
from tests.test_hand_cases import days


def cross(x, y):
    one = np.column_stack([np.ones(len(y)), x])
    return direct.Cross(len(y), one.T @ one, one.T @ y, y @ y)


def test_penalised_solutions_match_their_definitions():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((120, 6)), rng.standard_normal(120)
    y += x[:, 0]
    c = cross(x, y)
    xc, yc = x - x.mean(0), y - y.mean()
    assert c.least_squares() == pytest.approx(np.linalg.lstsq(xc, yc, rcond=None)[0])
    assert c.ridge(0.3) == pytest.approx(np.linalg.solve(xc.T @ xc + 120 * 0.3 * np.eye(6), xc.T @ yc))
    b = c.elastic_net(0.1, 0.9)
    grad = xc.T @ (xc @ b - yc) / 120 + 0.1 * 0.1 * b
    on = b != 0
    assert grad[on] == pytest.approx(-0.09 * np.sign(b[on]), abs=1e-7) and np.all(np.abs(grad[~on]) <= 0.09 + 1e-7)

    def gcv(lam):
        hat = xc @ np.linalg.solve(xc.T @ xc + 120 * lam * np.eye(6), xc.T)
        return ((yc - hat @ yc) ** 2).mean() / (1 - (1 + np.trace(hat)) / 120) ** 2

    _, lam = c.ridge_gcv()
    assert lam == direct.RIDGE_GRID[int(np.argmin([gcv(v) for v in direct.RIDGE_GRID]))]


def test_least_squares_is_refused_with_too_many_topics(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame(pd.DataFrame({"asset_id": 0, "n_train": 30, "y": rng.standard_normal(30), "x": rng.standard_normal((30, 17)).tolist()}), "asset_id int, n_train long, y double, x array<double>")
    scale = spark.createDataFrame([(0, "a")], "asset_id int, asset string")
    with pytest.raises(Exception, match="refused"):
        direct.fit_direct(rows, scale, [f"t{i}" for i in range(16)], direct.DirectConfig(method="ols")).collect()


def test_designed_world_is_recovered(spark):
    rng = np.random.default_rng(8)
    ds = days(2500, dt.date(2010, 1, 4))
    r = rng.standard_normal((2500, 6)) * 0.01
    rets = spark.createDataFrame([(d, f"s{i}", float(r[t, i])) for t, d in enumerate(ds) for i in range(6) if not (i == 5 and t % 5 == 0)], "date date, asset string, ret double")
    cal = trading_calendar(rets)
    weights = spark.createDataFrame([("a", "s0", 0.5), ("a", "s1", -0.3), ("b", "s5", 0.4)], "topic string, asset string, w double")
    topics, cfg = ["a", "b", "c"], designed.DesignConfig()
    std = designed.standardise(rets)
    scaling = designed.feasibility(std, weights, cal, topics, cfg)
    signal = designed.designed_signal(std, weights, cal, topics, cfg)
    attention = designed.designed_attention(signal, scaling, cfg)
    truth = {(x["topic"], x["asset"]): x["b"] for x in designed.population_sensitivities(signal, scaling, std, cal, topics, 5, cfg).collect()}
    from loomline.operators.shocks import attention_shocks

    scaled = designed.scale_on_window(attention_shocks(attention, cal, 5), str(ds[0]), str(ds[-1]))
    by_day, usable = designed.lead_pairs(rets, scaled, cal, 3, cfg.lead)
    rows, scale = direct.training_rows(by_day, usable, topics, str(ds[0]), str(ds[-1]))
    got = {(x["topic"], x["asset"]): x["b"] for x in direct.fit_direct(rows, scale, topics, direct.DirectConfig(method="ols")).collect()}
    assert got.keys() == truth.keys()
    assert max(abs(got[k] - truth[k]) for k in got) < 0.08
    assert truth["a", "s0"] > 0.35 and truth["a", "s1"] < -0.2 and abs(truth["c", "s0"]) < 0.05


def test_topic_draws_do_not_depend_on_other_topics():
    one = links.topic_generator(3, links.NOISE_STREAM, "G001").standard_normal(5)
    assert list(one) == list(np.random.default_rng([3, 202, 71, 48, 48, 49]).standard_normal(5))


def test_joint_test_and_pricing_against_direct_algebra(spark):
    rng = np.random.default_rng(4)
    T, N, K = 120, 4, 2
    f = rng.standard_normal((T, K)) * 0.02 + 0.005
    y = f @ rng.standard_normal((K, N)) + 0.01 * rng.standard_normal((T, N)) + 0.001
    rets = spark.createDataFrame([(t, f"a{i}", float(y[t, i])) for t in range(T) for i in range(N)], "t_idx int, asset string, y double")
    facs = spark.createDataFrame([(t, f[t].tolist()) for t in range(T)], "t_idx int, f array<double>")
    x = np.column_stack([np.ones(T), f])
    coef = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ coef
    sig, mu = e.T @ e / (T - K - 1), f.mean(0)
    om = (f - mu).T @ (f - mu) / T
    want = T / (T - K - 1) * (T - N - K) / N * (coef[0] @ np.linalg.solve(sig, coef[0])) / (1 + mu @ np.linalg.solve(om, mu))
    got = inference.joint_alpha_test(rets, facs, N, K).first()
    assert got["f_stat"] == pytest.approx(want, rel=1e-8) and 0 < got["p_value"] < 1
    assert inference.joint_alpha_test(rets.where("t_idx < 7"), facs, N, K).first()["f_stat"] is None
    priced = {r["asset"]: r for r in inference.price_test_assets(rets, facs, K, 0).collect()}
    u = x * e[:, [1]]
    white = np.linalg.inv(x.T @ x) @ (u.T @ u) @ np.linalg.inv(x.T @ x)
    assert priced["a1"]["alpha"] == pytest.approx(coef[0, 1]) and priced["a1"]["t_stat"] == pytest.approx(coef[0, 1] / white[0, 0] ** 0.5)


def test_unit_slips_and_bad_ticks(spark):
    ds = days(60)
    levels = [1.0 + 0.001 * (i % 7) for i in range(60)]
    slipped = [v * 100 if 20 <= i < 30 else v for i, v in enumerate(levels)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(ds, slipped)], "series string, at date, level double")
    out = cleaning.repair_unit_slips(df).orderBy("at").collect()
    assert [r["level"] for r in out] == pytest.approx(levels) and sum(r["repaired"] for r in out) == 10
    ticked = [v * 1.2 if i in (15, 40) else v for i, v in enumerate(levels)]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(ds, ticked)], "series string, at date, level double")
    kept = {r["at"] for r in cleaning.remove_bad_ticks(df).collect()}
    assert set(ds) - kept == {ds[15], ds[40]}


def test_spearman_matches_pandas_with_ties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 500).astype(float), "b": rng.standard_normal(500).round(1)})
    df = spark.createDataFrame(pdf)
    assert spearman(df, "a", "b").first()[0] == pytest.approx(pdf["a"].rank().corr(pdf["b"].rank()))
    counts = df.groupBy("b").count().withColumnRenamed("count", "ties")
    for buckets in (1, 7, 64):
        got = {r["b"]: r["r"] for r in average_rank(counts, "b", "r", buckets).collect()}
        assert all(got[v] == r for v, r in zip(pdf["b"], pdf["b"].rank()))


def test_pairwise_correlation_with_gaps(spark):
    rng = np.random.default_rng(2)
    z = pd.DataFrame(rng.standard_normal((200, 4)) + 3, columns=list("abcd"))
    z = z.mask(rng.random(z.shape) < 0.2)
    z.loc[2:, "d"] = np.nan
    rows = spark.createDataFrame([(i, c, float(v)) for c in z for i, v in z[c].items() if v == v], "k int, s string, v double")
    got = {(r["a"], r["b"]): r for r in scoring.pairwise_correlation(rows, "k", "s", "v", list("abcd")).collect()}
    for a, b in [("a", "b"), ("b", "c")]:
        ok = z[[a, b]].dropna()
        assert got[a, b]["n"] == len(ok) and got[a, b]["corr"] == pytest.approx(ok[a].corr(ok[b])) and got[a, b]["cov"] == pytest.approx(ok[a].cov(ok[b], ddof=0))
    assert all(r["corr"] is None for k, r in got.items() if "d" in k)


def test_shuffles_are_permutations(spark):
    rows = [(t, dt.date(2024, 1, 5), f"a{i}", 0.1 * i, [1.0, float(i)]) for t in range(2) for i in range(7)]
    df = spark.createDataFrame(rows, "t_idx int, period date, asset string, y double, x array<double>")
    out = weekly.shuffled_panel(df, 5, 3).toPandas()
    for _, g in out.groupby(["t_idx", "copy"]):
        assert sorted(v[1] for v in g["x"]) == list(range(7)) and sorted(g["y"]) == pytest.approx([0.1 * i for i in range(7)])
    assert out.sort_values(["t_idx", "copy", "asset"])["x"].map(lambda v: v[1]).tolist() != sorted(out["x"].map(lambda v: v[1]))


def test_checks_fail_on_missing_metrics(spark):
    metrics = spark.createDataFrame([("s", 0, "null", "null_selection_lift", 1.0), ("s", 0, "null", "null_oos_sharpe_abs", float("nan"))], "scenario string, seed int, kind string, name string, value double")
    flags = {r["check"]: r["passed"] for r in scoring.pass_flags(metrics, scoring.check_table(spark), ["scenario", "seed"]).collect()}
    assert flags == {"null_selection_lift": True, "null_oos_sharpe_abs": False}


def test_canonical_corr_of_whole_halves_per_label(spark):
    """All 64 columns, against QR of the centred halves of each label."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("label", "embedding").toPandas()
    got = {r["g"]: r for r in entry.QUERIES["canonical_corr"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {str(x) for x in rows["label"].unique()}
    for label, own in rows.groupby("label"):
        x = np.stack(own["embedding"].to_list()).astype(float)
        assert x.shape[1] == 64
        qa, qb = (np.linalg.qr(side - side.mean(0))[0] for side in (x[:, :32], x[:, 32:]))
        want = np.linalg.svd(qa.T @ qb, compute_uv=False)[0]
        assert got[str(label)]["n"] == len(x) and abs(got[str(label)]["first"] - want) < 1e-6

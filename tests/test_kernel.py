"""Kernel covariances against the definition, one cell at a time."""

import numpy as np
import pandas as pd
import pytest

from loomline.operators import align, kernel, moments, panel
from loomline.operators.calendar import trading_calendar


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    dates = pd.bdate_range("2021-01-04", periods=300)
    r = rng.standard_normal((300, 5))
    r[rng.random((300, 5)) < 0.1] = np.nan
    r[:40, 0] = np.nan
    r[-30:, 1] = np.nan
    r[60:150, 2] = np.nan
    z = rng.standard_normal((300, 3)) + 0.3
    z[:5] = np.nan
    z[70, 1] = np.nan
    days = [d.date() for d in dates]
    rets = spark.createDataFrame([(d, f"s{i}", float(r[t, i])) for t, d in enumerate(days) for i in range(5) if np.isfinite(r[t, i])], "date date, asset string, ret double")
    shk = spark.createDataFrame([(d, f"t{k}", float(z[t, k])) for t, d in enumerate(days) for k in range(3) if np.isfinite(z[t, k])], "date date, topic string, z double")
    return r, z, dates, rets, shk


def by_definition(r, z, dates, cfg, period="M"):
    pid = pd.factorize(dates.to_period(period))[0]
    back = np.array([(pid[i:] == pid[i]).sum() for i in range(len(pid))])
    ok_day = np.isfinite(z).all(1)
    out = {}
    for t in range(pid.max() + 1):
        for i in range(r.shape[1]):
            use = ok_day & np.isfinite(r[:, i]) & ((pid < t) | ((pid == t) & (back > cfg.skip_days)))
            if cfg.lookback:
                use &= t - pid < cfg.lookback
            if use.sum() < max(cfg.min_days, 1):
                continue
            w = cfg.xi ** (t - pid[use]) / (cfg.xi ** (t - pid[use])).sum()
            for k in range(z.shape[1]):
                out[t, f"s{i}", f"t{k}"] = ((w * r[use, i] * z[use, k]).sum() - (w * r[use, i]).sum() * (w * z[use, k]).sum(), use.sum())
    return out


CASES = [
    kernel.KernelConfig(xi=0.9, min_days=20), kernel.KernelConfig(xi=0.9, min_days=5, lookback=1), kernel.KernelConfig(xi=0.8, min_days=10, lookback=3),
    kernel.KernelConfig(xi=1.0, skip_days=0, min_days=1), kernel.KernelConfig(xi=0.9, skip_days=30, min_days=20),
]


@pytest.mark.parametrize("cfg", CASES)
@pytest.mark.parametrize("route", ["rows", "blocks"])
def test_matches_definition(world, cfg, route):
    r, z, dates, rets, shk = world
    cal = trading_calendar(rets)
    if route == "rows":
        cov = kernel.kernel_covariance(rets, shk, cal, 3, cfg)
    else:
        cov = kernel.unpack_topics(kernel.kernel_covariance_blocks(rets, shk, cal, ["t0", "t1", "t2"], cfg, 3), ["t0", "t1", "t2"])
    got = {(x["period_id"], x["asset"], x["topic"]): (x["cov"], x["n_days"]) for x in cov.collect()}
    want = by_definition(r, z, dates, cfg)
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][1] == want[key][1]
        assert got[key][0] == pytest.approx(want[key][0], abs=1e-12)


def test_shuffled_join_route_is_the_same(world, monkeypatch):
    _, _, _, rets, shk = world
    cal, cfg = trading_calendar(rets), kernel.KernelConfig(xi=0.9, min_days=20)
    a = {tuple(x[:3]): x[3] for x in kernel.kernel_covariance(rets, shk, cal, 3, cfg).collect()}
    monkeypatch.setattr(kernel, "BROADCAST_ROWS", 0)
    b = {tuple(x[:3]): x[3] for x in kernel.kernel_covariance(rets, shk, cal, 3, cfg).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-13) for k in a)


def test_covariance_ignores_the_future(world):
    r, z, dates, rets, shk = world
    cal, cfg = trading_calendar(rets), kernel.KernelConfig(xi=0.9, min_days=20)
    later = shk.withColumn("z", shk["z"] + (shk["date"] > "2021-09-01").cast("double") * 5)
    before = kernel.kernel_covariance(rets, shk, cal, 3, cfg).where("period_id < 8").orderBy("period_id", "asset", "topic").collect()
    after = kernel.kernel_covariance(rets, later, cal, 3, cfg).where("period_id < 8").orderBy("period_id", "asset", "topic").collect()
    assert [x["cov"] for x in before] == pytest.approx([x["cov"] for x in after], abs=1e-13)


def test_panel_pairs_next_period_and_moments(spark, world):
    r, z, dates, rets, shk = world
    cal, cfg = trading_calendar(rets), kernel.KernelConfig(xi=0.9, min_days=20)
    cov = kernel.pack_topics(kernel.kernel_covariance(rets, shk, cal, 3, cfg), ["t0", "t1", "t2"])
    rows = panel.build_panel(cov, align.period_returns(rets, cal), 3, 2)
    got = rows.toPandas()
    pid = pd.factorize(dates.to_period("M"))[0]
    want = by_definition(r, z, dates, cfg)
    ends = {dates[pid == t][-1].date(): t for t in range(pid.max() + 1)}
    assert sorted(got["t_idx"].unique()) == list(range(got["t_idx"].nunique()))
    for row in got.itertuples():
        t = ends[row.period]
        i = int(row.asset[1:])
        assert row.y == pytest.approx(np.nansum(r[pid == t, i]))
        assert list(row.x)[0] == 1.0 and list(row.x)[1:] == pytest.approx([want[t - 1, row.asset, f"t{k}"][0] for k in range(3)], abs=1e-12)
    held = moments.collect_moments(moments.period_moments(rows, fan_in=2))
    x0, y0 = np.stack(got[got.t_idx == 0]["x"]), got[got.t_idx == 0]["y"].to_numpy()
    assert held.s[0] == pytest.approx(x0.T @ x0) and held.v[0] == pytest.approx(x0.T @ y0) and held.n[0] == len(y0)
    allx = np.stack(got["x"])
    assert held.sigma()[1:] == pytest.approx(allx.std(0)[1:], rel=1e-12)


def test_moments_with_one_dominant_period(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 4))
    x[:, 0] = 1
    t = np.where(np.arange(4000) % 3 == 0, 0, np.arange(4000) % 50)
    df = spark.createDataFrame(pd.DataFrame({"t_idx": t, "y": x[:, 1] * 2, "x": x.tolist()}), "t_idx int, y double, x array<double>").repartition(16)
    held = moments.collect_moments(moments.period_moments(df, fan_in=4))
    for k in (0, 7, 49):
        rows = x[t == k]
        assert held.s[held.t_idx == k][0] == pytest.approx(rows.T @ rows, rel=1e-11)
        assert held.m2[held.t_idx == k][0] == pytest.approx(((rows - rows.mean(0)) ** 2).sum(0), rel=1e-10)


def test_panel_rows_are_made_once_and_not_moved_again(spark, capsys):
    """Covariances are not computed again to count a period's rows, and numbering the periods moves no instruments."""
    from datetime import date

    from loomline.operators import panel

    cov = spark.createDataFrame([(p, f"a{i}", [0.1 * p, 1.0 * i]) for p in range(4) for i in range(3)], "period_id int, asset string, cov array<double>")
    rets = spark.createDataFrame([(p, f"a{i}", date(2020, 1, p + 1), 0.5 * i) for p in range(5) for i in range(3)], "period_id int, asset string, period_end date, ret double")
    rows = panel.build_panel(cov, rets, 1, 2)
    rows.explain()
    plan = capsys.readouterr().out
    assert rows.inputFiles() and "SortMergeJoin" not in plan
    got = sorted((r["t_idx"], r["period"].day, r["asset"], r["y"], tuple(r["x"])) for r in rows.collect())
    assert got == sorted((p - 1, p + 2, f"a{i}", 0.5 * i, (1.0, 0.1 * p, 1.0 * i)) for p in range(1, 4) for i in range(3))

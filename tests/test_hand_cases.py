"""Literal cases with known answers."""

import datetime as dt

import pytest

from loomline.operators import align, calendar, designed, shocks, windows


def days(n, start=dt.date(2024, 1, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def test_shock_of_window_five(spark):
    ds = days(7)
    att = spark.createDataFrame([(d, "a", float(v)) for d, v in zip(ds, [1, 1, 1, 1, 1, 2, 1])], "date date, topic string, level double")
    got = shocks.attention_shocks(att, calendar.trading_calendar(att.select("date")), 5).orderBy("date").collect()
    assert [r["z"] for r in got[:5]] == [None] * 5
    assert got[5]["z"] == pytest.approx(1.0) and got[6]["z"] == pytest.approx(-0.2)


def test_gap_makes_shocks_missing(spark):
    ds = days(12)
    cal = calendar.trading_calendar(spark.createDataFrame([(d,) for d in ds], "date date"))
    att = spark.createDataFrame([(d, "a", 1.0) for i, d in enumerate(ds) if i != 6], "date date, topic string, level double")
    got = {r["date"]: r["z"] for r in shocks.attention_shocks(att, cal, 3).collect()}
    assert got[ds[5]] == 0.0 and got[ds[7]] is None and got[ds[9]] is None and got[ds[10]] == 0.0


def test_weighted_documents(spark):
    rows = [
        (dt.datetime(2024, 1, 1, 9), 100.0, "a", 0.8), (dt.datetime(2024, 1, 1, 9), 100.0, "b", 0.2),
        (dt.datetime(2024, 1, 1, 15), 300.0, "a", 0.2), (dt.datetime(2024, 1, 1, 15), 300.0, "b", 0.8),
    ]
    theta = spark.createDataFrame(rows, "ts timestamp, weight double, topic string, theta double")
    assert {r["topic"]: r["level"] for r in align.document_attention(theta).collect()} == pytest.approx({"a": 0.35, "b": 0.65})
    assert {r["topic"]: r["level"] for r in align.document_attention(theta, False).collect()} == pytest.approx({"a": 0.5, "b": 0.5})


def test_weighted_documents_with_missing_cells(spark):
    one, two = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [(one, 1.0, "a", None), (one, 1.0, "b", 0.2), (one, 1.0, "a", 0.4), (one, 1.0, "b", 0.8), (two, 0.0, "a", 0.6), (two, 0.0, "b", None)]
    theta = spark.createDataFrame(rows, "ts timestamp, weight double, topic string, theta double")
    got = {(r["date"].day, r["topic"]): r["level"] for r in align.document_attention(theta).collect()}
    assert got[1, "a"] == pytest.approx(0.4) and got[1, "b"] == pytest.approx(0.5)
    assert got[2, "a"] is None and got[2, "b"] is None


@pytest.mark.parametrize("policy,monday", [("fold_mean", 6.0), ("fold_sum", 18.0), ("drop", 7.0)])
def test_fold_policies(spark, policy, monday):
    base = dt.date(2020, 1, 6)
    cal = calendar.trading_calendar(spark.createDataFrame([(d,) for d in days(6, base)], "date date"))
    att = spark.createDataFrame([(base + dt.timedelta(i), "a", float(i)) for i in range(-2, 12)], "date date, topic string, level double")
    got = {r["date"]: r["level"] for r in align.apply_calendar_policy(att, cal, policy).collect()}
    assert got[dt.date(2020, 1, 13)] == monday
    first = {"fold_mean": -1.0, "fold_sum": -3.0, "drop": 0.0}[policy]
    assert got[base] == first and max(got) == dt.date(2020, 1, 13)


def test_limited_fill(spark):
    ds = days(9)
    cal = calendar.trading_calendar(spark.createDataFrame([(d,) for d in ds], "date date"))
    levels = spark.createDataFrame([(ds[0], "a", 1.0), (ds[8], "a", 2.0)], "date date, asset string, level double")
    got = {r["date"]: r["stale"] for r in align.fill_gaps(levels, cal, "asset", "level", 5).collect()}
    assert sorted(got) == ds[:6] + [ds[8]] and got[ds[0]] is False and got[ds[5]] is True


def test_infinite_returns_are_missing(spark):
    ds = days(4)
    rets = spark.createDataFrame([(ds[0], "x", 0.1), (ds[1], "x", float("inf")), (ds[2], "x", float("nan")), (ds[3], "x", 0.2)], "date date, asset string, ret double")
    att = spark.createDataFrame([(d, "a", 1.0) for d in ds], "date date, topic string, level double")
    _, got, _ = align.align(att, rets, align.AlignConfig())
    assert {r["ret"] for r in got.collect()} == {0.1, 0.2}


def test_period_aliases(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 14),)], "date date")
    for alias, want in [("M", dt.date(2024, 3, 1)), ("ME", dt.date(2024, 3, 1)), ("Q", dt.date(2024, 1, 1)), ("Y", dt.date(2024, 1, 1)), ("W", dt.date(2024, 3, 11)), ("W-FRI", dt.date(2024, 3, 9))]:
        assert df.select(calendar.period_start(df["date"], alias)).first()[0] == want
    with pytest.raises(ValueError):
        calendar.period_start(df["date"], "H")


def test_recovery_metrics(spark):
    w = [[0.35, 0, -0.15], [0, 0.05, 0]]
    truth = [[0.30, 0.02, -0.12], [0.01, 0.04, 0.06]]
    est = [[0.25, 0.01, 0.03], [0, 0, 0]]
    rows = [(w[i][j], est[i][j], truth[i][j], est[i][j] != 0) for i in range(2) for j in range(3)]
    pairs = spark.createDataFrame([tuple(map(float, r[:3])) + (r[3],) for r in rows], "w double, b double, b_true double, selected boolean")
    got = windows.recovery(pairs, 0.05).first()
    assert got["n_linked"] == 3 and got["coverage"] == pytest.approx(2 / 3) and got["sign_agreement"] == 0.5
    assert got["mcc"] == pytest.approx(1 / 3) and got["n_selected"] == 3 and got["n_exposed"] == 3


def test_placebos_keep_usable_days_and_numbering(spark):
    ds = days(300)
    rows = [(d, t, float((i * 7 + k * 3) % 11)) for i, d in enumerate(ds) for k, t in enumerate(["a", "b", "placebo_1"]) if not (i == 5 and t == "a")]
    z = spark.createDataFrame(rows, "date date, topic string, z double")
    out = shocks.append_placebos(z, ["a", "b", "placebo_1"], 2, 7)
    names = {r["topic"] for r in out.select("topic").distinct().collect()}
    assert names == {"a", "b", "placebo_1", "placebo_2", "placebo_3"}
    new = out.where("topic in ('placebo_2', 'placebo_3')")
    assert new.select("date").distinct().count() == 299
    assert new.orderBy("date", "topic").collect() == shocks.append_placebos(z, ["a", "b", "placebo_1"], 2, 7).where("topic in ('placebo_2', 'placebo_3')").orderBy("date", "topic").collect()


def test_attenuation_limits():
    cfg = designed.DesignConfig(slow_sd_ratio=0.0)
    assert designed.attenuation(cfg, 1) == pytest.approx(1 / 2**0.5) and designed.attenuation(cfg, 5) == pytest.approx(1 / 1.2**0.5)


def test_out_of_sample_guard():
    with pytest.raises(ValueError):
        windows.check_out_of_sample("2020-01-31", "2020-01-31")

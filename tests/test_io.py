"""Readers, writers, settings, stages, the command line and the stream."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomline import cli
from loomline.functions import configs
from loomline.operators import align, kernel
from loomline.operators.factor_model import FitConfig
from loomline.operators.tuning import OosConfig
from loomline.plans import study
from loomline.sources import contracts, market, registry, runs, wide
from loomline.streaming.attention import streaming_document_attention


def test_settings_round_trip_and_hash(tmp_path):
    cfg = study.StudyConfig(fit=FitConfig(K=2, lambdas=(0.1, 0.2)), kernel=kernel.KernelConfig(lookback=6))
    configs.save(cfg, str(tmp_path / "c.json"))
    again = configs.load(study.StudyConfig, str(tmp_path / "c.json"))
    assert again == cfg and configs.settings_hash(again) == configs.settings_hash(cfg) and len(configs.settings_hash(cfg)) == 12
    assert configs.from_dict(FitConfig, {"K": 4, "unknown": 1}).K == 4
    with pytest.raises(ValueError):
        align.AlignConfig(policy="spread")


def test_wide_files_round_trip(spark, tmp_path):
    pdf = pd.DataFrame({"date": pd.to_datetime(["2024-01-01", "2024-01-02"]), "a.b": [1.5, float("nan")], "c": [float("inf"), 2.0]})
    pdf.to_parquet(tmp_path / "w.parquet")
    pdf.to_csv(tmp_path / "w.csv", index=False)
    for name in ("w.parquet", "w.csv"):
        rows = wide.to_long(wide.read_wide(spark, str(tmp_path / name)), "topic", "level").collect()
        assert {(r["date"], r["topic"], r["level"]) for r in rows} == {(dt.date(2024, 1, 1), "a.b", 1.5), (dt.date(2024, 1, 2), "c", 2.0)}


def test_run_directory_and_stages(spark, tmp_path):
    df = spark.range(5)
    runs.write_run(spark, str(tmp_path), "r1", {"numbers": df}, {"k": 1})
    assert runs.read_run(spark, str(tmp_path), "r1")["numbers"].count() == 5
    store, calls = runs.StageStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return df

    store.get("s", {"a": 1}, build)
    store.get("s", {"a": 1}, build)
    assert len(calls) == 1
    store.get("s", {"a": 2}, build)
    assert len(calls) == 2
    with pytest.raises(LookupError):
        store.need("s", {"a": 3})
    for rows, calls_after in ((spark.range(3), 3), (spark.range(4), 4), (spark.range(3).repartition(3), 4)):
        runs.StageStore(spark, str(tmp_path), {"rows": rows}).get("s", {"a": 1}, build)
        assert len(calls) == calls_after


def test_unfinished_run_is_refused(spark, tmp_path):
    runs.write_run(spark, str(tmp_path), "r", {"n": spark.range(2)}, {})
    with pytest.raises(Exception, match="broken"):
        runs.write_run(spark, str(tmp_path), "r", {"n": spark.range(3), "m": spark.range(1).selectExpr("raise_error('broken') AS x")}, {})
    with pytest.raises(LookupError):
        runs.read_run(spark, str(tmp_path), "r")


def test_registry_reports_every_problem(spark, tmp_path):
    (tmp_path / "assets.csv").write_text("order,asset_id,name,long_leg,short_leg,asset_class,sub_class\n1,a,A,x,y,Equity,US\n2,a,A2,x,y,FX,\n")
    (tmp_path / "topics.csv").write_text("order,topic_id,ontology,group,name,scope\n1,t,econ,g,T,all\n")
    (tmp_path / "link_map.csv").write_text("topic_id,asset_id,tier,sign,mechanism\nt,a,huge,1,m\nt,b,weak,2,m\n")
    tables = [registry.read_registry(spark, str(tmp_path), n) for n in ("assets", "topics", "link_map")]
    problems = registry.registry_problems(*tables)
    assert {r["problem"] for r in problems.collect()} == {"duplicate asset", "unknown tier", "sign is not +1 or -1", "link to unknown asset"}
    with pytest.raises(ValueError, match="duplicate asset"):
        registry.require_valid(problems)


def test_contract_checks(spark):
    rows = spark.createDataFrame([("2024-01-01", "t", "a", "full"), ("2024-01-01", "t", "a", "some"), ("2024-01-01", "u", "a", "none")], "as_of string, topic string, asset string, coverage string")
    problems = contracts.sensitivity_problems(rows, spark.createDataFrame([("t",)], "topic string"))
    assert problems.first().asDict() == {"n_rows": 3, "n_duplicates": 1, "n_bad_coverage": 1, "n_unknown_topic": 1}
    with pytest.raises(ValueError, match="unknown_topic=1"):
        contracts.require(problems)


def test_failed_assets_are_filled(spark):
    d = dt.date(2024, 1, 1)
    real = spark.createDataFrame([(d, "a", 0.1), (d, "b", float("inf"))], "date date, asset string, ret double")
    cal = spark.createDataFrame([(d,)], "date date")
    manifest = spark.createDataFrame([("c", "failed", "no quotes")], "asset string, status string, reason string")
    kept, report = market.load_returns(real, cal, manifest, ["a", "b", "c"])
    assert {r["asset"]: r["reason"] for r in report.where("failed").collect()} == {"b": "no returns in the store", "c": "no quotes"}
    fake = spark.createDataFrame([(d, x, 0.5) for x in "abc"], "date date, asset string, ret double")
    assert {(r["asset"], r["source"]) for r in market.fill_failed(kept, fake, report).collect()} == {("a", "real"), ("b", "artificial"), ("c", "artificial")}


def test_log_timings(spark):
    lines = spark.createDataFrame([("noise",), ("baseline seed 2 done in 41.5 s",)], "value string")
    got = runs.timings_from_log(lines, r"(\w+) seed (\d+) done in ([\d.]+) s").collect()
    assert [tuple(r) for r in got] == [("baseline", 2, 41.5)]


def test_command_line_run(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    dates = pd.bdate_range("2018-01-01", periods=1000)
    pd.DataFrame({"date": dates, **{f"t{k}": rng.random(1000) for k in range(3)}}).to_parquet(tmp_path / "att.parquet")
    pd.DataFrame({"date": dates, **{f"s{k}": rng.standard_normal(1000) for k in range(25)}}).to_parquet(tmp_path / "ret.parquet")
    cfg = study.StudyConfig(fit=FitConfig(K=1, n_lambdas=3), oos=OosConfig(min_train=15, refit_every=12), kernel=kernel.KernelConfig(burn_in=6), n_placebos=2)
    configs.save(cfg, str(tmp_path / "c.json"))
    args = ["run", "--attention", str(tmp_path / "att.parquet"), "--returns", str(tmp_path / "ret.parquet"), "--config", str(tmp_path / "c.json"), "--out", str(tmp_path / "out"), "--run-id", "x"]
    assert cli.main(args) == 0
    tables = runs.read_run(spark, str(tmp_path / "out"), "x")
    assert {"panel", "path", "gamma", "factors", "oos", "states", "placebo", "metrics"} <= set(tables)
    assert tables["gamma"].count() == 4
    (tmp_path / "bad.json").write_text('{"data": {"policy": "spread"}}')
    assert cli.main(args[:5] + ["--config", str(tmp_path / "bad.json"), "--out", str(tmp_path / "out")]) == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i // 4, i % 4 * 5), float(1 + i % 3), t, v) for i in range(40) for t, v in (("a", (i % 10) / 10), ("b", 1 - (i % 10) / 10))]
    theta = spark.createDataFrame(rows, "ts timestamp, weight double, topic string, theta double")
    theta.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(theta.schema).parquet(str(tmp_path / "in"))
    q = streaming_document_attention(stream, "1 day").writeStream.format("memory").queryName("attention_stream").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["date"], r["topic"]): r["level"] for r in spark.table("attention_stream").collect()}
    want = {(r["date"], r["topic"]): r["level"] for r in align.document_attention(theta).where(F.col("date") <= "2024-01-08").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_shared_folder_fallback_is_local_only():
    from types import SimpleNamespace

    from loomline.functions.session import shared_folder

    def session(master, value=None):
        conf = SimpleNamespace(get=lambda key, default: value)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert shared_folder(session("yarn", "s3a://x/cp")) == "s3a://x/cp"
    first = shared_folder(session("local[2]"))
    assert first and shared_folder(session("local[2]")) == first
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))

"""Run directories, stage tables and study tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import __version__
from loomline.functions.configs import settings_hash


MANIFEST = "run_id string, table string, n_rows long, config_hash string, spark string, package string, config string"


def write_run(spark: SparkSession, root: str, run_id: str, tables: dict[str, DataFrame], cfg) -> DataFrame:
    """Writes every table under ``root/run_id`` and a manifest with row counts and the settings hash.

    The manifest goes last, and an earlier one is emptied first: a run directory
    whose manifest has rows is complete.
    """
    rows: list[tuple] = []
    spark.createDataFrame(rows, MANIFEST).write.mode("overwrite").parquet(f"{root}/{run_id}/manifest")
    for name, df in tables.items():
        path = f"{root}/{run_id}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((run_id, name, spark.read.parquet(path).count(), settings_hash(cfg), spark.version, __version__, json.dumps(cfg, default=lambda o: o.__dict__, sort_keys=True)))
    manifest = spark.createDataFrame(rows, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{root}/{run_id}/manifest")
    return manifest


def read_run(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """Tables of a complete run."""
    names = [r["table"] for r in spark.read.parquet(f"{root}/{run_id}/manifest").collect()]
    if not names:
        raise LookupError(f"run {run_id} was not finished")
    return {n: spark.read.parquet(f"{root}/{run_id}/{n}") for n in names}


def fingerprint(df: DataFrame) -> str:
    """Row count and order-free hash sums of a table: equal for the same rows, whatever their order or files."""
    cols = sorted(df.columns)
    marks = [F.sum(F.xxhash64(F.lit(k), *[F.col(f"`{c}`") for c in cols]).cast("decimal(38,0)")) for k in (1, 2)]
    n, one, two = df.agg(F.count("*"), *marks).first()
    return f"{n}-{one}-{two}-{','.join(cols)}"


class StageStore:
    """Stage tables kept by name, settings, inputs and package version, so a stage is computed once for each.

    ``inputs`` names the tables that all stages of the store start from.

    A stage counts as present when its marker exists; the marker is written after
    the table, which makes a lost or killed write invisible.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: dict[str, DataFrame] | None = None, more=None):
        self.spark, self.root = spark, root.rstrip("/")
        self.inputs = {"package": __version__, "more": more, **{k: fingerprint(v) for k, v in sorted((inputs or {}).items())}}

    def _key(self, cfg) -> str:
        return f"{settings_hash(cfg)}-{settings_hash(self.inputs)}"

    def _path(self, stage: str, key: str) -> str:
        return f"{self.root}/stages/{stage}-{key}"

    def has(self, stage: str, cfg) -> bool:
        try:
            return self.spark.read.parquet(self._path(stage, self._key(cfg)) + ".done").count() > 0
        except AnalysisException:
            return False

    def get(self, stage: str, cfg, build) -> DataFrame:
        path = self._path(stage, self._key(cfg))
        if not self.has(stage, cfg):
            build().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(stage,)], "stage string").write.mode("overwrite").parquet(path + ".done")
        return self.spark.read.parquet(path)

    def need(self, stage: str, cfg) -> DataFrame:
        """A stage that must already exist; long fits are never started implicitly."""
        if not self.has(stage, cfg):
            raise LookupError(f"stage {stage} has not been computed for these settings")
        return self.spark.read.parquet(self._path(stage, self._key(cfg)))


def read_per_run(spark: SparkSession, path: str) -> DataFrame:
    """Per-run study table (one CSV row per scenario and seed) as long metrics; flag columns stay out."""
    wide = spark.read.option("header", True).option("inferSchema", True).csv(path)
    numeric = [f.name for f in wide.schema.fields if f.dataType.typeName() in ("double", "integer", "long") and f.name != "seed"]
    cells = wide.select("scenario", "seed", *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
    return cells.unpivot(["scenario", "seed"], [F.col(f"`{c}`") for c in numeric], "name", "value")


def refresh_metrics(rows: DataFrame, newer: DataFrame) -> DataFrame:
    """Metrics with later values taken where an artefact has them."""
    keys = ["scenario", "seed", "name"]
    other = newer.select(*keys, F.col("value").alias("new"))
    return rows.join(other, keys, "full").select(*keys, F.coalesce("new", "value").alias("value"))


def timings_from_log(lines: DataFrame, pattern: str) -> DataFrame:
    """Scenario, seed and seconds out of log lines; ``pattern`` has those three groups."""
    parts = [F.regexp_extract("value", pattern, i) for i in (1, 2, 3)]
    hit = lines.where(F.col("value").rlike(pattern))
    return hit.select(parts[0].alias("scenario"), parts[1].cast("int").alias("seed"), parts[2].cast("double").alias("seconds"))

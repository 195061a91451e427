"""Registry files (assets, legs, topics, links) with full validation."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.columns import truthy

# Registry columns and enumerations.
SCHEMAS = {
    "assets": "order int, asset_id string, name string, long_leg string, short_leg string, asset_class string, sub_class string",
    "topics": "order int, topic_id string, ontology string, group string, name string, scope string",
    "link_map": "topic_id string, asset_id string, tier string, sign int, mechanism string",
}
TIERS = ["strong", "moderate", "weak"]


def data_folder(default: str, variable: str = "LOOMLINE_DATA") -> str:
    """Folder of registries and stores; an environment variable overrides the default."""
    return os.environ.get(variable) or default


def read_registry(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One registry file with its fixed columns; values are read by header name."""
    raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}.csv")
    wanted = [part.strip().split(" ") for part in SCHEMAS[name].split(",")]
    missing = [c for c, _ in wanted if c not in raw.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return raw.select(*[F.trim(F.col(c)).cast(kind).alias(c) for c, kind in wanted])


def read_legs(spark: SparkSession, folder: str) -> DataFrame:
    """Price legs with the inversion flag as a boolean and list fields split."""
    raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/legs.csv")
    split = [F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda v: F.trim(v) != "").alias(c) for c in ("fallback_tickers", "components")]
    return raw.withColumns({"invert": truthy(F.col("invert"))}).select(*[c for c in raw.columns if c not in ("fallback_tickers", "components")], *split)


def _problem(df: DataFrame, condition, key: str, what: str) -> DataFrame:
    return df.where(condition).select(F.lit(what).alias("problem"), F.col(key).cast("string").alias("key"))


def registry_problems(assets: DataFrame, topics: DataFrame, links: DataFrame) -> DataFrame:
    """Every problem of the three registries at once, one row each."""

    def repeated(df: DataFrame, keys: list[str], what: str) -> DataFrame:
        return df.groupBy(*keys).count().where("count > 1").select(F.lit(what).alias("problem"), F.concat_ws("/", *keys).alias("key"))

    found = [
        repeated(assets, ["asset_id"], "duplicate asset"), repeated(topics, ["topic_id"], "duplicate topic"),
        repeated(links, ["topic_id", "asset_id"], "duplicate link"), _problem(assets, F.col("asset_id").isNull(), "name", "asset without id"),
        _problem(links, ~F.col("tier").isin(TIERS), "topic_id", "unknown tier"), _problem(links, ~F.col("sign").isin(1, -1), "topic_id", "sign is not +1 or -1"),
        links.join(assets, "asset_id", "left_anti").select(F.lit("link to unknown asset").alias("problem"), F.col("asset_id").alias("key")),
        links.join(topics, "topic_id", "left_anti").select(F.lit("link to unknown topic").alias("problem"), F.col("topic_id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, found)


def require_valid(problems: DataFrame, show: int = 50) -> None:
    """Raises one error that counts the problems and names the first ``show``."""
    rows = problems.limit(show).collect()
    if rows:
        total = problems.count()
        raise ValueError(f"{total} registry problems" + (f", the first {show}: " if total > show else ": ") + "; ".join(f"{r['problem']} ({r['key']})" for r in rows))

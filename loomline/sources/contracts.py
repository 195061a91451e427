"""Checks of delivered tables; every check reports a count, so all problems show at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Enumerations of the sensitivity delivery.
COVERAGE = ["full", "partial", "none"]
SOURCES = ["structural", "regression", "llm", "blended"]


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key, as one count."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_duplicates"))


def sensitivity_problems(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Row count, duplicate keys, unknown enumeration values and unknown topics."""
    known = topics.select("topic").distinct().withColumn("known", F.lit(True))
    checked = rows.join(known, "topic", "left")
    wrong = ~F.col("coverage").isin(COVERAGE)
    if "source" in rows.columns:
        wrong = wrong | ~F.col("source").isin(SOURCES)
    per_key = checked.groupBy("as_of", "topic", "asset").agg(
        F.count("*").alias("c"), F.count(F.when(wrong, 1)).alias("bad"), F.count(F.when(F.col("known").isNull(), 1)).alias("unknown")
    )
    return per_key.agg(
        F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("n_duplicates"), F.sum("bad").alias("n_bad_coverage"), F.sum("unknown").alias("n_unknown_topic")
    )


def require(problems: DataFrame) -> None:
    """Raises one error that lists every non-zero problem count."""
    row = problems.first().asDict()
    bad = {k: v for k, v in row.items() if k.startswith("n_") and k != "n_rows" and v}
    if bad:
        raise ValueError("table fails its contract: " + ", ".join(f"{k[2:]}={v}" for k, v in bad.items()))

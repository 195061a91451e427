"""Wide daily files (a date column and one column per topic or asset) to long tables and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.columns import finite

# Names a date column may have.
DATE_NAMES = ["date", "day", "time", "timestamp", "index", "datetime", "period"]


def read_wide(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A parquet or CSV file as it lies; the first column, or one with a date name, becomes ``date``."""
    fmt = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", True)
    else:
        # Frames saved with nanosecond stamps arrive as whole numbers.
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = reader.load(path)
    named = [c for c in df.columns if c.strip().lower() in DATE_NAMES or c.startswith("__index")]
    key = named[0] if named else df.columns[0]
    stamp = F.col(f"`{key}`")
    stamp = F.timestamp_micros((stamp / 1000).cast("long")) if dict(df.dtypes)[key] == "bigint" else stamp.cast("timestamp")
    rest = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.select(F.to_date(stamp).alias("date"), *rest)


def to_long(wide: DataFrame, name: str, value: str) -> DataFrame:
    """One row per observed cell; NaN and infinite cells are missing and get no row."""
    columns = [c for c in wide.columns if c != "date"]
    doubles = wide.select("date", *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot("date", [F.col(f"`{c}`") for c in columns], name, value).withColumn(value, finite(F.col(value))).where(F.col(value).isNotNull())


def to_wide(df: DataFrame, name: str, value: str, columns: list[str]) -> DataFrame:
    """Back to one column per entity, with an explicit column list."""
    return df.groupBy("date").pivot(name, columns).agg(F.first(value))


def load_inputs(spark: SparkSession, attention: str, returns: str, risk_free: str | None = None, assets: str | None = None) -> dict[str, DataFrame]:
    """Attention, returns and optional risk-free and asset tables as long DataFrames."""
    out = {
        "attention": to_long(read_wide(spark, attention), "topic", "level"),
        "returns": to_long(read_wide(spark, returns), "asset", "ret"),
    }
    if risk_free:
        rf = read_wide(spark, risk_free)
        rate = next(c for c in rf.columns if c != "date")
        out["risk_free"] = rf.select("date", F.col(f"`{rate}`").cast("double").alias("rf"))
    if assets:
        meta = spark.read.option("header", True).csv(assets) if assets.endswith(".csv") else spark.read.parquet(assets)
        out["assets"] = meta.withColumnRenamed(meta.columns[0], "asset")
    return out

"""Return stores and saved vendor files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.columns import finite


def load_returns(returns: DataFrame, calendar: DataFrame, manifest: DataFrame, assets: list[str]) -> tuple[DataFrame, DataFrame]:
    """Listed returns on the calendar and the coverage table with failed assets and their reasons.

    ``manifest`` has ``asset``, ``status`` and ``reason``. Infinite returns are
    missing; an asset without any return fails even when the manifest is silent.
    """
    listed = returns.where(F.col("asset").isin(assets)).withColumn("ret", finite(F.col("ret")))
    kept = listed.where("ret IS NOT NULL").join(calendar.select("date"), "date", "left_semi")
    n_days = calendar.count()
    names = returns.sparkSession.createDataFrame([(a, i) for i, a in enumerate(assets)], "asset string, position int")
    seen = kept.groupBy("asset").agg(F.count("*").alias("n"))
    joined = names.join(seen, "asset", "left").join(manifest.select("asset", "status", "reason"), "asset", "left")
    n = F.coalesce("n", F.lit(0))
    failed = (n == 0) | (F.coalesce("status", F.lit("ok")) == "failed")
    reason = F.when(failed, F.coalesce("reason", F.when(n == 0, "no returns in the store")))
    return kept, joined.select("asset", "position", n.alias("n_days"), (n / n_days).alias("coverage"), failed.alias("failed"), reason.alias("reason"))


def fill_failed(real: DataFrame, artificial: DataFrame, report: DataFrame) -> DataFrame:
    """Real returns where an asset has them, artificial ones for the failed assets, with the source named."""
    bad = report.where("failed").select("asset")
    good = real.join(bad, "asset", "left_anti").select("date", "asset", "ret", F.lit("real").alias("source"))
    return good.unionByName(artificial.join(bad, "asset", "left_semi").select("date", "asset", "ret", F.lit("artificial").alias("source")))


def read_saved_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Raw quote files of a past download, one CSV per ticker, as (series, date, close, adj_close)."""
    raw = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/*.csv").withColumn("file", F.col("_metadata.file_name"))
    columns = {c.lower().replace(" ", "_"): c for c in raw.columns}
    adj = F.col(f"`{columns['adj_close']}`") if "adj_close" in columns else F.lit(None)
    return raw.select(
        F.regexp_replace("file", r"\.csv$", "").alias("series"), F.to_date(F.col(f"`{columns['date']}`")).alias("date"),
        F.col(f"`{columns['close']}`").cast("double").alias("close"), adj.cast("double").alias("adj_close"),
    ).where("date IS NOT NULL AND close IS NOT NULL")

"""Ranks over a whole column without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.session import materialise


def average_rank(counts: DataFrame, value: str, out: str, buckets: int = 64) -> DataFrame:
    """Average rank of each value (ties share their mean rank); ``counts`` has one row per value with ``ties``.

    Values are split into ranges at approximate quantiles and a range's ranks
    start after the counts of the ranges before it, so the ranks are exact and only
    range totals meet in one task.
    """
    cuts = sorted(set(counts.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.01))) if buckets > 1 else []
    below = sum(((F.col(value) > F.lit(float(c))).cast("int") for c in cuts), F.lit(0))
    split = counts.withColumn("bucket", below)
    totals = split.groupBy("bucket").agg(F.sum("ties").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return split.join(F.broadcast(starts), "bucket").select(
        value, (F.col("start") + F.coalesce(F.sum("ties").over(inside), F.lit(0)) + (F.col("ties") + 1) / 2).alias(out)
    )


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows where both values exist; NULL when one side is constant.

    Equal pairs are counted first, so heavily tied columns shrink before anything
    is ranked. Ranks have the known mean (N + 1) / 2, which centres them exactly.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = materialise(both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")), "rank_cells")
    total, size = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # A few values need no ranges; beyond that they are split.
    buckets = 1 if size <= 100_000 else 64
    ranked = cells
    for side in ("a", "b"):
        counts = cells.groupBy(side).agg(F.sum("n").alias("ties"))
        ranked = ranked.join(average_rank(counts, side, f"rank_{side}", buckets), side)
    middle = F.lit((total + 1) / 2)
    ra, rb, n = F.col("rank_a") - middle, F.col("rank_b") - middle, F.col("n")
    var = F.sqrt(F.sum(n * ra * ra) * F.sum(n * rb * rb))
    return ranked.agg(F.when(var > 0, F.sum(n * ra * rb) / var).alias("spearman"))

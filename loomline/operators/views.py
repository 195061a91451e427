"""Tables behind charts and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import ratio
from loomline.operators.calendar import period_start


def listed_subset(assets: DataFrame, classes: list[str] | None = None, drop: list[str] | None = None, listed: list[str] | None = None) -> DataFrame:
    """Universe filter by listed ids, class and dropped ids."""
    out = assets
    if listed is not None:
        out = out.where(F.col("asset").isin(listed))
    if classes:
        out = out.where(F.col("asset_class").isin(classes))
    if drop:
        out = out.where(~F.col("asset").isin(drop))
    return out


def blank(values: DataFrame, value: str, keep, threshold: float | None = None) -> DataFrame:
    """Cells that fail the rule or stay under the threshold become NULL; the cell itself is kept."""
    rule = keep if threshold is None else keep & (F.abs(value) >= threshold)
    return values.withColumn(value, F.when(rule, F.col(value)))


def apply_views(values: DataFrame, views: DataFrame, value: str) -> DataFrame:
    """Flips the sign of the rows held short; assets without a view are long."""
    return values.join(views, "asset", "left").withColumn(value, F.col(value) * F.coalesce("sign", F.lit(1))).drop("sign")


def sensitivity_matrix(rows: DataFrame, as_of: str, topics: list[str]) -> DataFrame:
    """Asset x topic table of one estimation date, with an explicit column list; uncovered cells are NULL."""
    cells = rows.where(F.col("as_of") == F.lit(as_of).cast("date")).withColumn(
        "sensitivity", F.when(F.col("coverage") != "none", F.col("sensitivity"))
    )
    return cells.groupBy("asset").pivot("topic", topics).agg(F.first("sensitivity"))


def stack(wide: DataFrame, key: str, columns: list[str], name: str = "topic", value: str = "value") -> DataFrame:
    """Wide columns to rows, missing cells dropped."""
    return wide.unpivot(key, columns, name, value).where(F.col(value).isNotNull())


def ordered(df: DataFrame, value: str, tie: str, descending: bool = True) -> DataFrame:
    """Position of each row by value with an explicit tie column, as ``rank``.

    For display tables of model size; use a range-partitioned sort for files.
    """
    v = F.col(value)
    order = v.desc_nulls_last() if descending else v.asc_nulls_last()
    return df.withColumn("rank", F.row_number().over(Window.orderBy(order, tie)))


def weekly_means(levels: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per week ending Friday."""
    week = F.date_add(period_start(F.col("date"), "W-FRI"), 6)
    return levels.groupBy(key, week.alias("week_end")).agg(F.avg(value).alias(value))


def cumulative(daily: DataFrame, key: str, value: str) -> DataFrame:
    """Running sum over time per key."""
    so_far = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumn("cumulative", F.sum(value).over(so_far))


def sample_pairs(pairs: DataFrame, linked, n: int, seed: int = 0) -> DataFrame:
    """All linked pairs plus ``n`` others picked by a seeded hash of the pair."""
    tag = pairs.withColumn("_h", F.xxhash64(F.lit(seed), "topic", "asset"))
    others = tag.where(~linked).orderBy("_h", "topic", "asset").limit(n)
    return tag.where(linked).unionByName(others).drop("_h")


def label_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Labels of either side with where they occur."""
    a, b = left.select(key).distinct().withColumn("in_left", F.lit(True)), right.select(key).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, key, "full").select(key, F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"))


def feasibility_summary(scaling: DataFrame) -> DataFrame:
    """How many designed topics had to be scaled down and how far."""
    scaled = F.col("scale") < 1
    return scaling.agg(
        F.count("*").alias("n_topics"), F.count(F.when(scaled, 1)).alias("n_scaled"), F.min("scale").alias("smallest_scale"), F.max("q").alias("largest_variance")
    )


def tie_band_chart(path: DataFrame, tolerance: float) -> DataFrame:
    """Path points with the floor of the tie band and whether they lie inside it."""
    from loomline.operators.tuning import band_width

    best = F.max("criterion").over(Window.partitionBy())
    rows = path.withColumn("best", best).withColumn("floor", F.col("best") - band_width(F.col("best"), tolerance))
    return rows.withColumn("in_band", F.col("criterion") >= F.col("floor"))


def share_of_total(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Each value over the total of its group."""
    return df.withColumn("share", ratio(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))

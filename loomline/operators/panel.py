"""Estimation panel: instruments of one period against returns of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import dot, safe_divisor
from loomline.functions.session import materialise


def build_panel(cov: DataFrame, period_rets: DataFrame, burn_in: int = 12, min_assets: int = 20) -> DataFrame:
    """Panel rows ``(t_idx, period, asset, y, x)`` with the constant first in ``x``.

    Instruments of period j meet returns of period j + 1 by position, also across
    a calendar gap. Rows need a return and every instrument; periods with fewer
    than ``min_assets`` rows are dropped and the rest renumbered from zero.

    The joined rows are written once. Counting a period's rows reads none of the
    instruments, and the numbers, one row a period, are broadcast, so the arrays
    are made once and shuffled for the join only.
    """
    lagged = cov.where(F.col("period_id") >= burn_in).select(
        (F.col("period_id") + 1).alias("period_id"), "asset", F.concat(F.array(F.lit(1.0)), "cov").alias("x")
    )
    rows = lagged.join(period_rets.select("period_id", "asset", "period_end", F.col("ret").alias("y")), ["period_id", "asset"])
    rows = materialise(rows.where("y IS NOT NULL"), "panel")
    sizes = rows.groupBy("period_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_assets)
    numbered = sizes.select("period_id", (F.row_number().over(Window.orderBy("period_id")) - 1).alias("t_idx"))
    return rows.join(F.broadcast(numbered), "period_id").select("t_idx", F.col("period_end").alias("period"), "asset", "y", "x")


def keep_periods(panel: DataFrame, condition) -> DataFrame:
    """Panel rows of the periods that satisfy ``condition``, renumbered from zero."""
    kept = panel.where(condition)
    numbered = kept.select("t_idx").distinct().select(
        "t_idx", (F.row_number().over(Window.orderBy("t_idx")) - 1).alias("new_idx")
    )
    return kept.join(numbered, "t_idx").select(F.col("new_idx").alias("t_idx"), "period", "asset", "y", "x")


def split_periods(panel: DataFrame, first_test) -> DataFrame:
    """Adds ``is_train``: whether the period ends before ``first_test``."""
    return panel.withColumn("is_train", F.col("period") < F.lit(first_test).cast("date"))


def replace_instruments(panel: DataFrame, other: DataFrame) -> DataFrame:
    """Same rows with the instrument arrays of ``other`` (period, asset, x)."""
    return panel.drop("x").join(other.select("period", "asset", "x"), ["period", "asset"]).select(
        "t_idx", "period", "asset", "y", "x"
    )


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, mean and sample deviation of the return per period."""
    return panel.groupBy("t_idx", "period").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")
    )


def instrument_scale(panel: DataFrame) -> DataFrame:
    """Population deviation of each instrument; 1 for the constant and for flat columns.

    ``stddev_pop`` merges count, mean and centred squares, never a difference of
    large sums, so instruments of size 1e-6 keep their digits.
    """
    long = panel.select(F.posexplode("x").alias("l", "v"))
    return long.groupBy("l").agg(F.stddev_pop("v").alias("sd")).select(
        "l", F.when(F.col("l") == 0, F.lit(1.0)).otherwise(safe_divisor(F.col("sd"))).alias("sigma")
    )


def moments_long(moments: DataFrame) -> DataFrame:
    """Period moments as rows ``(t_idx, l, m, s)``, with ``m = -1`` for x'y."""
    width = F.size("v")
    square = moments.select("t_idx", width.alias("p"), F.posexplode("s").alias("k", "s")).select(
        "t_idx", F.floor(F.col("k") / F.col("p")).cast("int").alias("l"), (F.col("k") % F.col("p")).alias("m"), "s"
    )
    return square.unionByName(moments.select("t_idx", F.posexplode("v").alias("l", "s")).withColumn("m", F.lit(-1)))


def fitted_values(panel: DataFrame, gamma: list[list[float]], factors: DataFrame) -> DataFrame:
    """Loadings times factors; ``factors`` holds one array ``f`` per ``t_idx``."""
    columns = [F.array(*[F.lit(float(v)) for v in col]) for col in zip(*gamma)]
    loadings = F.array(*[dot(F.col("x"), c) for c in columns])
    return panel.join(factors, "t_idx").select(
        "t_idx", "period", "asset", "y", dot(loadings, F.col("f")).alias("fitted")
    )


def uncentred_r2(fitted: DataFrame, *keys: str) -> DataFrame:
    """``1 - sum (y - fitted)^2 / sum y^2`` over all rows or per key."""
    err = F.sum(F.pow(F.col("y") - F.col("fitted"), 2))
    return fitted.groupBy(*keys).agg((1 - F.try_divide(err, F.sum(F.col("y") * F.col("y")))).alias("r2"))

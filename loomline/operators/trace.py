"""Step-by-step checks of a finished run and drill-downs into its tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.dense import f_quantile
from loomline.operators.kernel import KernelConfig, kernel_weight

# Probabilities of the no-signal Sharpe table.
NULL_PROBS = (0.5, 0.9, 0.95, 0.99)


def null_sharpe(K: int, periods: int, probs=NULL_PROBS, annualization: float = 12.0) -> dict[float, float]:
    """Quantiles of the in-sample Sharpe ratio of K factors without any signal.

    With T periods, ``(T - K) / (K (T - 1)) * T s^2`` is F(K, T - K) for the
    squared per-period Sharpe ratio s^2.
    """
    if periods <= K:
        return {p: math.nan for p in probs}
    scale = K * (periods - 1) / ((periods - K) * periods)
    return {p: math.sqrt(f_quantile(p, K, periods - K) * scale * annualization) for p in probs}


def kernel_profile(returns: DataFrame, shocks: DataFrame, calendar: DataFrame, asset: str, topic: str, period_id: int, cfg: KernelConfig) -> DataFrame:
    """Days behind one covariance cell with their normalised weight and contribution."""
    days = calendar.where((F.col("period_id") < period_id) | ((F.col("period_id") == period_id) & (F.col("back") > cfg.skip_days)))
    rows = days.join(returns.where(F.col("asset") == asset), "date").join(shocks.where((F.col("topic") == topic) & F.col("z").isNotNull()), "date")
    rows = rows.withColumn("w", kernel_weight(F.lit(period_id) - F.col("period_id"), cfg)).where("w > 0")
    every = Window.partitionBy()
    k = F.col("w") / F.sum("w").over(every)
    rows = rows.withColumn("k", k)
    mean_r, mean_z = F.sum(F.col("k") * F.col("ret")).over(every), F.sum(F.col("k") * F.col("z")).over(every)
    return rows.withColumn("part", F.col("k") * (F.col("ret") - mean_r) * (F.col("z") - mean_z)).select("date", "period_id", "ret", "z", "k", "part")


def instrument_series(cov: DataFrame, calendar: DataFrame, asset: str, topic: str) -> DataFrame:
    """One covariance cell through time."""
    ends = calendar.groupBy("period_id").agg(F.max("date").alias("period_end"))
    return cov.where((F.col("asset") == asset) & (F.col("topic") == topic)).join(ends, "period_id").select("period_id", "period_end", "cov", "n_days")


def pairing_table(cov: DataFrame, period_rets: DataFrame, calendar: DataFrame, asset: str) -> DataFrame:
    """Instrument period, the return period it meets and whether both sides exist."""
    ends = calendar.groupBy("period_id").agg(F.max("date").alias("period_end"), F.count("*").alias("n_days"))
    have = cov.where(F.col("asset") == asset).groupBy("period_id").agg(F.count("*").alias("n_instruments"))
    after = period_rets.where(F.col("asset") == asset).select((F.col("period_id") - 1).alias("period_id"), F.col("ret").alias("next_return"))
    return ends.join(have, "period_id", "left").join(after, "period_id", "left").select(
        "period_id", "period_end", "n_days", F.coalesce("n_instruments", F.lit(0)).alias("n_instruments"), "next_return",
        (F.col("n_instruments").isNotNull() & F.col("next_return").isNotNull()).alias("used"),
    )


def asset_days(returns: DataFrame, calendar: DataFrame, asset: str) -> DataFrame:
    """Every calendar day of one asset with its return, missing days included."""
    return calendar.select("date", "pos", "period_id").join(returns.where(F.col("asset") == asset).select("date", "ret"), "date", "left")


def topic_days(attention: DataFrame, shocks: DataFrame, calendar: DataFrame, topic: str) -> DataFrame:
    """Every calendar day of one topic with level and shock."""
    level = attention.where(F.col("topic") == topic).select("date", "level")
    return calendar.select("date", "pos").join(level, "date", "left").join(shocks.where(F.col("topic") == topic).select("date", "z"), "date", "left")

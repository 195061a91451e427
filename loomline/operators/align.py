"""Putting attention, returns and the risk-free rate on one trading calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import finite, ratio
from loomline.operators.calendar import next_trading_day, trading_calendar


@dataclass(frozen=True)
class AlignConfig:
    """Settings of the alignment step."""

    period: str = "M"
    policy: str = "drop"  # drop, fold_mean, fold_sum
    attention_lag: int = 0
    returns_are_excess: bool = True
    vol_window: int | None = None

    def __post_init__(self):
        if self.policy not in ("drop", "fold_mean", "fold_sum"):
            raise ValueError(f"unknown non-trading-day policy {self.policy!r}")
        if self.attention_lag < 0:
            raise ValueError("attention_lag must be >= 0")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keep the row with the largest ``order`` per key (last one wins).

    ``max_by`` combines map-side, so a key repeated a billion times is one row
    per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
    return packed.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def carry_forward(series: DataFrame, calendar: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """Last known ``value`` of one daily series on every calendar day.

    With ``limit`` the carry stops after that many consecutive calendar rows.
    Days before the first value stay NULL.
    """
    if limit is None:
        both = series.select("date", value).unionByName(calendar.select("date"), allowMissingColumns=True)
        filled = both.groupBy("date").agg(F.max(value).alias(value))
        past = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = filled.withColumn(value, F.last(value, ignorenulls=True).over(past))
        return calendar.select("date").join(filled, "date", "left")
    past = Window.orderBy("date").rowsBetween(-limit, Window.currentRow)
    on_days = calendar.select("date").join(series.select("date", value), "date", "left")
    return on_days.withColumn(value, F.last(value, ignorenulls=True).over(past))


def carry_backward(series: DataFrame, calendar: DataFrame, value: str, limit: int) -> DataFrame:
    """Next known ``value`` of one daily series on every calendar day, at most ``limit`` calendar rows ahead."""
    ahead = Window.orderBy("date").rowsBetween(Window.currentRow, limit)
    on_days = calendar.select("date").join(series.select("date", value), "date", "left")
    return on_days.withColumn(value, F.first(value, ignorenulls=True).over(ahead))


def match_periods(series: DataFrame, calendar: DataFrame, period: str, *values: str) -> DataFrame:
    """A series stamped on any day of its periods, put on the calendar's periods: (period_id, period_end, values).

    Period labels are compared, not days, so a value stamped on the first or the
    last day of a month, trading day or not, meets the same period. Of several
    stamps in one period the last is taken; periods that the calendar does not
    have are dropped.
    """
    from loomline.operators.calendar import period_start

    label = period_start(F.col("date"), period).alias("label")
    stamped = latest_per_key(series.select(label, "date", *values), ["label"], "date").drop("date")
    periods = calendar.select(label, "period_id", "period_end").distinct()
    return periods.join(stamped, "label").select("period_id", "period_end", *values)


def fill_gaps(levels: DataFrame, calendar: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """Limited forward fill per key, with a flag for filled days.

    Only the gaps that may be filled are generated: each print is repeated up to
    ``limit`` positions, or to the day before the next print.
    """
    ends = calendar.select("date", "pos", F.max("pos").over(Window.partitionBy()).alias("last_pos"))
    on_days = levels.join(ends, "date").where(F.col(value).isNotNull())
    spans = on_days.withColumn("next_pos", F.lead("pos").over(Window.partitionBy(key).orderBy("pos")))
    until = F.least(F.col("pos") + limit, F.coalesce(F.col("next_pos") - 1, F.col("last_pos")))
    spread = spans.select(
        key, value, F.col("pos").alias("from_pos"), F.explode(F.sequence("pos", until)).alias("pos")
    )
    return spread.join(calendar.select("pos", "date"), "pos").select(
        "date", key, value, (F.col("pos") > F.col("from_pos")).alias("stale")
    )


def excess_returns(returns: DataFrame, risk_free: DataFrame, calendar: DataFrame) -> DataFrame:
    """Total minus risk-free return, the rate carried forward; NULL before the first rate."""
    numbered = risk_free.select("date", finite(F.col("rf")).alias("rf"), F.col("seq") if "seq" in risk_free.columns else F.lit(0).alias("seq"))
    rate = latest_per_key(numbered, ["date"], "seq").select("date", "rf")
    daily = carry_forward(rate, calendar, "rf")
    return returns.join(daily, "date", "left").select("date", "asset", (F.col("ret") - F.col("rf")).alias("ret"))


def apply_calendar_policy(attention: DataFrame, calendar: DataFrame, policy: str) -> DataFrame:
    """Attention on trading days only.

    ``drop`` keeps trading-day rows. ``fold_mean`` and ``fold_sum`` combine every
    row with the first trading day on or after it, that day's own row included.
    """
    if policy == "drop":
        return attention.join(calendar.select("date"), "date", "left_semi").select("date", "topic", "level")
    target = next_trading_day(attention.select("date").distinct(), calendar)
    how = F.avg if policy == "fold_mean" else F.sum
    return (
        attention.join(target, "date")
        .groupBy(F.col("trading_date").alias("date"), "topic")
        .agg(how("level").alias("level"))
    )


def lag_attention(attention: DataFrame, calendar: DataFrame, rows: int) -> DataFrame:
    """Attention known ``rows`` trading days earlier, joined by position so gaps stay gaps."""
    if rows == 0:
        return attention
    pos = calendar.select("date", "pos")
    moved = attention.join(pos, "date").select((F.col("pos") + rows).alias("pos"), "topic", "level")
    return moved.join(pos, "pos").select("date", "topic", "level")


def trailing_volatility(
    returns: DataFrame, calendar: DataFrame, window: int, min_periods: int | None = None
) -> DataFrame:
    """Sample deviation of the previous ``window`` trading days, NULL when zero or too short.

    The frame counts calendar positions, so missing days need no rows of their own.
    """
    need = max(window // 4, 2) if min_periods is None else min_periods
    past = Window.partitionBy("asset").orderBy("pos").rangeBetween(-window, -1)
    on_days = returns.join(calendar.select("date", "pos"), "date")
    enough = F.count("ret").over(past) >= need
    sd = F.stddev_samp("ret").over(past)
    return on_days.select("date", "asset", "ret", F.when(enough & (sd > 0), sd).alias("scale"))


def inverse_volatility(scaled: DataFrame) -> DataFrame:
    """Returns over their ex-ante scale; a missing scale gives a missing return."""
    return scaled.select("date", "asset", ratio(F.col("ret"), F.col("scale")).alias("ret"), "scale")


def common_range(attention: DataFrame, returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar cut to the days between the first and last day that has both inputs."""
    a = attention.where("level IS NOT NULL").select("date").distinct()
    r = returns.where("ret IS NOT NULL").select("date").distinct()
    seen = calendar.join(a.join(r, "date").select("date", F.col("date").alias("both")), "date", "left")
    every = Window.partitionBy()
    return (
        seen.withColumn("lo", F.min("both").over(every)).withColumn("hi", F.max("both").over(every))
        .where(F.col("date").between(F.col("lo"), F.col("hi"))).drop("both", "lo", "hi")
    )


def align(attention: DataFrame, returns: DataFrame, cfg: AlignConfig, risk_free: DataFrame | None = None):
    """Excess, calendar policy, lag, scaling and trim, in that order.

    Returns ``(attention, returns, calendar)``; the calendar is rebuilt on the
    trimmed days so that positions and period ids start at zero.
    """
    returns = returns.select("date", "asset", finite(F.col("ret")).alias("ret")).where("ret IS NOT NULL")
    attention = attention.select("date", "topic", finite(F.col("level")).alias("level"))
    calendar = trading_calendar(returns, cfg.period)
    if not cfg.returns_are_excess:
        if risk_free is None:
            raise ValueError("total returns need a risk-free series")
        returns = excess_returns(returns, risk_free, calendar).where("ret IS NOT NULL")
    attention = apply_calendar_policy(attention, calendar, cfg.policy)
    attention = lag_attention(attention, calendar, cfg.attention_lag)
    if cfg.vol_window:
        returns = inverse_volatility(trailing_volatility(returns, calendar, cfg.vol_window)).where("ret IS NOT NULL")
    kept = common_range(attention, returns, calendar).select("date")
    return (
        attention.join(kept, "date", "left_semi"),
        returns.join(kept, "date", "left_semi"),
        trading_calendar(kept, cfg.period),
    )


def document_attention(theta: DataFrame, weighted: bool = True) -> DataFrame:
    """Weighted daily mean of document topic shares.

    A missing share leaves both sums of its cell; a cell with zero weight is
    missing. Stamps fold to their day. Sums combine map-side, so one day or topic
    holding most documents stays one row per task.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    share = finite(F.col("theta"))
    used = F.when(share.isNotNull(), w)
    return (
        theta.groupBy(F.to_date("ts").alias("date"), "topic")
        .agg(F.sum(share * w).alias("num"), F.sum(used).alias("den"))
        .select("date", "topic", ratio(F.col("num"), F.col("den")).alias("level"))
    )


def period_returns(returns: DataFrame, calendar: DataFrame, how: str = "sum") -> DataFrame:
    """Return of each asset and period over its observed days, summed or compounded."""
    if how not in ("sum", "compound"):
        raise ValueError(f"unknown accumulation {how!r}")
    value = F.sum("ret") if how == "sum" else F.product(1 + F.col("ret")) - 1
    return (
        returns.where("ret IS NOT NULL")
        .join(calendar.select("date", "period_id", "period_end"), "date")
        .groupBy("asset", "period_id", "period_end")
        .agg(value.alias("ret"), F.count("ret").alias("n_days"))
    )

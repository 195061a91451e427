"""Trading calendar, periods and window bounds.

The calendar is one row per trading day, so its size is bounded by the number
of days in history whatever the size of the facts. Windows over the whole
calendar therefore run in one small task on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Offset-style aliases and the period letter each one stands for.
PERIOD_ALIASES = {"ME": "M", "MS": "M", "QE": "Q", "QS": "Q", "YE": "Y", "YS": "Y", "A": "Y", "AE": "Y", "B": "D"}
WEEK_ANCHORS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def period_start(day: Column, period: str = "M") -> Column:
    """First calendar day of the period holding ``day``.

    ``D``, ``W``, ``M``, ``Q``, ``Y`` and their offset spellings are accepted, and
    weeks may name the closing weekday (``W-FRI``). A multiple such as ``2M``
    labels every base period on its own, so it groups like the base.
    """
    match = re.fullmatch(r"\d*([A-Za-z]+)(?:-([A-Za-z]{3}))?", period or "")
    if not match:
        raise ValueError(f"{period!r} is not a period alias")
    unit, anchor = match.group(1).upper(), (match.group(2) or "").upper()
    unit = PERIOD_ALIASES.get(unit, unit)
    if unit == "D":
        return day.cast("date")
    if unit == "W":
        close = WEEK_ANCHORS.index(anchor) if anchor else 6
        shift = 6 - close
        return F.date_sub(F.date_trunc("week", F.date_add(day.cast("date"), shift)).cast("date"), shift)
    trunc = {"M": "month", "Q": "quarter", "Y": "year"}.get(unit)
    if trunc is None or anchor:
        raise ValueError(f"{period!r} is not a supported period alias")
    return F.date_trunc(trunc, day).cast("date")


def trading_calendar(days: DataFrame, period: str = "M") -> DataFrame:
    """Positions, periods and distance to the period end of every trading day.

    ``period_id`` counts the periods that occur, so a period without a trading
    day gets no id. ``back`` is 1 on the last day of a period.
    """
    label = days.select(F.col("date").cast("date").alias("date")).where("date IS NOT NULL").distinct()
    label = label.withColumn("period_start", period_start(F.col("date"), period))
    by_day = Window.orderBy("date")
    by_period = Window.partitionBy("period_start")
    return label.select(
        "date",
        "period_start",
        (F.row_number().over(by_day) - 1).alias("pos"),
        (F.dense_rank().over(Window.orderBy("period_start")) - 1).alias("period_id"),
        F.max("date").over(by_period).alias("period_end"),
        F.row_number().over(by_period.orderBy(F.desc("date"))).alias("back"),
    )


def window_bounds(calendar: DataFrame, skip_days: int = 1) -> DataFrame:
    """First and last position of each period and the end of its usable window.

    The last ``skip_days`` trading days of a period are outside its window. A
    period too short for one usable day keeps the previous period's last day as
    ``window_end``; the first period then has none.
    """
    usable = F.when(F.col("back") > skip_days, F.col("date"))
    bounds = calendar.groupBy("period_id", "period_start", "period_end").agg(
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.count(usable).alias("n_window"),
        F.max(usable).alias("last_usable"),
    )
    previous = F.lag("period_end").over(Window.orderBy("period_id"))
    return bounds.select(
        "period_id", "period_start", "period_end", "first_pos", "last_pos", "n_window",
        F.coalesce("last_usable", previous).alias("window_end"),
    )


def weekday_calendar(spark, start: str, end: str) -> DataFrame:
    """Every Monday to Friday in ``[start, end]``."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return days.where(F.dayofweek("date").between(2, 6))


def next_trading_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``date -> trading_date``, the first trading day on or after each date.

    A next-or-equal lookup written as one frame over the union of both day
    lists instead of a range join; dates after the last trading day are absent.
    """
    both = days.select("date", F.lit(None).cast("date").alias("td")).unionByName(
        calendar.select("date", F.col("date").alias("td"))
    )
    merged = both.groupBy("date").agg(F.max("td").alias("td"))
    ahead = Window.orderBy("date").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        merged.select("date", F.first("td", ignorenulls=True).over(ahead).alias("trading_date"))
        .where("trading_date IS NOT NULL")
    )


def shift_business_days(day: Column, n: int) -> Column:
    """``day`` moved by ``n`` weekdays; a weekend start counts from the following Monday."""
    start = F.when(F.dayofweek(day) == 7, F.date_add(day, 2)).when(F.dayofweek(day) == 1, F.date_add(day, 1)).otherwise(day)
    slot = F.dayofweek(start) - 2 + F.lit(n)
    weeks = F.floor(slot / F.lit(5))
    return F.date_add(start, (weeks * 7 + (slot - weeks * 5) - (F.dayofweek(start) - 2)).cast("int"))


def training_start(train_end: Column, months: int) -> Column:
    """First day of a window of whole months that closes on ``train_end``."""
    return F.date_add(F.add_months(train_end, -months), 1)

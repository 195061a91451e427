"""Evaluation of frozen coefficients on forecast windows, and recovery scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import clip, dot, ratio

# Fixed value: fewest days for a correlation.
MIN_CORR_DAYS = 3


def forecast_days(df: DataFrame, start: str, weeks: int) -> DataFrame:
    """Rows dated in the ``weeks`` calendar weeks from ``start``."""
    first = F.lit(start).cast("date")
    return df.where((F.col("date") >= first) & (F.col("date") < F.date_add(first, 7 * weeks)))


def check_out_of_sample(train_end: str, forecast_start: str) -> None:
    """A forecast window must open after the training window closes."""
    if forecast_start <= train_end:
        raise ValueError(f"forecast start {forecast_start} is not after the training end {train_end}")


def fitted_days(by_return_day: DataFrame, usable: DataFrame, coefs: DataFrame, scale: DataFrame, topics: list[str]) -> DataFrame:
    """Daily fitted value ``scale * sum_topic b s`` next to the return.

    Shocks are packed per day and coefficients per asset, so each return row meets
    two arrays instead of one row per topic.
    """
    order = F.array(*[F.lit(t) for t in topics])

    def packed(df: DataFrame, key: str, value: str) -> DataFrame:
        slots = F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("topic")).alias("k"), F.col(value).alias("v"))))
        return df.groupBy(key).agg(slots.alias("p")).select(key, F.transform("p", lambda e: e["v"]).alias(value))

    rows = usable.select("date", "asset", "ret").join(packed(by_return_day, "date", "s"), "date")
    rows = rows.join(packed(coefs, "asset", "b"), "asset").join(scale.select("asset", "scale"), "asset")
    return rows.select("date", "asset", "ret", (F.col("scale") * dot(F.col("s"), F.col("b"))).alias("fitted"))


def window_r2(fitted: DataFrame, *keys: str) -> DataFrame:
    """Uncentred R2 per key over days with a return and a fit; NULL when the returns are all zero."""
    ok = fitted.where("ret IS NOT NULL AND fitted IS NOT NULL")
    err = F.sum(F.pow(F.col("ret") - F.col("fitted"), 2))
    total = F.sum(F.col("ret") * F.col("ret"))
    return ok.groupBy(*keys).agg((1 - ratio(err, F.when(total > 0, total))).alias("r2"), err.alias("sse"), total.alias("sst"))


def median_r2(r2: DataFrame, *keys: str) -> DataFrame:
    """Exact median over assets with a defined R2, and the pooled R2."""
    return r2.groupBy(*keys).agg(
        F.median("r2").alias("median_r2"), (1 - ratio(F.sum(F.when(F.col("r2").isNotNull(), F.col("sse"))), F.sum("sst"))).alias("pooled_r2")
    )


def window_sweep(fitted: DataFrame, calendar: DataFrame, start: str, weeks: int) -> DataFrame:
    """Median and pooled R2 over consecutive complete windows with frozen coefficients."""
    length = 7 * weeks
    first = F.lit(start).cast("date")
    number = F.floor(F.datediff("date", first) / length).cast("int")
    last = F.max("date").over(Window.partitionBy())
    days = calendar.select("date", last.alias("last"), number.alias("window")).where(F.col("date") >= first)
    complete = F.date_add(first, ((F.col("window") + 1) * length - 1).cast("int")) <= F.col("last")
    days = days.where(complete).select("date", "window")
    counted = days.groupBy("window").agg(F.count("*").alias("n_days"))
    scores = median_r2(window_r2(fitted.join(days, "date"), "window", "asset"), "window")
    return counted.join(scores, "window", "left").select(
        "window", F.date_add(first, F.col("window") * length).alias("start"),
        F.date_add(first, (F.col("window") + 1) * length - 1).alias("end"), "n_days", "median_r2", "pooled_r2",
    )


def pair_sums(by_return_day: DataFrame, usable: DataFrame) -> DataFrame:
    """Sums of returns and shocks per (asset, topic) over valid days, from which every window statistic follows."""
    rows = usable.select("date", "asset", "ret").join(by_return_day.select("date", "topic", "s"), "date")
    r, s = F.col("ret"), F.col("s")
    return rows.groupBy("asset", "topic").agg(
        F.count("*").alias("n"), F.sum(r).alias("sr"), F.sum(s).alias("ss"), F.sum(r * s).alias("srs"),
        F.sum(r * r).alias("srr"), F.sum(s * s).alias("sss"),
    )


def masked_correlation(sums: DataFrame) -> DataFrame:
    """Correlation per pair, NULL below three days or with (nearly) no variance, within [-1, 1]."""
    n = F.col("n")
    cov = F.col("srs") / n - F.col("sr") / n * F.col("ss") / n
    vr = F.col("srr") / n - F.pow(F.col("sr") / n, 2)
    vs = F.col("sss") / n - F.pow(F.col("ss") / n, 2)
    fine = (n >= MIN_CORR_DAYS) & (vr > 1e-14 * F.col("srr") / n) & (vs > 1e-12)
    return sums.select("asset", "topic", F.when(fine, clip(ratio(cov, F.sqrt(vr * vs)), -1.0, 1.0)).alias("corr"))


def contributions(sums: DataFrame, coefs: DataFrame, scale: DataFrame) -> DataFrame:
    """Explained return and share of squared return per (asset, topic)."""
    load = F.col("scale") * F.col("b")
    return sums.join(coefs.select("asset", "topic", "b"), ["asset", "topic"]).join(scale.select("asset", "scale"), "asset").select(
        "asset", "topic", (load * F.col("ss")).alias("contrib"),
        ratio(load * F.col("srs"), F.when(F.col("srr") > 0, F.col("srr"))).alias("var_share"), F.col("sr").alias("realized"),
    )


def explained(contrib: DataFrame) -> DataFrame:
    """Realised, explained and residual return per asset."""
    return contrib.groupBy("asset").agg(F.max("realized").alias("realized"), F.sum("contrib").alias("explained")).withColumn(
        "residual", F.col("realized") - F.col("explained")
    )


def recovery(pairs: DataFrame, tau: float) -> DataFrame:
    """Recovery of true sensitivities over all pairs.

    ``pairs`` has ``w`` (design weight), ``b`` (estimate), ``b_true`` and
    ``selected``; the scores are conditional counts of one pass.
    """
    linked, chosen = F.coalesce(F.col("w"), F.lit(0.0)) != 0, F.col("selected")
    exposed = F.abs("b_true") >= tau

    def count(cond):
        return F.sum(F.when(cond, 1.0).otherwise(0.0))

    agree = F.signum("b") == F.signum("b_true")
    raw = pairs.agg(
        count(linked).alias("n_linked"), count(linked & chosen).alias("hit"), count(linked & chosen & agree).alias("agree"),
        count(chosen & exposed).alias("tp"), count(chosen & ~exposed).alias("fp"), count(~chosen & exposed).alias("fn"),
        count(~chosen & ~exposed).alias("tn"), F.sqrt(F.avg(F.pow(F.col("b") - F.col("b_true"), 2))).alias("rmse"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return raw.select(
        "n_linked", ratio(F.col("hit"), F.col("n_linked")).alias("coverage"), ratio(F.col("agree"), F.col("hit")).alias("sign_agreement"),
        F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).alias("mcc"), "rmse", (tp + fp).alias("n_selected"), (tp + fn).alias("n_exposed"),
    )

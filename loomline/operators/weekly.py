"""The factor model on weekly periods of a training window, its forecasts and implied sensitivities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import ratio, safe_divisor
from loomline.functions.dense import least_squares_map, sym_pinv
from loomline.operators.factor_model import RIDGE, Fit
from loomline.operators.kernel import KernelConfig, kernel_weight
from loomline.operators.moments import _matrix, collect_moments, period_moments
from loomline.operators.shocks import shock_vectors
from loomline.operators.tuning import period_factors

# Trading weeks per year and shuffled references per week.
WEEKS_PER_YEAR = 52
N_SHUFFLES = 20


def half_life_decay(half_life: float) -> float:
    """Decay per period with the given half-life in periods."""
    return float(0.5 ** (1.0 / half_life))


def training_divisor(returns: DataFrame, paired_days: DataFrame, train_end: str) -> DataFrame:
    """Population deviation of each asset over paired training days; assets without one are left out."""
    rows = returns.join(paired_days.select("date"), "date", "left_semi").where(F.col("date") <= F.lit(train_end).cast("date"))
    return rows.groupBy("asset").agg(F.stddev_pop("ret").alias("scale")).where("scale > 0")


def scale_returns(returns: DataFrame, divisor: DataFrame) -> DataFrame:
    return returns.join(divisor, "asset").select("date", "asset", (F.col("ret") / F.col("scale")).alias("ret"))


def training_rows(panel: DataFrame, train_start: str, train_end: str) -> DataFrame:
    """Panel rows of whole weeks inside the training window, renumbered."""
    inside = panel.where(F.col("period").between(F.lit(train_start).cast("date"), F.lit(train_end).cast("date")))
    weeks = inside.select("period").distinct().select("period", (F.row_number().over(Window.orderBy("period")) - 1).alias("t_new"))
    return inside.join(weeks, "period").select(F.col("t_new").alias("t_idx"), "period", "asset", "y", "x")


def training_weeks(calendar: DataFrame, train_start: str, train_end: str, burn_in: int) -> DataFrame:
    """Whole weeks inside the training window and how many have a full instrument history before them."""
    weeks = calendar.groupBy("period_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    inside = (F.col("first") >= F.lit(train_start).cast("date")) & (F.col("last") <= F.lit(train_end).cast("date"))
    usable = inside & (F.col("period_id") > burn_in)
    return weeks.agg(F.count(F.when(inside, 1)).alias("n_weeks"), F.count(F.when(usable, 1)).alias("n_usable"), F.min(F.when(usable, F.col("first"))).alias("first_usable"))


def history_share(calendar: DataFrame, period_id: int, train_start: str, cfg: KernelConfig) -> DataFrame:
    """Share of one period's kernel weight that falls on days before the training window."""
    days = calendar.where((F.col("period_id") < period_id) | ((F.col("period_id") == period_id) & (F.col("back") > cfg.skip_days)))
    w = kernel_weight(F.lit(period_id) - F.col("period_id"), cfg)
    before = F.when(F.col("date") < F.lit(train_start).cast("date"), w).otherwise(0.0)
    return days.agg(ratio(F.sum(before), F.sum(w)).alias("share"))


def _times(x: Column, matrix: np.ndarray) -> Column:
    """``x @ matrix`` for an array column and a small fixed matrix."""

    @F.pandas_udf("array<double>")
    def multiply(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()) @ matrix))

    return multiply(x)


def panel_inputs(attention: DataFrame, returns: DataFrame, calendar: DataFrame, history: str, train_start: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Attention and returns that the panel may read: all of them (``full``), or from the training start on (``training``).

    Under ``training`` attention starts ``window`` trading days earlier, so that the first training day has a shock; returns after the training end stay, for the forecast.
    """
    if history == "full":
        return attention, returns
    if history != "training":
        raise ValueError(f"history is full or training, not {history!r}")
    start = F.lit(train_start).cast("date")
    first = calendar.where(F.col("date") >= start).agg(F.min("pos").alias("first"))
    days = calendar.join(first, calendar["pos"] >= F.col("first") - window).select("date")
    return attention.join(days, "date", "left_semi"), returns.where(F.col("date") >= start)


def forecast(panel: DataFrame, fit: Fit, start: str, end: str) -> DataFrame:
    """Fitted and realised return of every panel row in the forecast weeks, with the term of each instrument.

    Factors come from each week's own cross-section with frozen loadings, computed where the
    week's moments lie; neither rows nor weeks meet in one place. The ridge is 2, or 0 for
    the plain model. The terms of a row add up to its fitted return.
    """
    rows = panel.where(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    factors = period_factors(period_moments(rows), fit.gamma, 0.0 if fit.lam == 0 else RIDGE)
    weeks = factors.select("t_idx", _times(F.col("f"), fit.gamma.T).alias("g"))
    out = rows.join(weeks, "t_idx").withColumn("terms", F.zip_with("x", "g", lambda a, b: a * b))
    total = F.aggregate("terms", F.lit(0.0), lambda acc, v: acc + v)
    return out.select("t_idx", "period", "asset", "y", total.alias("fitted"), "terms")


def forecast_terms(rows: DataFrame, topics: list[str]) -> DataFrame:
    """(topic, explained, var_share): what each instrument's terms explain over all forecast rows, the constant first; shares add up to the share of the whole fit."""
    order = F.array(F.lit("const"), *[F.lit(t) for t in topics])
    long = rows.select("y", F.posexplode("terms").alias("k", "term")).groupBy("k").agg(F.sum("term").alias("explained"), F.sum(F.col("term") * F.col("y")).alias("ty"))
    total = rows.agg(F.sum(F.col("y") * F.col("y")).alias("yy"))
    return long.crossJoin(total).select(F.element_at(order, F.col("k") + 1).alias("topic"), "explained", ratio(F.col("ty"), F.when(F.col("yy") > 0, F.col("yy"))).alias("var_share"))


def forecast_scores(rows: DataFrame) -> DataFrame:
    """Uncentred R2 per asset over the forecast weeks."""
    err, tot = F.sum(F.pow(F.col("y") - F.col("fitted"), 2)), F.sum(F.col("y") * F.col("y"))
    return rows.groupBy("asset").agg((1 - ratio(err, F.when(tot > 0, tot))).alias("r2"), err.alias("sse"), tot.alias("sst"), F.count("*").alias("n_weeks"))


def hash_ranks(rows: DataFrame, keys: list[str], digest: Column, name: str) -> DataFrame:
    """The rows with their rank ``name`` in the order of a hex digest inside each group of ``keys``.

    A group is dealt to 256 ranges by the digest's first byte; ranges are counted, and a row's rank is what stands in the ranges
    before its own plus its place inside it. No window holds a whole group.
    """
    dealt = rows.withColumn("_digest", digest).withColumn("_range", F.conv(F.substring("_digest", 1, 2), 16, 10).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_digest", "asset"))
    return dealt.join(starts, [*keys, "_range"]).withColumn(name, F.col("_start") + inside).drop("_digest", "_range", "_start")


def shuffled_panel(panel: DataFrame, seed: int, copies: int = N_SHUFFLES) -> DataFrame:
    """Copies of the panel with topic instruments permuted across the assets of each week.

    A permutation pairs two digest orders of the same week (assets by md5 of their name, donors by md5 of
    ``seed|copy|name``), so it is the same on every run and on any cluster, and needs no sort of a week in one task.
    """
    many = panel.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    keys, name = ["t_idx", "copy"], F.col("asset").cast("string")
    receivers = hash_ranks(many.select("t_idx", "period", "asset", "y", "copy"), keys, F.md5(name.cast("binary")), "k")
    donors = hash_ranks(many.select("t_idx", "copy", "asset", "x"), keys, F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("copy").cast("string"), name).cast("binary")), "k")
    return receivers.join(donors.drop("asset"), [*keys, "k"]).drop("k")


def shuffle_reference(panel: DataFrame, fit: Fit, start: str, end: str, seed: int = 0, copies: int = N_SHUFFLES) -> DataFrame:
    """Pooled R2 that the loadings reach on permuted instruments, averaged over the copies."""
    rows = panel.where(F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    mixed = shuffled_panel(rows, seed, copies)
    width = F.col("t_idx") * copies + F.col("copy") - 1
    scored = forecast(mixed.select(width.cast("int").alias("t_idx"), "period", "asset", "y", "x"), fit, start, end)
    return scored.agg((1 - ratio(F.sum(F.pow(F.col("y") - F.col("fitted"), 2)), F.sum(F.col("y") * F.col("y")))).alias("r2_shuffled"))


def implied_covariance_map(fit: Fit, rcond: float = 1e-6) -> tuple[np.ndarray, int]:
    """Matrix that takes an instrument row to the topic covariances the model implies, and its rank."""
    back, rank = least_squares_map(fit.gamma[1:], rcond)
    return fit.gamma @ back.T, rank


def implied_sensitivities(panel: DataFrame, fit: Fit, shocks: DataFrame, returns_scale: DataFrame, topics: list[str],
                          train_start: str, train_end: str, rcond: float = 1e-6, tau: float = 0.05) -> DataFrame:
    """Sensitivities in the units of the direct regressions, from each asset's latest training row.

    ``returns_scale`` gives per asset the panel divisor (1 without scaling) and the
    training deviation. The shock covariance is one matrix of topic size; applying
    it is a product per row.
    """
    inside = F.col("date").between(F.lit(train_start).cast("date"), F.lit(train_end).cast("date"))
    vec = shock_vectors(shocks.where(inside), topics).select(F.lit(0).alias("t_idx"), F.lit(0.0).alias("y"), F.concat(F.array(F.lit(1.0)), "z").alias("x"))
    held = collect_moments(period_moments(vec), None)  # one period: a square of the topics
    n, s = int(held.n[0]), held.s[0]
    cov = s[1:, 1:] / n - np.outer(s[0, 1:], s[0, 1:]) / n**2
    sd = np.sqrt(np.diag(cov))
    to_m, _ = implied_covariance_map(fit, rcond)
    total = to_m @ sym_pinv(cov, rcond)[0] * sd
    last = panel.where(F.col("period") <= F.lit(train_end).cast("date")).groupBy("asset").agg(
        F.max_by("x", "t_idx").alias("x"), F.max("period").alias("row_period"))
    rows = last.join(returns_scale, "asset").withColumn("b", _times(F.col("x"), total))
    order = F.array(*[F.lit(t) for t in topics])
    long = rows.select("asset", "row_period", "divisor", "ret_scale", F.posexplode("b").alias("k", "raw"))
    b = F.col("raw") * F.col("divisor") / safe_divisor(F.col("ret_scale"))
    return long.select("asset", F.element_at(order, F.col("k") + 1).alias("topic"), b.alias("b"), (F.abs(b) >= tau).alias("selected"), "row_period")

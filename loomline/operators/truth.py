"""Matching estimates to a delivered truth, and loadings against true betas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import dot
from loomline.functions.session import materialise
from loomline.operators import scoring
from loomline.operators.calendar import period_start

# Every so many periods of the subsample, and the fewest it holds.
EVERY, MIN_PERIODS = 12, 5


def positions(rows: DataFrame, key: str) -> DataFrame:
    """(key, at): the place of each distinct key in their order, without sorting them in one task.

    Keys are dealt to ranges, numbered inside their range, and a range starts after the keys of the ranges before it.
    """
    spark = rows.sparkSession
    ranged = rows.select(key).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    ranged = materialise(ranged.withColumn("range", F.spark_partition_id()), "positions")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return ranged.join(starts, "range").select(key, (F.col("start") + inside - 1).alias("at"))


def match_periods(source: DataFrame, target: DataFrame, period: str | None = None) -> DataFrame:
    """(period, matched, how) for every distinct ``period`` date of ``source``: the date of ``target`` it stands for, null where none.

    Equal dates match. Where that leaves some out and a period alias is given, dates are matched by the period they lie in
    instead, if periods are unique on both sides and as many or more find a match.
    """
    src, tgt = (materialise(d.select(F.col("period").cast("date").alias("period")).where("period is not null").distinct(), "match_periods") for d in (source, target))
    exact = src.join(tgt.select("period", F.col("period").alias("matched")), "period", "left").withColumn("how", F.when(F.col("matched").isNotNull(), "date"))
    if period is None:
        return exact
    named = [d.withColumn("label", period_start(F.col("period"), period)) for d in (src, tgt)]
    n, hits = exact.agg(F.count("*"), F.count("matched")).first()
    unique = all(d.groupBy("label").count().where("count > 1").isEmpty() for d in named)
    if hits == n or not unique:
        return exact
    labelled = named[0].join(named[1].select("label", F.col("period").alias("matched")), "label", "left").select("period", "matched", F.when(F.col("matched").isNotNull(), "label").alias("how"))
    return labelled if labelled.where("matched is not null").count() >= hits else exact


def match_assets(source: DataFrame, truth: DataFrame, ids: bool = True) -> DataFrame:
    """(asset, true_asset) for every distinct asset of ``source``, null where the truth has none.

    Assets match by name. A truth whose assets are no ids but numbers in its order (``ids`` off) is matched by position, which
    needs equally many on both sides; otherwise nothing matches.
    """
    own = source.select("asset").distinct()
    if ids:
        return own.join(truth.select("asset", F.col("asset").alias("true_asset")).distinct(), "asset", "left")
    a, b = (positions(d, "asset") for d in (own, truth))
    same = a.count() == b.count()
    return a.join(b.select("at", F.col("asset").alias("true_asset")), "at", "left").select("asset", F.when(F.lit(same), F.col("true_asset")).alias("true_asset"))


def matched_truth(estimates: DataFrame, truth: DataFrame, period: str | None = None, ids: bool = True) -> DataFrame:
    """The rows of ``estimates`` (period, asset, ...) with the array ``b`` of the true row they stand for; rows without one have null.

    Each period and each asset has one match at most, so no row is multiplied. Column ``how`` tells how the period was matched.
    """
    when, who = match_periods(estimates, truth, period), match_assets(estimates, truth, ids)
    true = truth.select(F.col("period").cast("date").alias("matched"), F.col("asset").alias("true_asset"), "b")
    rows = estimates.withColumn("period", F.col("period").cast("date")).join(when, "period", "left").join(who, "asset", "left")
    return rows.join(true, ["matched", "true_asset"], "left")


def sampled_periods(rows: DataFrame, every: int = EVERY, least: int = MIN_PERIODS) -> DataFrame:
    """(t_idx) of every ``every``-th period back from the last, or ``least`` spread evenly where those are fewer."""
    last = rows.agg(F.max("t_idx")).first()[0]
    n = 0 if last is None else int(last) + 1
    chosen = list(range(n - 1, -1, -every))
    if len(chosen) < least:
        m = min(least, n)
        chosen = sorted({round(k * (n - 1) / max(m - 1, 1)) for k in range(m)})
    return rows.sparkSession.createDataFrame([(t,) for t in chosen], "t_idx int")


def beta_canonical_corr(panel: DataFrame, gamma, truth: DataFrame, width: int, period: str | None = None, ids: bool = True, every: int = EVERY, least: int = MIN_PERIODS) -> tuple[DataFrame, DataFrame]:
    """(summary, periods): canonical correlations of the implied betas ``x gamma`` with the true ones over sampled periods.

    panel: (t_idx, period, asset, x); gamma: instruments x K; truth: (period, asset, b) with ``width`` betas that hold for the return
    period. Both sides are centred and whitened inside a period, from one sum of cross products; rows without finite true
    betas do not count, and a period needs max(K, width) + 2 rows and betas that vary. ``mean`` averages over all ``width`` correlations, those that
    are missing being zero.
    """
    k = len(gamma[0])
    implied = F.array(*[dot(F.col("x"), F.array(*[F.lit(float(row[j])) for row in gamma])) for j in range(k)])
    rows = panel.join(sampled_periods(panel, every, least), "t_idx", "left_semi").select("t_idx", "period", "asset", implied.alias("a"))
    finite = F.forall("b", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.forall("a", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = matched_truth(rows, truth, period, ids).where(F.col("b").isNotNull()).where(finite)
    rows = materialise(rows.select("t_idx", "asset", "a", F.transform("b", lambda v: v.cast("double")).alias("b")), "beta_rows")
    enough = rows.groupBy("t_idx").agg(F.count("*").alias("m")).where(F.col("m") >= max(k, width) + 2)
    usable = rows.join(enough, "t_idx", "left_semi").select(F.col("t_idx").cast("string").alias("when"), "a", "b")
    found = scoring.canonical_correlations(usable, k, "when")
    periods = found.groupBy(F.col("g").cast("int").alias("t_idx")).agg(F.max("corr").alias("first"), (F.sum("corr") / width).alias("mean"), F.max("n").alias("n"))
    summary = periods.agg(F.avg("first").alias("beta_canonical_corr"), F.avg("mean").alias("beta_canonical_corr_mean"), F.count("*").alias("n_periods"), F.avg("n").alias("mean_n_assets"))
    return summary, periods

"""Attention shocks and their diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import safe_divisor, sample_kurtosis, sample_skew

# Fixed value: names of placebo topics.
PLACEBO_PATTERN = r"placebo_\d+"


def attention_shocks(attention: DataFrame, calendar: DataFrame, window: int = 5, standardise: bool = False) -> DataFrame:
    """Level minus the mean of the previous ``window`` trading rows.

    The frame counts calendar positions and the window must be complete, so a gap
    makes every shock that looks back across it missing. ``standardise`` divides
    by the full-sample deviation of each topic.
    """
    past = Window.partitionBy("topic").orderBy("pos").rangeBetween(-window, -1)
    on_days = attention.join(calendar.select("date", "pos"), "date")
    full = F.count("level").over(past) == window
    z = F.when(full, F.col("level") - F.avg("level").over(past))
    shocks = on_days.select("date", "topic", z.alias("z"))
    if not standardise:
        return shocks
    scale = shocks.groupBy("topic").agg(F.stddev_samp("z").alias("sd"))
    return shocks.join(scale, "topic").select("date", "topic", (F.col("z") / safe_divisor(F.col("sd"))).alias("z"))


def complete_days(shocks: DataFrame, n_topics: int) -> DataFrame:
    """Days on which every topic has a shock; other days are used for no asset."""
    return (
        shocks.where("z IS NOT NULL").groupBy("date").agg(F.count("z").alias("k"))
        .where(F.col("k") == n_topics).select("date")
    )


def shock_vectors(shocks: DataFrame, topics: list[str]) -> DataFrame:
    """One array of shocks per complete day, in the order of ``topics``."""
    order = F.array(*[F.lit(t) for t in topics])
    packed = shocks.where("z IS NOT NULL").groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct((F.array_position(order, F.col("topic"))).alias("k"), "z"))).alias("p")
    )
    return packed.where(F.size("p") == len(topics)).select("date", F.transform("p", lambda s: s["z"]).alias("z"))


def shock_diagnostics(shocks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Count, moments, lag-one autocorrelation and zero share per topic."""
    near = Window.partitionBy("topic").orderBy("pos").rangeBetween(-1, -1)
    z = F.col("z")
    lagged = (
        shocks.join(calendar.select("date", "pos"), "date").where("z IS NOT NULL")
        .withColumn("before", F.max("z").over(near))
    )
    stats = lagged.groupBy("topic").agg(
        F.count("z").alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("std"),
        F.skewness("z").alias("g1"), F.kurtosis("z").alias("g2"),
        F.corr("z", "before").alias("rho"),
        F.count(F.when(F.col("before").isNotNull(), 1)).alias("pairs"),
        F.avg((z == 0).cast("double")).alias("zero_share"),
    )
    return stats.select(
        "topic", "n", "mean", "std", sample_skew(F.col("g1"), F.col("n")).alias("skew"),
        sample_kurtosis(F.col("g2"), F.col("n")).alias("kurtosis"),
        F.when(F.col("pairs") >= 3, F.col("rho")).alias("autocorr1"), "zero_share",
    )


def append_placebos(shocks: DataFrame, topics: list[str], n: int, seed: int = 12345) -> DataFrame:
    """``n`` extra topics of independent noise, each with the spread of a random real topic.

    Draws are a Box-Muller transform of hashes of (day, placebo, seed), so every
    task makes its own rows and a retry makes the same ones. Days on which a real
    shock is missing get no placebo, which keeps the usable days unchanged.
    Numbering continues after placebos already present; those are never donors.
    """
    real = [t for t in topics if not re.fullmatch(PLACEBO_PATTERN, t)]
    first = len(topics) - len(real) + 1
    if n == 0:
        return shocks.select("date", "topic", "z")
    donors = (
        shocks.where(F.col("topic").isin(real)).groupBy("topic").agg(F.stddev_samp("z").alias("sd")).where("sd > 0")
        .select("sd", (F.row_number().over(Window.orderBy("topic")) - 1).cast("long").alias("donor"),
                F.count("*").over(Window.partitionBy()).alias("n_donors"))
    )
    slots = donors.where("donor = 0").select("n_donors", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("j"))
    picks = slots.withColumn("donor", F.floor(hashed_uniform(seed, F.lit("donor"), F.col("j")) * F.col("n_donors")))
    names = picks.join(donors.select("donor", "sd"), "donor").select("j", "sd")
    noise = complete_days(shocks, len(topics)).select(
        "date", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("j")
    )
    noise = noise.join(names, "j").select(
        "date",
        F.concat(F.lit("placebo_"), F.col("j").cast("string")).alias("topic"),
        (standard_normal(seed, F.col("date").cast("string"), F.col("j")) * F.col("sd")).alias("z"),
    )
    return shocks.select("date", "topic", "z").unionByName(noise)


def hashed_uniform(seed: int, *keys):
    """A uniform draw in (0, 1) fixed by the keys and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double")
    return (bits + 0.5) / F.lit(float(2**53))


def standard_normal(seed: int, *keys):
    """A standard normal draw fixed by the keys and the seed."""
    radius = F.sqrt(-2 * F.log(hashed_uniform(seed, F.lit("r"), *keys)))
    return radius * F.cos(2 * F.pi() * hashed_uniform(seed, F.lit("a"), *keys))

"""Topic-asset links: tiers, edits, design weights and roll-ups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Strength of a link by tier.
TIER_VALUES = {"strong": 0.35, "moderate": 0.15, "weak": 0.05}
# Streams of the seeded draws.
LINK_STREAM, NOISE_STREAM, ATTENTION_STREAM = 101, 202, 303


def topic_generator(seed: int, stream: int, topic: str) -> np.random.Generator:
    """Random stream of one topic; it does not depend on the other topics of a run."""
    return np.random.default_rng([seed, stream, *map(ord, topic)])


# Which topics of a registry a run takes, by ontology.
ONTOLOGIES = {"sector": ("sector",), "economic": ("economic",), "both": ("sector", "economic"), "none": ()}
TOPIC_FIELDS = ("name", "group", "ontology", "scope")


def topic_table(registry: DataFrame, manual: str = "both", n_generic: int = 0) -> DataFrame:
    """(topic_id, name, group, ontology, scope, order) of a run: the registry's topics of the chosen ontologies in its order, then generic ones G001, G002, ...

    ``registry`` has topic_id, the four text fields and ``order``, which must be unique. Order counts from 1 over the run without gaps.
    """
    from loomline.operators.truth import positions

    if manual not in ONTOLOGIES or n_generic < 0:
        raise ValueError(f"no topic set {manual!r} with {n_generic} generic topics")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TOPIC_FIELDS]
    chosen = registry.where(F.col("ontology").isin(*ONTOLOGIES[manual]) if ONTOLOGIES[manual] else F.lit(False))
    chosen = chosen.join(positions(chosen, "order"), "order").select(F.col("topic_id").cast("string").alias("topic_id"), *text, (F.col("at") + 1).cast("long").alias("order"))
    n, number = chosen.count(), F.col("id") + 1
    padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    generic = registry.sparkSession.range(n_generic).select(
        F.concat(F.lit("G"), padded).alias("topic_id"), F.concat(F.lit("Generic topic "), padded).alias("name"), F.lit("Generic").alias("group"), F.lit("generic").alias("ontology"), F.lit("").alias("scope"), (number + n).alias("order"))
    return chosen.unionByName(generic)


def random_links(topics: DataFrame, assets: list[str], counts: tuple[int, int, int] = (1, 2, 3), seed: int = 0) -> DataFrame:
    """Seeded links and a priority per topic; each topic's draw is its own, so tasks may run in any order."""
    tiers = ["strong"] * counts[0] + ["moderate"] * counts[1] + ["weak"] * counts[2]

    def draw(batches):
        for batch in batches:
            for topic in batch["topic"]:
                rng = topic_generator(seed, LINK_STREAM, topic)
                priority = rng.random()
                n = min(len(tiers), len(assets))
                picks = rng.choice(len(assets), size=n, replace=False)
                signs = np.where(rng.random(n) < 0.5, 1, -1)
                yield pd.DataFrame({"topic": topic, "priority": priority, "asset": [assets[i] for i in picks], "tier": tiers[:n], "sign": signs})

    return topics.select("topic").mapInPandas(draw, "topic string, priority double, asset string, tier string, sign int")


def share_with_signal(links: DataFrame, share: float) -> DataFrame:
    """Links of the topics with the smallest priorities, the given share of all topics rounded half up."""
    one = links.groupBy("topic").agg(F.min("priority").alias("p"))
    ranked = one.select(
        "topic", F.row_number().over(Window.orderBy("p", "topic")).alias("rank"), F.count("*").over(Window.partitionBy()).alias("n")
    )
    chosen = ranked.where(F.col("rank") <= F.floor(F.round(F.col("n") * share, 9) + 0.5)).select("topic")
    return links.join(chosen, "topic", "left_semi").drop("priority")


def apply_overrides(links: DataFrame, overrides: DataFrame, topics: DataFrame, assets: DataFrame) -> DataFrame:
    """Upserts or removes (tier ``none``) links by pair; the last edit of a pair wins.

    Edits that name a topic or asset outside the run are ignored. ``overrides``
    carries an edit number ``seq``.
    """
    known = overrides.join(topics.select("topic"), "topic", "left_semi").join(assets.select("asset"), "asset", "left_semi")
    last = known.groupBy("topic", "asset").agg(F.max_by(F.struct("tier", "sign"), "seq").alias("o"))
    both = links.select("topic", "asset", "tier", "sign", "origin").join(last, ["topic", "asset"], "full")
    edited = F.col("o").isNotNull()
    return both.select(
        "topic", "asset", F.when(edited, F.col("o.tier")).otherwise(F.col("tier")).alias("tier"),
        F.when(edited, F.col("o.sign")).otherwise(F.col("sign")).alias("sign"),
        F.when(edited, F.lit("override")).otherwise(F.col("origin")).alias("origin"),
    ).where("tier <> 'none'")


def tier_value(tier: Column, n_values: int = 3) -> Column:
    """Strength of a tier; with fewer values the weaker tiers share the last value kept."""
    names = list(TIER_VALUES)
    kept = {name: TIER_VALUES[names[min(i, n_values - 1)]] for i, name in enumerate(names)}
    out = F.lit(None).cast("double")
    for name, value in kept.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def design_weights(links: DataFrame, n_values: int = 3) -> DataFrame:
    """Signed weights of the linked pairs; unlinked pairs are absent, not stored as zeros."""
    return links.select("topic", "asset", (F.col("sign") * tier_value(F.col("tier"), n_values)).alias("w"))


def dense_pairs(weights: DataFrame, topics: list[str], assets: DataFrame, value: str = "w") -> DataFrame:
    """Every (topic, asset) cell with zero where nothing is stored, for views that show the whole matrix."""
    cells = assets.select("asset", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"))
    return cells.join(weights, ["topic", "asset"], "left").select("topic", "asset", F.coalesce(value, F.lit(0.0)).alias(value))


def roll_up(values: DataFrame, groups: DataFrame, value: str, *keys: str) -> DataFrame:
    """Topic values summed by topic group; a group without any value stays NULL."""
    return values.join(groups, "topic").groupBy("group", *keys).agg(F.sum(value).alias(value))


def top_with_rest(values: DataFrame, key: str, value: str, n: int, *partition: str) -> DataFrame:
    """The ``n`` largest entries by size per partition and one row for the sum of the others."""
    order = Window.partitionBy(*partition).orderBy(F.abs(F.col(value)).desc(), key)
    ranked = values.withColumn("rank", F.row_number().over(order))
    label = F.when(F.col("rank") <= n, F.col(key)).otherwise(F.lit("other"))
    return ranked.groupBy(*partition, label.alias(key)).agg(F.sum(value).alias(value), F.count("*").alias("n"))

"""Mixing sources to target weights through a tree of domains, languages and sources.

A node's budget is dealt to its children in proportion to their weights, none
getting more than the leaves of positive weight below it can spend; what one child cannot use goes to its
siblings, and only a family that is short as a whole leaves its shortage to the
level above. A leaf spends its budget on whole seeded epochs and then on the
prefix of one more epoch in seeded order. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.session import materialise

LEAF = ["domain", "lang", "source"]
BUCKET_ROWS = 1000  # mean rows in a bucket of one leaf's seeded order


@dataclass(frozen=True)
class MixConfig:
    """Weights by node name at each level (others weigh 1), and the whole budget as a share of the tokens there are."""

    domain_weights: Mapping[str, float] = field(default_factory=lambda: {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0})
    lang_weights: Mapping[str, float] = field(default_factory=lambda: {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0})
    source_weights: Mapping[str, float] = field(default_factory=dict)
    budget_share: float = 1.0
    max_epochs: int = 2
    seed: int = 7

    def __post_init__(self):
        for weights in (self.domain_weights, self.lang_weights, self.source_weights):
            if not all(0 <= w < float("inf") for w in weights.values()):
                raise ValueError("weights are finite and not negative; a weight of 0 leaves a node out")


def default_domain(source: Column) -> Column:
    """Domain of a source: its last digit modulo 4, d0 where there is none."""
    digit = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9])$", 1)
    return F.concat(F.lit("d"), F.pmod(F.when(digit == "", F.lit("0")).otherwise(digit).cast("int"), F.lit(4)).cast("string"))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _weight(name: str, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.col(name)), F.lit(1.0)).cast("double")


def _dealt(nodes: DataFrame, parent: list[str], keys: list[str]) -> DataFrame:
    """Adds ``given``: the share of ``target`` that each node gets among its siblings.

    Given is min(cap, weight * level) with one level a family; siblings sorted by
    cap/weight fill up one after the other, so the level is a running sum.
    """
    family = Window.partitionBy(*(parent or [F.lit(0)]))
    order = [F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).asc_nulls_last(), *keys]
    before = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0.0))).over(family.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(family.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    nodes = nodes.withColumn("level", F.when(F.col("weight") > 0, (F.col("target") - before) / left))
    free = (F.col("weight") > 0) & (F.col("cap") > F.col("weight") * F.col("level"))
    nodes = nodes.withColumn("free_level", F.max(F.when(free, F.col("level"))).over(family))
    given = F.when(F.col("weight") <= 0, F.lit(0.0)).when(free, F.col("weight") * F.col("free_level")).otherwise(F.col("cap"))
    return nodes.withColumn("given", given).drop("level", "free_level", "target")


def leaf_budgets(rows: DataFrame, cfg: MixConfig) -> DataFrame:
    """(domain, lang, source, docs, supply, quota) from rows of (domain, lang, source, n_tokens).

    The tree is as large as the number of sources; rows are summed per task first.
    """
    leaves = rows.groupBy(*LEAF).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("supply"))
    leaves = materialise(leaves, "mix_leaves")
    # What a node may be dealt is what its leaves of positive weight can spend.
    spendable = F.when((_weight("lang", cfg.lang_weights) > 0) & (_weight("source", cfg.source_weights) > 0), F.col("supply")).otherwise(F.lit(0))
    most = (F.sum(spendable) * F.lit(cfg.max_epochs)).cast("double")
    domains = leaves.groupBy("domain").agg(most.alias("cap"), F.sum("supply").alias("supply")).withColumn("weight", _weight("domain", cfg.domain_weights))
    domains = domains.withColumn("target", F.floor(F.sum("supply").over(Window.partitionBy(F.lit(0))) * F.lit(float(cfg.budget_share))).cast("double"))
    domains = _dealt(domains, [], ["domain"]).select("domain", F.col("given").alias("target"))
    langs = leaves.groupBy("domain", "lang").agg(most.alias("cap")).withColumn("weight", _weight("lang", cfg.lang_weights)).join(domains, "domain")
    langs = _dealt(langs, ["domain"], ["lang"]).select("domain", "lang", F.col("given").alias("target"))
    sources = leaves.withColumn("cap", (F.col("supply") * F.lit(cfg.max_epochs)).cast("double")).withColumn("weight", _weight("source", cfg.source_weights)).join(langs, ["domain", "lang"])
    return _dealt(sources, ["domain", "lang"], ["source"]).select(*LEAF, "docs", "supply", F.floor("given").cast("long").alias("quota"))


def _key(epoch: Column, seed: int) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def _bucket() -> Column:
    """Equal ranges of keys, about BUCKET_ROWS rows of the leaf in each."""
    return F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.ceil(F.col("docs") / F.lit(BUCKET_ROWS)), 32)


def cuts(rows: DataFrame, cfg: MixConfig) -> DataFrame:
    """One row per leaf: quota, whole epochs, and where the prefix of the last epoch ends.

    No leaf is sorted as a whole: tokens are summed by ranges of the seeded
    order, the range in which the budget runs out is found by a running
    sum over ranges, and only the rows of that range are ordered.
    """
    spent = leaf_budgets(rows, cfg).withColumn("whole", F.when(F.col("supply") > 0, F.floor(F.col("quota") / F.col("supply"))).otherwise(F.lit(cfg.max_epochs)).cast("int"))
    spent = materialise(spent.withColumn("rest", F.when(F.col("supply") > 0, F.col("quota") - F.col("whole") * F.col("supply")).otherwise(F.lit(0))), "mix_budgets")
    part = rows.join(spent.where("rest > 0"), LEAF).withColumn("key", _key(F.col("whole"), cfg.seed)).withColumn("bucket", _bucket())
    sums = part.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("rest"))
    run = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket")))
    ends = materialise(run.where("upto > rest and upto - n <= rest").select(*LEAF, F.col("bucket").alias("end_bucket"), (F.col("upto") - F.col("n")).alias("done")), "mix_ends")
    last = part.join(ends, LEAF).where("bucket = end_bucket")
    # Rows with one key (a repeated doc_id) are taken together or not at all.
    last = last.withColumn("upto", F.col("done") + F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))).where("upto <= rest")
    keys = last.groupBy(*LEAF).agg(F.max("key").alias("end_key"))
    return materialise(spent.join(ends.drop("done"), LEAF, "left").join(keys, LEAF, "left"), "mix_cuts")


def _leafed(docs: DataFrame, domain) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("source")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"), n_tokens(F.col("text")).alias("n_tokens"))


def _chosen(rows: DataFrame, ends: DataFrame, cfg: MixConfig, keys: list[str]) -> DataFrame:
    """Rows joined with the cut of their leaf, one for each epoch that takes them. ``keys``: the leaf columns of ``rows``."""
    ends = ends.select(*[F.col(c).alias(k) for c, k in zip(LEAF, keys)], "docs", "supply", "quota", "whole", "rest", "end_bucket", "end_key")
    met = rows.join(ends, keys).withColumn("key", _key(F.col("whole"), cfg.seed)).withColumn("bucket", _bucket())
    # Without an end the rest never runs out, which only a rest of nothing can do.
    inside = (F.col("rest") > 0) & ((F.col("bucket") < F.col("end_bucket")) | ((F.col("bucket") == F.col("end_bucket")) & (F.col("key") <= F.col("end_key"))))
    n = F.col("whole") + F.coalesce(inside, F.lit(False)).cast("int")
    return met.withColumn("epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def select_mixture(docs: DataFrame, cfg: MixConfig | None = None, domain=default_domain) -> DataFrame:
    """One row per document and epoch that the mixture takes: doc_id, domain, lang, source, epoch, n_tokens, leaf_supply, leaf_quota.

    docs: columns doc_id, text, lang and source are read, others ignored.
    domain: a function from the source column to the domain column.

    A null lang or source is the leaf "(none)"; a null text has no tokens and is
    taken where its leaf's prefix passes it. Repeated rows, and rows that share a
    doc_id, have one place in the order and are taken together or not at all.
    A document is taken whole, so a leaf's last epoch may end up to one
    document short of its quota. A leaf without any token is taken in every
    epoch. A node of weight 0 gets nothing and its share goes to its siblings; negative weights are refused.
    An empty table gives no rows.
    """
    cfg = cfg or MixConfig()
    rows = materialise(_leafed(docs, domain), "mix_rows")
    taken = _chosen(rows, cuts(rows, cfg), cfg, LEAF)
    return taken.select("doc_id", *LEAF, "epoch", "n_tokens", F.col("supply").alias("leaf_supply"), F.col("quota").alias("leaf_quota"))


def mix(docs: DataFrame, cfg: MixConfig | None = None, domain=default_domain) -> DataFrame:
    """``docs`` as the mixture has them: rows of a repeated epoch come again. Texts are not shuffled for it: a
    row is decided by its leaf's cut alone."""
    cfg = cfg or MixConfig()
    ends = cuts(materialise(_leafed(docs, domain), "mix_rows"), cfg)
    keys = ["_mix_domain", "_mix_lang", "_mix_source"]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("source")).alias(keys[0]),
                      *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(k) for c, k in (("lang", keys[1]), ("source", keys[2]))])
    return _chosen(own, ends, cfg, keys).select("_row.*")


def _level_sql(table: str, parent: str, key: str) -> str:
    family = f"PARTITION BY {parent}"
    order = f"{family} ORDER BY cap / weight, {key}"
    return f"""
{table}_level AS (SELECT *, (target - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {table}),
{table}_given AS (SELECT *, CASE WHEN cap > weight * level THEN weight * max(CASE WHEN cap > weight * level THEN level END) OVER ({family}) ELSE cap END AS given FROM {table}_level)"""


_DEFAULT = MixConfig()


def _case(column: str, weights: Mapping[str, float]) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1.0 END AS DOUBLE)"


MIX_SQL = f"""
WITH r AS (SELECT doc_id, 'd' || (CAST(coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9])$', 1), ''), '0') AS INT) % 4) AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM r GROUP BY ALL),
d AS (SELECT domain, 0 AS root, CAST(sum(supply) * {_DEFAULT.max_epochs} AS DOUBLE) AS cap, {_case("domain", _DEFAULT.domain_weights)} AS weight,
    (SELECT floor(sum(supply) * {_DEFAULT.budget_share}) FROM leaf) AS target FROM leaf GROUP BY domain),
{_level_sql("d", "root", "domain")},
l AS (SELECT domain, lang, CAST(sum(supply) * {_DEFAULT.max_epochs} AS DOUBLE) AS cap, {_case("lang", _DEFAULT.lang_weights)} AS weight, max(given) AS target
    FROM leaf JOIN d_given USING (domain) GROUP BY domain, lang),
{_level_sql("l", "domain", "lang")},
s AS (SELECT domain, lang, source, supply, CAST(supply * {_DEFAULT.max_epochs} AS DOUBLE) AS cap, CAST(1.0 AS DOUBLE) AS weight, given AS target
    FROM leaf JOIN (SELECT domain, lang, given FROM l_given) USING (domain, lang)),
{_level_sql("s", "domain, lang", "source")},
q AS (SELECT domain, lang, source, supply, CAST(floor(given) AS BIGINT) AS quota,
    CASE WHEN supply > 0 THEN CAST(floor(given) AS BIGINT) // supply ELSE {_DEFAULT.max_epochs} END AS whole FROM s_given),
o AS (SELECT r.*, supply, quota, whole, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{_DEFAULT.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS upto
    FROM r JOIN q USING (domain, lang, source)),
t AS (SELECT *, whole + CASE WHEN quota - whole * supply > 0 AND upto <= quota - whole * supply THEN 1 ELSE 0 END AS times FROM o)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, n_tokens, supply AS leaf_supply, quota AS leaf_quota
FROM t, unnest(range(times)) AS e(epoch)
"""

"""Queries that hold estimates against a truth that comes with other stamps, gaps and missing names."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import links, truth
from loomline.plans.catalog_align import GAMMA
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

# Average discount and tax of every brand and month, stamped at the month's end; every seventh month and one brand are missing.
TRUE = {
    "tr": """SELECT last_day(date) AS period, p_brand AS asset, avg(l_discount) AS b1, avg(l_tax) AS b2 FROM lines JOIN part ON p_partkey = l_partkey
      WHERE month(date) <> 7 AND p_brand <> 'Brand#7' GROUP BY 1, 2""",
    "src": "SELECT DISTINCT period FROM panel",
    "tgt": "SELECT DISTINCT period FROM tr",
    "hits": "SELECT (SELECT count(*) FROM src SEMI JOIN tgt USING (period)) AS by_date, (SELECT count(*) FROM src s JOIN tgt t ON date_trunc('month', s.period) = date_trunc('month', t.period)) AS by_label, (SELECT count(*) FROM src) AS n",
    "pm": """SELECT s.period, t.period AS matched, CASE WHEN t.period IS NULL THEN NULL WHEN by_date < n AND by_label >= by_date THEN 'label' ELSE 'date' END AS how
      FROM src s CROSS JOIN hits LEFT JOIN tgt t ON CASE WHEN by_date < n AND by_label >= by_date THEN date_trunc('month', s.period) = date_trunc('month', t.period) ELSE s.period = t.period END""",
}


def true_betas(t: Tables):
    """(period, asset, b) summed per month and part before the join with parts."""
    month = F.last_day("date").alias("period")
    sums = t.lineitem.where(F.month("date") != 7).groupBy(month, "l_partkey").agg(F.sum("l_discount").alias("d"), F.sum("l_tax").alias("x"), F.count("*").alias("n"))
    brand = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset")).where("asset <> 'Brand#7'")
    rows = sums.join(brand, "l_partkey").groupBy("period", "asset").agg((F.sum("d") / F.sum("n")).alias("b1"), (F.sum("x") / F.sum("n")).alias("b2"))
    return rows.select("period", "asset", F.array("b1", "b2").alias("b"))


@query("matched_periods", with_ctes("panel lines", "SELECT CAST(period AS VARCHAR) AS period, CAST(matched AS VARCHAR) AS matched, how FROM pm", **TRUE))
def matched_periods(t: Tables):
    """Which stamp of the truth each panel period stands for."""
    return tidy(truth.match_periods(t.panel, true_betas(t), "M"))


@query("matched_truth", with_ctes("panel lines", """
    SELECT t_idx, CAST(p.period AS VARCHAR) AS period, p.asset, how, round(b1, 8) AS b1, round(b2, 8) AS b2
    FROM panel p JOIN pm USING (period) LEFT JOIN tr ON tr.period = pm.matched AND tr.asset = p.asset""", **TRUE))
def matched_truth(t: Tables):
    """Every panel row with its true betas, matched by date or period and by name."""
    rows = truth.matched_truth(t.panel.select("t_idx", "period", "asset"), true_betas(t), "M")
    return tidy(rows.select("t_idx", "period", "asset", "how", F.col("b")[0].alias("b1"), F.col("b")[1].alias("b2")))


@query("matched_by_position", with_ctes("panel lines", """
    SELECT a.asset, b.asset AS true_asset FROM (SELECT asset, row_number() OVER (ORDER BY asset) AS k FROM (SELECT DISTINCT asset FROM panel)) a
    LEFT JOIN (SELECT asset, row_number() OVER (ORDER BY asset) AS k FROM (SELECT DISTINCT 'x' || p_brand AS asset FROM part)) b
      ON a.k = b.k AND (SELECT count(DISTINCT asset) FROM panel) = (SELECT count(DISTINCT p_brand) FROM part)"""))
def matched_by_position(t: Tables):
    """Assets against a truth without their names, by their place in order."""
    other = t.read("part").select(F.concat(F.lit("x"), "p_brand").alias("asset"))
    return tidy(truth.match_assets(t.panel, other, ids=False))


SAMPLE = """SELECT t_idx FROM (SELECT DISTINCT t_idx FROM panel) WHERE ((SELECT max(t_idx) FROM panel) - t_idx) % 3 = 0"""
BETA_ROWS = {**TRUE, "smp": SAMPLE, "br": "SELECT t_idx, " + " + ".join(f"{g[0]} * x[{i + 1}]" for i, g in enumerate(GAMMA)) + """ AS a, b1 FROM panel p SEMI JOIN smp USING (t_idx) JOIN pm USING (period) JOIN tr ON tr.period = pm.matched AND tr.asset = p.asset""",
             "bc": "SELECT t_idx, abs(corr(a, b1)) AS first, count(*) AS n FROM br GROUP BY t_idx HAVING count(*) >= 3"}


@query("beta_canonical_corr", with_ctes("panel lines", "SELECT t_idx, round(first, 6) AS first, round(first, 6) AS mean, n FROM bc", **BETA_ROWS))
def beta_canonical_corr(t: Tables):
    """With one beta a side the canonical correlation of a period is the absolute correlation."""
    one = true_betas(t).select("period", "asset", F.slice("b", 1, 1).alias("b"))
    _, periods = truth.beta_canonical_corr(t.panel, [[g[0]] for g in GAMMA], one, 1, "M", every=3, least=5)
    return tidy(periods, 6)


@query("beta_canonical_summary", with_ctes("panel lines", """
    SELECT round(avg(first), 6) AS beta_canonical_corr, round(avg(first), 6) AS beta_canonical_corr_mean, count(*) AS n_periods, round(avg(n), 6) AS mean_n_assets FROM bc""", **BETA_ROWS))
def beta_canonical_summary(t: Tables):
    one = true_betas(t).select("period", "asset", F.slice("b", 1, 1).alias("b"))
    return tidy(truth.beta_canonical_corr(t.panel, [[g[0]] for g in GAMMA], one, 1, "M", every=3, least=5)[0], 6)




@query("topic_table", with_ctes("", """
    SELECT * FROM (
      SELECT 'T' || n_nationkey AS topic_id, n_name AS name, r_name AS "group", 'economic' AS ontology, CAST(r_regionkey AS VARCHAR) AS scope, row_number() OVER (ORDER BY r_regionkey * 100 + n_nationkey) AS "order"
      FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0
      UNION ALL SELECT 'G' || lpad(CAST(k AS VARCHAR), 3, '0'), 'Generic topic ' || lpad(CAST(k AS VARCHAR), 3, '0'), 'Generic', 'generic', '', k + (SELECT count(*) FROM nation WHERE n_nationkey % 3 <> 0)
      FROM (SELECT unnest(range(1, 13)) AS k))"""))
def topic_table(t: Tables):
    """Nations as a registry of topics, those that are economic, and twelve generic ones."""
    nation = t.read("nation").join(t.read("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    registry = nation.select(F.concat(F.lit("T"), F.col("n_nationkey")).alias("topic_id"), F.col("n_name").alias("name"), F.col("r_name").alias("group"), F.when(F.col("n_nationkey") % 3 == 0, "sector").otherwise("economic").alias("ontology"),
                             F.col("r_regionkey").alias("scope"), (F.col("r_regionkey") * 100 + F.col("n_nationkey")).alias("order"))
    return tidy(links.topic_table(registry, "economic", 12))

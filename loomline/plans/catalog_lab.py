"""Queries on links, designed attention, direct regressions and window evaluation."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions.ranking import spearman
from loomline.functions.session import bounded_list, materialise
from loomline.operators import designed, direct, links, scoring, windows
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

TRAIN_START, TRAIN_END, FORECAST = "1995-01-01", "1998-12-31", "1999-01-04"

EDGES = """
    SELECT *, CASE WHEN rank = 1 THEN 'strong' WHEN rank <= 3 THEN 'moderate' WHEN rank <= 6 THEN 'weak' END AS tier FROM (
      SELECT n_name AS topic, p_brand AS asset, sum(l_quantity) AS qty,
        CASE WHEN avg(l_discount - l_tax) >= 0.0101 THEN 1 ELSE -1 END AS sign,
        row_number() OVER (PARTITION BY n_name ORDER BY sum(l_quantity) DESC, p_brand) AS rank
      FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey
      GROUP BY 1, 2)"""
LINKS = "SELECT topic, asset, tier, sign, 'default' AS origin FROM edges WHERE tier IS NOT NULL"
WEIGHTS = "SELECT topic, asset, sign * CASE tier WHEN 'strong' THEN 0.35 WHEN 'moderate' THEN 0.15 ELSE 0.05 END AS w FROM links"
LINKED = {"edges": EDGES, "links": LINKS, "wts": WEIGHTS}


def edges(t: Tables):
    """Supplier nation x brand edges with traded quantity, summed per supplier and part before the joins."""
    sums = t.read("lineitem").groupBy("l_suppkey", "l_partkey").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_discount") - F.col("l_tax")).alias("d"), F.count("*").alias("n"))
    nation = t.read("nation").select("n_nationkey", F.col("n_name").alias("topic"))
    supplier = t.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    part = t.read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("asset"))
    joined = sums.join(supplier, "l_suppkey").join(nation, "n_nationkey").join(part, "l_partkey")
    pairs = joined.groupBy("topic", "asset").agg(F.sum("q").alias("qty"), (F.sum("d") / F.sum("n")).alias("tilt"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("qty"), "asset"))
    tier = F.when(F.col("rank") == 1, "strong").when(F.col("rank") <= 3, "moderate").when(F.col("rank") <= 6, "weak")
    return pairs.withColumn("rank", rank).select(
        "topic", "asset", "qty", F.when(F.col("tilt") >= 0.0101, 1).otherwise(-1).alias("sign"), "rank", tier.alias("tier"))


def link_map(t: Tables):
    return edges(t).where("tier IS NOT NULL").select("topic", "asset", "tier", "sign", F.lit("default").alias("origin"))


@query("link_map", with_ctes("", "SELECT topic, asset, tier, CAST(sign AS BIGINT) AS sign, origin FROM links", edges=EDGES, links=LINKS))
def link_map_query(t: Tables):
    return tidy(link_map(t))


@query("design_matrix", with_ctes("", """
    SELECT t.topic, a.asset, coalesce(w.w, 0) AS w FROM (SELECT DISTINCT topic FROM links) t
    CROSS JOIN (SELECT DISTINCT p_brand AS asset FROM part) a LEFT JOIN wts w ON w.topic = t.topic AND w.asset = a.asset""", **LINKED)
    .replace("coalesce(w.w, 0) AS w", "CAST(coalesce(w.w, 0) AS DOUBLE) AS w"))
def design_matrix(t: Tables):
    table = materialise(link_map(t), "links")
    topics = bounded_list(table, "topic")
    brands = t.read("part").select(F.col("p_brand").alias("asset")).distinct()
    return tidy(links.dense_pairs(links.design_weights(table), topics, brands))


@query("design_two_tiers", with_ctes("", """
    SELECT topic, asset, CAST(sign * CASE tier WHEN 'strong' THEN 0.35 ELSE 0.15 END AS DOUBLE) AS w FROM links""", **LINKED))
def design_two_tiers(t: Tables):
    return tidy(links.design_weights(link_map(t), 2))


@query("link_overrides", with_ctes("", """
    SELECT coalesce(l.topic, o.topic) AS topic, coalesce(l.asset, o.asset) AS asset, coalesce(o.tier, l.tier) AS tier,
      CAST(coalesce(o.sign, l.sign) AS BIGINT) AS sign, CASE WHEN o.tier IS NOT NULL THEN 'override' ELSE l.origin END AS origin
    FROM links l FULL JOIN (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY topic, asset ORDER BY seq DESC) = 1) o
      ON o.topic = l.topic AND o.asset = l.asset
    WHERE coalesce(o.tier, l.tier) <> 'none'""", edges=EDGES, links=LINKS, ov="""
    SELECT topic, asset, CASE WHEN rank IN (1, 25) THEN 'none' ELSE 'weak' END AS tier, -sign AS sign, rank AS seq FROM edges WHERE rank IN (1, 2, 9, 25)"""))
def link_overrides(t: Tables):
    """Edits that remove the first, flip the second and add the ninth pair of every topic."""
    base = materialise(edges(t), "edges")
    edits = base.where("rank IN (1, 2, 9, 25)").select(
        "topic", "asset", F.when(F.col("rank").isin(1, 25), "none").otherwise("weak").alias("tier"), (-F.col("sign")).alias("sign"), F.col("rank").alias("seq"))
    outside = edits.limit(1).select(F.lit("NOWHERE").alias("topic"), "asset", "tier", "sign", "seq")
    table = base.where("tier IS NOT NULL").select("topic", "asset", "tier", "sign", F.lit("default").alias("origin"))
    return tidy(links.apply_overrides(table, edits.unionByName(outside), base.select("topic").distinct(), base.select("asset").distinct()))


@query("group_rollup", with_ctes("", """
    SELECT r_name AS "group", asset, sum(qty) AS qty FROM edges JOIN nation ON n_name = topic JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""", edges=EDGES))
def group_rollup(t: Tables):
    groups = t.read("nation").join(t.read("region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select(
        F.col("n_name").alias("topic"), F.col("r_name").alias("group"))
    return tidy(links.roll_up(edges(t), groups, "qty", "asset"))


@query("topk_other_bucket", with_ctes("", """
    SELECT topic, asset, sum(qty) AS qty, count(*) AS n FROM (
      SELECT topic, CASE WHEN rank <= 5 THEN asset ELSE 'other' END AS asset, qty FROM edges) GROUP BY 1, 2""", edges=EDGES))
def topk_other_bucket(t: Tables):
    return tidy(links.top_with_rest(edges(t).select("topic", "asset", "qty"), "asset", "qty", 5, "topic"))


@query("random_link_map")
def random_link_map(t: Tables):
    """Seeded links of a share of the nations."""
    nations = t.read("nation").select(F.col("n_name").alias("topic"))
    return links.share_with_signal(links.random_links(nations, t.assets), 0.2)


STD = "SELECT date, asset, (ret - avg(ret) OVER w) / coalesce(nullif(stddev_pop(ret) OVER w, 0), 1) AS rt FROM rets WINDOW w AS (PARTITION BY asset)"


@query("standardised_returns", with_ctes("rets", "SELECT CAST(date AS VARCHAR) AS date, asset, round(rt, 7) AS rt FROM std", std=STD))
def standardised_returns(t: Tables):
    return tidy(designed.standardise(t.returns), 7)


SIGNAL = {**LINKED, "std": STD, "sig": """
    SELECT c.date, c.pos, t.topic, coalesce(p.p, 0) AS p FROM cal c CROSS JOIN (SELECT DISTINCT topic FROM links) t
    LEFT JOIN (SELECT d.pos - {lead} AS pos, topic, sum(w * greatest(-8, least(8, rt))) AS p FROM std JOIN cal d USING (date) JOIN wts USING (asset) GROUP BY 1, 2) p
      ON p.pos = c.pos AND p.topic = t.topic"""}


def with_lead(lead: int) -> dict[str, str]:
    return {**SIGNAL, "sig": SIGNAL["sig"].format(lead=lead)}


def lab_design(t: Tables):
    table = materialise(link_map(t), "links")
    topics = bounded_list(table, "topic")
    std = materialise(designed.standardise(t.returns), "standardised")
    return std, materialise(links.design_weights(table), "weights"), topics


@query("designed_signal", with_ctes("rets cal", "SELECT CAST(date AS VARCHAR) AS date, pos, topic, round(p, 8) AS p FROM sig", **with_lead(1)))
def designed_signal(t: Tables):
    std, weights, topics = lab_design(t)
    return tidy(designed.designed_signal(std, weights, t.calendar, topics))


@query("design_feasibility", with_ctes("rets cal", """
    SELECT topic, round(q, 8) AS q, round(scale, 8) AS scale, round(sqrt(greatest(1 - q * scale * scale, 0.9)), 8) AS sigma_u
    FROM (SELECT topic, var_pop(p) AS q, CASE WHEN var_pop(p) > 0.1 THEN sqrt(0.1 / var_pop(p)) ELSE 1 END AS scale FROM sig GROUP BY topic)""", **with_lead(0)))
def design_feasibility(t: Tables):
    std, weights, topics = lab_design(t)
    return tidy(designed.feasibility(std, weights, t.calendar, topics, designed.DesignConfig(cap=0.1)))


def lab_world(t: Tables, cfg=designed.DesignConfig()):
    """Designed attention on the observed returns with its scaling and signal."""
    std, weights, topics = lab_design(t)
    scaling = materialise(designed.feasibility(std, weights, t.calendar, topics, cfg), "scaling")
    scaled = weights.join(scaling.select("topic", "scale"), "topic").select("topic", "asset", (F.col("w") * F.col("scale")).alias("w"))
    signal = materialise(designed.designed_signal(std, scaled, t.calendar, topics, cfg), "signal")
    attention = materialise(designed.designed_attention(signal, scaling, cfg), "designed")
    return std, weights, topics, scaling, signal, attention


@query("designed_attention")
def designed_attention(t: Tables):
    return lab_world(t)[-1]


@query("population_sensitivities")
def population_sensitivities(t: Tables):
    std, _, topics, scaling, signal, _ = lab_world(t)
    return designed.population_sensitivities(signal, scaling, std, t.calendar, topics, 5)


def lab_pairs(t: Tables, attention=None, topics=None, lead: int = 1):
    """Scaled shocks by return day and the returns they are paired with."""
    from loomline.operators.shocks import attention_shocks

    shocks = t.shocks if attention is None else attention_shocks(attention, t.calendar, 5)
    scaled = designed.scale_on_window(shocks, TRAIN_START, TRAIN_END)
    by_day, usable = designed.lead_pairs(t.returns, scaled, t.calendar, len(topics or t.topics), lead)
    return materialise(by_day, "paired_shocks"), materialise(usable, "paired_returns")


PAIRS = {
    "scl": f"""SELECT topic, coalesce(nullif(stddev_pop(z) FILTER (WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_END}'), 0), 1) AS scale FROM shk GROUP BY topic""",
    "sday": "SELECT c.date, s.date AS shock_day, s.topic, s.z / k.scale AS s FROM shk s SEMI JOIN okday o ON o.date = s.date JOIN scl k ON k.topic = s.topic JOIN cal c ON c.pos = s.pos + 1",
    "usable": "SELECT r.date, u.shock_day, r.asset, r.ret FROM rets r JOIN (SELECT DISTINCT date, shock_day FROM sday) u USING (date)",
    "train": f"SELECT * FROM usable WHERE shock_day >= DATE '{TRAIN_START}' AND date <= DATE '{TRAIN_END}'",
    "rsc": "SELECT asset, avg(ret) AS mean, coalesce(nullif(stddev_pop(ret), 0), 1) AS scale, count(*) AS n_train FROM train GROUP BY asset",
    "coef": """SELECT asset, topic, regr_slope((ret - mean) / scale, s) AS b FROM train JOIN sday USING (date) JOIN rsc USING (asset) GROUP BY 1, 2""",
    "fitd": """SELECT date, asset, ret, scale * sum(s * b) AS fitted FROM usable JOIN sday USING (date) JOIN coef USING (asset, topic) JOIN rsc USING (asset)
        GROUP BY date, asset, ret, scale""",
}
PAIR_CTES = "rets shk okday cal"


def slopes(by_day, usable, condition):
    """One-topic slopes of standardised returns; a transparent coefficient table for the window queries."""
    rows = usable.where(condition)
    stats = rows.groupBy("asset").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.count("*").alias("n_train"))
    scale = stats.select("asset", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("scale"), "n_train")
    y = (F.col("ret") - F.col("mean")) / F.col("scale")
    long = rows.join(by_day.select("date", "topic", "s"), "date").join(scale, "asset")
    return long.groupBy("asset", "topic").agg(F.regr_slope(y, F.col("s")).alias("b")), scale


@cache
def train_condition():
    return F.expr(f"shock_day >= DATE '{TRAIN_START}' AND date <= DATE '{TRAIN_END}'")


@query("observed_shock_scale", with_ctes(PAIR_CTES, "SELECT topic, round(scale, 8) AS scale FROM scl", **{k: PAIRS[k] for k in ["scl"]}))
def observed_shock_scale(t: Tables):
    scaled = designed.scale_on_window(t.shocks, TRAIN_START, TRAIN_END)
    return tidy(scaled.groupBy("topic").agg(F.max("scale").alias("scale")))


@query("training_pairs", with_ctes(PAIR_CTES, """
    SELECT asset, count(*) AS n_train, CAST(min(shock_day) AS VARCHAR) AS first_shock_day, CAST(max(date) AS VARCHAR) AS last_return_day,
      round(avg(ret), 9) AS mean FROM train GROUP BY asset""", **PAIRS))
def training_pairs(t: Tables):
    _, usable = lab_pairs(t)
    return tidy(usable.where(train_condition()).groupBy("asset").agg(
        F.count("*").alias("n_train"), F.min("shock_day").alias("first_shock_day"), F.max("date").alias("last_return_day"), F.avg("ret").alias("mean")), 9)


@query("direct_ols_one_topic", with_ctes(PAIR_CTES, """
    SELECT asset, topic, CASE WHEN count(*) >= 20 THEN round(regr_slope((ret - mean) / scale, s), 8) ELSE 0.0 END AS b,
      CASE WHEN count(*) >= 20 THEN round(regr_intercept((ret - mean) / scale, s), 8) ELSE 0.0 END AS intercept, count(*) AS n_train
    FROM train JOIN sday USING (date) JOIN rsc USING (asset) WHERE topic = '1-URGENT' GROUP BY 1, 2""", **PAIRS))
def direct_ols_one_topic(t: Tables):
    """Least squares on one topic through the cross-product route."""
    by_day, usable = lab_pairs(t)
    topic = by_day.where("topic = '1-URGENT'")
    rows, scale = direct.training_rows(topic, usable, ["1-URGENT"], TRAIN_START, TRAIN_END)
    return tidy(direct.fit_direct(rows, scale, ["1-URGENT"], direct.DirectConfig(method="ols")).select("asset", "topic", "b", "intercept", "n_train"))


@query("direct_ridge_one_topic", with_ctes(PAIR_CTES, """
    SELECT asset, topic, CASE WHEN count(*) >= 20 THEN round(covar_pop((ret - mean) / scale, s) / (var_pop(s) + 0.1), 8) ELSE 0.0 END AS b, count(*) AS n_train
    FROM train JOIN sday USING (date) JOIN rsc USING (asset) WHERE topic = '1-URGENT' GROUP BY 1, 2""", **PAIRS))
def direct_ridge_one_topic(t: Tables):
    by_day, usable = lab_pairs(t)
    rows, scale = direct.training_rows(by_day.where("topic = '1-URGENT'"), usable, ["1-URGENT"], TRAIN_START, TRAIN_END)
    return tidy(direct.fit_direct(rows, scale, ["1-URGENT"], direct.DirectConfig(method="ridge", ridge_lambda=0.1)).select("asset", "topic", "b", "n_train"))


@query("direct_lasso_one_topic", with_ctes(PAIR_CTES, """
    SELECT asset, topic, CASE WHEN abs(c) > 0.009 AND n_train >= 20 THEN round(sign(c) * (abs(c) - 0.009) / (v + 0.001), 6) ELSE 0 END AS b, n_train FROM (
      SELECT asset, topic, covar_pop((ret - mean) / scale, s) AS c, var_pop(s) AS v, count(*) AS n_train
      FROM train JOIN sday USING (date) JOIN rsc USING (asset) WHERE topic = '1-URGENT' GROUP BY 1, 2)""", **PAIRS)
    .replace("ELSE 0 END AS b", "ELSE 0.0 END AS b"))
def direct_lasso_one_topic(t: Tables):
    """Elastic net with one topic has a closed form."""
    by_day, usable = lab_pairs(t)
    rows, scale = direct.training_rows(by_day.where("topic = '1-URGENT'"), usable, ["1-URGENT"], TRAIN_START, TRAIN_END)
    cfg = direct.DirectConfig(penalty="fixed", alpha=0.01)
    return tidy(direct.fit_direct(rows, scale, ["1-URGENT"], cfg).select("asset", "topic", "b", "n_train"), 6)


def direct_all(t: Tables, cfg: direct.DirectConfig):
    by_day, usable = lab_pairs(t)
    rows, scale = direct.training_rows(by_day, usable, t.topics, TRAIN_START, TRAIN_END)
    return direct.fit_direct(rows, scale, t.topics, cfg)


# All five topics at once, solved in SQL from the covariances of one row per asset.
TOPICS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FIVE = range(1, 6)
WIDE = {
    **PAIRS,
    "xs": "SELECT date, " + ", ".join(f"max(CASE WHEN topic = '{v}' THEN s END) AS x{i}" for i, v in zip(FIVE, TOPICS)) + " FROM sday GROUP BY date",
    "w": "SELECT asset, (ret - mean) / scale AS y, " + ", ".join(f"x{i}" for i in FIVE) + " FROM train JOIN xs USING (date) JOIN rsc USING (asset)",
    "m": "SELECT asset, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, " + ", ".join(f"avg(x{i}) AS m{i}, covar_pop(x{i}, y) AS c{i}" for i in FIVE) + ", "
         + ", ".join(f"covar_pop(x{i}, x{j}) AS g{i}{j}" for i in FIVE for j in FIVE) + " FROM w GROUP BY asset",
}


def _elimination(source: str, keys: str, extra: int) -> dict[str, str]:
    """Gauss-Jordan steps e1 to e5 on the columns a11 to a5(5 + extra) of ``source``."""
    out, last = {}, source
    for k in FIVE:
        cells = [f"a{k}{c} / a{k}{k} AS a{k}{c}" if r == k else f"a{r}{c} - a{r}{k} * a{k}{c} / a{k}{k} AS a{r}{c}" for r in FIVE for c in range(k + 1, 6 + extra)]
        out[f"e{k}"] = f"SELECT {keys}, {', '.join(cells)} FROM {last}"
        last = f"e{k}"
    return out


def _by_topic(cells: str, table: str) -> str:
    """One row per topic of a table with columns b1 to b5."""
    return " UNION ALL ".join(f"SELECT asset, '{v}' AS topic, b{i} AS b, {cells} FROM {table}" for i, v in zip(FIVE, TOPICS))


DOT = " + ".join(f"m{i} * b{i}" for i in FIVE)
OLS = {**WIDE, "e0": "SELECT asset, " + ", ".join(f"g{i}{j} AS a{i}{j}" for i in FIVE for j in FIVE) + ", " + ", ".join(f"c{i} AS a{i}6" for i in FIVE) + " FROM m",
       **_elimination("e0", "asset", 1), "b": "SELECT asset, n, " + ", ".join(f"a{i}6 AS b{i}" for i in FIVE) + ", m.* EXCLUDE (asset, n) FROM e5 JOIN m USING (asset)",
       "long": _by_topic(f"my - ({DOT}) AS intercept, n AS n_train", "b")}
# The inverse stands in columns 7 to 11, so that effective degrees of freedom can be read off.
RIDGE = {**WIDE, "lams": "SELECT k, pow(10, -4 + 5.0 * k / 29) AS lam FROM range(30) AS r(k)",
         "e0": "SELECT asset, k, " + ", ".join(f"g{i}{j}" + (" + lam" if i == j else "") + f" AS a{i}{j}" for i in FIVE for j in FIVE) + ", " + ", ".join(f"c{i} AS a{i}6" for i in FIVE) + ", "
               + ", ".join(f"{1.0 if i == j else 0.0}::DOUBLE AS a{i}{6 + j}" for i in FIVE for j in FIVE) + " FROM m CROSS JOIN lams",
         **_elimination("e0", "asset, k", 6),
         "b": "SELECT asset, k, lam, n, my, vy, " + ", ".join(f"a{i}6 AS b{i}, m{i}, c{i}" for i in FIVE) + ", 1 + " + " + ".join(f"a{i}{6 + j} * g{j}{i}" for i in FIVE for j in FIVE)
              + " AS df, " + " + ".join(f"a{i}6 * a{j}6 * g{i}{j}" for i in FIVE for j in FIVE) + " AS bgb FROM e5 JOIN m USING (asset) JOIN lams USING (k)",
         "best": "SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY asset ORDER BY (vy - 2 * (" + " + ".join(f"b{i} * c{i}" for i in FIVE) + ") + bgb) / (1 - df / n) ** 2, k) = 1",
         "long": _by_topic(f"my - ({DOT}) AS intercept, n AS n_train, lam AS penalty", "best")}


def _descent(sweeps: int = 300) -> str:
    """Coordinate descent, one recursion step for each sweep over the five coefficients."""
    inner = "SELECT d.asset, d.step + 1 AS step, " + ", ".join(f"d.b{i}" for i in FIVE) + ", m.* EXCLUDE (asset), sqrt(2 * ln(5) / n) AS al FROM cd d JOIN m ON m.asset = d.asset WHERE d.step < " + str(sweeps)
    for i in FIVE:
        pull = f"c{i} - (" + " + ".join(f"g{i}{j} * b{j}" for j in FIVE if j != i) + ")"
        inner = f"SELECT * REPLACE (sign({pull}) * greatest(abs({pull}) - 0.9 * al, 0) / (g{i}{i} + 0.1 * al) AS b{i}) FROM ({inner})"
    cols = "asset, step, " + ", ".join(f"b{i}" for i in FIVE)
    return f"SELECT asset, 0 AS step, " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in FIVE) + f" FROM m UNION ALL SELECT {cols} FROM ({inner})"


NET = {**WIDE, "cd": _descent(), "last": "SELECT cd.*, n, my, " + ", ".join(f"m{i}" for i in FIVE) + " FROM cd JOIN m USING (asset) WHERE step = 300",
       "long": _by_topic(f"my - ({DOT}) AS intercept, n AS n_train, sqrt(2 * ln(5) / n) AS penalty", "last")}


@query("elastic_net", with_ctes(PAIR_CTES, """
    SELECT asset, topic, round(b, 6) AS b, round(intercept, 6) AS intercept, round(penalty, 6) AS penalty, n_train, b <> 0 AS selected FROM long""", **NET)
    .replace("WITH ", "WITH RECURSIVE ", 1))
def elastic_net(t: Tables):
    return tidy(direct_all(t, direct.DirectConfig()).select("asset", "topic", "b", "intercept", "penalty", "n_train", "selected"), 6)


@query("elastic_net_cv")
def elastic_net_cv(t: Tables):
    return direct_all(t, direct.DirectConfig(penalty="cv"))


@query("ridge_gcv", with_ctes(PAIR_CTES, """
    SELECT asset, topic, round(b, 6) AS b, round(intercept, 6) AS intercept, round(penalty, 6) AS penalty, n_train, abs(b) >= 0.05 AS selected FROM long""", **RIDGE))
def ridge_gcv(t: Tables):
    return tidy(direct_all(t, direct.DirectConfig(method="ridge")).select("asset", "topic", "b", "intercept", "penalty", "n_train", "selected"), 6)


@query("direct_ols", with_ctes(PAIR_CTES, """
    SELECT asset, topic, round(b, 7) AS b, round(intercept, 7) AS intercept, n_train, abs(b) >= 0.05 AS selected FROM long""", **OLS))
def direct_ols(t: Tables):
    return tidy(direct_all(t, direct.DirectConfig(method="ols")).select("asset", "topic", "b", "intercept", "n_train", "selected"), 7)


WINDOW = f"date >= DATE '{FORECAST}' AND date < DATE '{FORECAST}' + 84"
SUMS = {**PAIRS, "win": f"SELECT * FROM usable WHERE {WINDOW}", "sums": """
    SELECT asset, topic, count(*) AS n, sum(ret) AS sr, sum(s) AS ss, sum(ret * s) AS srs, sum(ret * ret) AS srr, corr(ret, s) AS c
    FROM win JOIN sday USING (date) GROUP BY 1, 2"""}


def window_sums(t: Tables):
    by_day, usable = lab_pairs(t)
    return by_day, usable, windows.pair_sums(by_day, windows.forecast_days(usable, FORECAST, 12))


@query("masked_corr", with_ctes(PAIR_CTES, "SELECT asset, topic, CASE WHEN n >= 3 THEN round(greatest(-1, least(1, c)), 7) END AS corr FROM sums", **SUMS))
def masked_corr(t: Tables):
    return tidy(windows.masked_correlation(window_sums(t)[2]), 7)


@query("contributions", with_ctes(PAIR_CTES, """
    SELECT asset, topic, round(scale * b * ss, 8) AS contrib, round(scale * b * srs / srr, 8) AS var_share, round(sr, 8) AS realized
    FROM sums JOIN coef USING (asset, topic) JOIN rsc USING (asset)""", **SUMS))
def contributions(t: Tables):
    by_day, usable, sums = window_sums(t)
    b, scale = slopes(by_day, usable, train_condition())
    return tidy(windows.contributions(sums, b, scale))


@query("explained_returns", with_ctes(PAIR_CTES, """
    SELECT asset, round(max(sr), 8) AS realized, round(sum(scale * b * ss), 8) AS explained, round(max(sr) - sum(scale * b * ss), 8) AS residual
    FROM sums JOIN coef USING (asset, topic) JOIN rsc USING (asset) GROUP BY asset""", **SUMS))
def explained_returns(t: Tables):
    by_day, usable, sums = window_sums(t)
    b, scale = slopes(by_day, usable, train_condition())
    return tidy(windows.explained(windows.contributions(sums, b, scale)))


def fitted(t: Tables):
    by_day, usable = lab_pairs(t)
    b, scale = slopes(by_day, usable, train_condition())
    return windows.fitted_days(by_day, usable, b, scale, t.topics)


@query("window_r2", with_ctes(PAIR_CTES, f"""
    SELECT asset, round(1 - sum((ret - fitted) ** 2) / nullif(sum(ret * ret), 0), 8) AS r2 FROM fitd WHERE {WINDOW} GROUP BY asset""", **PAIRS))
def window_r2(t: Tables):
    return tidy(windows.window_r2(windows.forecast_days(fitted(t), FORECAST, 12), "asset").select("asset", "r2"))


@query("median_r2", with_ctes(PAIR_CTES, f"""
    SELECT round(median(r2), 8) AS median_r2, round(1 - sum(sse) / sum(sst), 8) AS pooled_r2 FROM (
      SELECT asset, 1 - sum((ret - fitted) ** 2) / sum(ret * ret) AS r2, sum((ret - fitted) ** 2) AS sse, sum(ret * ret) AS sst
      FROM fitd WHERE {WINDOW} GROUP BY asset)""", **PAIRS))
def median_r2(t: Tables):
    return tidy(windows.median_r2(windows.window_r2(windows.forecast_days(fitted(t), FORECAST, 12), "asset")))


@query("window_sweep", with_ctes(PAIR_CTES, f"""
    SELECT d.k AS "window", CAST(DATE '{FORECAST}' + CAST(d.k * 28 AS INTEGER) AS VARCHAR) AS start,
      CAST(DATE '{FORECAST}' + CAST(d.k * 28 + 27 AS INTEGER) AS VARCHAR) AS "end", d.n_days,
      round(median(r2), 8) AS median_r2, round(1 - sum(sse) / sum(sst), 8) AS pooled_r2
    FROM (SELECT k, count(*) AS n_days FROM wd GROUP BY k) d LEFT JOIN (
      SELECT k, asset, 1 - sum((ret - fitted) ** 2) / sum(ret * ret) AS r2, sum((ret - fitted) ** 2) AS sse, sum(ret * ret) AS sst
      FROM fitd JOIN wd USING (date) GROUP BY 1, 2) f ON f.k = d.k GROUP BY d.k, d.n_days""",
    **PAIRS, wd=f"""
    SELECT date, k FROM (SELECT date, CAST(floor((date - DATE '{FORECAST}') / 28.0) AS BIGINT) AS k FROM cal WHERE date >= DATE '{FORECAST}')
    WHERE DATE '{FORECAST}' + CAST((k + 1) * 28 - 1 AS INTEGER) <= (SELECT max(date) FROM cal)"""))
def window_sweep(t: Tables):
    return tidy(windows.window_sweep(fitted(t), t.calendar, FORECAST, 4))


def recovery_pairs(t: Tables):
    """Training slopes as estimates against the slopes of the later days as truth."""
    by_day, usable = lab_pairs(t)
    b, _ = slopes(by_day, usable, train_condition())
    later, _ = slopes(by_day, usable, F.col("date") >= F.lit(FORECAST).cast("date"))
    pairs = b.join(later.select("asset", "topic", F.col("b").alias("b_true")), ["asset", "topic"])
    return pairs.withColumn("w", F.when(F.abs("b_true") >= 0.04, F.signum("b_true")).otherwise(0.0)).withColumn("selected", F.abs("b") >= 0.02)


RECOVERY = {**PAIRS, "late": f"SELECT * FROM usable WHERE date >= DATE '{FORECAST}'",
    "lsc": "SELECT asset, avg(ret) AS mean, coalesce(nullif(stddev_pop(ret), 0), 1) AS scale FROM late GROUP BY asset",
    "truth": "SELECT asset, topic, regr_slope((ret - mean) / scale, s) AS b_true FROM late JOIN sday USING (date) JOIN lsc USING (asset) GROUP BY 1, 2",
    "rp": "SELECT asset, topic, b, b_true, abs(b) >= 0.02 AS sel, abs(b_true) >= 0.03 AS ex, abs(b_true) >= 0.04 AS linked FROM coef JOIN truth USING (asset, topic)"}


@query("recovery_metrics", with_ctes(PAIR_CTES, """
    SELECT n_linked, round(hit / n_linked, 8) AS coverage, round(agree / hit, 8) AS sign_agreement,
      round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 8) AS mcc, round(rmse, 8) AS rmse,
      tp + fp AS n_selected, tp + fn AS n_exposed
    FROM (SELECT CAST(count(*) FILTER (WHERE linked) AS DOUBLE) AS n_linked, count(*) FILTER (WHERE linked AND sel) AS hit,
            CAST(count(*) FILTER (WHERE linked AND sel AND sign(b) = sign(b_true)) AS DOUBLE) AS agree,
            CAST(count(*) FILTER (WHERE sel AND ex) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE sel AND NOT ex) AS DOUBLE) AS fp,
            CAST(count(*) FILTER (WHERE NOT sel AND ex) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE NOT sel AND NOT ex) AS DOUBLE) AS tn,
            sqrt(avg((b - b_true) ** 2)) AS rmse FROM rp)""", **RECOVERY))
def recovery_metrics(t: Tables):
    return tidy(windows.recovery(recovery_pairs(t), 0.03))


@query("spearman_pairs", with_ctes(PAIR_CTES, """
    SELECT round(corr(ra, rb), 8) AS spearman FROM (
      SELECT rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS ra,
        rank() OVER (ORDER BY b_true) + (count(*) OVER (PARTITION BY b_true) - 1) / 2 AS rb FROM rp)""", **RECOVERY))
def spearman_pairs(t: Tables):
    return tidy(spearman(recovery_pairs(t), "b", "b_true"))


@query("spearman_ties", """
    SELECT round(corr(ra, rb), 8) AS spearman FROM (
      SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra,
        rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS rb FROM lineitem)""")
def spearman_ties(t: Tables):
    """Rank correlation of heavily tied columns over every line."""
    return tidy(spearman(t.read("lineitem"), "l_quantity", "l_discount"))


@query("lab_comparison")
def lab_comparison(t: Tables):
    """Direct methods on designed attention with known sensitivities, scored on the same days."""
    from loomline.functions.session import shared_folder
    from loomline.plans.lab import LabConfig, LabSession

    _, weights, topics = lab_design(t)
    cfg = LabConfig(train_start=TRAIN_START, train_end=TRAIN_END, forecast_start=FORECAST, forecast_weeks=12)
    lab = LabSession(t.spark, f"{shared_folder(t.spark)}/loomline/lab-{uuid.uuid4().hex}", t.returns, weights, t.calendar, topics, cfg)
    return lab.compare(("elastic_net", "ridge", "ols", "oracle"))


@query("pairwise_corr", with_ctes("shk", """
    SELECT a.topic AS a, b.topic AS b, CASE WHEN count(*) >= 3 THEN round(corr(a.z, b.z), 8) END AS corr, round(covar_pop(a.z, b.z), 7) AS cov, count(*) AS n
    FROM shk a JOIN shk b ON a.date = b.date AND a.topic < b.topic WHERE a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY 1, 2"""))
def pairwise_corr(t: Tables):
    return tidy(scoring.pairwise_correlation(t.shocks, "date", "topic", "z", t.topics), 8, cov=7)


@query("observation_groups", with_ctes("rets", """
    SELECT asset, min(asset) OVER (PARTITION BY s) AS leader, count(*) OVER (PARTITION BY s) AS members, n_days, first_day FROM (
      SELECT asset, list(date ORDER BY date) AS s, count(*) AS n_days, CAST(min(date) AS VARCHAR) AS first_day FROM rets GROUP BY asset)"""))
def observation_groups(t: Tables):
    return tidy(scoring.observation_groups(t.returns, "asset", "date"))


def weekly_world(t: Tables):
    """Weekly panel on training-scaled returns with attention lagged by the lead, its fit and pieces."""
    from loomline.operators import align, factor_model, kernel, moments, panel, shocks, tuning, weekly

    cal = t.calendar_of("W")
    att = align.lag_attention(t.attention, cal, 1)
    shock_rows = materialise(shocks.attention_shocks(att, cal, 5), "weekly_shocks")
    divisor = materialise(weekly.training_divisor(t.returns, shocks.complete_days(shock_rows, len(t.topics)), TRAIN_END), "divisor")
    rets = materialise(weekly.scale_returns(t.returns, divisor), "scaled_returns")
    cfg = kernel.KernelConfig(xi=weekly.half_life_decay(69 * 52 / 12), burn_in=52)
    cov = kernel.kernel_covariance(rets, shock_rows, cal, len(t.topics), cfg)
    rows = materialise(panel.build_panel(kernel.pack_topics(cov, t.topics), align.period_returns(rets, cal), cfg.burn_in, 12), "weekly_panel")
    train = moments.period_moments(weekly.training_rows(rows, TRAIN_START, TRAIN_END))
    tune = tuning.TuneConfig(tolerance=0.02, annualization=weekly.WEEKS_PER_YEAR)
    _, fit = tuning.tune_model(train, factor_model.FitConfig(ratio=1e-2), tune)
    return rows, fit, divisor, shock_rows, cal, cfg


@query("weekly_training_divisor", with_ctes("rets shk okday cal", f"""
    SELECT asset, round(stddev_pop(ret), 9) AS scale FROM rets r
    JOIN (SELECT d.date FROM okday o JOIN cal c ON c.date = o.date JOIN cal d ON d.pos = c.pos + 1) k ON k.date = r.date
    WHERE r.date <= DATE '{TRAIN_END}' GROUP BY asset HAVING stddev_pop(ret) > 0"""))
def weekly_training_divisor(t: Tables):
    """Training deviation of each asset over the days paired with a lagged shock."""
    from loomline.operators import align, shocks, weekly

    moved = align.lag_attention(t.attention, t.calendar, 1)
    days = shocks.complete_days(shocks.attention_shocks(moved, t.calendar, 5), len(t.topics))
    return tidy(weekly.training_divisor(t.returns, days, TRAIN_END), 9)


@query("weekly_history_share", with_ctes("wcal", f"""
    SELECT round(sum(CASE WHEN date < DATE '1997-01-06' THEN w ELSE 0 END) / sum(w), 9) AS share FROM (
      SELECT date, pow(0.99, 200 - period_id) AS w FROM wcal WHERE period_id < 200 OR (period_id = 200 AND back > 1))"""))
def weekly_history_share(t: Tables):
    from loomline.operators import kernel, weekly

    return tidy(weekly.history_share(t.calendar_of("W"), 200, "1997-01-06", kernel.KernelConfig()), 9)


@query("weekly_training_weeks", with_ctes("wcal", f"""
    SELECT count(*) FILTER (WHERE ins) AS n_weeks, count(*) FILTER (WHERE ins AND period_id > 52) AS n_usable,
      CAST(min(f) FILTER (WHERE ins AND period_id > 52) AS VARCHAR) AS first_usable
    FROM (SELECT period_id, min(date) AS f, min(date) >= DATE '{TRAIN_START}' AND max(date) <= DATE '{TRAIN_END}' AS ins FROM wcal GROUP BY period_id)"""))
def weekly_training_weeks(t: Tables):
    from loomline.operators import weekly

    return tidy(weekly.training_weeks(t.calendar_of("W"), TRAIN_START, TRAIN_END, 52))


@query("weekly_forecast")
def weekly_forecast(t: Tables):
    """Out-of-sample fit of the weekly factor model per asset and on shuffled instruments."""
    from loomline.operators import weekly

    rows, fit, *_ = weekly_world(t)
    scores = weekly.forecast_scores(weekly.forecast(rows, fit, FORECAST, "1999-03-28"))
    shuffled = weekly.shuffle_reference(rows, fit, FORECAST, "1999-03-28")
    every = Window.partitionBy()
    pooled = 1 - F.sum("sse").over(every) / F.sum("sst").over(every)
    return scores.withColumn("pooled", pooled).withColumn("r2_shuffled", F.lit(shuffled.first()[0]))


@query("implied_sensitivities")
def implied_sensitivities(t: Tables):
    """Sensitivities implied by the weekly factor model, in the units of the direct regressions."""
    from loomline.operators import weekly

    rows, fit, divisor, shock_rows, *_ = weekly_world(t)
    return weekly.implied_sensitivities(rows, fit, shock_rows, return_units(t, divisor), t.topics, TRAIN_START, TRAIN_END)


def return_units(t: Tables, divisor):
    """The panel's divisor of every asset next to the training deviation that the direct regressions divide by."""
    by_day, usable = lab_pairs(t)
    _, scale = direct.training_rows(by_day, usable, t.topics, TRAIN_START, TRAIN_END)
    return divisor.select("asset", F.col("scale").alias("divisor")).join(scale.select("asset", F.col("scale").alias("ret_scale")), "asset")


@query("harness_run")
def harness_run(t: Tables):
    """All seeds of a signal and a null scenario on designed attention, with pass flags."""
    from loomline.operators import tuning
    from loomline.plans import harness, study

    nations = t.read("nation").select(F.col("n_name").alias("topic"))
    drawn = links.share_with_signal(links.random_links(nations, t.assets), 0.5)
    used = materialise(links.design_weights(drawn), "linked_weights")
    topics = bounded_list(nations, "topic")
    cfg = study.StudyConfig(oos=tuning.OosConfig(min_train=30))
    return harness.run_harness(t.returns, used, t.calendar, topics, harness.HarnessConfig(study=cfg))["passed"]


@query("designed_kernel_pairs")
def designed_kernel_pairs(t: Tables):
    """Kernel covariances of every brand with designed attention in the last period; the largest pairs."""
    from loomline.operators import interpret, kernel, shocks

    *_, topics, _, _, attention = lab_world(t)
    z = materialise(shocks.attention_shocks(attention.select("date", "topic", "level"), t.calendar, 5), "designed_shocks")
    cov = kernel.kernel_covariance(t.returns, z, t.calendar, len(topics))
    newest = cov.groupBy("asset", "topic").agg(F.max_by(F.struct("period_id", "cov", "n_days"), "period_id").alias("k"))
    pairs = newest.select("asset", "topic", "k.period_id", "k.cov", "k.n_days").withColumn("size", F.abs("cov"))
    return interpret.top_scores(pairs, "size", 20, "asset", "topic").drop("size")

"""The wrap-up and the report of a one-factor model with fixed loadings, which SQL can follow to the end."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomline.operators import inference, interpret
from loomline.operators.factor_model import Fit, factor_moments
from loomline.plans import study
from loomline.plans.catalog_align import GAMMA
from loomline.plans.catalog_lab import FIVE, TOPICS, _elimination
from loomline.plans.catalog_model import ONE_FACTOR, first_factor
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

ONE = [g[0] for g in GAMMA]
GAMMA_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {g})" for t, g in zip(TOPICS, ONE[1:])) + ") v(topic, g)"
_sum = lambda f: " + ".join(f(i) for i in FIVE)


def one_factor_fit(t: Tables) -> tuple[Fit, object]:
    """The fixed loadings with the factors that the panel gives them, and those factors as a table."""
    factors = first_factor(t, t.panel).select("t_idx", F.array("f1").alias("f"))
    f = np.array([r["f"] for r in factors.orderBy("t_idx").collect()])
    mu, cov = factor_moments(f)
    fitted = t.panel.join(factors, "t_idx").select("y", F.aggregate(F.zip_with("x", F.array(*[F.lit(g) for g in ONE]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias("b"), F.col("f")[0].alias("f"))
    y, b = F.col("y"), F.col("b")
    e0, e1, yy, ff = fitted.agg(F.sum(F.pow(y - b * F.col("f"), 2)), F.sum(F.pow(y - b * float(mu[0]), 2)), F.sum(y * y), F.lit(float((f**2).sum()))).first()
    return Fit(np.array(ONE)[:, None], f, mu, cov, 0.0, 0.5 * e0 + ff, [], 0, True, 1 - e0 / yy, 1 - e1 / yy), factors


# Orders of every priority by the customer's nation: a topic x term matrix; the market and the count of lines are observables.
PHI = """SELECT topic, term, n * 1.0 / sum(n) OVER (PARTITION BY topic) AS p FROM (
    SELECT o_orderpriority AS topic, n_name AS term, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)"""
MADE = {
    **ONE_FACTOR, "ms": "SELECT avg(f) AS mu, var_samp(f) AS v FROM fac", "mkt": "SELECT t_idx, avg(y) AS y FROM panel GROUP BY t_idx",
    "act": """SELECT t_idx, CAST(n AS DOUBLE) / 1000 AS y FROM (SELECT DISTINCT t_idx, period FROM panel) JOIN (SELECT last_day(date) AS m, count(*) AS n FROM lines GROUP BY 1) ON last_day(period) = m""",
    "obs": "SELECT 'lines' AS name, * FROM act UNION ALL SELECT 'market', * FROM mkt",
    "prj": "SELECT name, regr_slope(y, f) AS b, regr_r2(y, f) AS r2, count(*) AS n FROM obs JOIN fac USING (t_idx) GROUP BY name",
    "gam": GAMMA_SQL,
    "imp": """SELECT topic, 'f1' AS target, g * v AS w FROM gam CROSS JOIN ms UNION ALL SELECT topic, 'mve', g * mu FROM gam CROSS JOIN ms
      UNION ALL SELECT topic, name, g * v * b FROM gam CROSS JOIN ms CROSS JOIN prj""",
}


def wrapped(t: Tables):
    fit, factors = one_factor_fit(t)
    days = t.lineitem.groupBy(F.last_day("date").alias("m")).agg((F.count("*").cast("double") / 1000).alias("y"))
    act = t.panel.select("t_idx", "period").distinct().join(days, F.last_day("period") == F.col("m")).select("t_idx", "y")
    market = t.panel.groupBy("t_idx").agg(F.avg("y").alias("y"))
    per_customer = t.read("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("n"))
    nation = t.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(t.read("nation").select("n_nationkey", F.col("n_name").alias("term")), "n_nationkey")
    counts = per_customer.join(nation, "o_custkey").groupBy("topic", "term").agg(F.sum("n").alias("n"))
    total = counts.groupBy("topic").agg(F.sum("n").alias("all"))
    phi = counts.join(total, "topic").select("topic", "term", (F.col("n") / F.col("all")).alias("p"))
    return interpret.wrap_up(fit, t.shocks, t.topics, factors, {"lines": act, "market": market}, phi, 1e-12)


@query("wrapup_k1", with_ctes("panel lines", "SELECT topic, target, round(w, 8) AS w FROM imp", **MADE))
def wrapup_k1(t: Tables):
    """Impact of a unit shock in every topic on the state, the efficient portfolio and two observables."""
    return tidy(wrapped(t).impacts)


@query("wrapup_projections", with_ctes("panel lines", "SELECT name, round(b, 6) AS b, round(r2, 8) AS r2, n FROM prj", **MADE))
def wrapup_projections(t: Tables):
    return tidy(wrapped(t).projections.select("name", F.col("b")[0].alias("b"), "r2", "n"), 8, b=6)


@query("wrapup_states", with_ctes("panel shk att", """
    SELECT CAST(date AS VARCHAR) AS date, CASE WHEN count(z) = 5 THEN round(sum(z * g) * max(v), 7) END AS state, CASE WHEN count(z) = 5 THEN round(sum(z * g) * max(mu), 7) END AS mve
    FROM shk JOIN gam USING (topic) SEMI JOIN att USING (date) CROSS JOIN ms GROUP BY date""", **{k: v for k, v in MADE.items() if k not in ("act", "obs", "prj", "imp")}))
def wrapup_states(t: Tables):
    """Daily latent state and that of the efficient portfolio."""
    out = wrapped(t)
    return tidy(out.states.select("date", F.col("value").alias("state")).join(out.mve.select("date", F.col("value").alias("mve")), "date"), 7)


# The inverse of the topics' Gram matrix over terms stands in columns 6 to 10.
TERMS = {
    **MADE, "phi": PHI, "pt": "SELECT term, " + ", ".join(f"coalesce(max(p) FILTER (topic = '{v}'), 0) AS p{i}" for i, v in zip(FIVE, TOPICS)) + " FROM phi GROUP BY term",
    "e0": "SELECT 1 AS one, " + ", ".join(f"sum(p{i} * p{j}) AS a{i}{j}" for i in FIVE for j in FIVE) + ", " + ", ".join(f"{1.0 if i == j else 0.0}::DOUBLE AS a{i}{5 + j}" for i in FIVE for j in FIVE) + " FROM pt",
    **_elimination("e0", "one", 5),
    "iw": "SELECT target, " + ", ".join(f"max(w) FILTER (topic = '{v}') AS w{i}" for i, v in zip(FIVE, TOPICS)) + " FROM imp WHERE target <> 'f1' GROUP BY target",
    "tw": "SELECT target, " + ", ".join(f"{' + '.join(f'a{i}{5 + j} * w{j}' for j in FIVE)} AS u{i}" for i in FIVE) + " FROM iw CROSS JOIN e5",
}


@query("wrapup_terms", with_ctes("panel lines", f"SELECT term, target, round({_sum(lambda i: f'p{i} * u{i}')}, 5) AS impact FROM pt CROSS JOIN tw", **TERMS))
def wrapup_terms(t: Tables):
    """Impact of every term on the efficient portfolio and the observables, through the topic x term shares."""
    return tidy(wrapped(t).terms, 5)


# Two portfolios of brands, by the parity of their number, priced by the fixed factor and by the market.
PARITY = "CASE WHEN CAST(regexp_extract(asset, '[0-9]+') AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END"
PRICE = {
    **ONE_FACTOR, "ms": "SELECT avg(f) AS mu, var_samp(f) AS v, count(*) AS t FROM fac", "mkt": "SELECT t_idx, avg(y) AS f FROM panel GROUP BY t_idx",
    "two": f"SELECT t_idx, {PARITY} AS asset, avg(y) AS y FROM panel GROUP BY ALL",
    "mod": "SELECT 'narrative_is' AS model, * FROM fac UNION ALL SELECT 'benchmark', * FROM mkt",
    "ts": """SELECT model, asset, count(*) AS n, regr_intercept(y, f) AS alpha, regr_slope(y, f) AS beta, avg(f) AS mf, var_pop(f) AS vf,
      sqrt((sum(y * y) - count(*) * avg(y) ** 2) * (1 - regr_r2(y, f)) / (count(*) - 2) * (1.0 / count(*) + avg(f) ** 2 / regr_sxx(y, f))) AS se FROM two JOIN mod USING (t_idx) GROUP BY 1, 2""",
    "rs": "SELECT model, t_idx, max(y - alpha - beta * f) FILTER (asset = 'even') AS e, max(y - alpha - beta * f) FILTER (asset = 'odd') AS o FROM two JOIN mod USING (t_idx) JOIN ts USING (model, asset) GROUP BY 1, 2",
    "sg": "SELECT model, count(*) AS t, sum(e * e) / (count(*) - 2) AS a, sum(e * o) / (count(*) - 2) AS b, sum(o * o) / (count(*) - 2) AS d FROM rs GROUP BY model",
    "al": "SELECT model, max(alpha) FILTER (asset = 'even') AS x, max(alpha) FILTER (asset = 'odd') AS z, max(mf) AS mf, max(vf) AS vf FROM ts GROUP BY model",
    "gr": "SELECT model, t, t * (t - 3.0) / (2.0 * (t - 2)) * ((d * x * x - 2 * b * x * z + a * z * z) / (a * d - b * b)) / (1 + mf * mf / vf) AS f FROM sg JOIN al USING (model)",
    "jt": "SELECT model, f, pow(1 + 2 * f / (t - 3), -(t - 3) / 2.0) AS p, t FROM gr",
    "sm": "SELECT model, avg(abs(alpha)) AS a, avg(abs(alpha / se)) AS t, avg(CASE WHEN abs(alpha / se) > 1.96 THEN 1.0 ELSE 0.0 END) AS s FROM ts GROUP BY model",
}


def portfolios(t: Tables):
    number = F.regexp_extract("asset", "[0-9]+", 0).cast("int")
    return t.panel.withColumn("asset", F.when(number % 2 == 0, "even").otherwise("odd")).groupBy("t_idx", "asset").agg(F.avg("y").alias("y"))


@query("grs_n2", with_ctes("panel", "SELECT round(f, 5) AS f_stat, round(p, 7) AS p_value, t AS n_periods, CAST(2 AS BIGINT) AS n_assets FROM jt WHERE model = 'narrative_is'", **PRICE))
def grs_n2(t: Tables):
    """Joint test of two portfolios; with two assets the tail of F has a closed form."""
    factors = first_factor(t, t.panel).select("t_idx", F.array("f1").alias("f"))
    return tidy(inference.joint_alpha_test(portfolios(t), factors, 2, 1), 7, f_stat=5)


@query("report_k1", with_ctes("panel", """
    SELECT name, round(value, 5) AS value FROM (
      SELECT 'n_obs' AS name, CAST(count(*) AS DOUBLE) AS value FROM panel UNION ALL SELECT 'T', count(DISTINCT t_idx) FROM panel UNION ALL SELECT 'N', count(DISTINCT asset) FROM panel
      UNION ALL SELECT 'n_populated_periods', t FROM ms UNION ALL SELECT 'total_r2', 1 - sum((y - b * f) ** 2) / sum(y * y) FROM one JOIN fac USING (t_idx)
      UNION ALL SELECT 'pred_r2', 1 - sum((y - b * mu) ** 2) / sum(y * y) FROM one CROSS JOIN ms UNION ALL SELECT 'is_sharpe', sqrt(12 * mu * mu / v) FROM ms
      UNION ALL SELECT 'obs_r2_market', regr_r2(m.f, c.f) FROM mkt m JOIN fac c USING (t_idx)
      UNION ALL SELECT 'pricing_' || model || '_avg_abs_alpha', a FROM sm UNION ALL SELECT 'pricing_' || model || '_avg_abs_t', t FROM sm UNION ALL SELECT 'pricing_' || model || '_frac_significant', s FROM sm
      UNION ALL SELECT 'pricing_' || model || '_grs_stat', f FROM jt UNION ALL SELECT 'pricing_' || model || '_grs_pvalue', p FROM jt)""", **PRICE))
def report_k1(t: Tables):
    """The report of the one-factor model: sizes, fit, projection, and pricing of two portfolios by it and by the market."""
    fit, factors = one_factor_fit(t)
    run = one_factor_study(t, fit, factors)
    market = t.panel.groupBy("t_idx").agg(F.array(F.avg("y")).alias("f"))
    names = ["n_obs", "T", "N", "n_populated_periods", "total_r2", "pred_r2", "is_sharpe", "obs_r2_market"]
    rows = study.report(run, study.StudyConfig(), portfolios(t), market)
    return tidy(rows.where(F.col("name").isin(names) | F.col("name").startswith("pricing_")), 5)


def one_factor_study(t: Tables, fit: Fit, factors) -> study.Study:
    run = study.Study(t.calendar, t.topics, t.shocks, t.panel, None, None, fit)
    run.wrapup = interpret.wrap_up(fit, t.shocks, t.topics, factors, {"market": study.period_market(run)}, None, 1e-12)
    return run


@query("benchmark_correlations", with_ctes("panel", """
    SELECT n.factor, 'benchmark1' AS other, round(sign(CASE n.factor WHEN 'mve' THEN mu ELSE 1 END) * corr(c.f, m.f), 7) AS corr, count(*) AS n
    FROM fac c JOIN mkt m USING (t_idx) CROSS JOIN (SELECT unnest(['f1', 'mve']) AS factor) n CROSS JOIN ms GROUP BY n.factor, mu""", **PRICE))
def benchmark_correlations(t: Tables):
    """Factor and efficient portfolio against the market."""
    fit, factors = one_factor_fit(t)
    market = t.panel.groupBy("t_idx").agg(F.array(F.avg("y")).alias("f"))
    return tidy(study.benchmark_correlations(one_factor_study(t, fit, factors), study.StudyConfig(), market), 7)

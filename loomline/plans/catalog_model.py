"""Queries on the factor model, tuning, interpretation and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.functions.columns import dot
from loomline.functions.session import materialise
from loomline.operators import align, factor_model, inference, interpret, moments, tiles, tuning
from loomline.plans import study
from loomline.plans.catalog_align import FIXED_FIT, GAMMA, fixed_factors
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

FIT = factor_model.FitConfig()
OOS = tuning.OosConfig(min_train=30)


def moments_of(t: Tables):
    return t.panel, moments.period_moments(t.panel)


@query("panel_moments", with_ctes("panel", """
    SELECT t_idx, count(*) AS n, round(sum(y * y), 8) AS yy, round(sum(y), 8) AS v0, round(sum(x[2] * y), 9) AS v1,
      round(sum(x[2]), 9) AS s01, round(sum(x[2] * x[2]), 10) AS s11 FROM panel GROUP BY t_idx"""))
def panel_moments(t: Tables):
    """Moments by matrix products in tasks, compared with direct sums."""
    m = moments.period_moments(t.panel)
    width = F.size("v")
    return tidy(m.select(
        "t_idx", "n", "yy", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), F.col("s")[1].alias("s01"),
        F.element_at("s", width + 2).alias("s11"),
    ), 8, v1=9, s01=9, s11=10)


@query("sigma_from_moments", with_ctes("panel", """
    SELECT l, CASE WHEN l = 0 THEN 1.0 ELSE round(stddev_pop(v), 9) END AS sigma
    FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS l FROM panel) GROUP BY l"""))
def sigma_from_moments(t: Tables):
    """Deviation of each instrument over all periods, merged from period statistics."""
    m = moments.period_moments(t.panel)
    rows = m.select("n", F.posexplode(F.arrays_zip("mean", "m2")).alias("l", "z")).select("n", "l", "z.mean", "z.m2")
    n = F.col("n")
    grand = F.sum(n * F.col("mean")).over(Window.partitionBy("l")) / F.sum(n).over(Window.partitionBy("l"))
    spread = F.sum(F.col("m2") + n * F.pow(F.col("mean") - F.col("grand"), 2)) / F.sum(n)
    sd = rows.withColumn("grand", grand).groupBy("l").agg(F.sqrt(spread).alias("sd"))
    return tidy(sd.select("l", F.when(F.col("l") == 0, 1.0).otherwise(F.col("sd")).alias("sigma")), 9)


ONE = "SELECT *, " + " + ".join(f"{g[0]} * x[{i + 1}]" for i, g in enumerate(GAMMA)) + " AS b FROM panel"


def one_loading():
    return dot(F.col("x"), F.array(*[F.lit(g[0]) for g in GAMMA]))


@query("oos_factor_k1", with_ctes("panel", """
    SELECT t_idx, round(sum(b * y) / (sum(b * b) + 2), 9) AS f FROM one GROUP BY t_idx""", one=ONE))
def oos_factor_k1(t: Tables):
    """Cross-sectional ridge factor of frozen loadings, from the moments of each period."""
    loadings = np.array([[g[0]] for g in GAMMA])
    return tidy(tuning.period_factors(moments.period_moments(t.panel), loadings).select("t_idx", F.col("f")[0].alias("f")), 9)


GRADIENT = {"bet": FIXED_FIT["bet"], "two": """
    SELECT t_idx, sum(b1 * b1) + 2 AS a, sum(b1 * b2) AS b, sum(b2 * b2) + 2 AS d, sum(b1 * y) AS p, sum(b2 * y) AS q FROM bet GROUP BY t_idx""",
    "own_f": "SELECT t_idx, (d * p - b * q) / (a * d - b * b) AS f1, (a * q - b * p) / (a * d - b * b) AS f2 FROM two",
    "err": "SELECT x, y, f1, f2, b1 * f1 + b2 * f2 - y AS e FROM bet JOIN own_f USING (t_idx)"}


@query("loading_gradient", with_ctes("panel", """
    SELECT l, round(sum(e * v * f1), 7) AS g1, round(sum(e * v * f2), 7) AS g2 FROM (SELECT e, f1, f2, unnest(x) AS v, unnest(range(len(x))) AS l FROM err) GROUP BY l""", **GRADIENT))
def loading_gradient(t: Tables):
    """Gradient of half the squared error in the loadings, at their own factors, from moment tiles."""
    window, (_, grads) = fixed_pass(t)
    g = grads[0] * window.sigma[:, None]
    return tidy(t.spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(g)], "l int, g1 double, g2 double"), 7)


@query("sweep_objective", with_ctes("panel", """
    SELECT round(sum(e * e), 8) AS ssr, round((SELECT sum(f1 * f1 + f2 * f2) FROM own_f), 8) AS ridge, round(1 - sum(e * e) / sum(y * y), 8) AS total_r2,
      (SELECT count(*) FROM own_f) AS periods FROM err""", **GRADIENT))
def sweep_objective(t: Tables):
    """The parts of the criterion at fixed loadings, from one sweep over moment tiles."""
    window, (states, _) = fixed_pass(t)
    now, total = states[0], float(window.yy.sum())
    return tidy(t.spark.createDataFrame([(now.ssr, float(np.trace(now.f_outer)), 1 - now.ssr / total, len(now.factors))], "ssr double, ridge double, total_r2 double, periods long"))


def fixed_pass(t: Tables):
    table, head = tiles.moment_tiles(t.panel, 2)
    window = tiles.Window(head)
    return window, tiles.TileSweeps(table, head, 2).gradients({0: (window, np.array(GAMMA) * window.sigma[:, None])})


@query("refit_schedule", with_ctes("panel", """
    SELECT p.t_idx, CAST(period AS VARCHAR) AS period, CAST(floor((p.t_idx - first) / 12) AS BIGINT) AS refit,
      CAST(first + floor((p.t_idx - first) / 12) * 12 AS BIGINT) AS n_train, first > start AS moved
    FROM (SELECT DISTINCT t_idx, period FROM panel) p, s WHERE p.t_idx >= first""",
    s="""SELECT n - greatest(1, round_even(n * 0.4, 0)) AS start, greatest(n - greatest(1, round_even(n * 0.4, 0)), 30) AS first
         FROM (SELECT count(DISTINCT t_idx) AS n FROM panel)"""))
def refit_schedule(t: Tables):
    return tidy(tuning.refit_schedule(t.panel.select("t_idx", "period").distinct(), OOS))


# A penalty path read off the orders: one point per (customer segment, order priority).
PATHLIKE = """
    SELECT dense_rank() OVER (ORDER BY c_mktsegment) AS "K", CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS DOUBLE) / 10 AS lam,
      avg(o_totalprice) / 100000 AS criterion, count(DISTINCT o_orderstatus) AS n_selected
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderpriority"""


def path_like(t: Tables):
    per_customer = t.read("orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.sum("o_totalprice").alias("s"), F.count("*").alias("n"), F.collect_set("o_orderstatus").alias("st"))
    rows = per_customer.join(t.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    points = rows.groupBy("c_mktsegment", "o_orderpriority").agg(
        (F.sum("s") / F.sum("n") / 100000).alias("criterion"),
        F.size(F.array_distinct(F.flatten(F.collect_set("st")))).alias("n_selected"))
    return points.select(
        F.dense_rank().over(Window.orderBy("c_mktsegment")).alias("K"),
        (F.dense_rank().over(Window.orderBy("o_orderpriority")) / 10).alias("lam"), "criterion", "n_selected")


SELECT_SQL = """
    SELECT "K", round(lam, 8) AS lam, round(criterion, 8) AS criterion, n_selected FROM path
    WHERE criterion >= (SELECT max(criterion) - greatest({tol} * abs(max(criterion)), 1e-9 * greatest(1, abs(max(criterion)))) FROM path)
    ORDER BY lam {d}, n_selected {a}, "K" {a} LIMIT 1"""


@query("select_best_exact", with_ctes("", SELECT_SQL.format(tol=0, d="DESC", a="ASC"), path=PATHLIKE))
def select_best_exact(t: Tables):
    return tidy(tuning.select_best(path_like(t)))


@query("select_best_tolerance", with_ctes("", SELECT_SQL.format(tol=0.02, d="DESC", a="ASC"), path=PATHLIKE))
def select_best_tolerance(t: Tables):
    return tidy(tuning.select_best(path_like(t), 0.02))


@query("select_best_denser", with_ctes("", SELECT_SQL.format(tol=0.02, d="ASC", a="DESC"), path=PATHLIKE))
def select_best_denser(t: Tables):
    return tidy(tuning.select_best(path_like(t), 0.02, "denser"))


MAP = {"1-URGENT": (0.5, -0.2), "2-HIGH": (0.1, 0.4), "3-MEDIUM": (-0.3, 0.2), "4-NOT SPECIFIED": (0.2, 0.0), "5-LOW": (0.0, 0.7)}
MAP_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {i + 1}, {v[i]})" for k, v in MAP.items() for i in range(2)) + ") m(topic, factor, w)"


def fixed_map(t: Tables):
    return t.spark.createDataFrame([(k, i + 1, v[i]) for k, v in MAP.items() for i in range(2)], "topic string, factor int, w double")


@query("states_fixed_map", with_ctes("shk att", """
    SELECT CAST(date AS VARCHAR) AS date, CAST(factor AS BIGINT) AS factor, CASE WHEN count(z) = 5 THEN round(sum(z * w), 8) END AS value
    FROM shk JOIN map USING (topic) SEMI JOIN att USING (date) GROUP BY 1, 2""", map=MAP_SQL))
def states_fixed_map(t: Tables):
    return tidy(interpret.weighted_shocks(t.shocks, fixed_map(t), len(t.topics)))


@query("retrieval_topk", with_ctes("shk", """
    SELECT CAST(date AS VARCHAR) AS date, value FROM (
      SELECT date, round(sum(z * w), 8) AS value FROM shk JOIN map USING (topic) WHERE factor = 1 GROUP BY date HAVING count(z) = 5)
    ORDER BY value DESC, date LIMIT 25""", map=MAP_SQL))
def retrieval_topk(t: Tables):
    scores = interpret.weighted_shocks(t.shocks, fixed_map(t).where("factor = 1"), len(t.topics))
    return tidy(interpret.top_scores(scores.select("date", F.round("value", 8).alias("value")), "value", 25, "date"))


WORDS = """SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS topic, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS term FROM documents"""


@query("term_impact", with_ctes("", """
    SELECT term, round(sum(CASE topic WHEN 'en' THEN p * (0.8 * g22 + 0.3 * g12) ELSE p * (-0.3 * g11 - 0.8 * g12) END) / max(g11 * g22 - g12 * g12), 8) AS impact
    FROM phi CROSS JOIN gram GROUP BY term""",
    words=WORDS,
    phi="SELECT topic, term, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY topic) AS p FROM words GROUP BY topic, term",
    gram="""SELECT sum(a * a) AS g11, sum(a * b) AS g12, sum(b * b) AS g22 FROM (
        SELECT term, coalesce(max(p) FILTER (WHERE topic = 'en'), 0) AS a, coalesce(max(p) FILTER (WHERE topic = 'other'), 0) AS b
        FROM phi GROUP BY term)"""))
def term_impact(t: Tables):
    """Term weights from a topic x term matrix counted over whole texts."""
    topic = F.when(F.col("lang") == "en", "en").otherwise("other").alias("topic")
    words = t.read("documents").select(topic, F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), F.lit(0))).alias("term"))
    counts = words.groupBy("topic", "term").agg(F.count("*").alias("c"))
    total = counts.groupBy("topic").agg(F.sum("c").alias("n"))
    phi = materialise(counts.join(total, "topic").select("topic", "term", (F.col("c") / F.col("n")).alias("p")), "phi")
    return tidy(interpret.term_impact(phi, {"en": 0.8, "other": -0.3}, 1e-12))


def first_factor(t: Tables, rows):
    return rows.groupBy("t_idx").agg((F.sum(one_loading() * F.col("y")) / (F.sum(one_loading() * one_loading()) + 2)).alias("f1"))


ONE_FACTOR = {"one": ONE, "fac": "SELECT t_idx, sum(b * y) / (sum(b * b) + 2) AS f FROM one GROUP BY t_idx"}


@query("project_observable_k1", with_ctes("panel", """
    SELECT round(regr_slope(m, f), 6) AS b, round(regr_r2(m, f), 8) AS r2, count(*) AS n
    FROM fac JOIN (SELECT t_idx, avg(y) AS m FROM panel GROUP BY t_idx) USING (t_idx)""", **ONE_FACTOR))
def project_observable_k1(t: Tables):
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    out = interpret.project_observable(factors, rows.groupBy("t_idx").agg(F.avg("y").alias("y")), 1)
    return tidy(out.select(F.col("b")[0].alias("b"), "r2", "n"), 8, b=6)


PRICED = {**ONE_FACTOR, "priced": """
    SELECT asset, count(*) AS n, regr_intercept(y, f) AS alpha, regr_slope(y, f) AS beta, regr_r2(y, f) AS r2,
      sqrt((sum(y * y) - count(*) * avg(y) ** 2) * (1 - regr_r2(y, f)) / (count(*) - 2) * (1.0 / count(*) + avg(f) ** 2 / regr_sxx(y, f))) AS se
    FROM panel JOIN fac USING (t_idx) GROUP BY asset"""}


@query("pricing_k1", with_ctes("panel", """
    SELECT asset, n, round(alpha, 7) AS alpha, round(beta, 5) AS beta, round(r2, 7) AS r2, round(alpha / se, 5) AS t_stat FROM priced""", **PRICED))
def pricing_k1(t: Tables):
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    out = inference.price_test_assets(rows.select("t_idx", "asset", "y"), factors, 1)
    return tidy(out.select("asset", "n", "alpha", F.col("betas")[0].alias("beta"), "r2", "t_stat"), 7, beta=5, t_stat=5)


@query("pricing_summary", with_ctes("panel", """
    SELECT count(*) AS n_assets, round(avg(abs(alpha)), 7) AS avg_abs_alpha, round(avg(abs(alpha / se)), 5) AS avg_abs_t,
      round(avg(CASE WHEN abs(alpha / se) > 1.96 THEN 1.0 ELSE 0 END), 7) AS frac_significant FROM priced""", **PRICED))
def pricing_summary(t: Tables):
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    tests = inference.price_test_assets(rows.select("t_idx", "asset", "y"), factors, 1)
    return tidy(inference.pricing_summary(tests), 7, avg_abs_t=5)


@query("newey_west_k1", with_ctes("panel", """
    SELECT asset, round(alpha / sqrt(var), 5) AS t_stat FROM (
      SELECT asset, max(alpha) AS alpha, sum(s00) AS m00,
        -- bread rows for the intercept: (Sff, -Sf) / (n Sff - Sf^2)
        (max(sff) ** 2 * sum(s00) - 2 * max(sff) * max(sf) * sum(s01) + max(sf) ** 2 * sum(s11)) / (max(n) * max(sff) - max(sf) ** 2) ** 2 AS var
      FROM (
        SELECT asset, alpha, n, sf, sff,
          e * e + e * (4.0/3 * 0 + 2 * 0.75 * coalesce(e1, 0) + 2 * 0.5 * coalesce(e2, 0) + 2 * 0.25 * coalesce(e3, 0)) AS s00,
          e * e * f + 0.75 * (e * coalesce(e1 * f1, 0) + e * f * coalesce(e1, 0)) + 0.5 * (e * coalesce(e2 * f2, 0) + e * f * coalesce(e2, 0))
            + 0.25 * (e * coalesce(e3 * f3, 0) + e * f * coalesce(e3, 0)) AS s01,
          e * e * f * f + 2 * e * f * (0.75 * coalesce(e1 * f1, 0) + 0.5 * coalesce(e2 * f2, 0) + 0.25 * coalesce(e3 * f3, 0)) AS s11
        FROM (SELECT *, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3,
                lag(f, 1) OVER w AS f1, lag(f, 2) OVER w AS f2, lag(f, 3) OVER w AS f3
              FROM (SELECT p.asset, t_idx, f, y - alpha - beta * f AS e, alpha, q.n, sum(f) OVER (PARTITION BY p.asset) AS sf,
                      sum(f * f) OVER (PARTITION BY p.asset) AS sff
                    FROM panel p JOIN fac USING (t_idx) JOIN priced q ON q.asset = p.asset)
              WINDOW w AS (PARTITION BY asset ORDER BY t_idx)))
      GROUP BY asset)""", **PRICED))
def newey_west_k1(t: Tables):
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    out = inference.price_test_assets(rows.select("t_idx", "asset", "y"), factors, 1, hac_lags=3)
    return tidy(out.select("asset", "t_stat"), 5)


@query("grs_n1", with_ctes("panel", """
    SELECT round((alpha / se) ** 2, 4) AS f_stat, n AS n_periods, CAST(1 AS BIGINT) AS n_assets FROM mkt""",
    **ONE_FACTOR, mkt="""
    SELECT count(*) AS n, regr_intercept(m, f) AS alpha,
      sqrt((sum(m * m) - count(*) * avg(m) ** 2) * (1 - regr_r2(m, f)) / (count(*) - 2) * (1.0 / count(*) + avg(f) ** 2 / regr_sxx(m, f))) AS se
    FROM fac JOIN (SELECT t_idx, avg(y) AS m FROM panel GROUP BY t_idx) USING (t_idx)"""))
def grs_n1(t: Tables):
    """With one asset the joint test is the squared t of its alpha."""
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    market = rows.groupBy("t_idx").agg(F.avg("y").alias("y")).withColumn("asset", F.lit("all"))
    return tidy(inference.joint_alpha_test(market, factors, 1, 1).select("f_stat", "n_periods", "n_assets"), 4)


@query("grs_brands")
def grs_brands(t: Tables):
    """Joint test of all brands at once."""
    rows = t.panel
    factors = first_factor(t, rows).select("t_idx", F.array("f1").alias("f"))
    return inference.joint_alpha_test(rows.select("t_idx", "asset", "y"), factors, len(t.assets), 1)


@query("factor_correlations", with_ctes("panel", """
    SELECT factor, asset AS other, CASE WHEN count(*) >= 3 THEN round(corr(value, y), 7) END AS corr, count(*) AS n
    FROM (SELECT t_idx, 'f1' AS factor, f1 AS value FROM fac UNION ALL SELECT t_idx, 'f2', f2 FROM fac) JOIN panel USING (t_idx)
    GROUP BY 1, 2""", **FIXED_FIT))
def factor_correlations(t: Tables):
    rows = t.panel
    f = fixed_factors(rows).select("t_idx", F.col("f")[0].alias("f1"), F.col("f")[1].alias("f2")).unpivot("t_idx", ["f1", "f2"], "name", "value")
    return tidy(inference.factor_correlations(f, rows.select("t_idx", F.col("asset").alias("name"), F.col("y").alias("value")), "t_idx"), 7)


@query("realized_sharpe", with_ctes("pret", """
    SELECT asset, CASE WHEN stddev_samp(ret) > 1e-15 THEN round(avg(ret) / stddev_samp(ret) * sqrt(12), 6) END AS sharpe, count(*) AS n
    FROM pret GROUP BY asset"""))
def realized_sharpe(t: Tables):
    return tidy(tuning.realised_sharpe(align.period_returns(t.returns, t.calendar), "ret", 12, "asset"), 6)


@query("jaccard_stability", with_ctes("shk", """
    SELECT round(avg(CASE WHEN len(u) = 0 THEN 1.0 ELSE len(list_intersect(topics, prev)) * 1.0 / len(u) END), 8) AS stability, count(*) AS pairs
    FROM (SELECT *, list_distinct(list_concat(topics, prev)) AS u FROM (
      SELECT period_id, topics, lag(topics) OVER (ORDER BY period_id) AS prev FROM sets)) WHERE prev IS NOT NULL""",
    sets="SELECT period_id, list(topic) FILTER (WHERE m > 0) AS topics FROM (SELECT period_id, topic, sum(z) AS m FROM shk WHERE z IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
    .replace("list(topic) FILTER (WHERE m > 0)", "coalesce(list(topic) FILTER (WHERE m > 0), [])"))
def jaccard_stability(t: Tables):
    """Similarity of the topics with a positive sum of shocks, month after month."""
    sums = t.shocks.join(t.calendar.select("date", "period_id"), "date").where("z IS NOT NULL").groupBy("period_id", "topic").agg(F.sum("z").alias("m"))
    sets = sums.groupBy(F.col("period_id").alias("refit")).agg(F.collect_list(F.when(F.col("m") > 0, F.col("topic"))).alias("topics"))
    return tidy(tuning.selection_stability(sets))


@query("lambda_max_by_instrument", with_ctes("kcov", """
    SELECT topic AS instrument, max(period_id / 10) FILTER (WHERE abs(round(cov, 9)) > 0.0005) AS lam_max FROM kcov GROUP BY topic"""))
def lambda_max_by_instrument(t: Tables):
    """Last tenth-period in which a topic's covariance with any asset exceeds a threshold."""
    from loomline.operators import kernel

    cov = kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics))
    path = cov.select(F.col("topic").alias("instrument"), (F.col("period_id") / 10).alias("lam"), F.abs(F.round("cov", 9)).alias("norm"))
    return tuning.lambda_max_by_instrument(path, 0.0005)


@query("lambda_path")
def lambda_path(t: Tables):
    """The whole penalty path for one to three factors."""
    _, m = moments_of(t)
    path = tuning.penalty_path(m, FIT, tuning.TuneConfig(K_grid=(1, 2, 3)))
    return path.select("K", "lam", "total_r2", "pred_r2", "mve_sharpe", "objective", "n_selected", "converged", "n_iter")


@query("group_lasso_fit")
def group_lasso_fit(t: Tables):
    """Loadings of the tuned model."""
    _, m = moments_of(t)
    _, fit = tuning.tune_model(m, FIT)
    return factor_model.gamma_table(t.spark, fit, t.topics)


@query("plain_fit")
def plain_fit(t: Tables):
    """Loadings of the unpenalised model."""
    _, m = moments_of(t)
    path = tuning.penalty_path(m, factor_model.FitConfig(K=2, lambdas=(0.0,)))
    return path.select("K", "lam", "total_r2", "objective", "converged", F.explode("gamma").alias("value"))


@query("loocv")
def loocv(t: Tables):
    """Leave-one-period-out Sharpe of every point; one task per left-out period."""
    _, m = moments_of(t)
    path = tuning.penalty_path(m, FIT, tuning.TuneConfig(criterion="loocv"))
    return path.select("K", "lam", "criterion", "n_selected")


@query("oos_run")
def oos_run(t: Tables):
    """Out-of-sample efficient-portfolio returns with a retuned penalty per refit."""
    rows, m = moments_of(t)
    schedule = tuning.refit_schedule(rows.select("t_idx", "period").distinct(), OOS)
    return tuning.run_out_of_sample(m, schedule, FIT, oos=OOS).select("refit", "t_idx", "mve", "lam", "K", "n_selected", "train_sharpe", "truncated")


@query("oos_frozen")
def oos_frozen(t: Tables):
    """Out of sample with the penalty tuned once."""
    rows, m = moments_of(t)
    frozen = tuning.OosConfig(min_train=30, retune=False)
    schedule = tuning.refit_schedule(rows.select("t_idx", "period").distinct(), frozen)
    return tuning.run_out_of_sample(m, schedule, FIT, oos=frozen).select("refit", "t_idx", "mve", "lam", "K", "n_selected")


STUDY = study.StudyConfig(fit=FIT, oos=OOS)


@query("study_metrics")
def study_metrics(t: Tables):
    """Every step from daily facts to the metric table."""
    return study.report(study.run_study(t.attention_all_days, t.returns, STUDY), STUDY)


@query("latent_states")
def latent_states(t: Tables):
    """Daily latent states of the tuned model."""
    _, m = moments_of(t)
    _, fit = tuning.tune_model(m, FIT)
    to_state, _, _ = interpret.impact_vectors(fit)
    return interpret.weighted_shocks(t.shocks, interpret.topic_weights(t.spark, t.topics, to_state), len(t.topics))


@query("placebo_test")
def placebo_test(t: Tables):
    """Placebo topics picked by the re-estimated model."""
    cfg = study.StudyConfig(fit=FIT, n_placebos=3)
    rets, shk, cal, topics, rows, m = study.build(t.attention_all_days, t.returns, cfg)
    path, fit = tuning.tune_model(m, FIT)
    return study.placebo_test(study.Study(cal, topics, shk, rows, m, path, fit), rets, cfg)


WIDE = {
    "wret": "SELECT date, CAST(l_suppkey AS VARCHAR) AS asset, avg(l_discount - l_tax) AS ret FROM lines GROUP BY 1, 2",
    "wcnt": """SELECT CAST(o_orderdate AS DATE) AS date, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || ' ' || o_orderpriority AS topic, CAST(count(*) AS DOUBLE) AS level
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""",
    "wtop": "SELECT DISTINCT topic FROM wcnt",
    "wshk": """SELECT * FROM (SELECT g.date, g.topic, CASE WHEN count(l) OVER w = 5 THEN l - avg(l) OVER w END AS z FROM (
          SELECT c.date, t.topic, CASE WHEN o.date IS NOT NULL THEN coalesce(n.level, 0) END AS l
          FROM cal c CROSS JOIN wtop t LEFT JOIN oday o ON o.date = c.date LEFT JOIN wcnt n ON n.date = c.date AND n.topic = t.topic) g
        WINDOW w AS (PARTITION BY g.topic ORDER BY g.date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) WHERE z IS NOT NULL""",
    "wsum": """SELECT r.asset, s.topic, c.period_id AS m, sum(r.ret * z) AS rz, sum(r.ret) AS r, sum(z) AS z, count(*) AS n,
          coalesce(sum(r.ret * z) FILTER (WHERE back > 1), 0) AS prz, coalesce(sum(r.ret) FILTER (WHERE back > 1), 0) AS pr,
          coalesce(sum(z) FILTER (WHERE back > 1), 0) AS pz, count(*) FILTER (WHERE back > 1) AS pn
        FROM wret r JOIN wshk s USING (date) JOIN cal c USING (date) GROUP BY 1, 2, 3""",
    "wcov": """SELECT t AS period_id, asset, topic, rz / w - r / w * (z / w) AS cov, n AS n_days FROM (
          SELECT p.t, asset, topic, sum(k * CASE WHEN m = p.t THEN prz ELSE rz END) AS rz, sum(k * CASE WHEN m = p.t THEN pr ELSE r END) AS r,
            sum(k * CASE WHEN m = p.t THEN pz ELSE z END) AS z, sum(k * CASE WHEN m = p.t THEN pn ELSE n END) AS w, sum(CASE WHEN m = p.t THEN pn ELSE n END) AS n
          FROM (SELECT p.t, s.*, pow(0.99, p.t - m) AS k FROM periods p JOIN wsum s ON m <= p.t) p GROUP BY 1, 2, 3) WHERE n >= 60""",
}


@query("kernel_cov_wide", with_ctes("lines cal oday periods", """
    SELECT period_id, topic, count(*) AS n_assets, CAST(sum(n_days) AS BIGINT) AS n_days, round(sum(cov), 7) AS sum_cov, round(sum(cov * cov), 8) AS sum_sq
    FROM wcov GROUP BY 1, 2""", **WIDE))
def kernel_cov_wide(t: Tables):
    """Matrix-product covariances of every supplier with 125 topics, summed over suppliers."""
    from loomline.functions.session import bounded_list
    from loomline.operators import kernel
    from loomline.operators.calendar import trading_calendar
    from loomline.operators.shocks import attention_shocks
    from loomline.plans.study import covariances

    cal = materialise(trading_calendar(t.wide_returns.select("date")), "calendar")
    att = align.apply_calendar_policy(t.wide_attention, cal, "drop")
    shk = materialise(attention_shocks(att, cal, 5), "wide_shocks")
    topics = bounded_list(shk, "topic", 10_000)
    long = kernel.unpack_topics(covariances(t.wide_returns, shk, cal, topics, kernel.KernelConfig()), topics)
    return tidy(long.groupBy("period_id", "topic").agg(
        F.count("*").alias("n_assets"), F.sum("n_days").alias("n_days"), F.sum("cov").alias("sum_cov"), F.sum(F.col("cov") * F.col("cov")).alias("sum_sq")), 7, sum_sq=8)


WIDE_STUDY = study.StudyConfig(
    fit=factor_model.FitConfig(K=3, n_lambdas=12, ratio=1e-2), oos=tuning.OosConfig(min_train=30, refit_every=4))


@query("study_wide")
def study_wide(t: Tables):
    """The whole study with suppliers as assets and 125 topics."""
    return study.report(study.run_study(t.wide_attention, t.wide_returns, WIDE_STUDY), WIDE_STUDY)


@query("study_checks")
def study_checks(t: Tables):
    """Every identity and diagnostic of a finished study."""
    from loomline.plans.checks import study_checks as checks

    return checks(study.run_study(t.attention_all_days, t.returns, STUDY), t.returns, STUDY)


TRACE = {"asset": "Brand#7", "topic": "2-HIGH", "period_id": 40}


@query("trace_kernel_profile", with_ctes("prods", """
    SELECT CAST(date AS VARCHAR) AS date, period_id, round(r, 8) AS ret, round(z, 8) AS z, round(w / sum(w) OVER (), 10) AS k,
      round(w / sum(w) OVER () * (r - sum(w * r) OVER () / sum(w) OVER ()) * (z - sum(w * z) OVER () / sum(w) OVER ()), 10) AS part
    FROM (SELECT *, pow(0.99, 40 - period_id) AS w FROM prods WHERE asset = 'Brand#7' AND topic = '2-HIGH' AND (period_id < 40 OR (period_id = 40 AND back > 1)))"""))
def trace_kernel_profile(t: Tables):
    """Days behind one covariance cell."""
    from loomline.operators import kernel, trace
    from loomline.operators.shocks import complete_days

    full = t.shocks.join(complete_days(t.shocks, len(t.topics)), "date", "left_semi")
    return tidy(trace.kernel_profile(t.returns, full, t.calendar, **TRACE, cfg=kernel.KernelConfig()), 8, k=10, part=10)


@query("trace_instrument_series", with_ctes("kcov periods", """
    SELECT period_id, CAST(period_end AS VARCHAR) AS period_end, round(cov, 9) AS cov, n_days
    FROM kcov JOIN periods ON t = period_id WHERE asset = 'Brand#7' AND topic = '2-HIGH'"""))
def trace_instrument_series(t: Tables):
    from loomline.operators import kernel, trace

    cov = kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics))
    return tidy(trace.instrument_series(cov, t.calendar, TRACE["asset"], TRACE["topic"]), 9)


@query("trace_pairing", with_ctes("kcov cal pret", """
    SELECT c.period_id, CAST(c.period_end AS VARCHAR) AS period_end, c.n_days, CAST(coalesce(k.n, 0) AS BIGINT) AS n_instruments, round(r.ret, 8) AS next_return,
      k.n IS NOT NULL AND r.ret IS NOT NULL AS used
    FROM (SELECT period_id, max(date) AS period_end, count(*) AS n_days FROM cal GROUP BY 1) c
    LEFT JOIN (SELECT period_id, count(*) AS n FROM kcov WHERE asset = 'Brand#7' GROUP BY 1) k USING (period_id)
    LEFT JOIN (SELECT period_id - 1 AS period_id, ret FROM pret WHERE asset = 'Brand#7') r USING (period_id)"""))
def trace_pairing(t: Tables):
    from loomline.operators import kernel, trace

    cov = kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics))
    return tidy(trace.pairing_table(cov, align.period_returns(t.returns, t.calendar), t.calendar, TRACE["asset"]))


@query("trace_asset_days", with_ctes("cal rets", """
    SELECT CAST(c.date AS VARCHAR) AS date, pos, period_id, round(ret, 8) AS ret FROM cal c LEFT JOIN rets r ON r.date = c.date AND r.asset = 'Brand#7'"""))
def trace_asset_days(t: Tables):
    from loomline.operators import trace

    return tidy(trace.asset_days(t.returns, t.calendar, TRACE["asset"]))


@query("trace_topic_days", with_ctes("cal att shk", """
    SELECT CAST(c.date AS VARCHAR) AS date, c.pos, a.level, round(s.z, 8) AS z FROM cal c
    LEFT JOIN att a ON a.date = c.date AND a.topic = '2-HIGH' LEFT JOIN shk s ON s.date = c.date AND s.topic = '2-HIGH'"""))
def trace_topic_days(t: Tables):
    from loomline.operators import trace

    return tidy(trace.topic_days(t.attention, t.shocks, t.calendar, TRACE["topic"]))

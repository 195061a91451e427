"""Queries on the calendar, alignment, shocks and kernel steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomline.operators import align, calendar, kernel, panel, shocks
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

KERNEL = kernel.KernelConfig()


@query("calendar_periods", with_ctes("cal", """
    SELECT CAST(date AS VARCHAR) AS date, CAST(period_start AS VARCHAR) AS period_start, pos, period_id,
      CAST(period_end AS VARCHAR) AS period_end, back FROM cal"""))
def calendar_periods(t: Tables):
    return tidy(t.calendar)


@query("calendar_weeks_friday", with_ctes("days", """
    SELECT CAST(date AS VARCHAR) AS date, CAST(wk AS VARCHAR) AS period_start, row_number() OVER (ORDER BY date) - 1 AS pos,
      dense_rank() OVER (ORDER BY wk) - 1 AS period_id,
      CAST(max(date) OVER (PARTITION BY wk) AS VARCHAR) AS period_end,
      row_number() OVER (PARTITION BY wk ORDER BY date DESC) AS back
    FROM (SELECT date, CAST(date - CAST((isodow(date) + 1) % 7 AS INTEGER) AS DATE) AS wk FROM days)"""))
def calendar_weeks_friday(t: Tables):
    return tidy(t.calendar_of("W-FRI"))


@query("window_bounds_skip1", with_ctes("cal", """
    SELECT period_id, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end,
      min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (WHERE back > 1) AS n_window,
      CAST(coalesce(max(date) FILTER (WHERE back > 1), lag(period_end) OVER (ORDER BY period_id)) AS VARCHAR) AS window_end
    FROM cal GROUP BY period_id, period_start, period_end"""))
def window_bounds_skip1(t: Tables):
    return tidy(calendar.window_bounds(t.calendar, 1))


@query("window_bounds_weekly_skip5", with_ctes("wcal", """
    SELECT period_id, CAST(date_trunc('week', period_end) AS DATE)::VARCHAR AS period_start, CAST(period_end AS VARCHAR) AS period_end,
      min(pos) AS first_pos, max(pos) AS last_pos, count(*) FILTER (WHERE back > 5) AS n_window,
      CAST(coalesce(max(date) FILTER (WHERE back > 5), lag(period_end) OVER (ORDER BY period_id)) AS VARCHAR) AS window_end
    FROM wcal GROUP BY period_id, period_end"""))
def window_bounds_weekly_skip5(t: Tables):
    return tidy(calendar.window_bounds(t.calendar_of("W"), 5))


@query("attention_daily", with_ctes("att_all", "SELECT CAST(date AS VARCHAR) AS date, topic, level FROM att_all"))
def attention_daily(t: Tables):
    return tidy(t.attention_all_days)


@query("attention_weighted_docs", """
    SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, s.status AS topic,
      round(sum(CASE WHEN o_orderstatus = s.status THEN o_totalprice ELSE 0 END) / nullif(sum(o_totalprice), 0), 8) AS level
    FROM orders CROSS JOIN (SELECT DISTINCT o_orderstatus AS status FROM orders) s GROUP BY 1, 2""")
def attention_weighted_docs(t: Tables):
    from loomline.functions.session import bounded_list

    statuses = bounded_list(t.orders, "o_orderstatus", 1000)
    theta = t.orders.select(
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("weight"),
        F.posexplode(F.array(*[(F.col("o_orderstatus") == s).cast("double") for s in statuses])).alias("k", "theta"),
    ).withColumn("topic", F.element_at(F.array(*[F.lit(s) for s in statuses]), F.col("k") + 1))
    return tidy(align.document_attention(theta))


@query("attention_event_mix", """
    SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, s.kind AS topic,
      round(sum(CASE WHEN event_type = s.kind THEN 1.0 ELSE 0 END) / count(*), 8) AS level
    FROM events CROSS JOIN (SELECT DISTINCT event_type AS kind FROM events) s GROUP BY 1, 2""")
def attention_event_mix(t: Tables):
    """Unweighted daily mix of intraday records."""
    from loomline.functions.session import bounded_list

    kinds = bounded_list(t.read("events"), "event_type", 1000)
    theta = t.read("events").select(
        "ts", F.lit(1.0).alias("weight"),
        F.posexplode(F.array(*[(F.col("event_type") == k).cast("double") for k in kinds])).alias("k", "theta"),
    ).withColumn("topic", F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("k") + 1))
    return tidy(align.document_attention(theta, weighted=False))


@query("attention_drop", with_ctes("att", "SELECT CAST(date AS VARCHAR) AS date, topic, level FROM att"))
def attention_drop(t: Tables):
    return tidy(align.apply_calendar_policy(t.attention_all_days, t.calendar, "drop"))


FOLD = """
    SELECT CAST(target AS VARCHAR) AS date, topic, {how}(level) AS level
    FROM (SELECT a.topic, a.level, (SELECT min(c.date) FROM cal c WHERE c.date >= a.date) AS target FROM att_all a)
    WHERE target IS NOT NULL GROUP BY 1, 2"""


@query("attention_fold_mean", with_ctes("att_all cal", FOLD.format(how="avg").replace("avg(level)", "round(avg(level), 8)")))
def attention_fold_mean(t: Tables):
    return tidy(align.apply_calendar_policy(t.attention_all_days, t.calendar, "fold_mean"))


@query("attention_fold_sum", with_ctes("att_all cal", FOLD.format(how="sum")))
def attention_fold_sum(t: Tables):
    return tidy(align.apply_calendar_policy(t.attention_all_days, t.calendar, "fold_sum"))


@query("attention_lag2", with_ctes("grid", """
    SELECT CAST(date AS VARCHAR) AS date, topic, level FROM (
      SELECT date, topic, lag(level, 2) OVER (PARTITION BY topic ORDER BY date) AS level FROM grid) WHERE level IS NOT NULL"""))
def attention_lag2(t: Tables):
    return tidy(align.lag_attention(t.attention, t.calendar, 2))


@query("rf_forward_fill", with_ctes("cal rfm", """
    SELECT CAST(c.date AS VARCHAR) AS date,
      round((SELECT max_by(rf, r.date) FROM rfm r WHERE r.date <= c.date), 10) AS rf FROM cal c"""))
def rf_forward_fill(t: Tables):
    return tidy(align.carry_forward(t.risk_free, t.calendar, "rf"), 10)


@query("rf_forward_fill_limit5", with_ctes("cal rfm", """
    SELECT CAST(date AS VARCHAR) AS date, round(last_value(rf IGNORE NULLS) OVER (
      ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 10) AS rf
    FROM cal LEFT JOIN rfm USING (date)"""))
def rf_forward_fill_limit5(t: Tables):
    return tidy(align.carry_forward(t.risk_free, t.calendar, "rf", limit=5), 10)


@query("fill_gaps_limit5", with_ctes("cal rets", """
    SELECT CAST(date AS VARCHAR) AS date, asset, round(level, 8) AS level, stale FROM (
      SELECT g.date, g.asset, last_value(r.ret IGNORE NULLS) OVER (PARTITION BY g.asset ORDER BY g.date
        ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS level, r.ret IS NULL AS stale
      FROM (SELECT c.date, a.asset FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM rets) a) g
      LEFT JOIN rets r USING (date, asset)) WHERE level IS NOT NULL"""))
def fill_gaps_limit5(t: Tables):
    levels = t.returns.withColumnRenamed("ret", "level")
    return tidy(align.fill_gaps(levels, t.calendar, "asset", "level", 5))


@query("excess_returns", with_ctes("rets cal rfm", """
    SELECT CAST(r.date AS VARCHAR) AS date, r.asset, round(r.ret - f.rf, 8) AS ret
    FROM rets r LEFT JOIN (SELECT c.date, (SELECT max_by(rf, m.date) FROM rfm m WHERE m.date <= c.date) AS rf FROM cal c) f
    USING (date)"""))
def excess_returns(t: Tables):
    return tidy(align.excess_returns(t.returns, t.risk_free, t.calendar))


TRAILING = """
    SELECT date, asset, ret, CASE WHEN n >= 15 AND sd > 0 THEN sd END AS scale FROM (
      SELECT g.date, g.asset, r.ret, count(r.ret) OVER w AS n, stddev_samp(r.ret) OVER w AS sd
      FROM (SELECT c.date, a.asset FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM rets) a) g
      LEFT JOIN rets r USING (date, asset)
      WINDOW w AS (PARTITION BY g.asset ORDER BY g.date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
    WHERE ret IS NOT NULL"""


@query("trailing_vol", with_ctes("cal rets", """
    SELECT CAST(date AS VARCHAR) AS date, asset, round(ret, 8) AS ret, round(scale, 8) AS scale FROM tv""", tv=TRAILING))
def trailing_vol(t: Tables):
    return tidy(align.trailing_volatility(t.returns, t.calendar, 60))


@query("inverse_vol_returns", with_ctes("cal rets", """
    SELECT CAST(date AS VARCHAR) AS date, asset, round(ret / scale, 6) AS ret, round(scale, 6) AS scale FROM tv""", tv=TRAILING))
def inverse_vol_returns(t: Tables):
    return tidy(align.inverse_volatility(align.trailing_volatility(t.returns, t.calendar, 60)), 6)


@query("trim_range", with_ctes("att_all rets cal", """
    SELECT CAST(date AS VARCHAR) AS date, pos FROM cal
    WHERE date BETWEEN (SELECT min(date) FROM both_in) AND (SELECT max(date) FROM both_in)""",
    both_in="SELECT DISTINCT a.date FROM att_all a JOIN rets r USING (date)"))
def trim_range(t: Tables):
    return tidy(align.common_range(t.attention_all_days, t.returns, t.calendar).select("date", "pos"))


@query("aligned_inputs", with_ctes("att rets", """
    SELECT count(DISTINCT date) AS n_days, min(CAST(date AS VARCHAR)) AS first_day, max(CAST(date AS VARCHAR)) AS last_day,
      count(*) AS n_returns FROM rets
    WHERE date BETWEEN (SELECT min(date) FROM b) AND (SELECT max(date) FROM b)""",
    b="SELECT DISTINCT a.date FROM att a JOIN rets r USING (date)"))
def aligned_inputs(t: Tables):
    _, rets, _ = align.align(t.attention_all_days, t.returns, align.AlignConfig())
    return tidy(rets.agg(
        F.countDistinct("date").alias("n_days"), F.min("date").alias("first_day"),
        F.max("date").alias("last_day"), F.count("*").alias("n_returns"),
    ))


@query("period_returns_sum", with_ctes("pret", """
    SELECT asset, period_id, CAST(period_end AS VARCHAR) AS period_end, round(ret, 8) AS ret, n_days FROM pret"""))
def period_returns_sum(t: Tables):
    return tidy(align.period_returns(t.returns, t.calendar, "sum"))


@query("period_returns_compound", with_ctes("rets cal", """
    SELECT asset, period_id, CAST(period_end AS VARCHAR) AS period_end, round(product(1 + ret) - 1, 8) AS ret, count(*) AS n_days
    FROM rets JOIN cal USING (date) GROUP BY 1, 2, 3"""))
def period_returns_compound(t: Tables):
    return tidy(align.period_returns(t.returns, t.calendar, "compound"))


@query("shocks_w5", with_ctes("shk", "SELECT CAST(date AS VARCHAR) AS date, topic, round(z, 8) AS z FROM shk SEMI JOIN att USING (date)"))
def shocks_w5(t: Tables):
    return tidy(t.shocks)


@query("shocks_w1", with_ctes("grid", """
    SELECT CAST(date AS VARCHAR) AS date, topic, round(z, 8) AS z FROM (
      SELECT date, topic, level - lag(level) OVER (PARTITION BY topic ORDER BY date) AS z FROM grid) SEMI JOIN att USING (date)"""))
def shocks_w1(t: Tables):
    return tidy(shocks.attention_shocks(t.attention, t.calendar, 1))


@query("shocks_std", with_ctes("shk", """
    SELECT CAST(date AS VARCHAR) AS date, topic,
      round(z / coalesce(nullif(sd, 0), 1), 8) AS z
    FROM (SELECT *, stddev_samp(z) OVER (PARTITION BY topic) AS sd FROM shk) SEMI JOIN att USING (date)"""))
def shocks_std(t: Tables):
    return tidy(shocks.attention_shocks(t.attention, t.calendar, 5, standardise=True))


@query("shock_diagnostics", with_ctes("shk", """
    SELECT topic, count(z) AS n, round(avg(z), 8) AS mean, round(stddev_samp(z), 8) AS std, round(skewness(z), 6) AS skew,
      round(kurtosis(z), 6) AS kurtosis, round(corr(z, prev), 8) AS autocorr1,
      round(avg(CASE WHEN z = 0 THEN 1.0 ELSE 0 END), 8) AS zero_share
    FROM (SELECT *, lag(z) OVER (PARTITION BY topic ORDER BY date) AS prev FROM shk) WHERE z IS NOT NULL GROUP BY topic"""))
def shock_diagnostics(t: Tables):
    return tidy(shocks.shock_diagnostics(t.shocks, t.calendar), 8, skew=6, kurtosis=6)


@query("kernel_weights", with_ctes("periods", """
    SELECT a.t AS period_id, b.t AS day_period, round(pow(0.99, a.t - b.t), 10) AS weight
    FROM periods a JOIN periods b ON b.t <= a.t AND a.t - b.t < 12"""))
def kernel_weights(t: Tables):
    cfg = kernel.KernelConfig(lookback=12)
    ids = t.calendar.select("period_id").distinct()
    rows = ids.select("period_id", F.explode(F.sequence(F.greatest(F.col("period_id") - 11, F.lit(0)), "period_id")).alias("day_period"))
    return tidy(rows.select("period_id", "day_period", kernel.kernel_weight(F.col("period_id") - F.col("day_period"), cfg).alias("weight")), 10)


KCOV_OUT = "SELECT period_id, asset, topic, round(cov, 9) AS cov, n_days FROM {src}"


def _kernel_sql(xi: float, skip: int = 1, lookback: int | None = None, cal: str = "cal") -> str:
    inside = f"d.period_id < p.t OR (d.period_id = p.t AND d.back > {skip})"
    if lookback:
        inside = f"({inside}) AND p.t - d.period_id < {lookback}"
    extra = {
        "pd": f"""SELECT r.asset, s.topic, c.period_id, c.back, r.ret AS r, s.z
            FROM rets r JOIN shk s USING (date) SEMI JOIN okday k ON k.date = s.date JOIN {cal} c ON c.date = s.date""",
        "pt": f"SELECT DISTINCT period_id AS t FROM {cal}",
        "kc": f"""SELECT t AS period_id, asset, topic,
              sum(w * r * z) / sum(w) - sum(w * r) / sum(w) * (sum(w * z) / sum(w)) AS cov, count(*) AS n_days
            FROM (SELECT p.t, d.asset, d.topic, d.r, d.z, pow({xi}, p.t - d.period_id) AS w FROM pt p JOIN pd d ON {inside})
            GROUP BY 1, 2, 3 HAVING count(*) >= 60""",
    }
    return with_ctes(f"rets shk okday {cal}", KCOV_OUT.format(src="kc"), **extra)


@query("kernel_cov", with_ctes("kcov", KCOV_OUT.format(src="kcov")))
def kernel_cov(t: Tables):
    return tidy(kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics), KERNEL), 9)


@query("kernel_cov_blocks", with_ctes("kcov", KCOV_OUT.format(src="kcov")))
def kernel_cov_blocks(t: Tables):
    blocks = kernel.kernel_covariance_blocks(t.returns, t.shocks, t.calendar, t.topics, KERNEL, n_blocks=8)
    return tidy(kernel.unpack_topics(blocks, t.topics), 9)


@query("kernel_cov_lookback12", _kernel_sql(0.99, lookback=12))
def kernel_cov_lookback12(t: Tables):
    return tidy(kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics), kernel.KernelConfig(lookback=12)), 9)


@query("kernel_cov_lookback12_blocks", _kernel_sql(0.99, lookback=12))
def kernel_cov_lookback12_blocks(t: Tables):
    cfg = kernel.KernelConfig(lookback=12)
    return tidy(kernel.unpack_topics(kernel.kernel_covariance_blocks(t.returns, t.shocks, t.calendar, t.topics, cfg, 8), t.topics), 9)


@query("kernel_cov_xi1", _kernel_sql(1.0, skip=3).replace("round(cov, 9)", "round(cov * sqrt(252), 9)"))
def kernel_cov_xi1(t: Tables):
    cfg = kernel.KernelConfig(xi=1.0, skip_days=3)
    cov = kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics), cfg)
    return tidy(cov.withColumn("cov", F.col("cov") * F.sqrt(F.lit(252.0))), 9)


@query("kernel_cov_weekly", _kernel_sql(0.99, lookback=26, cal="wcal"))
def kernel_cov_weekly(t: Tables):
    cfg = kernel.KernelConfig(lookback=26)
    return tidy(kernel.kernel_covariance(t.returns, t.shocks, t.calendar_of("W"), len(t.topics), cfg), 9)


@query("kernel_top_pairs", with_ctes("kcov", """
    SELECT asset, topic, round(cov, 9) AS cov, rank FROM (
      SELECT *, row_number() OVER (ORDER BY abs(round(cov, 9)) DESC, asset, topic) AS rank FROM kcov
      WHERE period_id = (SELECT max(period_id) FROM kcov)) WHERE rank <= 20"""))
def kernel_top_pairs(t: Tables):
    """The twenty pairs with the largest covariance in the last period."""
    cov = kernel.kernel_covariance(t.returns, t.shocks, t.calendar, len(t.topics), KERNEL)
    size = F.abs(F.round("cov", 9))
    newest = cov.groupBy("asset", "topic").agg(F.max_by(F.struct("period_id", "cov"), "period_id").alias("k")).select(
        "asset", "topic", "k.period_id", "k.cov")
    last = t.calendar.agg(F.max("period_id").alias("period_id"))
    top = newest.join(last, "period_id").orderBy(size.desc(), "asset", "topic").limit(20)
    ranked = top.select("asset", "topic", "cov", F.row_number().over(Window.orderBy(size.desc(), "asset", "topic")).alias("rank"))
    return tidy(ranked, 9)


@query("panel_rows", with_ctes("panel", """
    SELECT t_idx, CAST(period AS VARCHAR) AS period, asset, round(y, 8) AS y, l, round(v, 9) AS v
    FROM (SELECT t_idx, period, asset, y, unnest(x) AS v, unnest(range(len(x))) AS l FROM panel)"""))
def panel_rows(t: Tables):
    return tidy(t.panel.select("t_idx", "period", "asset", "y", F.posexplode("x").alias("l", "v")), 8, v=9)


@query("panel_summary", with_ctes("panel", """
    SELECT t_idx, CAST(period AS VARCHAR) AS period, count(*) AS n, round(avg(y), 8) AS mean, round(stddev_samp(y), 8) AS std
    FROM panel GROUP BY 1, 2"""))
def panel_summary(t: Tables):
    return tidy(panel.panel_summary(t.panel))


@query("panel_split", with_ctes("panel", """
    SELECT period < DATE '1999-01-01' AS is_train, count(*) AS n, count(DISTINCT t_idx) AS n_periods FROM panel GROUP BY 1"""))
def panel_split(t: Tables):
    split = panel.split_periods(t.panel, "1999-01-01")
    return tidy(split.groupBy("is_train").agg(F.count("*").alias("n"), F.countDistinct("t_idx").alias("n_periods")))


@query("panel_subset_renumbered", with_ctes("panel", """
    SELECT dense_rank() OVER (ORDER BY t_idx) - 1 AS t_idx, CAST(period AS VARCHAR) AS period, asset, round(y, 8) AS y
    FROM panel WHERE month(period) <> 12"""))
def panel_subset_renumbered(t: Tables):
    return tidy(panel.keep_periods(t.panel, F.month("period") != 12).select("t_idx", "period", "asset", "y"))


@query("sigma_c", with_ctes("panel", """
    SELECT l, CASE WHEN l = 0 THEN 1.0 ELSE coalesce(nullif(round(stddev_pop(v), 9), 0), 1.0) END AS sigma
    FROM (SELECT unnest(x) AS v, unnest(range(len(x))) AS l FROM panel) GROUP BY l"""))
def sigma_c(t: Tables):
    return tidy(panel.instrument_scale(t.panel), 9)


@query("panel_moments_long", with_ctes("panel", """
    SELECT t_idx, a.l, b.l - 1 AS m, round(sum(a.v * b.v), 9) AS s
    FROM (SELECT t_idx, asset, unnest(x) AS v, unnest(range(len(x))) AS l FROM panel) a
    JOIN (SELECT t_idx, asset, unnest(list_prepend(y, x)) AS v, unnest(range(len(x) + 1)) AS l FROM panel) b USING (t_idx, asset)
    GROUP BY 1, 2, 3"""))
def panel_moments_long(t: Tables):
    from loomline.operators.moments import period_moments

    return tidy(panel.moments_long(period_moments(t.panel)), 9)


# A fixed two-factor loading matrix for the fitted-value queries.
GAMMA = [[0.4, 0.1], [2.0, -1.0], [-1.5, 0.5], [0.7, 0.3], [0.0, 0.0], [1.2, -0.4]]
FIXED_FIT = {
    "bet": "SELECT *, " + ", ".join(
        " + ".join(f"{g[k]} * x[{l + 1}]" for l, g in enumerate(GAMMA)) + f" AS b{k + 1}" for k in range(2)) + " FROM panel",
    "fac": "SELECT t_idx, sum(b1 * y) / (sum(b1 * b1) + 2) AS f1, sum(b2 * y) / (sum(b2 * b2) + 2) AS f2 FROM bet GROUP BY t_idx",
    "fit": "SELECT t_idx, period, asset, y, b1 * f1 + b2 * f2 AS fitted FROM bet JOIN fac USING (t_idx)",
}


def fixed_factors(rows):
    """Per-period slopes of the return on each fixed loading alone, with ridge 2."""
    from loomline.functions.columns import dot

    b = [dot(F.col("x"), F.array(*[F.lit(g[k]) for g in GAMMA])) for k in range(2)]
    return rows.groupBy("t_idx").agg(F.array(*[F.sum(c * F.col("y")) / (F.sum(c * c) + 2) for c in b]).alias("f"))


@query("fitted_fixed_gamma", with_ctes("panel", """
    SELECT t_idx, CAST(period AS VARCHAR) AS period, asset, round(y, 8) AS y, round(fitted, 8) AS fitted FROM fit""", **FIXED_FIT))
def fitted_fixed_gamma(t: Tables):
    rows = t.panel
    return tidy(panel.fitted_values(rows, GAMMA, fixed_factors(rows)))


@query("total_r2", with_ctes("panel", """
    SELECT round(1 - sum((y - fitted) ** 2) / sum(y * y), 8) AS r2 FROM fit""", **FIXED_FIT))
def total_r2(t: Tables):
    rows = t.panel
    return tidy(panel.uncentred_r2(panel.fitted_values(rows, GAMMA, fixed_factors(rows))))


@query("pred_r2", with_ctes("panel", """
    SELECT round(1 - sum((y - b1 * m1 - b2 * m2) ** 2) / sum(y * y), 8) AS r2
    FROM bet CROSS JOIN (SELECT avg(f1) AS m1, avg(f2) AS m2 FROM fac)""", **FIXED_FIT))
def pred_r2(t: Tables):
    rows = t.panel
    f = fixed_factors(rows)
    mean = [F.avg(F.col("f")[k]).over(Window.partitionBy()) for k in range(2)]
    return tidy(panel.uncentred_r2(panel.fitted_values(rows, GAMMA, f.select("t_idx", F.array(*mean).alias("f")))))

"""The ladder of sensitivity variants on the given tables, and what it finds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.operators import direct, ladder
from loomline.operators.kernel import KernelConfig, kernel_weight
from loomline.operators.shocks import shock_vectors
from loomline.plans.catalog_align import GAMMA
from loomline.plans.catalog_lab import FIVE, FORECAST, OLS, PAIR_CTES, TOPICS, TRAIN_END, TRAIN_START, _elimination, lab_pairs
from loomline.plans.catalog_model import PATHLIKE, path_like
from loomline.plans.oracle import with_ctes
from loomline.plans.registry import query
from loomline.plans.tables import Tables, tidy

ONE = [g[0] for g in GAMMA]  # the constant's loading, then those of the five topics
NORM = sum(g * g for g in ONE[1:])
_cells = lambda f, sep=", ": sep.join(f(i) for i in FIVE)
_square = lambda f: ", ".join(f(i, j) for i in FIVE for j in FIVE)


def _inverse(source: str, prefix: str) -> dict[str, str]:
    """Inverse of the covariances g11 to g55 of ``source`` as columns v11 to v55."""
    steps = {f"{prefix}0": "SELECT 1 AS one, " + _square(lambda i, j: f"g{i}{j} AS a{i}{j}") + ", " + _square(lambda i, j: f"{1.0 if i == j else 0.0}::DOUBLE AS a{i}{5 + j}") + f" FROM {source}"}
    for name, body in _elimination(f"{prefix}0", "one", 5).items():
        steps[prefix + name[1:]] = body.replace("FROM e", f"FROM {prefix}")
    return {**steps, f"{prefix}v": "SELECT " + _square(lambda i, j: f"a{i}{5 + j} AS v{i}{j}") + f" FROM {prefix}5"}


DOT = " + ".join(f"{g} * c{i}" for i, g in zip(FIVE, ONE[1:]))
GG = {i: "(" + " + ".join(f"{g} * g{i}{j}" for j, g in zip(FIVE, ONE[1:])) + ")" for i in FIVE}
GGG = " + ".join(f"{g} * {GG[i]}" for i, g in zip(FIVE, ONE[1:]))
ROWS = {
    **OLS,
    "lastx": f"SELECT asset, arg_max(x, t_idx) AS x FROM panel WHERE period <= DATE '{TRAIN_END}' GROUP BY asset",
    "cc": f"SELECT asset, {_cells(lambda i: f'x[{i + 1}] AS c{i}')} FROM lastx",
    "gram": "SELECT " + _square(lambda i, j: f"sum(c{i} * c{j}) AS g{i}{j}") + " FROM cc",
    "zw": "SELECT date, " + ", ".join(f"max(CASE WHEN topic = '{v}' THEN z END) AS z{i}" for i, v in zip(FIVE, TOPICS)) + " FROM shk SEMI JOIN okday USING (date) GROUP BY date",
    "trn": "SELECT " + _square(lambda i, j: f"covar_pop(z{i}, z{j}) AS g{i}{j}") + f" FROM zw WHERE date BETWEEN DATE '{TRAIN_START}' AND DATE '{TRAIN_END}'",
    "pid": f"SELECT max(c.period_id) - 1 AS p FROM panel q JOIN cal c ON c.date = q.period WHERE q.period <= DATE '{TRAIN_END}'",
    "kw": "SELECT zw.*, pow(0.99, p - c.period_id) AS k FROM zw JOIN cal c USING (date) CROSS JOIN pid WHERE c.period_id < p OR (c.period_id = p AND c.back > 1)",
    "krn": "SELECT " + _square(lambda i, j: f"sum(k * z{i} * z{j}) / sum(k) - sum(k * z{i}) / sum(k) * (sum(k * z{j}) / sum(k)) AS g{i}{j}") + " FROM kw",
    **_inverse("trn", "t"), **_inverse("krn", "u"),
    "pw": f"SELECT 0 AS n, {_cells(lambda i: f'1.0::DOUBLE AS v{i}')} UNION ALL SELECT n + 1, {_cells(lambda i: f'w{i} / sqrt({_cells(lambda j: f"w{j} * w{j}", " + ")})')} FROM (SELECT n, "
          + _cells(lambda i: "(" + " + ".join(f"g{i}{j} * v{j}" for j in FIVE) + f") AS w{i}") + " FROM pw CROSS JOIN gram WHERE n < 2000)",
    "ev": f"SELECT {_cells(lambda i: f'v{i} AS d{i}')} FROM pw WHERE n = 2000",
    "q": " UNION ALL ".join([
        f"SELECT 'instruments_kernel' AS variant, asset, {_cells(lambda i: f'c{i} AS q{i}')} FROM cc",
        f"SELECT 'instruments_train', asset, {_cells(lambda i: f'c{i}')} FROM cc",
        f"SELECT 'best_k', asset, {_cells(lambda i: '(' + _cells(lambda j: f'c{j} * d{j}', ' + ') + f') * d{i}')} FROM cc CROSS JOIN ev",
        f"SELECT 'least_squares', asset, {_cells(lambda i: f'({DOT}) * {GG[i]} / ({GGG})')} FROM cc CROSS JOIN gram",
        f"SELECT 'no_constant', asset, {_cells(lambda i: f'({DOT}) * {ONE[i] / NORM}')} FROM cc",
        f"SELECT 'production', asset, {_cells(lambda i: f'({ONE[0]} + {DOT}) * {ONE[i] / NORM}')} FROM cc",
        f"SELECT 'zero', asset, {_cells(lambda i: '0.0::DOUBLE')} FROM cc"]),
    "bw": "SELECT variant, asset, " + _cells(lambda i: "(" + " + ".join(f"q{j} * CASE WHEN variant = 'instruments_kernel' THEN uv.v{j}{i} ELSE tv.v{j}{i} END" for j in FIVE) + f") * sqrt(trn.g{i}{i}) / rsc.scale AS b{i}")
          + " FROM q JOIN rsc USING (asset) CROSS JOIN tv CROSS JOIN uv CROSS JOIN trn",
    "vb": " UNION ALL ".join(f"SELECT variant, asset, '{v}' AS topic, b{i} AS b FROM bw" for i, v in zip(FIVE, TOPICS)),
}
LADDER = {
    **ROWS,
    "pr": "SELECT v.variant, v.b, l.b AS t FROM vb v JOIN long l ON l.asset = v.asset AND l.topic = v.topic",
    "rk": """SELECT variant, b, t, rank() OVER (PARTITION BY variant ORDER BY b) + (count(*) OVER (PARTITION BY variant, b) - 1) / 2.0 AS rb,
        rank() OVER (PARTITION BY variant ORDER BY t) + (count(*) OVER (PARTITION BY variant, t) - 1) / 2.0 AS rt FROM pr""",
    "sc": "SELECT variant, CASE WHEN stddev_pop(rb) > 0 THEN corr(rb, rt) END AS spearman, sqrt(avg((b - t) ** 2)) AS rmse FROM rk GROUP BY variant",
    "fd": f"""SELECT variant, date, asset, ret, scale * sum(s * b) AS fitted FROM usable JOIN sday USING (date) JOIN vb USING (asset, topic) JOIN rsc USING (asset)
        WHERE date >= DATE '{FORECAST}' AND date < DATE '{FORECAST}' + INTERVAL 364 DAY GROUP BY variant, date, asset, ret, scale""",
    "r2": "SELECT variant, median(r) AS median_r2 FROM (SELECT variant, asset, 1 - sum((ret - fitted) ** 2) / sum(ret * ret) AS r FROM fd GROUP BY 1, 2) GROUP BY variant",
    "lad": "SELECT variant, spearman, rmse, median_r2 FROM sc LEFT JOIN r2 USING (variant)",
    "share": "SELECT (" + _cells(lambda i: "d%d * (%s)" % (i, " + ".join(f"g{i}{j} * d{j}" for j in FIVE)), " + ") + ") / tr AS kept_best_k, (" + GGG + f") / {NORM} / tr AS kept_no_constant, ("
             + _cells(lambda i: f"{GG[i]} * {GG[i]}", " + ") + f") / ({GGG}) / tr AS kept_least_squares FROM gram CROSS JOIN ev CROSS JOIN (SELECT {_cells(lambda i: f'g{i}{i}', ' + ')} AS tr FROM gram)",
}


def _with(names: str, body: str, extra: dict[str, str]) -> str:
    """As ``with_ctes``, for expressions of which one refers to itself."""
    return with_ctes(names, body, **extra).replace("WITH ", "WITH RECURSIVE ", 1)


def variants(t: Tables):
    """(rows, maps, shares) of the fixed one-factor loadings: asset rows of the last training month and the matrices of all variants."""
    day = F.lit(TRAIN_END).cast("date")
    gamma = np.array(ONE)[:, None]
    inside = t.panel.where(F.col("period") <= day)
    last = materialise(inside.groupBy("asset").agg(F.max_by("x", "t_idx").alias("x")), "ladder_rows")
    vectors = materialise(shock_vectors(t.shocks, t.topics).join(t.calendar.select("date", "period_id", "back"), "date"), "ladder_shocks")
    p = inside.join(t.calendar.select(F.col("date").alias("period"), "period_id"), "period").agg(F.max("period_id")).first()[0] - 1
    cfg = KernelConfig()
    train = ladder.weighted_covariance(vectors.where(F.col("date").between(F.lit(TRAIN_START).cast("date"), day)))
    seen = vectors.where((F.col("period_id") < p) | ((F.col("period_id") == p) & (F.col("back") > cfg.skip_days)))
    kernel = ladder.weighted_covariance(seen.withColumn("k", kernel_weight(F.lit(p) - F.col("period_id"), cfg)), "k")
    return last, *ladder.inversions(gamma, ladder.instruments_gram(last), train, kernel)


def scored(t: Tables):
    last, maps, shares = variants(t)
    by_day, usable = lab_pairs(t)
    rows, scale = direct.training_rows(by_day, usable, t.topics, TRAIN_START, TRAIN_END)
    target = direct.fit_direct(rows, scale, t.topics, direct.DirectConfig(method="ols"))
    scale = materialise(scale, "ladder_scale")
    found = materialise(ladder.sensitivities(last.join(scale.select("asset", F.col("scale").alias("ret_scale")), "asset"), maps, t.topics), "ladder_b")
    first = F.lit(FORECAST).cast("date")
    window = usable.where((F.col("date") >= first) & (F.col("date") < F.date_add(first, 364)))
    return materialise(ladder.score_ladder(found, target, by_day, window, scale, t.topics), "ladder"), found, shares


@query("ladder_sensitivities", _with(PAIR_CTES + " panel", "SELECT variant, asset, topic, round(b, 6) AS b FROM vb", ROWS))
def ladder_sensitivities(t: Tables):
    """Sensitivities of every brand by every inversion of the instruments."""
    return tidy(scored(t)[1], 6)


@query("trace_ladder", _with(PAIR_CTES + " panel", "SELECT variant, round(spearman, 6) AS spearman, round(rmse, 6) AS rmse, round(median_r2, 6) AS median_r2 FROM lad", LADDER))
def trace_ladder(t: Tables):
    """Each variant against the least-squares sensitivities and on the forecast year."""
    return tidy(scored(t)[0], 6)


YEAR = ("1999-01-01", "1999-12-31")
FORECAST_ROWS = {
    "fo": f"SELECT t_idx, period, asset, y, x, {' + '.join(f'{g} * x[{i + 1}]' for i, g in enumerate(ONE))} AS b FROM panel WHERE period BETWEEN DATE '{YEAR[0]}' AND DATE '{YEAR[1]}'",
    "ff": "SELECT t_idx, sum(b * y) / (sum(b * b) + 2) AS f FROM fo GROUP BY t_idx",
    "cp": "SELECT * FROM fo CROSS JOIN (SELECT unnest(range(1, 21)) AS copy)",
    "rc": "SELECT t_idx, copy, asset, y, row_number() OVER (PARTITION BY t_idx, copy ORDER BY md5(asset)) AS k FROM cp",
    "dn": "SELECT t_idx, copy, b, row_number() OVER (PARTITION BY t_idx, copy ORDER BY md5('0|' || copy || '|' || asset)) AS k FROM cp",
    "sh": "SELECT t_idx, copy, y, b FROM rc JOIN dn USING (t_idx, copy, k)",
    "sf": "SELECT t_idx, copy, sum(b * y) / (sum(b * b) + 2) AS f FROM sh GROUP BY 1, 2",
}


def fixed_forecast(t: Tables):
    """The fixed one-factor loadings as a fit, for forecasts."""
    from loomline.operators.factor_model import Fit

    return Fit(np.array(ONE)[:, None], np.zeros((0, 1)), np.zeros(1), np.eye(1), 1.0, 0.0)


@query("forecast_fixed", with_ctes("panel", """
    SELECT asset, round(1 - sum((y - b * f) ** 2) / sum(y * y), 7) AS r2, count(*) AS n_weeks,
      (SELECT round(1 - sum((y - b * f) ** 2) / sum(y * y), 7) FROM sh JOIN sf USING (t_idx, copy)) AS r2_shuffled
    FROM fo JOIN ff USING (t_idx) GROUP BY asset""", **FORECAST_ROWS))
def forecast_fixed(t: Tables):
    """Forecast year of frozen loadings per brand, with the reference of shuffled instruments."""
    from loomline.operators import weekly

    fit = fixed_forecast(t)
    scores = weekly.forecast_scores(weekly.forecast(t.panel, fit, *YEAR)).select("asset", "r2", "n_weeks")
    return tidy(scores.crossJoin(weekly.shuffle_reference(t.panel, fit, *YEAR)), 7)


@query("forecast_terms", with_ctes("panel", """
    SELECT topic, round(sum(g * x[k + 1] * f), 7) AS explained, round(sum(g * x[k + 1] * f * y) / (SELECT sum(y * y) FROM fo), 7) AS var_share
    FROM fo JOIN ff USING (t_idx) CROSS JOIN (VALUES """ + ", ".join(f"('{n}', {i}, {g})" for i, (n, g) in enumerate(zip(["const", *TOPICS], ONE))) + """) v(topic, k, g) GROUP BY topic""", **FORECAST_ROWS))
def forecast_terms(t: Tables):
    """What every topic explains in the forecast year; the terms add up to the fitted return."""
    from loomline.operators import weekly

    return tidy(weekly.forecast_terms(weekly.forecast(t.panel, fixed_forecast(t), *YEAR), t.topics), 7)


UNITS = {**ROWS, "dv": f"SELECT r.asset, stddev_pop(r.ret) AS d FROM rets r JOIN okday o ON o.date = r.date WHERE r.date <= DATE '{TRAIN_END}' GROUP BY r.asset",
         "iw": "SELECT asset, " + _cells(lambda i: "(" + " + ".join(f"({ONE[0]} + ({DOT}) / d) * {ONE[j] / NORM} * tv.v{j}{i}" for j in FIVE) + f") * sqrt(trn.g{i}{i}) * d / rsc.scale AS b{i}")
         + " FROM cc JOIN dv USING (asset) JOIN rsc USING (asset) CROSS JOIN tv CROSS JOIN trn"}


@query("implied_fixed", _with(PAIR_CTES + " panel", "SELECT asset, topic, round(b, 5) AS b FROM (" + " UNION ALL ".join(f"SELECT asset, '{v}' AS topic, b{i} AS b FROM iw" for i, v in zip(FIVE, TOPICS)) + ")", UNITS))
def implied_fixed(t: Tables):
    """Implied sensitivities of a panel on scaled returns, brought to the units of the direct regressions."""
    from loomline.operators import align, kernel, panel, weekly
    from loomline.operators.shocks import complete_days
    from loomline.plans.catalog_lab import return_units

    divisor = materialise(weekly.training_divisor(t.returns, complete_days(t.shocks, len(t.topics)), TRAIN_END), "divisor")
    scaled = materialise(weekly.scale_returns(t.returns, divisor), "scaled_returns")
    cfg = KernelConfig()
    cov = kernel.kernel_covariance(scaled, t.shocks, t.calendar, len(t.topics), cfg)
    rows = panel.build_panel(kernel.pack_topics(cov, t.topics), align.period_returns(scaled, t.calendar), cfg.burn_in, 20)
    out = weekly.implied_sensitivities(rows, fixed_forecast(t), t.shocks, return_units(t, divisor), t.topics, TRAIN_START, TRAIN_END, 1e-12)
    return tidy(out.select("asset", "topic", "b"), 5)


LATER = "1996-07-01"


@query("kernel_training_history", with_ctes("prods periods", f"""
    SELECT CAST(period_end AS VARCHAR) AS period_end, asset, topic, n AS n_days, round(cov, 7) AS cov FROM (
      SELECT period_end, asset, topic, count(*) AS n, sum(w * r * z) / sum(w) - sum(w * r) / sum(w) * (sum(w * z) / sum(w)) AS cov
      FROM (SELECT p.t, p.period_end, d.asset, d.topic, d.r, d.z, pow(0.99, p.t - d.period_id) AS w
            FROM periods p JOIN prods d ON d.period_id < p.t OR (d.period_id = p.t AND d.back > 1) WHERE d.date >= DATE '{LATER}')
      GROUP BY 1, 2, 3) WHERE n >= 60"""))
def kernel_training_history(t: Tables):
    """Covariances of a panel that reads nothing before its training window."""
    from loomline.operators import kernel, weekly
    from loomline.operators.shocks import attention_shocks

    att, rets = weekly.panel_inputs(t.attention, t.returns, t.calendar, "training", LATER, 5)
    days = t.calendar.where(F.col("date").isNotNull())
    z = materialise(attention_shocks(att, days, 5).where(F.col("date") >= F.lit(LATER).cast("date")), "history_shocks")
    cov = kernel.kernel_covariance(rets, z, t.calendar, len(t.topics))
    ends = t.calendar.select("period_id", "period_end").distinct()
    return tidy(cov.join(ends, "period_id").select("period_end", "asset", "topic", "n_days", "cov"), 7)


EDGE = {"pth": PATHLIKE, "pq": """SELECT min(lam) AS lo, max(lam) AS hi, arg_max(lam, criterion) AS best, min(criterion) AS cmin, max(criterion) AS cmax, stddev_samp(criterion) / sqrt(count(*)) AS se FROM pth"""}
SHARE = "SELECT sum(CASE WHEN date < DATE '1997-01-06' THEN k ELSE 0 END) / sum(k) AS s FROM kw"


@query("trace_findings", _with(PAIR_CTES + " panel", """
    SELECT * FROM (
      SELECT 'implied' AS step, 'departure' AS severity, 'method' AS origin, 'The fit''s directions keep little of the instruments' AS title, kept_no_constant < 0.5 * kept_best_k AS holds FROM share
      UNION ALL SELECT 'implied', CASE WHEN k.spearman - n.spearman >= 0.05 OR k.median_r2 - n.median_r2 >= 0.005 THEN 'departure' ELSE 'note' END, 'implementation',
        'Instruments and the shocks'' covariance cover different days', s > 0.5 FROM hs, (SELECT * FROM lad WHERE variant = 'instruments_kernel') k, (SELECT * FROM lad WHERE variant = 'instruments_train') n
      UNION ALL SELECT 'implied', 'departure', 'method', 'The implied sensitivities are further from the truth than zero', p.rmse > z.rmse FROM (SELECT * FROM lad WHERE variant = 'production') p, (SELECT * FROM lad WHERE variant = 'zero') z
      UNION ALL SELECT 'implied', 'note', 'method', 'The betas hold more than their inversion returns', kept_least_squares > kept_no_constant AND l.spearman > f.spearman
        FROM share, (SELECT * FROM lad WHERE variant = 'least_squares') l, (SELECT * FROM lad WHERE variant = 'no_constant') f
      UNION ALL SELECT 'fit', 'departure', 'method', 'The penalty choice is within noise', cmax - cmin < 2 * se FROM pq
      UNION ALL SELECT 'fit', 'departure', 'implementation', 'The choice sits at the edge of the penalty grid', best <= lo OR best >= hi FROM pq
      UNION ALL SELECT 'forecast', 'note', 'method', 'The forecast R2 does not measure topic signal', max(median_r2) FILTER (variant = 'production') > 0 FROM lad
    ) WHERE holds""".replace("SELECT * FROM (", "SELECT * EXCLUDE (holds) FROM ("), {**LADDER, **EDGE, "hs": SHARE}))
def trace_findings(t: Tables):
    """What the ladder, the kernel's reach and a penalty path give away, as findings."""
    table, _, shares = scored(t)
    wide = table.unpivot("variant", ["spearman", "rmse", "median_r2"], "what", "value").select(F.concat_ws("_", "what", "variant").alias("name"), "value")
    path = path_like(t)
    facts = path.agg(F.min("lam").alias("smallest_lam"), F.max("lam").alias("largest_lam"), F.max_by("lam", "criterion").alias("best_lam"), F.min("criterion").alias("criterion_min"),
                     F.max("criterion").alias("criterion_max"), (F.stddev_samp("criterion") / F.sqrt(F.count("*"))).alias("criterion_se"))
    # No null distribution belongs to this path: its band is empty.
    facts = facts.withColumns({"null_q05": F.lit(1e300), "null_q95": F.lit(-1e300), "chosen_lam": F.col("best_lam")})
    wide = wide.unionByName(facts.unpivot([], facts.columns, "name", "value"))
    wide = wide.unionByName(table.where("variant = 'production'").select(F.lit("pooled_r2").alias("name"), F.col("median_r2").alias("value")))
    p = t.panel.where(F.col("period") <= F.lit(TRAIN_END).cast("date")).join(t.calendar.select(F.col("date").alias("period"), "period_id"), "period").agg(F.max("period_id")).first()[0] - 1
    from loomline.operators.shocks import complete_days
    from loomline.operators.weekly import history_share

    days = t.calendar.join(complete_days(t.shocks, len(t.topics)), "date", "left_semi")
    wide = wide.unionByName(history_share(days, p, "1997-01-06", KernelConfig()).select(F.lit("history_share").alias("name"), F.col("share").alias("value")))
    wide = wide.unionByName(t.spark.createDataFrame(list(shares.items()), "name string, value double"))
    return ladder.findings(wide).drop("subject")

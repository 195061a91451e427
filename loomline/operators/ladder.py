"""Where implied sensitivities lose the truth: variants of the inversion, their scores, and findings.

All variants are one matrix each, instruments to topics, made from the loadings, the instruments' own cross products
(topics x topics) and the shock covariance; rows of assets meet the matrix where they lie.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.dense import sym_pinv
from loomline.functions.ranking import spearman
from loomline.functions.session import materialise
from loomline.operators import windows
from loomline.operators.moments import collect_moments, period_moments
from loomline.operators.weekly import _times

# Differences between variants that count as material.
MATERIAL_SPEARMAN, MATERIAL_R2 = 0.05, 0.005


def weighted_covariance(vectors: DataFrame, weight: str | None = None) -> np.ndarray:
    """Population covariance of the array column ``z`` with weights; a square of the number of topics."""
    root = F.sqrt(F.col(weight)) if weight else F.lit(1.0)
    x = F.concat(F.array(root), F.transform("z", lambda v: v * root))
    s = collect_moments(period_moments(vectors.select(F.lit(0).alias("t_idx"), F.lit(0.0).alias("y"), x.alias("x"))), None).s[0]
    mean = s[0, 1:] / s[0, 0]
    return s[1:, 1:] / s[0, 0] - np.outer(mean, mean)


def inversions(gamma: np.ndarray, gram: np.ndarray, cov_train: np.ndarray, cov_kernel: np.ndarray, rcond: float = 1e-6) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """(maps, shares): for each variant the matrix from an instrument row (constant first) to sensitivities, and the share of the instruments' squared norm it keeps.

    gram: sum over assets of topic instruments' cross products. Variants: the instruments alone over either covariance, the best K
    directions, betas inverted across assets by least squares, the fit's own directions without the constant, and with it (the production form).
    """
    topics, k = gamma[1:], gamma.shape[1]
    eye, none = np.eye(len(gram)), np.zeros((1, len(gram)))
    power, axes = np.linalg.eigh(0.5 * (gram + gram.T))
    best = axes[:, np.argsort(power)[::-1][:k]]
    back = topics @ sym_pinv(topics.T @ topics, rcond)[0]
    crossed = topics @ sym_pinv(topics.T @ gram @ topics, rcond)[0] @ topics.T @ gram
    kept = {"instruments_kernel": eye, "instruments_train": eye, "best_k": best @ best.T, "least_squares": crossed, "no_constant": topics @ back.T}
    sd, total = np.sqrt(np.diag(cov_train)), max(float(np.trace(gram)), 1e-300)
    over = {name: sym_pinv(cov_kernel if name == "instruments_kernel" else cov_train, rcond)[0] * sd for name in [*kept, "production"]}
    maps = {name: np.vstack([none, m]) @ over[name] for name, m in kept.items()}
    maps["production"] = gamma @ back.T @ over["production"]
    maps["zero"] = np.zeros_like(maps["production"])
    shares = {f"kept_{name}": float(np.trace(m.T @ gram @ m)) / total for name, m in kept.items()} | {"random_share": min(k, len(gram)) / len(gram)}
    return maps, shares


def instruments_gram(rows: DataFrame) -> np.ndarray:
    """Cross products of the topic instruments of ``rows`` (x, constant first), summed over assets."""
    return collect_moments(period_moments(rows.select(F.lit(0).alias("t_idx"), F.lit(0.0).alias("y"), "x")), None).s[0][1:, 1:]


def sensitivities(rows: DataFrame, maps: dict[str, np.ndarray], topics: list[str]) -> DataFrame:
    """(variant, asset, topic, b) of every variant; ``rows`` has asset, x and ret_scale (the unit of an asset's returns)."""
    names = list(maps)
    wide = rows.withColumn("b", _times(F.col("x"), np.hstack([maps[n] for n in names])))
    order = F.array(*[F.lit(f"{n}\t{t}") for n in names for t in topics])
    long = wide.select("asset", "ret_scale", F.posexplode("b").alias("k", "raw")).withColumn("at", F.split(F.element_at(order, F.col("k") + 1), "\t"))
    return long.select(F.col("at")[0].alias("variant"), "asset", F.col("at")[1].alias("topic"), (F.col("raw") / F.col("ret_scale")).alias("b"))


def score_ladder(found: DataFrame, target: DataFrame, by_return_day: DataFrame, usable: DataFrame, scale: DataFrame, topics: list[str]) -> DataFrame:
    """(variant, spearman, rmse, median_r2): each variant against the ``target`` (asset, topic, b) and on the days of ``usable``.

    The rank correlation is over all pairs, null for a constant; the R2 is the uncentred one of frozen coefficients per asset, its median over assets.
    """
    pairs = materialise(found.join(target.select("asset", "topic", F.col("b").alias("target")), ["asset", "topic"]), "ladder_pairs")
    errors = pairs.groupBy("variant").agg(F.sqrt(F.avg(F.pow(F.col("b") - F.col("target"), 2))).alias("rmse"))
    names = [r[0] for r in errors.select("variant").collect()]
    ranked = None
    for name in names:
        one = spearman(pairs.where(F.col("variant") == name), "b", "target").withColumn("variant", F.lit(name))
        ranked = one if ranked is None else ranked.unionByName(one)
    both = F.concat_ws("\t", "variant", "asset")
    keyed = [df.withColumn("asset", both) for df in (found, usable.crossJoin(found.select("variant").distinct()), scale.crossJoin(found.select("variant").distinct()))]
    fitted = windows.fitted_days(by_return_day, keyed[1], keyed[0], keyed[2], topics)
    r2 = windows.window_r2(fitted, "asset").withColumn("variant", F.split("asset", "\t")[0])
    return errors.join(ranked, "variant").join(windows.median_r2(r2, "variant").select("variant", "median_r2"), "variant", "left").select("variant", "spearman", "rmse", "median_r2")


# What is looked for: step, severity, origin, title and when it holds, over the facts by name; the severity may depend on them too.
RULES = [
    ("implied", "'departure'", "method", "The fit's directions keep little of the instruments", "kept_no_constant < 0.5 * kept_best_k"),
    ("implied", f"CASE WHEN spearman_instruments_kernel - spearman_instruments_train >= {MATERIAL_SPEARMAN} OR median_r2_instruments_kernel - median_r2_instruments_train >= {MATERIAL_R2} THEN 'departure' ELSE 'note' END",
     "implementation", "Instruments and the shocks' covariance cover different days", "history_share > 0.5"),
    ("implied", "'departure'", "method", "The implied sensitivities are further from the truth than zero", "rmse_production > rmse_zero"),
    ("implied", "'note'", "method", "The betas hold more than their inversion returns", "kept_least_squares > kept_no_constant AND spearman_least_squares > spearman_no_constant"),
    ("fit", "'departure'", "implementation", "The fit stopped at its sweep cap", "converged = 0"),
    ("fit", "'departure'", "method", "The chosen fit is worse than no fit", "objective > zero_objective"),
    ("fit", "'departure'", "method", "The penalty choice follows noise", "criterion_min >= null_q05 AND criterion_max <= null_q95"),
    ("fit", "'departure'", "method", "The penalty choice is within noise", "NOT (criterion_min >= null_q05 AND criterion_max <= null_q95) AND criterion_max - criterion_min < 2 * criterion_se"),
    ("fit", "'departure'", "implementation", "The choice sits at the edge of the penalty grid", "chosen_lam <= smallest_lam OR chosen_lam >= largest_lam OR best_lam <= smallest_lam OR best_lam >= largest_lam"),
    ("fit", "'note'", "method", "Spurious stationary points on the path", "points_above_zero > 0"),
    ("fit", "'departure'", "method", "A factor is dead", "factor_ratio < 1e-6"),
    ("fit", "'note'", "method", "The selected topics are not those with the largest true sensitivities", "top_topics_selected < 0.5 * top_topics"),
    ("instruments", "CASE WHEN effective_days >= 500 THEN 'departure' ELSE 'note' END", "data", "Instruments are far from their population value", "instrument_corr < 0.9"),
    ("align", "'note'", "implementation", "The unit conversion is approximate", "conversion_gap > 0.1"),
    ("forecast", "'note'", "method", "The forecast R2 does not measure topic signal", "pooled_r2 > 0"),
]
STEPS = ("inputs", "align", "shocks", "instruments", "panel", "fit", "path", "forecast", "implied")
SEVERITIES = ("defect", "departure", "note")


def findings(facts: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """(step, severity, origin, title, subject) of every rule that holds and of every identity check that is off.

    ``facts`` is (name, value), one row a name; a rule that reads a missing or null fact does not hold. ``checks`` has step, name, status and kind.
    """
    names = {word for rule in RULES for text in (rule[1], rule[4]) for word in text.replace("(", " ").replace(")", " ").split() if word[:1].islower() and word[0] != "'"}
    row = facts.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in sorted(names)])
    held = [row.select(F.lit(s).alias("step"), F.expr(sev).alias("severity"), F.lit(o).alias("origin"), F.lit(title).alias("title"), F.lit(None).cast("string").alias("subject"), F.coalesce(F.expr(when), F.lit(False)).alias("holds")) for s, sev, o, title, when in RULES]
    out = held[0]
    for one in held[1:]:
        out = out.unionByName(one)
    out = out.where("holds").drop("holds")
    if checks is not None:
        off = checks.where("status = 'fail' AND kind = 'identity'")
        out = out.unionByName(off.select("step", F.lit("defect").alias("severity"), F.lit("defect").alias("origin"), F.lit("Check off").alias("title"), F.col("name").alias("subject")))
    return out


def in_order(found: DataFrame) -> DataFrame:
    """Findings by step, then severity; a few rows."""
    place = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    return found.orderBy(place("step", STEPS), place("severity", SEVERITIES), "title", "subject")

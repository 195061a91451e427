"""From a fitted model back to topics, days, terms and documents."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.dense import least_squares_map, sym_pinv
from loomline.operators.factor_model import Fit, loading_map
from loomline.operators.moments import collect_moments, period_moments


def topic_weights(spark, topics: list[str], weights: np.ndarray) -> DataFrame:
    """Small table (topic, factor, w) of a topics x factors matrix."""
    rows = [(topics[i], k + 1, float(v)) for (i, k), v in np.ndenumerate(np.atleast_2d(weights.T).T)]
    return spark.createDataFrame(rows, "topic string, factor int, w double")


def impact_vectors(fit: Fit, rcond: float = 1e-6) -> tuple[np.ndarray, np.ndarray, bool]:
    """Topic-to-state map, topic-to-efficient-portfolio vector and the rank flag."""
    loadings, short = loading_map(fit, rcond)
    to_state = least_squares_map(loadings, rcond)[0]
    return to_state, to_state @ fit.mve(rcond), short


def weighted_shocks(shocks: DataFrame, weights: DataFrame, n_topics: int) -> DataFrame:
    """``sum_topic w z`` per (date, factor); NULL on days with a missing shock.

    ``weights`` has one row per topic and factor, which is small by construction,
    so the shocks are never shuffled by topic: the sums combine map-side by day.
    """
    terms = shocks.join(weights, "topic")
    value = F.when(F.count("z") == n_topics, F.sum(F.col("z") * F.col("w")))
    return terms.groupBy("date", "factor").agg(value.alias("value"))


def project_observable(factors: DataFrame, target: DataFrame, K: int) -> DataFrame:
    """OLS of a period series on the factors: slopes and centred R2, NULL below K + 1 periods.

    ``factors`` has ``t_idx`` and the array ``f``; ``target`` has ``t_idx`` and ``y``.
    The cross products are Spark sums; only a (K + 2)-square matrix is solved.
    """
    rows = factors.join(target.where("y IS NOT NULL"), "t_idx")
    x = F.concat(F.array(F.lit(1.0)), "f", F.array("y"))
    held = collect_moments(period_moments(rows.select(F.lit(0).alias("t_idx"), "y", x.alias("x"))), None)
    s, n = held.s[0], int(held.n[0])
    spark = factors.sparkSession
    schema = "b array<double>, r2 double, n int"
    if n < K + 1:
        return spark.createDataFrame([(None, None, n)], schema)
    mean = s[0, 1:] / n
    centred = s[1:, 1:] - n * np.outer(mean, mean)
    b = sym_pinv(centred[:K, :K], 1e-12)[0] @ centred[:K, K]
    r2 = float(b @ centred[:K, K] / centred[K, K]) if centred[K, K] > 0 else None
    return spark.createDataFrame([([float(v) for v in b], r2, n)], schema)


def term_impact(phi: DataFrame, impact: dict[str, float], rcond: float = 1e-6) -> DataFrame:
    """Impact of each term: ``P'(PP')^+ impact`` for the topic x term matrix ``P``.

    The vocabulary stays distributed: one row of topic shares per term gives
    ``PP'`` as a sum of outer products, and the final weights are one pass over
    ``phi``.
    """
    topics = sorted(impact)
    order = F.array(*[F.lit(t) for t in topics])
    packed = phi.where(F.col("topic").isin(topics)).groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("topic", "p"))).alias("m")
    )
    wide = packed.select(F.transform(order, lambda t: F.coalesce(F.col("m")[t], F.lit(0.0))).alias("x"))
    gram = collect_moments(period_moments(wide.select(F.lit(0).alias("t_idx"), F.lit(0.0).alias("y"), "x")), None).s[0]
    weights = sym_pinv(gram, rcond)[0] @ np.array([impact[t] for t in topics])
    small = phi.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(topics, weights)], "topic string, w double")
    return phi.join(small, "topic").groupBy("term").agg(F.sum(F.col("p") * F.col("w")).alias("impact"))


@dataclass
class WrapUp:
    """What a fit says about topics, days, observables and terms; tables are long."""

    loadings: DataFrame  # (topic, factor, w): topics on the latent states
    states: DataFrame  # (date, factor, value)
    mve: DataFrame  # (date, value): the efficient portfolio's state
    impacts: DataFrame  # (topic, target, w): of a unit shock on every state, the efficient portfolio and each observable
    projections: DataFrame | None = None  # (name, b, r2, n)
    terms: DataFrame | None = None  # (term, target, impact)
    rank_deficient: bool = False
    targets: list[str] = field(default_factory=list)


def wrap_up(fit: Fit, shocks: DataFrame, topics: list[str], factors: DataFrame, observables: dict[str, DataFrame] | None = None, phi: DataFrame | None = None, rcond: float = 1e-6) -> WrapUp:
    """Loadings of topics on states, daily states, and impact vectors carried through to observables and terms.

    factors: (t_idx, f); observables: by name (t_idx, y), each projected on the factors where it has a value; phi: (topic, term, p), which must
    hold every topic. An observable with fewer than K + 1 periods has null projections and no impact. Impacts of terms are given for the
    efficient portfolio and every observable.
    """
    spark, width = shocks.sparkSession, fit.K
    loadings, short = loading_map(fit, rcond)
    to_state, b = least_squares_map(loadings, rcond)[0], fit.mve(rcond)
    states = weighted_shocks(shocks, topic_weights(spark, topics, to_state), len(topics))
    mve = weighted_shocks(shocks, topic_weights(spark, topics, (to_state @ b)[:, None]), len(topics)).select("date", "value")
    vectors, projected = {**{f"f{k + 1}": to_state[:, k] for k in range(width)}, "mve": to_state @ b}, []
    for name, series in (observables or {}).items():
        row = project_observable(factors, series, width).first()
        projected.append((name, row["b"], row["r2"], row["n"]))
        if row["b"] is not None:
            vectors[name] = to_state @ np.array(row["b"])
    impacts = spark.createDataFrame([(topic, target, float(w)) for target, vec in vectors.items() for topic, w in zip(topics, vec)], "topic string, target string, w double")
    out = WrapUp(topic_weights(spark, topics, loadings), states, mve, impacts, rank_deficient=short, targets=list(vectors))
    if observables:
        out.projections = spark.createDataFrame(projected, "name string, b array<double>, r2 double, n int")
    if phi is not None:
        missing = set(topics) - {r[0] for r in phi.select("topic").where(F.col("topic").isin(topics)).distinct().collect()}
        if missing:
            raise ValueError(f"phi has no row for {len(missing)} topics, {sorted(missing)[0]} among them")
        for target in ["mve", *(n for n in (observables or {}) if n in vectors)]:
            one = term_impact(phi, dict(zip(topics, vectors[target].tolist())), rcond).select("term", F.lit(target).alias("target"), "impact")
            out.terms = one if out.terms is None else out.terms.unionByName(one)
    return out


def top_scores(scores: DataFrame, value: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` largest rows; planned as a per-task top-k, never a full sort."""
    return scores.where(F.col(value).isNotNull()).orderBy(F.col(value).desc(), *ties).limit(k)

"""The check table of a finished study: what was stored against what follows from the inputs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import group_lasso
from loomline.operators import align, inference, panel, scoring, tuning
from loomline.operators.factor_model import ArrayPeriods, TablePeriods, canonical, factor_table, fit_sparse, largest_lambda, penalties
from loomline.operators.moments import collect_moments
from loomline.plans.study import Study, StudyConfig

SCHEMA = "step string, name string, value double, reference double, tolerance double, status string, kind string"


def _row(step: str, name: str, value: float, reference: float, tolerance: float | None, relative: bool = True):
    if tolerance is None:
        return step, name, float(value), float(reference), None, "info", "info"
    gap = abs(value - reference) / (max(abs(reference), 1e-300) if relative else 1.0)
    return step, name, float(value), float(reference), float(tolerance), "pass" if gap <= tolerance else "fail", "identity"


def model_checks(study: Study, cfg: StudyConfig) -> list[tuple]:
    """Checks that need the model: refit, stationarity, closed forms, grid and tie band."""
    held = collect_moments(study.moments)
    periods, fit = (TablePeriods(study.moments) if held is None else ArrayPeriods(held)), study.fit
    gamma = fit.gamma * periods.sigma[:, None]
    now = periods.run(gamma) if held is not None else periods.run(gamma, factors=True)
    path = [r.asDict() for r in study.path.select("K", "lam", "criterion", "objective", "n_selected").collect()]
    out = [
        _row("fit", "factors follow from the loadings", float(np.abs(now.factors - fit.factors).max()), 0.0, 1e-8 * max(1.0, np.abs(fit.factors).max()), False),
        _row("fit", "total R2 recomputed", 1 - now.ssr / periods.total(), fit.total_r2, 1e-8),
        _row("fit", "canonical: factor covariance is diagonal", float(np.abs(fit.cov - np.diag(np.diag(fit.cov))).max()), 0.0, 1e-10 * np.abs(fit.cov).max(), False),
        _row("fit", "canonical: factor means are not negative", float(min(fit.mu.min(), 0.0)), 0.0, 1e-12, False),
        _row("fit", "smallest to largest factor variance", float(np.linalg.eigvalsh(fit.cov)[0] / np.linalg.eigvalsh(fit.cov)[-1]), 1.0, None),
    ]
    if fit.lam > 0:
        pen = penalties(fit.lam, periods.n_obs, periods.width, cfg.fit)
        cost = float(pen @ np.linalg.norm(gamma, axis=1))
        gap = group_lasso.optimality_gap(now.gram, now.cross, gamma, pen)
        again = canonical(fit_sparse(periods, fit.lam, cfg.fit, gamma))
        out += [
            _row("fit", "objective recomputed", 0.5 * now.ssr + cost + float((fit.factors**2).sum()), fit.objective, 1e-8),
            _row("fit", "penalty is twice the ridge", cost, 2 * float((fit.factors**2).sum()), None),
            _row("fit", "stationarity of the stored fit", gap / max(np.abs(now.cross).max(), 1e-300), 0.0, None),
            _row("fit", "a refit from here does not improve", again.objective, fit.objective, 1e-6),
        ]
    lams = np.array(sorted(r["lam"] for r in path if r["K"] == fit.K and r["lam"] > 0))
    if cfg.fit.lambdas is None and len(lams) > 2:
        from dataclasses import replace

        steps = np.diff(np.log(lams))
        out += [
            _row("path", "penalties are log-spaced", float(np.ptp(steps)), 0.0, 1e-9, False),
            _row("path", "largest penalty recomputed", largest_lambda(periods, replace(cfg.fit, K=fit.K)), float(lams[-1]), 1e-8),
        ]
    best = max(r["criterion"] for r in path)
    width = max(cfg.tune.tolerance * abs(best), tuning.TIE * max(1.0, abs(best)))
    chosen = next(r for r in path if r["lam"] == fit.lam and r["K"] == fit.K)
    zero = 0.5 * periods.total()
    out += [
        _row("path", "chosen point is inside the tie band", float(chosen["criterion"] >= best - width), 1.0, 0.0, False),
        _row("path", "chosen fit beats the empty model", float(fit.lam == 0 or fit.objective <= zero * (1 + 1e-12)), 1.0, 0.0, False),
    ]
    return out


def study_checks(study: Study, returns: DataFrame, cfg: StudyConfig) -> DataFrame:
    """All checks as rows. Table identities are aggregates over the stored tables."""
    spark = study.panel.sparkSession
    rows = spark.createDataFrame(model_checks(study, cfg), SCHEMA)

    def table(df: DataFrame) -> DataFrame:
        return df.select("step", "name", "value", F.lit(0.0).alias("reference"), "tolerance", "status", F.lit("identity").alias("kind"))

    constant = scoring.difference_check(study.panel.select(F.col("x")[0].alias("a"), F.lit(1.0).alias("b")), "panel", "constant column", "a", "b", 0.0)
    sums = align.period_returns(returns, study.calendar, cfg.accumulate).select("asset", F.col("period_end").alias("period"), F.col("ret").alias("b"))
    rebuilt = scoring.difference_check(study.panel.join(sums, ["asset", "period"], "left").select(F.col("y").alias("a"), "b"), "panel", "period return", "a", "b", 1e-12)
    gamma = [[float(v) for v in row] for row in study.fit.gamma]
    fitted = panel.fitted_values(study.panel, gamma, factor_table(study.panel, study.fit).select("t_idx", "f"))
    r2 = panel.uncentred_r2(fitted).withColumn("b", F.lit(study.fit.total_r2))
    from_rows = scoring.difference_check(r2, "fit", "total R2 from panel rows", "r2", "b", 1e-8)
    smallest = study.panel.groupBy("t_idx").count().agg(F.min("count").cast("double").alias("value"))
    enough = smallest.select(
        F.lit("panel").alias("step"), F.lit("fewest assets in a period").alias("name"), "value", F.lit(float(cfg.min_assets)).alias("reference"), F.lit(0.0).alias("tolerance"),
        F.when(F.col("value") >= cfg.min_assets, "pass").otherwise("fail").alias("status"), F.lit("identity").alias("kind"))
    return rows.unionByName(table(constant)).unionByName(table(rebuilt)).unionByName(table(from_rows)).unionByName(enough)


def alphas(study: Study) -> DataFrame:
    """Pricing regressions of the panel's own assets on its factors."""
    factors = factor_table(study.panel, study.fit).select("t_idx", "f")
    return inference.price_test_assets(study.panel.select("t_idx", "asset", "y"), factors, study.fit.K)

"""The full study: align, shocks, covariances, panel, tuning, out-of-sample, interpretation, tests."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import bounded_list, materialise
from loomline.operators import align, inference, interpret, kernel, moments, panel, shocks, tuning
from loomline.operators.factor_model import Fit, FitConfig, factor_table, gamma_table

# Topics beyond which covariances are computed as matrix products per asset block.
WIDE = 32


@dataclass(frozen=True)
class StudyConfig:
    """One settings object per step."""

    data: align.AlignConfig = align.AlignConfig()
    shock_window: int = 5
    standardise: bool = False
    kernel: kernel.KernelConfig = kernel.KernelConfig()
    min_assets: int = 20
    accumulate: str = "sum"
    fit: FitConfig = FitConfig()
    tune: tuning.TuneConfig = tuning.TuneConfig()
    oos: tuning.OosConfig = tuning.OosConfig()
    n_placebos: int = 0
    placebo_seed: int = 12345
    t_crit: float = 1.96
    hac_lags: int | None = None


@dataclass
class Study:
    """Everything a run produced; tables are DataFrames, the chosen model is in memory."""

    calendar: DataFrame
    topics: list[str]
    shocks: DataFrame
    panel: DataFrame
    moments: DataFrame
    path: DataFrame
    fit: Fit
    oos: DataFrame | None = None
    wrapup: interpret.WrapUp | None = None
    placebo: DataFrame | None = None
    status: dict[str, str] = field(default_factory=dict)


def covariances(returns, shock_rows, calendar, topics: list[str], cfg: kernel.KernelConfig) -> DataFrame:
    """Array covariances by whichever form suits the number of topics and the decay."""
    n_periods = calendar.select("period_id").distinct().count()
    if len(topics) <= WIDE and kernel.rescaling_is_safe(n_periods, cfg):
        return kernel.pack_topics(kernel.kernel_covariance(returns, shock_rows, calendar, len(topics), cfg), topics)
    n_assets = returns.agg(F.approx_count_distinct("asset")).first()[0]
    return kernel.kernel_covariance_blocks(returns, shock_rows, calendar, topics, cfg, max(8, n_assets // 256 + 1))


def build(attention: DataFrame, returns: DataFrame, cfg: StudyConfig, risk_free: DataFrame | None = None, extra_shocks=None):
    """Steps from raw inputs to written moments."""
    att, rets, cal = align.align(attention, returns, cfg.data, risk_free)
    cal = materialise(cal, "calendar")
    rets = materialise(rets.select("date", "asset", "ret"), "aligned_returns")
    shock_rows = materialise(shocks.attention_shocks(att, cal, cfg.shock_window, cfg.standardise), "shocks")
    topics = bounded_list(shock_rows, "topic", 10_000)
    return assemble(rets, shock_rows, cal, topics, cfg)


def assemble(rets, shock_rows, cal, topics: list[str], cfg: StudyConfig):
    """Covariances, panel and moments of one set of shocks."""
    cov = covariances(rets, shock_rows, cal, topics, cfg.kernel)
    rows = panel.build_panel(cov, align.period_returns(rets, cal, cfg.accumulate), cfg.kernel.burn_in, cfg.min_assets)
    return rets, shock_rows, cal, topics, rows, moments.period_moments(rows)


def run_study(attention: DataFrame, returns: DataFrame, cfg: StudyConfig = StudyConfig(), risk_free: DataFrame | None = None,
              observables: dict[str, DataFrame] | None = None, phi: DataFrame | None = None) -> Study:
    """All steps. Interpretation and placebo failures are recorded and do not stop the run; others do.

    observables: by name (t_idx, y), projected on the factors; phi: (topic, term, p), for the impact of terms. The
    panel's own market is projected in any case.
    """
    rets, shock_rows, cal, topics, rows, mom = build(attention, returns, cfg, risk_free)
    path, fit = tuning.tune_model(mom, cfg.fit, cfg.tune)
    out = Study(cal, topics, shock_rows, rows, mom, path, fit)
    schedule = tuning.refit_schedule(rows.select("t_idx", "period").distinct(), cfg.oos)
    out.oos = materialise(tuning.run_out_of_sample(mom, schedule, cfg.fit, cfg.tune, cfg.oos), "oos")
    try:
        seen = {"market": period_market(out), **(observables or {})}
        out.wrapup = interpret.wrap_up(fit, shock_rows, topics, factor_table(rows, fit).select("t_idx", "f"), seen, phi, cfg.tune.rcond)
        out.status["interpret"] = "rank deficient" if out.wrapup.rank_deficient else "ok"
    except (ValueError, np.linalg.LinAlgError) as problem:
        out.status["interpret"] = f"failed: {problem}"
    if cfg.n_placebos:
        try:
            out.placebo = placebo_test(out, rets, cfg)
            out.status["placebo"] = "ok"
        except (ValueError, np.linalg.LinAlgError) as problem:
            out.status["placebo"] = f"failed: {problem}"
    return out


def placebo_test(study: Study, rets: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Adds noise topics, repeats the steps up to tuning and counts what was picked."""
    spark = study.panel.sparkSession
    noisy = materialise(shocks.append_placebos(study.shocks, study.topics, cfg.n_placebos, cfg.placebo_seed), "placebos")
    topics = bounded_list(noisy, "topic", 10_000)
    *_, mom = assemble(rets, noisy, study.calendar, topics, cfg)
    _, fit = tuning.tune_model(mom, cfg.fit, cfg.tune)

    def chosen(f: Fit, names: list[str]) -> DataFrame:
        return spark.createDataFrame([(n,) for n, keep in zip(names, f.selected) if keep], "topic string")

    return inference.placebo_counts(chosen(fit, topics), chosen(study.fit, study.topics))


def period_market(study: Study) -> DataFrame:
    """Equal-weight return of the panel per period, as an observable to project on."""
    return study.panel.groupBy("t_idx").agg(F.avg("y").alias("y"))


def _pricing(study: Study, cfg: StudyConfig, assets: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """(name, value): summary and joint test of the test assets under every set of factors (t_idx, f)."""
    out = None
    for model, factors in models.items():
        width = len(factors.first()["f"])
        tests = inference.price_test_assets(assets, factors, width, cfg.hac_lags)
        summary = inference.pricing_summary(tests, cfg.t_crit)
        n_assets = assets.where("y IS NOT NULL").select("asset").distinct().count()
        joint = inference.joint_alpha_test(assets, factors, n_assets, width).select(F.col("f_stat").alias("grs_stat"), F.col("p_value").alias("grs_pvalue"))
        names = ["avg_abs_alpha", "avg_abs_t", "frac_significant", "grs_stat", "grs_pvalue"]
        rows = summary.crossJoin(joint).select(names).unpivot([], names, "name", "value").select(F.concat(F.lit(f"pricing_{model}_"), "name").alias("name"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def benchmark_correlations(study: Study, cfg: StudyConfig, benchmarks: DataFrame) -> DataFrame:
    """Correlation of every factor and of the efficient portfolio with the benchmark factors (t_idx, f)."""
    own = factor_table(study.panel, study.fit).select("t_idx", "f")
    b = F.array(*[F.lit(float(v)) for v in study.fit.mve(cfg.tune.rcond)])
    long = own.select("t_idx", F.posexplode("f").alias("k", "value")).select("t_idx", F.concat(F.lit("f"), F.col("k") + 1).alias("name"), "value")
    mve = own.select("t_idx", F.lit("mve").alias("name"), F.aggregate(F.zip_with("f", b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y).alias("value"))
    other = benchmarks.select("t_idx", F.posexplode("f").alias("k", "value")).select("t_idx", F.concat(F.lit("benchmark"), F.col("k") + 1).alias("name"), "value")
    return inference.factor_correlations(long.unionByName(mve), other, "t_idx")


def report(study: Study, cfg: StudyConfig, test_assets: DataFrame | None = None, benchmarks: DataFrame | None = None) -> DataFrame:
    """Flat metrics ``(name, value)`` of a run, each computed from its tables.

    test_assets: (t_idx, asset, y), the panel's own where none are given; they are priced by the factors in sample, out of
    sample and by the benchmark factors (t_idx, f), with a joint test each.
    """
    spark, fit = study.panel.sparkSession, study.fit
    pairs = [
        ("n_topics", len(study.topics)), ("K", fit.K), ("lam", fit.lam), ("n_selected", int(fit.selected.sum())), ("frac_selected", float(fit.selected.mean())),
        ("total_r2", fit.total_r2), ("pred_r2", fit.pred_r2), ("is_sharpe", fit.sharpe(cfg.tune.annualization, cfg.tune.rcond)),
        ("objective", fit.objective), ("converged", float(fit.converged)), ("n_iter", fit.n_iter), ("n_populated_periods", len(fit.factors)),
    ]
    metrics = spark.createDataFrame([(n, float(v)) for n, v in pairs], "name string, value double")

    def add(row: DataFrame) -> None:
        nonlocal metrics
        row = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
        metrics = metrics.unionByName(row.unpivot([], row.columns, "name", "value"))

    add(study.panel.agg(F.count("*").alias("n_obs"), F.count_distinct("t_idx").alias("T"), F.count_distinct("asset").alias("N")))
    if study.path is not None:
        add(study.path.agg(F.max("lam").alias("lam_max"), F.count("*").alias("n_path_points")))
    models = {"narrative_is": factor_table(study.panel, fit).select("t_idx", "f")}
    if study.oos is not None:
        add(tuning.realised_sharpe(study.oos, "mve", cfg.tune.annualization).select(F.col("sharpe").alias("oos_sharpe")))
        refits = study.oos.groupBy("refit").agg(F.first("n_selected").alias("s"), F.first("lam").alias("lam"))
        add(study.oos.agg(F.count("mve").alias("oos_n_periods")).crossJoin(refits.agg(F.count("*").alias("oos_n_refits"), F.avg("s").alias("oos_mean_n_selected"), F.avg("lam").alias("oos_mean_lam"))))
        order = F.array(*[F.lit(t) for t in study.topics])
        sets = study.oos.groupBy("refit").agg(F.first("selected").alias("s")).select(
            "refit", F.filter(F.transform("s", lambda keep, i: F.when(keep, F.element_at(order, i + 1))), lambda x: x.isNotNull()).alias("topics")
        )
        add(tuning.selection_stability(sets).select(F.col("stability").alias("selection_stability")))
        models["narrative_oos"] = study.oos.select("t_idx", F.col("factors").alias("f"))
    if benchmarks is not None:
        models["benchmark"] = benchmarks
    if study.wrapup is not None:
        add(spark.createDataFrame([(float(study.wrapup.rank_deficient),)], "wrapup_rank_deficient double"))
        if study.wrapup.projections is not None:
            metrics = metrics.unionByName(study.wrapup.projections.select(F.concat(F.lit("obs_r2_"), "name").alias("name"), F.col("r2").alias("value")))
    if study.placebo is not None:
        add(study.placebo.select(F.lit(cfg.n_placebos).alias("placebo_n"), F.col("n_placebo").alias("placebo_n_selected"), F.col("n_real").alias("placebo_n_real_selected"), F.col("jaccard").alias("placebo_jaccard_real")))
    assets = study.panel.select("t_idx", "asset", "y") if test_assets is None else test_assets
    return metrics.unionByName(_pricing(study, cfg, assets, models))


def settings(cfg: StudyConfig) -> dict:
    """Plain dictionary of every setting, for hashing and manifests."""
    return asdict(cfg)


def model_tables(study: Study) -> dict[str, DataFrame]:
    """The tables a run directory holds."""
    out = {
        "calendar": study.calendar, "shocks": study.shocks, "panel": study.panel, "path": study.path,
        "gamma": gamma_table(study.panel.sparkSession, study.fit, study.topics), "factors": factor_table(study.panel, study.fit),
    }
    for name in ("oos", "placebo"):
        if getattr(study, name) is not None:
            out[name] = getattr(study, name)
    if study.wrapup is not None:
        out |= {name: table for name in ("loadings", "states", "mve", "impacts", "projections", "terms") if (table := getattr(study.wrapup, name)) is not None}
    return out

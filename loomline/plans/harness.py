"""Repeated studies on designed attention with a known answer, scored and summarised.

Runs use the given returns; a scenario only changes the design. Each run is a set
of Spark jobs, and a failed run becomes a row with its error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.operators import designed, scoring
from loomline.plans import study

# Scenarios as the factor on the design weights, the noise and the kind of checks.
SCENARIOS = {"baseline": (1.0, 0.0, "signal"), "weak": (0.5, 0.0, "signal"), "heavy_tails": (1.0, 5.0, "signal"), "no_signal": (0.0, 0.0, "null")}
# Scenarios with bounds of their own.
OVERRIDES = [("weak", "selection_recall", 0.3), ("weak", "selection_recall_strong", 0.6)]
RUN_SCHEMA = "scenario string, seed int, kind string, name string, value double"


@dataclass(frozen=True)
class HarnessConfig:
    """Which scenarios and seeds to run."""

    scenarios: tuple[str, ...] = ("baseline", "no_signal")
    seeds: tuple[int, ...] = (0, 1, 2)
    study: study.StudyConfig = study.StudyConfig()

    def overrides(self, spark) -> DataFrame:
        return spark.createDataFrame(OVERRIDES, "scenario string, check string, bound double")


def designed_world(returns: DataFrame, weights: DataFrame, calendar: DataFrame, topics: list[str], scenario: str, seed: int) -> DataFrame:
    """Designed attention of one scenario and seed; topics without links carry noise only."""
    factor, noise_df, _ = SCENARIOS[scenario]
    cfg = designed.DesignConfig(seed=seed, noise_df=noise_df)
    std = designed.standardise(returns)
    used = weights.withColumn("w", F.col("w") * factor)
    scaling = materialise(designed.feasibility(std, used, calendar, topics, cfg), "scaling")
    scaled = used.join(scaling.select("topic", "scale"), "topic").select("topic", "asset", (F.col("w") * F.col("scale")).alias("w"))
    return designed.designed_attention(designed.designed_signal(std, scaled, calendar, topics, cfg), scaling, cfg)


def score_run(result: study.Study, weights: DataFrame, cfg: study.StudyConfig) -> dict[str, float]:
    """Selection scores of a run against the design plus its own headline metrics."""
    spark = result.panel.sparkSession
    strength = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("strength"))
    picked = spark.createDataFrame([(t, bool(s)) for t, s in zip(result.topics, result.fit.selected)], "topic string, selected boolean")
    rows = picked.join(strength, "topic", "left").select(
        "selected", F.col("strength").isNotNull().alias("relevant"), F.coalesce("strength", F.lit(0.0)).alias("strength"), F.col("strength").isNull().alias("placebo"))
    scores = {k: (float("nan") if v is None else float(v)) for k, v in scoring.selection_scores(rows).first().asDict().items()}
    scores |= {r["name"]: r["value"] for r in study.report(result, cfg).collect()}
    chance = max(round(0.05 * len(result.topics)), 1)
    scores["null_selection_lift"] = float(result.fit.selected.sum()) / chance
    sharpe = scores.get("oos_sharpe")
    scores["null_oos_sharpe_abs"] = float("nan") if sharpe is None else abs(sharpe)
    return scores


def run_harness(returns: DataFrame, weights: DataFrame, calendar: DataFrame, topics: list[str], cfg: HarnessConfig = HarnessConfig()) -> dict[str, DataFrame]:
    """Per-run metrics, pass flags, summary and pass rates; errors are rows of their own."""
    spark = returns.sparkSession
    rows, errors = [], []
    for scenario in cfg.scenarios:
        for seed in cfg.seeds:
            fit = replace(cfg.study, fit=replace(cfg.study.fit, seed=seed))
            try:
                attention = materialise(designed_world(returns, weights, calendar, topics, scenario, seed), "attention")
                result = study.run_study(attention.select("date", "topic", "level"), returns, fit)
                rows += [(scenario, seed, SCENARIOS[scenario][2], k, v) for k, v in score_run(result, weights, fit).items()]
            except Exception as problem:  # noqa: BLE001  a failed run, its Spark jobs included, is a row
                errors.append((scenario, seed, f"{type(problem).__name__}: {problem}"[:2000]))
    metrics = spark.createDataFrame(rows, RUN_SCHEMA)
    # Every check of a run's kind is there: one that no run has a metric for has failed.
    flags = scoring.pass_flags(metrics, scoring.check_table(spark), ["scenario", "seed"], cfg.overrides(spark))
    return {
        "per_run": metrics, "passed": flags, "summary": scoring.scenario_summary(metrics), "pass_rates": scoring.pass_rates(flags),
        "errors": spark.createDataFrame(errors, "scenario string, seed int, error string"),
    }


def markdown_report(tables: dict[str, DataFrame]) -> str:
    """Summary and pass rates as text."""
    lines = ["# Harness report", "", "| scenario | metric | mean | std | runs |", "|---|---|---|---|---|"]
    for r in tables["summary"].orderBy("scenario", "name").collect():
        spread = "" if r["std"] is None else f"{r['std']:.4g}"
        lines.append(f"| {r['scenario']} | {r['name']} | {'' if r['mean'] is None else format(r['mean'], '.4g')} | {spread} | {r['n']} |")
    lines += ["", "| scenario | check | pass rate | runs |", "|---|---|---|---|"]
    lines += [f"| {r['scenario']} | {r['check']} | {r['pass_rate']:.2f} | {r['runs']} |" for r in tables["pass_rates"].orderBy("scenario", "check").collect()]
    lines += [f"\nFailed: {r['scenario']} seed {r['seed']}: {r['error']}" for r in tables["errors"].collect()]
    return "\n".join(lines) + "\n"

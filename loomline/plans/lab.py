"""The sensitivity lab as stages: designed attention, truth, pairs, direct fits, evaluation, comparison.

Every stage is a table kept by the hash of the settings it depends on, so a changed
forecast window re-scores stored fits and a changed penalty refits stored pairs.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.ranking import spearman
from loomline.operators import designed, direct, windows
from loomline.operators.shocks import attention_shocks
from loomline.sources.runs import StageStore


@dataclass(frozen=True)
class LabConfig:
    """Windows, design and method settings."""

    train_start: str = "2015-01-01"
    train_end: str = "2022-12-30"
    forecast_start: str = "2023-01-02"
    forecast_weeks: int = 4
    shock_window: int = 5
    tau: float = 0.05
    design: designed.DesignConfig = designed.DesignConfig()
    direct: direct.DirectConfig = direct.DirectConfig()

    def __post_init__(self):
        windows.check_out_of_sample(self.train_end, self.forecast_start)


class LabSession:
    """Stages of one lab run over given returns and design weights."""

    def __init__(self, spark: SparkSession, root: str, returns: DataFrame, weights: DataFrame, calendar: DataFrame, topics: list[str], cfg: LabConfig):
        self.store = StageStore(spark, root, {"returns": returns, "weights": weights, "calendar": calendar}, sorted(topics))
        self.returns, self.weights, self.calendar, self.topics, self.cfg = returns, weights, calendar, topics, cfg

    def _key(self, *names: str) -> dict:
        every = asdict(self.cfg)
        return {n: every[n] for n in names}

    def standard(self) -> DataFrame:
        return self.store.get("standard", {}, lambda: designed.standardise(self.returns))

    def scaling(self) -> DataFrame:
        return self.store.get("scaling", self._key("design"), lambda: designed.feasibility(self.standard(), self.weights, self.calendar, self.topics, self.cfg.design))

    def signal(self) -> DataFrame:
        def build():
            scaled = self.weights.join(self.scaling().select("topic", "scale"), "topic").select("topic", "asset", (F.col("w") * F.col("scale")).alias("w"))
            return designed.designed_signal(self.standard(), scaled, self.calendar, self.topics, self.cfg.design)

        return self.store.get("signal", self._key("design"), build)

    def attention(self) -> DataFrame:
        return self.store.get("attention", self._key("design"), lambda: designed.designed_attention(self.signal(), self.scaling(), self.cfg.design))

    def truth(self) -> DataFrame:
        return self.store.get("truth", self._key("design", "shock_window"), lambda: designed.population_sensitivities(
            self.signal(), self.scaling(), self.standard(), self.calendar, self.topics, self.cfg.shock_window, self.cfg.design))

    def pairs(self) -> tuple[DataFrame, DataFrame]:
        """Scaled shocks by return day, and the returns paired with them."""
        key = self._key("design", "shock_window", "train_start", "train_end")

        def both():
            shocks = attention_shocks(self.attention().select("date", "topic", "level"), self.calendar, self.cfg.shock_window)
            scaled = designed.scale_on_window(shocks, self.cfg.train_start, self.cfg.train_end)
            return designed.lead_pairs(self.returns, scaled, self.calendar, len(self.topics), self.cfg.design.lead)

        return self.store.get("paired_shocks", key, lambda: both()[0]), self.store.get("paired_returns", key, lambda: both()[1])

    def training(self) -> tuple[DataFrame, DataFrame]:
        """Standardised training rows and the scale of each asset."""
        key = self._key("design", "shock_window", "train_start", "train_end")

        def both():
            return direct.training_rows(*self.pairs(), self.topics, self.cfg.train_start, self.cfg.train_end)

        return self.store.get("training_rows", key, lambda: both()[0]), self.store.get("training_scale", key, lambda: both()[1])

    def coefficients(self, method: str) -> DataFrame:
        if method == "oracle":
            return self.truth().select("topic", "asset", "b", (F.abs("b") >= self.cfg.tau).alias("selected"))
        cfg = replace(self.cfg.direct, method=method, tau=self.cfg.tau)
        key = {**self._key("design", "shock_window", "train_start", "train_end"), "direct": asdict(cfg)}
        return self.store.get("coefficients", key, lambda: direct.fit_direct(*self.training(), self.topics, cfg)).select("topic", "asset", "b", "selected")

    def fitted(self, method: str) -> DataFrame:
        """Daily fitted returns on every paired day, for windows and sweeps alike."""
        by_day, usable = self.pairs()
        return windows.fitted_days(by_day, usable, self.coefficients(method), self.training()[1], self.topics)

    def evaluation(self, method: str) -> DataFrame:
        days = windows.forecast_days(self.fitted(method), self.cfg.forecast_start, self.cfg.forecast_weeks)
        return windows.window_r2(days, "asset")

    def sweep(self, method: str) -> DataFrame:
        return windows.window_sweep(self.fitted(method), self.calendar, self.cfg.forecast_start, self.cfg.forecast_weeks)

    def recovery(self, method: str) -> DataFrame:
        pairs = self.coefficients(method).join(self.truth().select("topic", "asset", F.col("b").alias("b_true")), ["topic", "asset"]).join(
            self.weights, ["topic", "asset"], "left")
        name = F.lit(method).alias("method")
        return windows.recovery(pairs, self.cfg.tau).select(name, "*").join(spearman(pairs, "b", "b_true").select(name, "*"), "method")

    def compare(self, methods: tuple[str, ...]) -> DataFrame:
        """One row per method: forecast R2 on identical days and recovery of the truth."""
        rows = None
        for method in methods:
            scores = windows.median_r2(self.evaluation(method)).select(F.lit(method).alias("method"), "*")
            row = scores.join(self.recovery(method), "method")
            rows = row if rows is None else rows.unionByName(row)
        return rows

"""Direct regressions of each asset on all topic shocks.

A regression needs only its cross products. They are summed once per asset (and
per fold when a penalty is cross-validated) as period moments keyed by asset, so
raw days never gather in one place; the solves run on those rows in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import group_lasso
from loomline.functions.columns import safe_divisor
from loomline.operators.moments import period_moments

# Fewest training pairs per asset, ridge grid and cross-validation grid length.
MIN_TRAIN = 20
RIDGE_GRID = np.logspace(-4, 1, 30)
CV_POINTS = 30

COEF_SCHEMA = "asset_id int, topic string, b double, intercept double, penalty double, n_train long, selected boolean"


@dataclass(frozen=True)
class DirectConfig:
    """Method and penalty rule."""

    method: str = "elastic_net"  # elastic_net, ridge, ols
    penalty: str = "universal"  # universal, fixed, cv (elastic net)
    alpha: float = 0.01
    l1_ratio: float = 0.9
    ridge_lambda: float | None = None  # None: generalised cross-validation
    folds: int = 5
    tau: float = 0.05

    def __post_init__(self):
        if self.method not in ("elastic_net", "ridge", "ols") or self.penalty not in ("universal", "fixed", "cv"):
            raise ValueError("unknown method or penalty rule")
        if self.method == "elastic_net" and self.penalty == "fixed" and self.alpha <= 0:
            raise ValueError("a fixed elastic-net penalty must be positive; use ols for none")


def universal_alpha(n_topics: int, n_obs: int) -> float:
    """``sqrt(2 ln max(L, 2) / n)``."""
    return float(np.sqrt(2 * np.log(max(n_topics, 2)) / n_obs))


class Cross:
    """Centred cross products of one regression."""

    def __init__(self, n: int, s: np.ndarray, v: np.ndarray, yy: float):
        self.n = n
        self.xbar, self.ybar = s[0, 1:] / n, v[0] / n
        self.xx = s[1:, 1:] - n * np.outer(self.xbar, self.xbar)
        self.xy = v[1:] - n * self.xbar * self.ybar
        self.yy = yy - n * self.ybar**2

    def intercept(self, b: np.ndarray) -> float:
        return float(self.ybar - self.xbar @ b)

    def elastic_net(self, alpha: float, l1: float, start: np.ndarray | None = None) -> np.ndarray:
        """Minimiser of ``|y - Xb|^2 / 2n + alpha l1 |b|_1 + alpha (1 - l1) |b|^2 / 2``."""
        p = len(self.xy)
        gram = self.xx / self.n + alpha * (1 - l1) * np.eye(p)
        x0 = np.zeros((p, 1)) if start is None else start[:, None]
        return group_lasso.solve(gram, self.xy[:, None] / self.n, x0, np.full(p, alpha * l1), 5000, 1e-8)[0][:, 0]

    def ridge(self, lam: float) -> np.ndarray:
        if lam == 0:
            return self.least_squares()
        return np.linalg.solve(self.xx + self.n * lam * np.eye(len(self.xy)), self.xy)

    def ridge_gcv(self) -> tuple[np.ndarray, float]:
        """Ridge with the grid penalty of smallest generalised cross-validation score; the intercept costs one degree."""
        d, u = np.linalg.eigh(self.xx)
        d = np.clip(d, 0, None)
        live = d > 1e-12 * max(d.max(initial=0), 1e-300)
        along = np.where(live, (u.T @ self.xy) ** 2 / np.where(live, d, 1), 0.0)
        scores = np.full(len(RIDGE_GRID), np.inf)
        for i, lam in enumerate(RIDGE_GRID):
            left = self.n * lam / (d + self.n * lam)
            rss = max(self.yy - along.sum(), 0.0) + (left**2 * along).sum()
            df = 1 + (1 - left)[live].sum()
            if df < self.n:
                scores[i] = rss / self.n / (1 - df / self.n) ** 2
        best = int(scores.argmin()) if np.isfinite(scores).any() else len(RIDGE_GRID) - 1
        return self.ridge(RIDGE_GRID[best]), float(RIDGE_GRID[best])

    def least_squares(self) -> np.ndarray:
        return np.linalg.lstsq(self.xx, self.xy, rcond=1e-13)[0]


def _cross_validated(folds: list[tuple[int, np.ndarray, np.ndarray, float]], cfg: DirectConfig) -> tuple[np.ndarray, float, Cross]:
    """Elastic-net penalty by expanding time folds: train on earlier blocks, score on the next one."""

    def total(parts):
        return Cross(sum(p[0] for p in parts), sum(p[1] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts))

    whole = total(folds)
    top = np.abs(whole.xy).max() / (whole.n * cfg.l1_ratio)
    grid = np.logspace(np.log10(top), np.log10(top * 1e-3), CV_POINTS)
    error = np.zeros(CV_POINTS)
    for k in range(1, len(folds)):
        train, (n, s, v, yy) = total(folds[:k]), folds[k]
        b = None
        for i, alpha in enumerate(grid):
            b = train.elastic_net(alpha, cfg.l1_ratio, b)
            full = np.concatenate([[train.intercept(b)], b])
            error[i] += (yy - 2 * full @ v + full @ s @ full) / n
    alpha = float(grid[int(error.argmin())])
    return whole.elastic_net(alpha, cfg.l1_ratio), alpha, whole


def training_rows(by_return_day: DataFrame, usable: DataFrame, topics: list[str], start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Training rows per asset, standardised, with the shock array; and the per-asset scale.

    Kept are pairs whose shock day and return day both lie in the window.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = F.col("shock_day").between(lo, hi) & (F.col("date") <= hi)
    rows = usable.where(inside)
    scale = rows.groupBy("asset").agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.count("*").alias("n_train"))
    scale = scale.select("asset", "mean", safe_divisor(F.col("sd")).alias("scale"), "n_train",
                         (F.row_number().over(Window.orderBy("asset")) - 1).alias("asset_id"))
    order = F.array(*[F.lit(t) for t in topics])
    packed = by_return_day.where(inside).groupBy("date").agg(
        F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("topic")).alias("k"), "s"))).alias("p")
    ).select("date", F.concat(F.array(F.lit(1.0)), F.transform("p", lambda e: e["s"])).alias("x"))
    std = rows.join(scale, "asset").select("asset_id", "date", "n_train", ((F.col("ret") - F.col("mean")) / F.col("scale")).alias("y"))
    return std.join(packed, "date"), scale


def fit_direct(rows: DataFrame, scale: DataFrame, topics: list[str], cfg: DirectConfig = DirectConfig()) -> DataFrame:
    """Coefficients (topic, asset, b, intercept, penalty, n_train, selected) in standardised units.

    Assets below the minimum number of pairs get zero coefficients. Least squares
    is refused when topics reach half the pairs of a fitted asset.
    """
    blocks = cfg.folds + 1 if cfg.method == "elastic_net" and cfg.penalty == "cv" else 1
    if blocks > 1:
        place = F.row_number().over(Window.partitionBy("asset_id").orderBy("date"))
        size = F.floor(F.col("n_train") / blocks)
        first = F.col("n_train") - size * cfg.folds
        block = F.when(place <= first, F.lit(0)).otherwise(F.floor((place - first - 1) / size) + 1)
        rows = rows.withColumn("block", block.cast("int"))
    else:
        rows = rows.withColumn("block", F.lit(0))
    keyed = rows.select((F.col("asset_id") * blocks + F.col("block")).cast("int").alias("t_idx"), "y", "x")
    products = period_moments(keyed).select(
        F.floor(F.col("t_idx") / blocks).cast("int").alias("asset_id"), F.struct("t_idx", "n", "s", "v", "yy").alias("m")
    ).groupBy("asset_id").agg(F.sort_array(F.collect_list("m")).alias("parts"))
    width = len(topics)

    def solve(batches):
        for batch in batches:
            for asset, parts in zip(batch["asset_id"], batch["parts"]):
                folds = [(int(m["n"]), np.asarray(m["s"], float).reshape(width + 1, -1), np.asarray(m["v"], float), float(m["yy"])) for m in parts]
                n = sum(f[0] for f in folds)
                pen, c = np.nan, 0.0
                if n < MIN_TRAIN:
                    b = np.zeros(width)
                elif blocks > 1:
                    b, pen, cross = _cross_validated(folds, cfg)
                    c = cross.intercept(b)
                else:
                    cross = Cross(*folds[0])
                    if cfg.method == "elastic_net":
                        pen = universal_alpha(width, n) if cfg.penalty == "universal" else cfg.alpha
                        b = cross.elastic_net(pen, cfg.l1_ratio)
                    elif cfg.method == "ridge":
                        b, pen = (cross.ridge(cfg.ridge_lambda), cfg.ridge_lambda) if cfg.ridge_lambda is not None else cross.ridge_gcv()
                    else:
                        if width >= n / 2:
                            raise ValueError(f"least squares refused: {width} topics for {n} training pairs")
                        b = cross.least_squares()
                    c = cross.intercept(b)
                # A coefficient at the very edge of its threshold may keep a rounding residue.
                b = np.where(np.abs(b) < 1e-12, 0.0, b)
                chosen = b != 0 if cfg.method == "elastic_net" else np.abs(b) >= cfg.tau
                yield pd.DataFrame({"asset_id": asset, "topic": topics, "b": b, "intercept": c, "penalty": pen, "n_train": n, "selected": chosen})

    coefs = products.mapInPandas(solve, COEF_SCHEMA)
    return coefs.join(scale.select("asset_id", "asset"), "asset_id").drop("asset_id")

"""Scores of runs against a known truth, pass flags and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.columns import ratio
from loomline.functions.dense import subspace_cosines
from loomline.functions.session import materialise
from loomline.operators.moments import period_moments

# Check, direction, bound and the kind of scenario it applies to.
CHECKS = [
    ("selection_recall", ">=", 0.50, "signal"),
    ("selection_recall_strong", ">=", 0.80, "signal"),
    ("selection_precision", ">=", 0.60, "signal"),
    ("beta_canonical_corr", ">=", 0.90, "signal"),
    ("placebo_selected", "<=", 0.0, "signal"),
    ("factor_canonical_corr", ">=", 0.90, "signal"),
    ("oos_sharpe_ratio_to_true", ">=", 0.50, "signal"),
    ("systematic_r2_recovered", ">=", 0.50, "signal"),
    ("gamma_subspace_cos", ">=", 0.85, "reported"),
    ("state_canonical_corr", ">=", 0.80, "reported"),
    ("impact_spearman", ">=", 0.70, "reported"),
    ("null_selection_lift", "<=", 2.0, "null"),
    ("null_oos_sharpe_abs", "<=", 0.75, "null"),
]
CHECK_SCHEMA = "check string, direction string, bound double, kind string"


def check_table(spark) -> DataFrame:
    return spark.createDataFrame(CHECKS, CHECK_SCHEMA)


def scenario_bounds(checks: DataFrame, scenarios: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(scenario, check, direction, bound, kind) of every scenario; ``overrides`` (scenario, check, bound) replace bounds.

    A scenario is compared in lower case, with dashes as underscores and without the suffix of a short run.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.col(c))), "-", "_"), "_fast$", "")
    rows = scenarios.select("scenario", "kind").distinct().join(checks, "kind").withColumn("_plain", plain("scenario"))
    if overrides is None:
        return rows.drop("_plain")
    own = overrides.select(plain("scenario").alias("_plain"), "check", F.col("bound").cast("double").alias("own"))
    return rows.join(own, ["_plain", "check"], "left").select("scenario", "check", "direction", F.coalesce("own", "bound").alias("bound"), "kind")


def pass_flags(metrics: DataFrame, checks: DataFrame, keys: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """One flag per run and check of its kind; a missing or non-finite metric fails.

    ``metrics`` is (keys, kind, name, value); ``overrides`` (scenario, check, bound) give single scenarios bounds of their own, where scenario is one of the keys.
    """
    runs = metrics.select(*keys, "kind").distinct()
    if overrides is None:
        wanted = runs.join(checks, "kind")
    else:
        wanted = runs.join(scenario_bounds(checks, metrics, overrides), ["scenario", "kind"])
    got = metrics.select(*keys, F.col("name").alias("check"), "value")
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    ok = F.when(F.col("direction") == ">=", value >= F.col("bound")).otherwise(value <= F.col("bound"))
    return wanted.join(got, [*keys, "check"], "left").select(*keys, "kind", "check", "value", "bound", F.coalesce(ok, F.lit(False)).alias("passed"))


def scenario_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric per scenario."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return metrics.groupBy("scenario", "name").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def pass_rates(flags: DataFrame) -> DataFrame:
    """Share of runs that pass each check, per scenario."""
    return flags.groupBy("scenario", "check").agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.count("*").alias("runs"))


def selection_scores(topics: DataFrame) -> DataFrame:
    """Recall, strong recall, precision and placebo count.

    ``topics`` has ``selected``, ``relevant``, ``strength`` and ``placebo`` per
    topic; strong topics are the relevant ones at or above their median strength.
    """
    middle = F.median(F.when(F.col("relevant"), F.col("strength"))).over(Window.partitionBy())
    rows = topics.withColumn("strong", F.col("relevant") & (F.col("strength") >= middle))

    def count(cond):
        return F.sum(F.when(cond, 1.0).otherwise(0.0))

    s, r = F.col("selected"), F.col("relevant")
    return rows.agg(
        ratio(count(s & r), count(r)).alias("selection_recall"),
        ratio(count(s & F.col("strong")), count(F.col("strong"))).alias("selection_recall_strong"),
        ratio(count(s & r), count(s)).alias("selection_precision"), count(s & F.col("placebo")).alias("placebo_selected"),
    )


def _numbered(rows: DataFrame, by: str | None) -> DataFrame:
    """Rows with an integer group number ``t_idx`` and the group's label ``g``."""
    if by is None:
        return rows.withColumn("t_idx", F.lit(0)).withColumn("g", F.lit("all"))
    labels = rows.select(F.col(by).cast("string").alias("g")).distinct()
    numbers = labels.select("g", (F.row_number().over(Window.orderBy("g")) - 1).alias("t_idx"))
    return rows.withColumn("g", F.col(by).cast("string")).join(numbers, "g")


def _moment_matrices(batch: pd.DataFrame):
    """Number, count and covariance of the columns after the constant, for each row of a moment table."""
    for t, n, s in zip(batch["t_idx"], batch["n"], batch["s"]):
        width = int(round(len(s) ** 0.5))
        m = np.asarray(s, float).reshape(width, width)
        mean = m[0, 1:] / n
        yield int(t), int(n), m[1:, 1:] / n - np.outer(mean, mean)


def first_canonical_correlation(left: DataFrame, right: DataFrame, keys: list[str], width: int, by: str | None = None) -> DataFrame:
    """Largest canonical correlation of two sets of columns, overall or per group.

    Each side has an array column ``v``; ``width`` is its length on the left. Only
    the joint covariance of a group is needed, which is summed map-side, so a
    group may hold any number of rows.
    """
    rows = left.select(*keys, F.col("v").alias("a")).join(right.select(*keys, F.col("v").alias("b")), keys)
    rows = _numbered(rows, by)
    x = F.concat(F.array(F.lit(1.0)), "a", "b")
    table = period_moments(rows.select("t_idx", F.lit(0.0).alias("y"), x.alias("x")))

    def whiten(c: np.ndarray) -> np.ndarray:
        w, u = np.linalg.eigh(c)
        keep = w > 1e-10 * max(w.max(), 1e-300)
        return u[:, keep] / np.sqrt(w[keep])

    def solve(batches):
        for batch in batches:
            out = []
            for t, n, c in _moment_matrices(batch):
                pa, pb = whiten(c[:width, :width]), whiten(c[width:, width:])
                got = np.linalg.svd(pa.T @ c[:width, width:] @ pb, compute_uv=False)
                out.append((t, min(float(got[0]), 1.0) if len(got) else None, n))
            yield pd.DataFrame(out, columns=["t_idx", "first", "n"])

    solved = table.select("t_idx", "n", "s").mapInPandas(solve, "t_idx int, first double, n long")
    return solved.join(rows.select("t_idx", "g").distinct(), "t_idx").select("g", "first", "n")


def canonical_correlations(rows: DataFrame, width: int, by: str | None = None) -> DataFrame:
    """All canonical correlations of two sets of columns, largest first: (k, corr, n), with the group's label g before them if ``by`` is given.

    ``rows`` holds both sides as the arrays ``a`` (of length ``width``) and ``b``.
    One reading sums their joint covariance, a square of the columns' number.
    """
    both = F.concat(F.array(F.lit(1.0)), F.transform("a", lambda v: v.cast("double")), F.transform("b", lambda v: v.cast("double")))
    rows = _numbered(rows, by)
    table = period_moments(rows.select("t_idx", F.lit(0.0).alias("y"), both.alias("x")))

    def solve(batches):
        for batch in batches:
            for t, n, c in _moment_matrices(batch):
                sides = []
                for own in (c[:width, :width], c[width:, width:]):
                    power, axes = np.linalg.eigh(own)
                    live = power > 1e-10 * max(power.max(), 1e-300)
                    sides.append(axes[:, live] / np.sqrt(power[live]))
                found = np.minimum(np.linalg.svd(sides[0].T @ c[:width, width:] @ sides[1], compute_uv=False), 1.0)
                yield pd.DataFrame({"t_idx": t, "k": np.arange(1, len(found) + 1, dtype=np.int32), "corr": found, "n": n})

    solved = table.select("t_idx", "n", "s").mapInPandas(solve, "t_idx int, k int, corr double, n long")
    if by is None:
        return solved.drop("t_idx")
    return solved.join(rows.select("t_idx", "g").distinct(), "t_idx").select("g", "k", "corr", "n")


def instrument_beta_r2(instruments: DataFrame, betas: DataFrame, keys: list[str], K: int, by: str) -> DataFrame:
    """Cross-sectional R2 of each instrument on the true betas, per period.

    Both sides have an array column ``v``; the regressions of a period share one
    cross-product matrix.
    """
    rows = betas.select(*keys, F.col("v").alias("b")).join(instruments.select(*keys, F.col("v").alias("c")), keys)
    rows = _numbered(rows, by)
    table = period_moments(rows.select("t_idx", F.lit(0.0).alias("y"), F.concat(F.array(F.lit(1.0)), "b", "c").alias("x")))

    def solve(batches):
        for batch in batches:
            out = []
            for t, n, c in _moment_matrices(batch):
                cross = c[:K, K:]
                part = np.einsum("kl,kl->l", cross, np.linalg.pinv(c[:K, :K], hermitian=True) @ cross)
                for j, total in enumerate(np.diag(c)[K:]):
                    out.append((t, j, float(part[j] / total) if total > 0 else None, n))
            yield pd.DataFrame(out, columns=["t_idx", "instrument", "r2", "n"])

    solved = table.select("t_idx", "n", "s").mapInPandas(solve, "t_idx int, instrument int, r2 double, n long")
    return solved.join(rows.select("t_idx", "g").distinct(), "t_idx").select("g", "instrument", "r2", "n")


def systematic_r2(pairs: DataFrame, *keys: str) -> DataFrame:
    """Share of the true systematic return that the fit recovers; ``pairs`` has ``truth`` and ``fitted``."""
    err = F.sum(F.pow(F.col("truth") - F.col("fitted"), 2))
    return pairs.groupBy(*keys).agg((1 - ratio(err, F.sum(F.col("truth") * F.col("truth")))).alias("systematic_r2"))


def loading_angles(estimate: np.ndarray, truth: np.ndarray) -> float:
    """Smallest cosine between two loading spaces, NaN when the rows cannot inform it."""
    if len(estimate) <= estimate.shape[1]:
        return float("nan")
    got = subspace_cosines(estimate, truth)
    return float(got.min()) if len(got) else float("nan")


TILE, PART_KEYS = 128, 512  # series in a tile, keys in a part


def pairwise_correlation(rows: DataFrame, key: str, name: str, value: str, names: list[str], min_obs: int = 3, tile: int = TILE) -> DataFrame:
    """Pairwise-complete correlation and population covariance of every pair of series with ``a < b``.

    A symmetric blocked product: values are laid out as tiles of keys x series, tiles of the same keys meet once for each
    pair of tiles, and a meeting is six small matrix products of presence, value and squared value, which add up over the
    keys. Work and memory of a task follow the tile, whatever the number of series or keys. A key that has a series twice counts its largest value.
    """
    spark, order = rows.sparkSession, sorted(names)
    place = spark.createDataFrame([(n, i) for i, n in enumerate(order)], "_name string, _at int")
    found = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(name).cast("string").alias("_name")).agg(F.max(F.col(value).cast("double")).alias("_v")).join(place, "_name")
    found = found.where(~F.isnan("_v")).withColumn("_hash", F.xxhash64("_key"))
    n_keys = found.agg(F.approx_count_distinct("_key")).first()[0] or 0
    parts = max(1, -(-n_keys // PART_KEYS))
    cells = found.select(F.pmod("_hash", F.lit(parts)).cast("int").alias("part"), F.floor(F.col("_at") / tile).cast("int").alias("tile"), F.col("_key").cast("string").alias("k"), (F.col("_at") % tile).alias("at"), F.col("_v").alias("v"))

    def lay_out(table: pa.Table) -> pa.Table:
        keys, row = np.unique(np.array(table["k"].to_pylist(), object).astype(str), return_inverse=True)
        m = np.full((len(keys), tile), np.nan)
        m[row, table["at"].to_numpy()] = table["v"].to_numpy()
        return pa.table({"part": table["part"][:1], "tile": table["tile"][:1], "keys": pa.array([keys.tolist()], pa.list_(pa.string())), "m": pa.array([m.tobytes()], pa.binary())})

    tiles = materialise(cells.groupBy("part", "tile").applyInArrow(lay_out, "part int, tile int, keys array<string>, m binary"), "series_tiles")
    left = tiles.select("part", F.col("tile").alias("i"), F.col("keys").alias("keys_i"), F.col("m").alias("m_i"))
    met = left.join(tiles.select("part", F.col("tile").alias("j"), F.col("keys").alias("keys_j"), F.col("m").alias("m_j")), "part").where("i <= j")

    def multiply(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sides = [np.frombuffer(row[m], np.float64).reshape(-1, tile) for m in ("m_i", "m_j")]
                both, at_i, at_j = np.intersect1d(row["keys_i"], row["keys_j"], return_indices=True)
                x, y = sides[0][at_i], sides[1][at_j]
                p, q = ~np.isnan(x), ~np.isnan(y)
                x, y, p, q = np.where(p, x, 0.0), np.where(q, y, 0.0), p.astype(float), q.astype(float)
                sums = np.stack([p.T @ q, x.T @ q, p.T @ y, x.T @ y, (x * x).T @ q, p.T @ (y * y)])
                yield pa.RecordBatch.from_arrays([pa.array([row["i"]], pa.int32()), pa.array([row["j"]], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["i", "j", "sums"])

    def solve(table: pa.Table) -> pa.Table:
        n, sx, sy, sxy, sxx, syy = sum(np.frombuffer(m, np.float64) for m in table["sums"].to_pylist()).reshape(6, tile, tile)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = np.nonzero((n > 0) & (i * tile + np.arange(tile)[:, None] < j * tile + np.arange(tile)))
        k = n[a, b]
        mi, mj = sx[a, b] / k, sy[a, b] / k
        cov, var = sxy[a, b] / k - mi * mj, (sxx[a, b] / k - mi**2) * (syy[a, b] / k - mj**2)
        good = (k >= min_obs) & (var > 0)
        corr = np.where(good, cov / np.sqrt(np.where(good, var, 1.0)), np.nan)
        label = lambda t, at: pa.array([order[t * tile + v] for v in at], pa.string())
        return pa.table({"a": label(i, a), "b": label(j, b), "corr": pa.array(corr), "cov": pa.array(cov), "n": pa.array(k.astype(np.int64))})

    out = met.mapInArrow(multiply, "i int, j int, sums binary").groupBy("i", "j").applyInArrow(solve, "a string, b string, corr double, cov double, n long")
    return out.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


def observation_groups(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Series grouped by an identical set of observed days.

    The set is fingerprinted by its size and two independent hash sums, which
    combine map-side; no list of days is collected.
    """
    day = F.xxhash64(F.lit(1), F.col(key))
    other = F.xxhash64(F.lit(2), F.col(key))
    marks = rows.groupBy(name).agg(
        F.count("*").alias("n_days"), F.sum(day.cast("decimal(38,0)")).alias("h1"), F.bit_xor(other).alias("h2"), F.min(key).alias("first_day")
    )
    sets = marks.groupBy("n_days", "h1", "h2").agg(F.min(name).alias("leader"), F.count("*").alias("members"))
    return marks.join(sets, ["n_days", "h1", "h2"]).select(name, "leader", "members", "n_days", "first_day")


def difference_check(df: DataFrame, step: str, name: str, got: str, want: str, tolerance: float, relative: bool = False) -> DataFrame:
    """One check row: largest difference over rows where both values exist, and how many exist on one side only."""
    gap = F.abs(F.col(got) - F.col(want))
    if relative:
        gap = gap / F.greatest(F.abs(F.col(want)), F.lit(1e-300))
    one_sided = F.col(got).isNull() != F.col(want).isNull()
    out = df.agg(F.max(gap).alias("value"), F.sum(F.when(one_sided, 1).otherwise(0)).alias("unmatched"), F.count("*").alias("n"))
    ok = (F.coalesce(F.col("value"), F.lit(0.0)) <= tolerance) & (F.coalesce(F.col("unmatched"), F.lit(0)) == 0)
    return out.select(
        F.lit(step).alias("step"), F.lit(name).alias("name"), "value", "unmatched", "n", F.lit(float(tolerance)).alias("tolerance"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
    )

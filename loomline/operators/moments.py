"""Per-period sufficient statistics of the panel.

After this step no estimator touches panel rows: a period is its count, y'y,
X'y and X'X, whatever the number of assets behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import materialise

MOMENT_SCHEMA = "t_idx int, n long, yy double, v array<double>, s array<double>, mean array<double>, m2 array<double>"
PARTIAL_BYTES = 64 << 20
DRIVER_BYTES = 256 << 20


def _lists(a: np.ndarray) -> pa.ListArray:
    offsets = np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(a).ravel()))


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _batch(stats: dict[int, list]) -> pa.RecordBatch:
    keys = sorted(stats)
    cols = [np.array([stats[k][j] for k in keys]) for j in range(6)]
    p = cols[2].shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(keys, np.int32)), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(float)),
         _lists(cols[2]), _lists(cols[3].reshape(-1, p * p)), _lists(cols[4]), _lists(cols[5])],
        names=["t_idx", "n", "yy", "v", "s", "mean", "m2"],
    )


def _combine(a: list, b: list) -> list:
    """Sums add; means and centred squares merge without losing digits."""
    n = a[0] + b[0]
    gap = b[4] - a[4]
    return [n, a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] + gap * (b[0] / n), a[5] + b[5] + gap * gap * (a[0] * b[0] / n)]


def _partial_moments(batches):
    """One matrix product per period and batch, added up inside the task and flushed when large."""
    held: dict[int, list] = {}
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        x = _matrix(batch.column(2), batch.num_rows)
        t, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in np.unique(t):
            rows = t == k
            xk, yk = x[rows], y[rows]
            centre = xk.mean(0)
            stat = [len(yk), yk @ yk, xk.T @ yk, xk.T @ xk, centre, ((xk - centre) ** 2).sum(0)]
            if int(k) in held:
                held[int(k)] = _combine(held[int(k)], stat)
            else:
                held[int(k)] = stat
                size += 8 * (x.shape[1] ** 2 + 3 * x.shape[1])
        if size > PARTIAL_BYTES:
            yield _batch(held)
            held, size = {}, 0
    if held:
        yield _batch(held)


def _merge_sorted(batches):
    """Adds up the rows of each key; keys arrive in order, so one key is held at a time."""
    held: dict[int, list] = {}
    size = 0
    for batch in batches:
        rows = batch.num_rows
        if rows == 0:
            continue
        key, n, yy = (batch.column(j).to_numpy() for j in range(3))
        v, s, mean, m2 = (_matrix(batch.column(j), rows) for j in range(3, 7))
        p = v.shape[1]
        for i in range(rows):
            stat = [int(n[i]), yy[i], v[i], s[i].reshape(p, p), mean[i], m2[i]]
            k = int(key[i])
            if k in held:
                held[k] = _combine(held[k], stat)
                continue
            if size > PARTIAL_BYTES:
                yield _batch(held)
                held, size = {}, 0
            held[k] = stat
            size += 8 * (p * p + 3 * p)
    if held:
        yield _batch(held)


def period_moments(panel: DataFrame, fan_in: int = 64) -> DataFrame:
    """One row of moments per period, written once because every estimator reads them again.

    Every task reduces its own rows to partial moments, so a period that holds
    most of the panel is still a few rows per task before anything is shuffled.
    On clusters with more than ``fan_in`` cores the partials of a period first
    meet under ``fan_in`` salted keys, so no task adds up thousands of them.
    """
    partial = panel.select("t_idx", "y", "x").mapInArrow(_partial_moments, MOMENT_SCHEMA)
    if panel.sparkSession.sparkContext.defaultParallelism > fan_in:
        salt = F.pmod(F.spark_partition_id(), F.lit(fan_in))
        salted = partial.withColumn("salt", salt).repartition("t_idx", "salt").sortWithinPartitions("t_idx").drop("salt")
        partial = salted.mapInArrow(_merge_sorted, MOMENT_SCHEMA)
    merged = partial.repartition("t_idx").sortWithinPartitions("t_idx").mapInArrow(_merge_sorted, MOMENT_SCHEMA)
    return materialise(merged, "moments")


@dataclass
class Moments:
    """Moments of all periods as arrays."""

    t_idx: np.ndarray
    n: np.ndarray
    yy: np.ndarray
    v: np.ndarray
    s: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    def subset(self, keep: np.ndarray) -> "Moments":
        return Moments(*[getattr(self, f)[keep] for f in ("t_idx", "n", "yy", "v", "s", "mean", "m2")])

    @property
    def n_obs(self) -> int:
        return int(self.n.sum())

    def sigma(self) -> np.ndarray:
        """Population deviation of every instrument over these periods; 1 for the constant and flat columns."""
        n = self.n.astype(float)
        centre = (n[:, None] * self.mean).sum(0) / n.sum()
        spread = self.m2.sum(0) + (n[:, None] * (self.mean - centre) ** 2).sum(0)
        sd = np.sqrt(spread / n.sum())
        out = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
        out[0] = 1.0
        return out


def moment_bytes(periods: int, width: int) -> int:
    """Size of all moments in memory."""
    return 8 * periods * (width * width + 3 * width + 3)


def collect_moments(moments: DataFrame, limit: int | None = DRIVER_BYTES) -> Moments | None:
    """Moments on the driver when their size, fixed by periods and topics alone, is under ``limit``; else None.

    No limit is for the moments of a single period: one square of the model's width.
    """
    head = moments.agg(F.max(F.size("v")).alias("p"), F.count("*").alias("t")).first()
    if not head["t"]:
        raise ValueError("the panel is empty")
    p = head["p"]
    if limit is not None and moment_bytes(head["t"], p) > limit:
        return None
    table = moments.toArrow()
    rows = table.num_rows
    held = Moments(
        table["t_idx"].to_numpy(), table["n"].to_numpy(), table["yy"].to_numpy(), _matrix(table["v"], rows),
        _matrix(table["s"], rows).reshape(rows, p, p), _matrix(table["mean"], rows), _matrix(table["m2"], rows),
    )
    return held.subset(np.argsort(held.t_idx))

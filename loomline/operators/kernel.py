"""Kernel-weighted covariances of asset returns with topic shocks.

For asset i, period t and topic l::

    cov = sum k r z - (sum k r)(sum k z),   k proportional to xi ** (t - period(day))

over the days that the asset and every topic are observed, with the last
``skip_days`` trading days of period t left out. The weight is constant inside a
period, so daily products are summed per period once and the decayed history is
a window over those sums: the scan cost does not grow with the number of
periods a day contributes to.

Two physical forms share this algebra. ``kernel_covariance`` is plain DataFrame
code on (asset, topic) rows. ``kernel_covariance_blocks`` moves arrays of topics
and does one matrix product per period and asset block; it is the form for
hundreds of topics and for strong decay, where rescaled sums would overflow.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.calendar import window_bounds
from loomline.operators.shocks import complete_days, shock_vectors


@dataclass(frozen=True)
class KernelConfig:
    """Decay per period, window closing and validity rule."""

    xi: float = 0.99
    skip_days: int = 1
    min_days: int = 60
    lookback: int | None = None
    burn_in: int = 12

    def __post_init__(self):
        if not 0 < self.xi <= 1:
            raise ValueError("xi must be in (0, 1]")
        if self.lookback is not None and self.lookback < 1:
            raise ValueError("lookback must be at least 1")


def kernel_weight(age: Column, cfg: KernelConfig) -> Column:
    """Raw weight of a day whose period lies ``age`` periods back; 0 outside the lookback."""
    inside = age >= 0
    if cfg.lookback is not None:
        inside = inside & (age < cfg.lookback)
    return F.when(inside, F.pow(F.lit(cfg.xi), age.cast("double"))).otherwise(F.lit(0.0))


def rescaling_is_safe(n_periods: int, cfg: KernelConfig) -> bool:
    """Whether sums may be carried as ``xi ** -t`` multiples without overflow."""
    return n_periods * math.log(1 / cfg.xi) <= 200


# Rows of day-keyed shocks (date, topic, z) that are safe to hold in every executor: about 100 MB.
BROADCAST_ROWS = 2_000_000


def period_products(returns: DataFrame, shocks: DataFrame, calendar: DataFrame, n_topics: int, cfg: KernelConfig) -> DataFrame:
    """Sums of rz, r, z and the count per (asset, topic, period), whole and inside the window.

    Shocks number at most days times topics. Below ``BROADCAST_ROWS`` they are
    broadcast and returns are laid out by asset once: the sums and the later
    windows then need no further shuffle. Above it the two sides meet by day and
    the sums combine map-side before they are shuffled.
    """
    usable = shocks.join(complete_days(shocks, n_topics), "date", "left_semi")
    keyed = usable.join(calendar.select("date", "period_id", "back"), "date")
    observed = returns.where("ret IS NOT NULL")
    if calendar.count() * n_topics <= BROADCAST_ROWS:
        daily = observed.repartition("asset").join(F.broadcast(keyed), "date")
    else:
        daily = observed.join(keyed, "date")
    r, z, inside = F.col("ret"), F.col("z"), F.col("back") > cfg.skip_days

    def both(expr: Column, name: str) -> list[Column]:
        return [F.sum(expr).alias(name), F.coalesce(F.sum(F.when(inside, expr)), F.lit(0.0)).alias("w_" + name)]

    return daily.groupBy("asset", "topic", "period_id").agg(
        *both(r * z, "rz"), *both(r, "r"), *both(z, "z"), *both(F.lit(1.0), "n")
    )


def _dense_periods(sums: DataFrame, last_period: Column) -> DataFrame:
    """One row per period from an asset's first to the last one, zero where nothing was observed."""
    order = Window.partitionBy("asset", "topic").orderBy("period_id")
    until = F.coalesce(F.lead("period_id").over(order) - 1, last_period)
    spread = sums.withColumn("until", until).withColumn("t", F.explode(F.sequence("period_id", "until")))
    own = F.col("t") == F.col("period_id")
    measures = [c for c in sums.columns if c not in ("asset", "topic", "period_id", "last_period")]
    return spread.select(
        "asset", "topic", F.col("t").alias("period_id"),
        *[F.when(own, F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in measures],
    )


def kernel_sums(sums: DataFrame, calendar: DataFrame, cfg: KernelConfig) -> DataFrame:
    """Decayed history plus the current window for every (asset, topic, period)."""
    every = Window.partitionBy()
    stamped = calendar.select("period_id", F.max("period_id").over(every).alias("last_period")).distinct()
    dense = _dense_periods(sums.join(F.broadcast(stamped), "period_id"), F.col("last_period"))
    t = F.col("period_id").cast("double")
    lift, drop = F.pow(F.lit(cfg.xi), -t), F.pow(F.lit(cfg.xi), t)
    order = Window.partitionBy("asset", "topic").orderBy("period_id")
    if cfg.lookback == 1:
        closed = None
    elif cfg.lookback is None:
        closed = order.rowsBetween(Window.unboundedPreceding, -1)
    else:
        closed = order.rowsBetween(-(cfg.lookback - 1), -1)

    def decayed(name: str) -> Column:
        if closed is None:
            return F.col("w_" + name)
        return drop * F.coalesce(F.sum(F.col(name) * lift).over(closed), F.lit(0.0)) + F.col("w_" + name)

    count = F.col("w_n") if closed is None else F.coalesce(F.sum("n").over(closed), F.lit(0.0)) + F.col("w_n")
    return dense.select(
        "asset", "topic", "period_id", decayed("rz").alias("rz"), decayed("r").alias("r"),
        decayed("z").alias("z"), decayed("n").alias("weight"), count.cast("long").alias("n_days"),
    )


def kernel_covariance(
    returns: DataFrame, shocks: DataFrame, calendar: DataFrame, n_topics: int, cfg: KernelConfig = KernelConfig()
) -> DataFrame:
    """Long covariances ``(period_id, asset, topic, cov, n_days)``; cells below ``min_days`` are absent."""
    sums = kernel_sums(period_products(returns, shocks, calendar, n_topics, cfg), calendar, cfg)
    w = F.col("weight")
    valid = sums.where((F.col("n_days") >= cfg.min_days) & (w > 0))
    return valid.select(
        "period_id", "asset", "topic",
        (F.col("rz") / w - (F.col("r") / w) * (F.col("z") / w)).alias("cov"), "n_days",
    )


def stamp_windows(cov: DataFrame, calendar: DataFrame, cfg: KernelConfig) -> DataFrame:
    """Adds the period end and the last day inside each period's window."""
    bounds = window_bounds(calendar, cfg.skip_days).select("period_id", "period_end", "window_end")
    return cov.join(bounds, "period_id")


def pack_topics(cov: DataFrame, topics: list[str]) -> DataFrame:
    """Long covariances to one array per (period, asset) in topic order; incomplete rows are dropped."""
    order = F.array(*[F.lit(t) for t in topics])
    packed = cov.groupBy("period_id", "asset").agg(
        F.sort_array(F.collect_list(F.struct(F.array_position(order, F.col("topic")).alias("k"), "cov"))).alias("p"),
        F.max("n_days").alias("n_days"),
    )
    return packed.where(F.size("p") == len(topics)).select(
        "period_id", "asset", F.transform("p", lambda s: s["cov"]).alias("cov"), "n_days"
    )


def unpack_topics(cov: DataFrame, topics: list[str]) -> DataFrame:
    """Arrays back to long rows."""
    order = F.array(*[F.lit(t) for t in topics])
    return cov.select("period_id", "asset", F.posexplode("cov").alias("k", "cov"), "n_days").select(
        "period_id", "asset", F.element_at(order, F.col("k") + 1).alias("topic"), "cov", "n_days"
    )


def kernel_covariance_blocks(
    returns: DataFrame,
    shocks: DataFrame,
    calendar: DataFrame,
    topics: list[str],
    cfg: KernelConfig = KernelConfig(),
    n_blocks: int = 64,
) -> DataFrame:
    """Array covariances ``(period_id, asset, cov, n_days)`` by matrix products per asset block.

    Assets are hashed into ``n_blocks`` blocks; each block meets the shock vectors
    in a cogroup, so no side is broadcast and a group holds at most the calendar
    times the assets of one block. The shock vectors are sent once a block: choose
    ``n_blocks`` near the number of assets divided by 256.
    """
    block = F.pmod(F.xxhash64("asset"), F.lit(n_blocks))
    days = calendar.select("date", "period_id", "back")
    left = (
        returns.where("ret IS NOT NULL").join(days, "date")
        .select(block.alias("block"), "asset", "date", "ret")
    )
    vectors = shock_vectors(shocks, topics)
    last = F.max("period_id").over(Window.partitionBy())
    right = (
        days.withColumn("last_period", last).join(vectors, "date")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        .select("block", "date", "period_id", "back", "last_period", "z")
    )
    schema = "period_id int, asset string, cov array<double>, n_days long"

    def block_covariances(r: pa.Table, s: pa.Table) -> pa.Table:
        return _block_covariances(r, s, cfg)

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(block_covariances, schema)


def _block_covariances(r: pa.Table, s: pa.Table, cfg: KernelConfig) -> pa.Table:
    """All periods of one asset block: per-period products, then the decay recursion."""
    empty = pa.table({
        "period_id": pa.array([], pa.int32()), "asset": pa.array([], pa.string()),
        "cov": pa.array([], pa.list_(pa.float64())), "n_days": pa.array([], pa.int64()),
    })
    if r.num_rows == 0 or s.num_rows == 0:
        return empty
    s = s.sort_by("date")
    day = s["date"].to_numpy()
    z = np.array(s["z"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(day), -1)
    period, back = s["period_id"].to_numpy(), s["back"].to_numpy()
    n_periods = int(s["last_period"][0].as_py()) + 1

    assets, column = np.unique(r["asset"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    row = np.searchsorted(day, r["date"].to_numpy())
    known = (row < len(day)) & (day[np.minimum(row, len(day) - 1)] == r["date"].to_numpy())
    ret = np.zeros((len(day), len(assets)))
    seen = np.zeros((len(day), len(assets)))
    ret[row[known], column[known]] = r["ret"].to_numpy()[known]
    seen[row[known], column[known]] = 1.0

    def products(rows: np.ndarray):
        x, o, y = ret[rows], seen[rows], z[rows]
        return np.concatenate([x.T @ y, o.T @ y, x.sum(0)[:, None], o.sum(0)[:, None]], axis=1)

    width = z.shape[1]
    whole, history, counts = {}, np.zeros((len(assets), 2 * width + 2)), np.zeros(len(assets))
    out_period, out_asset, out_cov, out_n = [], [], [], []
    for t in range(n_periods):
        mine = np.flatnonzero(period == t)
        inside = mine[back[mine] > cfg.skip_days]
        now = products(inside)
        if cfg.lookback is None:
            total, n = cfg.xi * history + now, counts + now[:, -1]
        else:
            recent = range(max(0, t - cfg.lookback + 1), t)
            total = now + sum((cfg.xi ** (t - m) * whole[m] for m in recent), np.zeros_like(now))
            n = now[:, -1] + sum((whole[m][:, -1] for m in recent), np.zeros(len(assets)))
        ok = np.flatnonzero((n >= cfg.min_days) & (total[:, -1] > 0))
        if ok.size:
            w = total[ok, -1:]
            cov = total[ok, :width] / w - (total[ok, -2:-1] / w) * (total[ok, width : 2 * width] / w)
            out_cov.append(cov)
            out_asset.append(assets[ok])
            out_n.append(n[ok].astype(np.int64))
            out_period.append(np.full(ok.size, t, dtype=np.int32))
        full = products(mine)
        if cfg.lookback is None:
            history, counts = cfg.xi * history + full, counts + full[:, -1]
        else:
            whole[t] = full
            whole.pop(t - cfg.lookback + 1, None)
    if not out_cov:
        return empty
    cov = np.concatenate(out_cov)
    offsets = np.arange(0, cov.size + 1, width, dtype=np.int32)
    return pa.table({
        "period_id": pa.array(np.concatenate(out_period)),
        "asset": pa.array(np.concatenate(out_asset).astype(str).tolist(), pa.string()),
        "cov": pa.ListArray.from_arrays(pa.array(offsets), pa.array(cov.ravel())),
        "n_days": pa.array(np.concatenate(out_n)),
    })

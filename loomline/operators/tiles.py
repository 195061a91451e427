"""Latent-factor fits over a table of moment tiles, for models too wide for one process.

The cross products of a period are cut into square tiles of ``block``
instruments, and no task ever holds more than the tiles it reads. Fits advance together:
every round is one job for all that want factors and one for all that want new loadings, with the
loadings broadcast (fits x instruments x K numbers) and factors coming back (periods x fits x K^2 numbers).

A loading step is block-coordinate descent on the Gram matrix of the loadings, kept as tiles: each row
block, as many tiles high as ``GRAM_BYTES`` allow, solves its own group lasso with the other blocks where they
are, and the moves are averaged over the blocks, which never raises the convex objective. Up to about a
thousand instruments of three factors there is one block, and the step is exact.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.functions import group_lasso
from loomline.functions.session import materialise
from loomline.operators import factor_model
from loomline.operators.factor_model import RIDGE, Fit, FitConfig
from loomline.operators.moments import MOMENT_SCHEMA, PARTIAL_BYTES, Moments, _combine, _lists, _matrix

BLOCK = 64
ROUND_BYTES = 64 << 20  # Gram tiles that a task holds for the fits of one round
GRAM_BYTES = 64 << 20  # rows of one fit's Gram matrix that are solved together

TILE_SCHEMA = "t_idx int, i int, j int, s array<double>"


def _tile_sums(block: int):
    def flush(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in keys], pa.int32()) for c in range(3)), pa.array([held[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["t_idx", "i", "j", "s"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t, x = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
            cuts = range(0, x.shape[1], block)
            for k in np.unique(t):
                rows = x[t == k]
                for i, a in enumerate(cuts):
                    for j, b in enumerate(cuts):
                        if i <= j:
                            tile = rows[:, a:a + block].T @ rows[:, b:b + block]
                            key = (int(k), i, j)
                            size += 0 if key in held else tile.nbytes
                            held[key] = held[key] + tile if key in held else tile
                if size > PARTIAL_BYTES:
                    yield flush(held)
                    held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _sum_tiles(table: pa.Table) -> pa.Table:
    total = _matrix(table["s"], table.num_rows).sum(0)
    return pa.table({"t_idx": table["t_idx"][:1], "i": table["i"][:1], "j": table["j"][:1], "s": pa.array([total], pa.list_(pa.float64()))})


def _head_sums(batches):
    """Everything of the moments that grows with the instruments only once: n, yy, v, mean, m2."""
    held: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        t, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), batch.num_rows)
        for k in np.unique(t):
            xk, yk = x[t == k], y[t == k]
            centre = xk.mean(0)
            stat = [len(yk), yk @ yk, xk.T @ yk, np.zeros(0), centre, ((xk - centre) ** 2).sum(0)]
            held[int(k)] = _combine(held[int(k)], stat) if int(k) in held else stat
    if held:
        keys = sorted(held)
        cols = [np.array([held[k][c] for k in keys]) for c in (0, 1, 2, 4, 5)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(float)), _lists(cols[2]), pa.array([[]] * len(keys), pa.list_(pa.float64())), _lists(cols[3]), _lists(cols[4])],
                                         names=["t_idx", "n", "yy", "v", "s", "mean", "m2"])


def moment_tiles(panel: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Moments]:
    """(tiles, head): tiles (t_idx, i, j, s) of the cross products of every period, upper triangle, and the rest of the moments without them.

    Tasks add up their own rows first, so a period that holds most of the panel is a few rows per task.
    """
    parts = panel.select("t_idx", "x").mapInArrow(_tile_sums(block), TILE_SCHEMA)
    tiles = materialise(parts.groupBy("t_idx", "i", "j").applyInArrow(_sum_tiles, TILE_SCHEMA), "tiles")
    rows = panel.select("t_idx", "y", "x").mapInArrow(_head_sums, MOMENT_SCHEMA).toArrow()
    if not rows.num_rows:
        raise ValueError("the panel is empty")
    held: dict[int, list] = {}
    n, yy = rows["n"].to_numpy(), rows["yy"].to_numpy()
    v, mean, m2 = (_matrix(rows[c], rows.num_rows) for c in ("v", "mean", "m2"))
    for r, k in enumerate(rows["t_idx"].to_pylist()):
        stat = [int(n[r]), yy[r], v[r], np.zeros(0), mean[r], m2[r]]
        held[k] = _combine(held[k], stat) if k in held else stat
    keys = sorted(held)
    col = lambda c: np.array([held[k][c] for k in keys])
    return tiles, Moments(np.array(keys), col(0), col(1), col(2), np.zeros((len(keys), 0, 0)), col(4), col(5))


def tiles_of(moments: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Moments]:
    """The same from a table of moments, whose squares are cut where they lie."""

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                s = batch.column(1)[r].values.to_numpy(zero_copy_only=False)
                s = s.reshape(int(round(len(s) ** 0.5)), -1)
                at = range(0, len(s), block)
                keys = [(i, j) for i in range(len(at)) for j in range(i, len(at))]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[r].as_py()] * len(keys), pa.int32()), *(pa.array([x[c] for x in keys], pa.int32()) for c in (0, 1)),
                                                  pa.array([s[at[i]:at[i] + block, at[j]:at[j] + block].ravel() for i, j in keys], pa.list_(pa.float64()))], names=["t_idx", "i", "j", "s"])

    tiles = materialise(moments.select("t_idx", "s").mapInArrow(cut, TILE_SCHEMA), "tiles")
    rows = moments.select("t_idx", "n", "yy", "v", "mean", "m2").orderBy("t_idx").toArrow()
    v, mean, m2 = (_matrix(rows[c], rows.num_rows) for c in ("v", "mean", "m2"))
    return tiles, Moments(rows["t_idx"].to_numpy(), rows["n"].to_numpy(), rows["yy"].to_numpy(), v, np.zeros((rows.num_rows, 0, 0)), mean, m2)


@dataclass
class State:
    """What a round of factors tells one fit."""

    factors: np.ndarray  # periods of the fit x K
    inner: np.ndarray  # their projected cross products
    ssr: float

    @property
    def f_outer(self) -> np.ndarray:
        return self.factors.T @ self.factors


@dataclass
class Ask:
    """A fit's wish for the next round: factors at ``gamma``, or with ``pen`` new loadings from ``state``."""

    gamma: np.ndarray
    state: State | None = None
    pen: np.ndarray | None = None
    tol: float = 1e-9
    steps: int = 400


Steps = Generator[Ask, object, Fit]


class Window:
    """The periods that one fit may see, with the deviations of their instruments."""

    def __init__(self, head: Moments, keep: np.ndarray | None = None):
        self.keep = np.ones(len(head.n), bool) if keep is None else keep
        part = Moments(head.t_idx[self.keep], head.n[self.keep], head.yy[self.keep], head.v[self.keep], np.zeros((int(self.keep.sum()), 0, 0)), head.mean[self.keep], head.m2[self.keep])
        self.sigma, self.n_obs, self.n, self.yy = part.sigma(), part.n_obs, part.n, part.yy
        self.v = part.v / self.sigma
        self.first = part.n[:, None] * part.mean / self.sigma  # the constant's row of the cross products

    @property
    def width(self) -> int:
        return self.v.shape[1]

    def mean_portfolios(self) -> np.ndarray:
        return self.v / self.n[:, None]


def start_steps(window: Window, cfg: FitConfig) -> Generator[Ask, object, np.ndarray]:
    """Seeded start scaled so that the signal matches the ridge, then unpenalised warm-up sweeps."""
    gamma = factor_model._leading_directions(window, cfg.K, np.random.default_rng(cfg.seed), 1e-3)
    size = float(np.trace((yield Ask(gamma)).inner.sum(0))) / len(window.n)
    if np.isfinite(size) and size > 0:
        gamma = gamma * np.sqrt(2.0 * cfg.K / size)
    for _ in range(cfg.warmup):
        gamma = yield Ask(gamma, (yield Ask(gamma)), np.zeros(window.width), cfg.inner_tol, cfg.inner_steps)
    return gamma


def sparse_steps(window: Window, lam: float, cfg: FitConfig, start: np.ndarray | None = None) -> Steps:
    """The sweeps of one penalised fit, as ``factor_model.fit_sparse`` makes them, asking for what it needs."""
    pen = factor_model.penalties(lam, window.n_obs, window.width, cfg)
    gamma = (yield from start_steps(window, cfg)) if start is None else start

    def value(state: State, g: np.ndarray) -> float:
        return 0.5 * max(state.ssr, 0.0) + float(pen @ np.linalg.norm(g, axis=1)) + float(np.trace(state.f_outer))

    best, now = gamma, (yield Ask(gamma))
    path, converged, momentum, settling, moved = [value(now, gamma)], False, 1.0, False, 1.0
    for _ in range(cfg.max_sweeps):
        new = yield Ask(gamma, now, pen, max(cfg.inner_tol, min(1e-5, 0.1 * moved)), cfg.inner_steps)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = new + (momentum - 1) / after * (new - best) if momentum > 1 else new
        state = yield Ask(ahead)
        if momentum > 1 and value(state, ahead) > path[-1]:
            after, ahead = 1.0, new
            state = yield Ask(new)
        best, gamma, now, momentum = new, ahead, state, after
        path.append(value(now, gamma))
        moved = abs(path[-2] - path[-1]) / max(abs(path[-2]), 1e-300)
        if moved >= cfg.tol:
            settling = False
        elif settling:
            converged = True
            break
        else:
            settling, momentum, gamma = True, 1.0, best
            now = yield Ask(gamma)
            path[-1] = value(now, gamma)
    if gamma is not best:
        gamma, now = best, (yield Ask(best))
        path[-1] = value(now, gamma)
    mu, cov = factor_model.factor_moments(now.factors)
    load, total = gamma @ mu, float(window.yy.sum())
    flat = yield Ask(load[:, None])
    spread = total - 2 * float((window.v @ load).sum()) + float(flat.inner.sum())
    return Fit(gamma / window.sigma[:, None], now.factors, mu, cov, float(lam), path[-1], path, len(path) - 1, converged,
               1 - now.ssr / total if total > 0 else 0.0, 1 - spread / total if total > 0 else 0.0, window.sigma)


class _Known:
    """What ``largest_lambda`` reads of the periods, from one state: the constant's part of the Gram pair."""

    def __init__(self, window: Window, state: State, gamma: np.ndarray):
        k = gamma.shape[1]
        outer = np.einsum("tk,tj->tkj", state.factors, state.factors)
        self.n_obs, self.width = window.n_obs, window.width
        column = np.einsum("tp,tkj->pkj", window.first, outer).reshape(-1, k)
        self.state = factor_model.Pass(column, window.v.T @ state.factors, state.ssr, state.factors.sum(0), state.f_outer, len(state.factors))


def largest_lambda_steps(window: Window, cfg: FitConfig) -> Generator[Ask, object, float]:
    """``factor_model.largest_lambda`` without the whole Gram matrix: only its constant columns enter."""
    gamma = yield from start_steps(window, cfg)
    known = _Known(window, (yield Ask(gamma)), gamma)
    return factor_model.largest_lambda_from(known.state, known.n_obs, cfg)


def path_steps(window: Window, cfg: FitConfig) -> Generator[Ask, object, list[Fit]]:
    """Fits along ascending penalties, each started from the one before."""
    if cfg.lambdas is not None:
        grid = np.array(sorted(cfg.lambdas), float)
    else:
        top = yield from largest_lambda_steps(window, cfg)
        if not top > 0:
            raise ValueError("no topic row carries signal; there is no penalty grid")
        grid = np.logspace(np.log10(cfg.ratio * top), np.log10(top), cfg.n_lambdas)
    fits, start = [], None
    for lam in grid:
        fit = yield from sparse_steps(window, float(lam), cfg, start)
        start = fit.gamma * window.sigma[:, None]
        fits.append(fit)
    return fits


def later_factors(window: Window, fit: Fit) -> Generator[Ask, object, np.ndarray]:
    """Factors of the window's periods from the loadings of a finished fit."""
    return (yield Ask(fit.gamma * window.sigma[:, None])).factors


class TileSweeps:
    """Rounds of distributed sweeps for many fits at once."""

    def __init__(self, tiles: DataFrame, head: Moments, block: int = BLOCK):
        self.tiles, self.head, self.block = tiles, head, block
        self.jobs = 0

    def advance(self, fits: Iterable[tuple[Window, Generator]]) -> list:
        """Runs every generator to its end, one or two jobs a round; what they return, in order."""
        running, done, windows = {}, {}, {}
        for m, (window, steps) in enumerate(fits):
            windows[m] = window
            running[m] = (steps, next(steps))
        while running:
            wants = [m for m, (_, ask) in running.items() if ask.pen is None]
            told = self._factors({m: (windows[m], running[m][1].gamma) for m in wants}) if wants else {}
            moves = [m for m in running if m not in told]
            told |= self._loadings({m: (windows[m], running[m][1]) for m in moves}) if moves else {}
            for m, answer in told.items():
                steps = running[m][0]
                try:
                    running[m] = (steps, steps.send(answer))
                except StopIteration as end:
                    done[m] = end.value
                    del running[m]
        return [done[m] for m in sorted(done)]

    def _factors(self, asked: dict[int, tuple[Window, np.ndarray]]) -> dict[int, State]:
        """Factors of every period of every fit: each tile adds its part of the projected cross products."""
        self.jobs += 1
        names, k = list(asked), max(g.shape[1] for _, g in asked.values())
        p, block, times = self.head.v.shape[1], self.block, {int(t): r for r, t in enumerate(self.head.t_idx)}
        load = np.zeros((len(names), p, k))  # in units of the instruments; missing factors load zero
        for r, m in enumerate(names):
            window, g = asked[m]
            load[r, :, :g.shape[1]] = g / window.sigma[:, None]
        keep = np.array([asked[m][0].keep for m in names])
        shared = self.tiles.sparkSession.sparkContext.broadcast((load, keep, times))

        def project(batches):
            load, keep, times = shared.value
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    t, i, j = (batch.column(c)[r].as_py() for c in range(3))
                    left, right = load[:, i * block:(i + 1) * block], load[:, j * block:(j + 1) * block]
                    s = batch.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(left.shape[1], right.shape[1])
                    some = keep[:, times[t]]
                    part = np.zeros((len(load), load.shape[2], load.shape[2]))
                    part[some] = np.swapaxes(left[some], 1, 2) @ (s @ right[some])
                    held[t] = held.get(t, 0) + (part if i == j else part + np.swapaxes(part, 1, 2))
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.ravel() for a in held.values()], pa.list_(pa.float64()))], names=["t_idx", "a"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"t_idx": table["t_idx"][:1], "a": pa.array([_matrix(table["a"], table.num_rows).sum(0)], pa.list_(pa.float64()))})

        rows = self.tiles.mapInArrow(project, "t_idx int, a array<double>").groupBy("t_idx").applyInArrow(add, "t_idx int, a array<double>").toArrow()
        shared.unpersist()
        order = np.argsort(rows["t_idx"].to_numpy())
        inner = _matrix(rows["a"], rows.num_rows).reshape(rows.num_rows, len(names), k, k)[order]
        out = {}
        for r, m in enumerate(names):
            window, g = asked[m]
            width = g.shape[1]
            a = inner[window.keep, r, :width, :width]
            a = 0.5 * (a + np.swapaxes(a, 1, 2))
            pull = window.v @ g
            f = np.linalg.solve(a + RIDGE * np.eye(width), pull[..., None])[..., 0]
            ssr = float(window.yy.sum() - 2 * np.einsum("tk,tk->", f, pull) + np.einsum("tk,tkj,tj->", f, a, f))
            out[m] = State(f, a, ssr)
        return out

    def gradients(self, asked: dict[int, tuple[Window, np.ndarray]]) -> tuple[dict[int, State], dict[int, np.ndarray]]:
        """Factors at the loadings of every fit and the gradient of half the squared error there, row by instrument (loadings in standard units).

        A fit is optimal where the gradient of a live row is minus the penalty times its direction, and no longer than the penalty on a row of zeros.
        """
        states, block, p = self._factors(asked), self.block, self.head.v.shape[1]
        self.jobs += 1
        names, k, times = list(asked), max(g.shape[1] for _, g in asked.values()), {int(t): r for r, t in enumerate(self.head.t_idx)}
        load, outer = np.zeros((len(names), p, k)), np.zeros((len(names), len(times), k, k))
        for r, m in enumerate(names):
            window, g = asked[m]
            load[r, :, :g.shape[1]] = g / window.sigma[:, None]
            f = states[m].factors
            outer[r, window.keep, :g.shape[1], :g.shape[1]] = np.einsum("tk,tj->tkj", f, f)
        shared = self.tiles.sparkSession.sparkContext.broadcast((load, outer, times))

        def push(batches):
            load, outer, times = shared.value
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for r in range(batch.num_rows):
                    t, i, j = (batch.column(c)[r].as_py() for c in range(3))
                    left, right = load[:, i * block:(i + 1) * block], load[:, j * block:(j + 1) * block]
                    s = batch.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(left.shape[1], right.shape[1])
                    held[i] = held.get(i, 0) + (s @ right) @ outer[:, times[t]]
                    if i != j:
                        held[j] = held.get(j, 0) + (s.T @ left) @ outer[:, times[t]]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([a.ravel() for a in held.values()], pa.list_(pa.float64()))], names=["i", "a"])

        def add(table: pa.Table) -> pa.Table:
            return pa.table({"i": table["i"][:1], "a": pa.array([_matrix(table["a"], table.num_rows).sum(0)], pa.list_(pa.float64()))})

        grad = np.zeros((len(names), p, k))
        for row in self.tiles.mapInArrow(push, "i int, a array<double>").groupBy("i").applyInArrow(add, "i int, a array<double>").toArrow().to_pylist():
            here = slice(row["i"] * block, (row["i"] + 1) * block)
            grad[:, here] = np.reshape(row["a"], grad[:, here].shape)
        shared.unpersist()
        out = {}
        for r, m in enumerate(names):
            window, g = asked[m]
            out[m] = grad[r, :, :g.shape[1]] / window.sigma[:, None] - window.v.T @ states[m].factors
        return states, out

    def _loadings(self, asked: dict[int, tuple[Window, Ask]]) -> dict[int, np.ndarray]:
        """New loadings: tiles become Gram tiles of the fits, and every row block of a fit is solved in its own group."""
        k = max(a.gamma.shape[1] for _, a in asked.values())
        at_once = max(1, ROUND_BYTES // (8 * self.block * self.block * k * k))
        out, names = {}, list(asked)
        for a in range(0, len(names), at_once):
            out |= self._some_loadings({m: asked[m] for m in names[a:a + at_once]}, k)
        return out

    def _some_loadings(self, asked: dict[int, tuple[Window, Ask]], k: int) -> dict[int, np.ndarray]:
        self.jobs += 1
        names, block, times = list(asked), self.block, {int(t): r for r, t in enumerate(self.head.t_idx)}
        p = self.head.v.shape[1]
        outer = np.zeros((len(names), len(times), k, k))
        plan = {}
        for r, m in enumerate(names):
            window, ask = asked[m]
            f, width = ask.state.factors, ask.gamma.shape[1]
            outer[r, window.keep, :width, :width] = np.einsum("tk,tj->tkj", f, f)
            plan[r] = (ask.gamma, window.v.T @ f, ask.pen, ask.tol, ask.steps, window.sigma)
        shared = self.tiles.sparkSession.sparkContext.broadcast((outer, plan, times))
        high = max(1, GRAM_BYTES // (8 * k * k * p * block))  # tiles in a row block
        blocks = -(-p // (block * high))

        def gram(batches):
            outer, _, times = shared.value
            held: dict[tuple[int, int], np.ndarray] = {}

            def flush():
                for (i, j), h in held.items():
                    for r in range(len(h)):
                        turned = [(i, j, h[r])] if i == j else [(i, j, h[r]), (j, i, h[r].transpose(1, 0, 3, 2))]
                        for x, y, part in turned:
                            yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.int32()) for c in (r, x // high, x, y)), pa.array([part.ravel()], pa.list_(pa.float64()))], names=["m", "g", "i", "j", "h"])
                held.clear()

            for batch in batches:
                for r in range(batch.num_rows):
                    t, i, j = (batch.column(c)[r].as_py() for c in range(3))
                    wide = min(block, p - i * block), min(block, p - j * block)
                    s = batch.column(3)[r].values.to_numpy(zero_copy_only=False).reshape(wide)
                    part = s[None, :, :, None, None] * outer[:, times[t], None, None]
                    if (i, j) in held:
                        held[i, j] += part
                    else:
                        if len(held) >= 2:
                            yield from flush()
                        held[i, j] = part
            yield from flush()

        def solve(table: pa.Table) -> pa.Table:
            _, plan, _ = shared.value
            r, g = table["m"][0].as_py(), table["g"][0].as_py()
            gamma, cross, pen, tol, steps, sigma = plan[r]
            width, low = gamma.shape[1], g * high * block
            here = slice(low, low + high * block)
            n = len(gamma[here])
            rest, own = cross[here].copy(), np.zeros((n, width, n, width))
            for i, j, h in _added(table):
                down, there = slice(i * block, (i + 1) * block), slice(j * block, (j + 1) * block)
                h = h.reshape(len(gamma[down]), len(gamma[there]), k, k)[..., :width, :width] / sigma[down, None, None, None] / sigma[None, there, None, None]
                at = slice(i * block - low, i * block - low + len(h))
                if j // high == g:
                    own[at, :, j * block - low:j * block - low + h.shape[1]] = h.transpose(0, 2, 1, 3)
                else:
                    rest[at] -= np.einsum("abkl,bl->ak", h, gamma[there])
            # The tolerance is relative to the largest entry of the whole right side.
            scale = np.abs(cross).max(initial=0.0) / max(np.abs(rest).max(initial=0.0), 1e-300)
            new, _, _ = group_lasso.solve(own.reshape(n * width, -1), rest, gamma[here], pen[here], steps, tol * max(scale, 1e-3))
            gone, new = ~new.any(1), gamma[here] + (new - gamma[here]) / blocks
            # Averages of a row on its way out only halve; what is left of it is cut off.
            new[gone & (np.linalg.norm(new, axis=1) <= 1e-9 * np.linalg.norm(gamma, axis=1).max(initial=0.0))] = 0.0
            return pa.table({"m": pa.array([r], pa.int32()), "g": pa.array([g], pa.int32()), "x": pa.array([new.ravel()], pa.list_(pa.float64()))})

        rows = self.tiles.mapInArrow(gram, "m int, g int, i int, j int, h array<double>").groupBy("m", "g").applyInArrow(solve, "m int, g int, x array<double>").toArrow()
        shared.unpersist()
        out = {m: np.zeros_like(asked[m][1].gamma) for m in names}
        for row in rows.to_pylist():
            g = out[names[row["m"]]]
            g[row["g"] * high * block:(row["g"] + 1) * high * block] = np.reshape(row["x"], (-1, g.shape[1]))
        return out


def _added(table: pa.Table):
    """The tiles of one row block, summed over the tasks that made them."""
    i, j = table["i"].to_numpy(), table["j"].to_numpy()
    for x, y in np.unique(np.column_stack((i, j)), axis=0):
        rows = table.filter(pa.array((i == x) & (j == y)))
        yield int(x), int(y), _matrix(rows["h"], rows.num_rows).sum(0)


def tiled_path(panel: DataFrame, cfg: FitConfig, k_grid: tuple[int, ...] | None = None, block: int = BLOCK) -> list[Fit]:
    """Penalty paths for every factor count, all advancing together."""
    tiles, head = moment_tiles(panel, block)
    window = Window(head)
    paths = TileSweeps(tiles, head, block).advance([(window, path_steps(window, replace(cfg, K=k))) for k in k_grid or (cfg.K,)])
    return [fit for path in paths for fit in path]

"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own k-means,
so k centroids a half make k * k cells. A query walks the pairs of centroids
from the nearest on, by the sum of the two half distances taken from a heap, until
the cells it has met hold enough entries; those entries are ranked again by
their exact inner product. How many are enough is measured: a few queries are
answered by brute force, and it is seen how far they had to walk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.session import materialise

TOP = 20
SAMPLE = 16_384  # vectors that the centroids are fitted on
ROUNDS = 12
ENTRY_BLOCK = 1 << 14  # entries of the cells that are met together
BLOCK = 2048  # entries, and queries, of one product in a task
RECALL = 0.95  # share of true neighbours that the walk of the measured queries must have met
MEASURED = 128  # queries answered by brute force to set the walk


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """At most k centroids of the rows of x; empty ones move to the rows that lie farthest off."""
    points = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        dist = (centres**2).sum(1) - 2 * x @ centres.T
        near = dist.argmin(1)
        size = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = size > 0
        centres[full] = sums[full] / size[full, None]
        if not full.all():
            far = np.argsort(-(dist[np.arange(len(x)), near] + (x**2).sum(1)))[: int((~full).sum())]
            centres[~full] = x[far]
    return centres


def cells_by_distance(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in order of the summed distance of their two centroids, until their counts reach ``wanted``.

    first, second: distances of the centroids of each half; counts: entries by cell.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, pushed, met, out = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}, 0, []
    while heap and met < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(one[i]) * len(second) + int(two[j])
        if counts[cell]:
            out.append(cell)
            met += int(counts[cell])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))
    return out


def _assign(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = model.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            half = one.shape[1]
            a = ((one**2).sum(1) - 2 * x[:, :half] @ one.T).argmin(1)
            b = ((two**2).sum(1) - 2 * x[:, half:] @ two.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * len(two) + b).astype(np.int32))], names=["vec_id", "v", "cell"])

    return run


def cell_blocks(counts: np.ndarray, size: int) -> np.ndarray:
    """Block of every cell: neighbouring cells are packed up to about ``size`` entries; a larger cell is a block of its own."""
    out, block, held = np.zeros(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > size:
            block, held = block + 1, 0
        out[cell] = block
        held += int(n)
    return out


def _visit(model, sizes, wanted: float):
    """For every query the blocks that its walk meets, each with the cells it asks for there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = model.value
        counts, block_of = sizes.value
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            half = one.shape[1]
            # Nearest is the largest inner product, so a centroid's distance is its negative.
            first, second = -x[:, :half] @ one.T, -x[:, half:] @ two.T
            rows, blocks, cells = [], [], []
            for r, (f, s) in enumerate(zip(first, second)):
                met = np.array(cells_by_distance(f, s, counts, wanted), np.int64)
                order = np.argsort(block_of[met], kind="stable")
                own, at = np.unique(block_of[met][order], return_index=True)
                rows += [r] * len(own)
                blocks += own.tolist()
                cells += [c.tolist() for c in np.split(met[order], at[1:])] if len(own) else []
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(blocks, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["rep", "v", "block", "cells"])

    return run


def exact_products(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components.

    A matrix product may add in another order at the edge of a block, and equal vectors would then differ in the last digit.
    """
    out = np.zeros((len(q), len(e)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * e[None, :, k]
    return out


def _rank(top: int):
    """The best entries of every query in one block, among the cells that it asks for."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not len(queries) or not len(entries):
            return pa.table({"rep": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids = entries.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        e, ids, reps, q = _matrix(entries.column("v"))[order], ids[order], queries.column("rep").to_numpy(), _matrix(queries.column("v"))
        kinds, of = np.unique(entries.column("cell").to_numpy()[order], return_inverse=True)
        wants = queries.column("cells").to_pylist()
        step, out = max(1, (1 << 21) // len(ids)), []
        members = [np.flatnonzero(of == c) for c in range(len(kinds))]
        for at in range(0, len(q), step):
            part = q[at:at + step]
            asked = np.zeros((len(part), len(kinds)), bool)
            for r, cells in enumerate(wants[at:at + step]):
                asked[r, np.searchsorted(kinds, np.intersect1d(kinds, cells))] = True
            score = np.full((len(part), len(ids)), -np.inf)
            for c, here in enumerate(members):
                some = np.flatnonzero(asked[:, c])
                if len(some):
                    score[np.ix_(some, here)] = exact_products(part[some], e[here])
            k = min(top, len(ids))
            least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]
            row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            value = score[row, col]
            by = np.lexsort((ids[col], -value, row))
            row, col, value = row[by], col[by], value[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k  # ties for the last place go to smaller ids
            out.append((reps[at:at + step][row[keep]], ids[col[keep]], value[keep]))
        rep, vec, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"rep": rep, "vec_id": vec, "score": score})

    return run


def _best_of_batches(queries, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, q = queries.value
        for batch in batches:
            if not len(batch):
                continue
            score = q @ _matrix(batch.column(1)).T
            best = np.argsort(-score, axis=1, kind="stable")[:, :top]
            rows = np.repeat(np.arange(len(q)), best.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(reps[rows]), batch.column(0).take(pa.array(best.ravel())), batch.column(2).take(pa.array(best.ravel())), pa.array(score[rows, best.ravel()])],
                                             names=["rep", "vec_id", "cell", "score"])

    return run


def walk_length(indexed: DataFrame, reps: DataFrame, centres, counts: np.ndarray, top: int, recall: float) -> float:
    """Entries that the cells of a walk must hold for the measured queries to meet ``recall`` of their true neighbours.

    At most MEASURED queries (those with the smallest hash of their id) meet every
    entry, in blocks; each task keeps the best of a batch, so what is collected is MEASURED * top rows.
    """
    if recall >= 1:
        return float("inf")
    table = reps.orderBy(F.xxhash64("rep"), "rep").limit(MEASURED).select("rep", "v").toArrow()
    if not table.num_rows:
        return 0.0
    ids, q = table.column("rep").to_numpy(), _matrix(table.column("v"))
    shared = reps.sparkSession.sparkContext.broadcast((ids, q))
    every = indexed.select("vec_id", "v", "cell").mapInArrow(_best_of_batches(shared, top + 1), "rep long, vec_id long, cell int, score double").where("rep <> vec_id")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
    true = every.withColumn("place", place).where(F.col("place") <= top).select("rep", "cell").collect()
    half, needed = centres[0].shape[1], []
    met = {}
    for rep, vector in zip(ids, q):
        order = cells_by_distance(-centres[0] @ vector[:half], -centres[1] @ vector[half:], counts, np.inf)
        met[int(rep)] = dict(zip(order, np.cumsum(counts[order]) - counts[order] + 1))
    needed = np.sort([met[r["rep"]][r["cell"]] for r in true])
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else 0.0


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows whose vector has no null or non-finite component, is not zero and has the usual length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(fine)
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def nearest(vectors: DataFrame, every: int = 20, top: int = TOP, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``: their ``top`` nearest other rows.

    Nearness is the largest inner product in double precision; ties go to the smaller id.

    recall: share of true neighbours that the walk is set for (``walk_length``);
    1 walks all cells. The centroids are fitted on the SAMPLE vectors with the
    smallest hash of their id; every vector is indexed.

    A vector that is null, zero, of another length than most, or holds a null or
    non-finite component takes no part, nor does a row without id; a query
    of that kind has no rows. Repeated rows count once. Of equal vectors only the
    top + 1 smallest ids can be among any query's nearest, so no more of them
    are indexed, and equal queries are searched once: a vector that fills a third of
    the table is a few entries. With fewer candidates than ``top`` all are returned.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vector_col), "ann_rows")
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = materialise(rows.withColumn("place", first).where(F.col("place") <= top + 1).drop("place").distinct(), "ann_entries")
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    sample = _matrix(entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v"))
    half, k = max(1, sample.shape[1] // 2), 1 << max(1, round(np.log2(n) / 4))
    centres = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)) if sample.shape[1] > 1 else (kmeans(sample, k), np.zeros((1, 0)))
    model = spark.sparkContext.broadcast(centres)
    kind = dict(entries.dtypes)["v"]
    indexed = materialise(entries.mapInArrow(_assign(model), f"vec_id long, v {kind}, cell int"), "ann_index")
    cells = len(centres[0]) * len(centres[1])  # about the square root of the entries
    counts = np.zeros(cells, np.int64)
    for cell, size in indexed.groupBy("cell").count().collect():
        counts[cell] = size
    block_of = cell_blocks(counts, ENTRY_BLOCK)
    sizes = spark.sparkContext.broadcast((counts, block_of))

    asked = rows.where(F.col("vec_id") % every == 0)
    reps = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("rep")), "ann_queries")
    wanted = max(walk_length(indexed, reps, centres, counts, top, recall), float(top + 1))
    walked = reps.select("rep", "v").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep")
    visits = materialise(walked.mapInArrow(_visit(model, sizes, wanted), f"rep long, v {kind}, block int, cells array<int>"), "ann_visits")
    # A block holds several cells, so a query keeps its best of all of them in one place; one with many queries or one huge cell is met in several tasks.
    holds = np.bincount(block_of, weights=counts, minlength=int(block_of.max()) + 1)
    sized = spark.createDataFrame([(int(b), int(-(-h // ENTRY_BLOCK))) for b, h in enumerate(holds) if h], "block int, e_parts int")
    load = visits.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_parts")).join(sized, "block")
    load = materialise(load, "ann_load")
    placed = indexed.join(spark.createDataFrame([(c, int(b)) for c, b in enumerate(block_of)], "cell int, block int"), "cell")
    q = visits.join(load, "block").withColumn("qp", F.pmod(F.xxhash64("rep"), F.col("q_parts")).cast("int")).withColumn("ep", F.explode(F.sequence(F.lit(0), F.col("e_parts") - 1)))
    e = placed.join(load, "block").withColumn("ep", F.pmod(F.xxhash64("vec_id"), F.col("e_parts")).cast("int")).withColumn("qp", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
    keys = ["block", "qp", "ep"]
    found = q.select(*keys, "rep", "v", "cells").groupBy(*keys).cogroup(e.select(*keys, "vec_id", "v", "cell").groupBy(*keys)).applyInArrow(_rank(top + 1), "rep long, vec_id long, score double")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = materialise(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top + 1).drop("place"), "ann_found")
    of = asked.join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep").distinct()
    pairs = of.join(found, "rep").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")

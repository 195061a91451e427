"""N-gram Jaccard join by a blocked sparse matrix product of documents and n-grams.

The incidence matrix of documents and their word n-grams is cut into blocks:
a task holds the columns of a range of n-gram hashes for its documents and
sends each block, coded, to the owner of that range. Owners multiply a block
with its transpose: the overlap counts of document pairs are summed over
blocks, and pairs whose counts stay below the bound that their sizes set are
discarded. What is left is counted exactly on the whole texts.

Three things keep the product sparse without losing a link:

* Documents with one set of n-grams are one row of the matrix.
* A row has only the n-grams that a link can not do without: of a set of n,
  ordered rarest first, the first n - ceil(0.75 n) + 1 hold at least one
  n-gram of any partner. Rarity comes from a count of fixed size.
* Links found by comparing every row with the first row of its min-hash groups
  are joined to components first; the product then only looks at pairs of rows
  in different components, since links inside one change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.session import materialise
from loomline.llm import packed
from loomline.llm.graph import components
from loomline.llm.sieve import with_ids

WIDTH, PERCENT = 5, 75
SIGNATURES = 6  # min-hash groups a row is compared in before the product
SKETCH_BITS = 18  # counters of the rarity count: 2 MB, whatever the input
PIECES = 16
WIDE = 48  # rows from which a column is multiplied by tiles rather than as pairs
TILE, TILE_COLUMNS = 512, 4096
PART_BYTES = 1 << 21  # text that a task takes apart at once
BLOCK_CELLS = 1 << 22  # cells of the matrix in one block of columns
_SALTS = np.random.default_rng(11).integers(1, 2**64, SIGNATURES, dtype=np.uint64)

SCAN = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sigs", T.ArrayType(T.LongType())),
])


def enough(overlap, n_a, n_b, percent: int):
    """100 * intersection >= percent * union, for numbers, arrays or columns."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def prefix_size(n: int, percent: int) -> int:
    """How many of the rarest n-grams of a set of n must be looked at."""
    return n - -(-percent * n // 100) + 1


def _scan(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in packed.parts(batches, PART_BYTES):
            data, offsets = packed.text_bytes(batch.column(1))
            n, h1, h2, sigs = [], [], [], []
            for grams in packed.shingle_sets(data, offsets, width):
                n.append(len(grams))
                h1.append(int(grams.sum(dtype=np.uint64)))
                h2.append(int(packed.mixed(grams + packed.ODD).sum(dtype=np.uint64)))
                sigs.append(np.array([packed.mixed(grams ^ s).min() for s in _SALTS], np.uint64).view(np.int64) if len(grams) else None)
                if len(grams):
                    # Sorted hashes: one counter may meet several of them.
                    at, times = np.unique(grams >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                    counts[at] += times.astype(np.uint32)
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            m = len(n)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), batch.column(0), pa.array(n, pa.int64()), signed(h1), signed(h2), pa.array(sigs, pa.list_(pa.int64()))], names=SCAN.names)
        parts = [x.tobytes() for x in np.split(counts, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary()), *[pa.nulls(PIECES, t) for t in (*[pa.int64()] * 4, pa.list_(pa.int64()))]], names=SCAN.names)

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.zeros((1 << SKETCH_BITS) // PIECES, np.uint64)
    for part in table.column("counts"):
        total += np.frombuffer(part.as_buffer(), np.uint32)
    return pa.table({"piece": table.column("piece").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def _rarity(scan: DataFrame) -> np.ndarray:
    """The rarity counters summed over all tasks: 2^18 numbers at any size of input."""
    rows = scan.where("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(_sum_counts, "piece int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in sorted(rows)]) if rows else np.zeros(1 << SKETCH_BITS, np.uint64)


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed.parts(batches, PART_BYTES):
            sides = [list(packed.shingle_sets(*packed.text_bytes(batch.column(c)), width)) for c in ("text_a", "text_b")]
            ok = []
            for x, y in zip(*sides):
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                ok.append(bool(len(x) and len(y) and enough(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that link, counted on their whole texts."""
    ids = materialise(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "pair_ids")
    texts = materialise(with_ids(docs, ids).select("doc_id", "text"), "pair_texts")
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(width, percent), "a long, b long").distinct(), "pair_links")


def _blocks(width: int, percent: int, blocks: int, shared):
    """Sends each range of n-grams the columns that these documents have in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in packed.parts(batches, 2 * PART_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = packed.text_bytes(batch.column(1))
            grams, rows, sizes, places = [], [], [], []
            for k, all_grams in enumerate(packed.shingle_sets(data, offsets, width)):
                n = len(all_grams)
                if n == 0:
                    continue
                p = prefix_size(n, percent)
                rare = all_grams[np.argsort(rarity[all_grams >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:p]]
                grams.append(rare)
                rows.append(np.full(p, k, np.int32))
                sizes.append(np.full(p, n, np.int32))
            if not grams:
                continue
            grams, rows, sizes = np.concatenate(grams), np.concatenate(rows), np.concatenate(sizes)
            order = np.argsort(grams, kind="stable")
            grams, rows, sizes = grams[order], ids[rows[order]].astype(np.int64), sizes[order]
            owner = ((grams >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(blocks + 1).astype(np.uint64))
            cols = [(int(o), packed.golomb(grams[a:b]), rows[a:b].tobytes(), sizes[a:b].tobytes()) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cols), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "grams", "ids", "sizes"])

    return run


def _columns(table: pa.Table) -> pa.Table:
    """The columns of one block that more than one row has, as (gram, doc_id, size)."""
    grams = np.concatenate([packed.ungolomb(x) for x in table.column("grams").to_pylist()])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ids").to_pylist()])
    sizes = np.concatenate([np.frombuffer(x, np.int32) for x in table.column("sizes").to_pylist()])
    order = np.argsort(grams, kind="stable")
    grams, ids, sizes = grams[order], ids[order], sizes[order]
    same = grams[1:] == grams[:-1]
    shared = np.zeros(len(grams), bool)
    shared[1:] |= same
    shared[:-1] |= same
    return pa.table({"gram": grams[shared].view(np.int64), "doc_id": ids[shared], "size": sizes[shared].astype(np.int64)})


def _tile(width: int, percent: int):
    """Overlaps of all rows of two tiles as a matrix product over chunks of columns; gives each row the first row it is connected with."""

    def run(table: pa.Table) -> pa.Table:
        data, offsets = packed.text_bytes(table.column("text"))
        sets = list(packed.shingle_sets(data, offsets, width))
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        met = times > 1
        row, column = row[met[column]], (np.cumsum(met) - 1)[column[met[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        total = int(met.sum())
        for at in range(0, total, TILE_COLUMNS):
            a, b = np.searchsorted(column, (at, at + TILE_COLUMNS))
            cells = np.zeros((len(sets), min(TILE_COLUMNS, total - at)), np.float32)
            cells[row[a:b], column[a:b] - at] = 1
            overlap += cells @ cells.T
        links = enough(overlap.astype(np.int64), size[:, None], size[None, :], percent) & (comp[:, None] != comp[None, :])
        label = np.arange(len(sets))
        while True:
            near = np.where(links, label[None, :], len(sets)).min(1)
            new = np.minimum(label, near)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(sets))
        return pa.table({"a": node[label[moved]], "b": node[moved]})

    return run


def _hot_links(cells: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between different components among the rows of wide columns: (a, b), a spanning set of them.

    Columns that start with the same row are one family (the n-grams of a shared
    passage have nearly the same rows). A family is cut into tiles of TILE rows and
    each pair of tiles is one product, so no pair of rows leaves a task
    but those that connect something. Pairs of tiles that lie in one component, or
    whose sizes can not link, are left out.
    """
    rows = materialise(cells.groupBy("family", "node").agg(F.max("n").alias("n"), F.max("comp").alias("comp")), "jaccard_families")
    by_comp = rows.groupBy("family", "comp").agg(F.count("*").alias("own"))
    small = by_comp.groupBy("family").agg(F.sum(F.when(F.col("own") <= TILE, F.col("own")).otherwise(0)).alias("others"))
    spread = lambda key, m: F.pmod(F.xxhash64(key), F.ceil(F.col(m) / TILE)).cast("string")
    tile = F.when(F.col("own") > TILE, F.concat(F.col("comp").cast("string"), F.lit("#"), spread("node", "own"))).otherwise(F.concat(F.lit("#"), spread("comp", "others")))
    rows = materialise(rows.join(by_comp, ["family", "comp"]).join(small, "family").select("family", "node", "n", "comp", tile.alias("tile")), "jaccard_tiled")
    tiles = rows.groupBy("family", "tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    one, two = tiles.alias("x"), tiles.alias("y")
    pairs = one.join(two, F.expr(f"""x.family = y.family and x.tile <= y.tile and (x.low <> x.high or y.low <> y.high or x.low <> y.low)
        and 100 * x.most >= {percent} * y.least and 100 * y.most >= {percent} * x.least""")).selectExpr("x.family as family", "x.tile as tile_a", "y.tile as tile_b")
    pairs = materialise(pairs, "jaccard_tile_pairs")
    side = lambda t: pairs.select("family", "tile_a", "tile_b", F.col(t).alias("tile"))
    dealt = side("tile_a").unionByName(side("tile_b").where("tile_a <> tile_b")).join(rows, ["family", "tile"]).select("family", "tile_a", "tile_b", "node", "comp")
    ids = materialise(rows.select(F.col("node").alias("i")).distinct(), "jaccard_tile_ids")
    texts = with_ids(docs, ids).select(F.col("doc_id").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return dealt.join(texts, "node").groupBy("family", "tile_a", "tile_b").applyInArrow(_tile(width, percent), "a long, b long")


def _pairs_of(cells: DataFrame, percent: int) -> DataFrame:
    """Overlap counts of rows in different components, at or above what their sizes ask for: (a, b)."""
    left = cells.select("gram", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    right = cells.select("gram", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    met = left.join(right, "gram").where(smaller & (F.col("comp_a") != F.col("comp_b")) & (100 * F.col("n_a") >= percent * F.col("n_b")))
    counts = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    # Beyond the rows' cells lie ceil(0.75 n) - 1 n-grams of the one whose cells end first.
    rest = F.ceil(F.lit(percent) * F.col("n_b") / F.lit(100)) - 1
    rest = F.least(rest, F.col("n_a"))
    return counts.where(enough(F.col("c") + rest, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, blocks: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read): doc_id, n_shingles, component_id.

    Words are maximal runs without white space, A-Z lower-cased. A document's set
    are its distinct ``width``-word shingles, or its whole word sequence where
    that is shorter. Documents link when 100 * intersection >= percent *
    union; component_id is the smallest doc_id that links lead to.

    blocks: ranges of n-grams, by default the session's shuffle partitions, and more where a block would hold over 4 million cells.

    A null or empty text has an empty set and links with nothing. Rows that share
    a doc_id are one document to links; each has its own n_shingles. A row
    without doc_id is counted but links with nothing (null component_id).
    Other columns are ignored; an empty table gives no rows. N-grams are compared
    by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = materialise(docs.mapInArrow(_scan(width), SCAN), "jaccard_scan")
    rows = scan.where("piece is null").drop("piece", "counts")
    cells_in_all = (rows.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells_in_all // BLOCK_CELLS))
    named = rows.where("n > 0 and doc_id is not null")
    # One node per set of n-grams.
    nodes = materialise(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("sigs").alias("sigs")), "jaccard_nodes")
    members = materialise(named.select("doc_id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node").distinct(), "jaccard_members")
    twins = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("m"), F.collect_set("node").alias("all")).where("m > 1").select("a", F.explode("all").alias("b"))

    # Every row against the first of its min-hash groups.
    signed = nodes.select("node", "n", F.posexplode("sigs").alias("k", "sig"))
    # A row that is in large groups throughout is most like the rest of its family, so each group tries it; and one at random.
    sizes = signed.groupBy("k", "sig").agg(F.count("*").alias("m")).where("m > 1")
    signed = materialise(signed.join(sizes, ["k", "sig"]), "jaccard_groups")
    central = signed.groupBy("node").agg(F.sum(F.log("m")).alias("central"))
    ranked = signed.join(central, "node")
    one = F.struct("node", "n")
    first = ranked.groupBy("k", "sig").agg(F.array(F.max_by(one, F.struct("central", -F.col("node"))), F.min_by(one, F.xxhash64("node", "k"))).alias("first"))
    first = first.select("k", "sig", F.explode("first").alias("first"))
    tries = signed.join(first, ["k", "sig"]).where("node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b"))
    tries = tries.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).groupBy("a", "b").agg(F.count("*").alias("times"))
    sure = _linked(materialise(tries.select("a", "b"), "jaccard_tries"), docs, width, percent)
    start = components(sure.unionByName(twins.select("a", "b")))

    # The product over what is left.
    shared = spark.sparkContext.broadcast(_rarity(scan))
    # Copies of a text have its node's cells already.
    sent = with_ids(docs, nodes.select(F.col("node").alias("i"))).mapInArrow(_blocks(width, percent, blocks, shared), "block int, grams binary, ids binary, sizes binary")
    cells = sent.groupBy("block").applyInArrow(_columns, "gram long, doc_id long, size long")
    of = members.join(start, members.node == start.node, "left").select("doc_id", members.node, F.coalesce("label", members.node).alias("comp"))
    cells = materialise(cells.where("size > 0").join(of.where("doc_id = node"), "doc_id").select("gram", "node", F.col("size").alias("n"), "comp"), "jaccard_cells")
    mixed = cells.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.min("node").alias("family")).where("low <> high").select("gram", "m", "family")
    cells = materialise(cells.join(mixed, "gram"), "jaccard_mixed")
    # A pair that meets in a wide column is counted there; for any other the narrow columns hold all it shares.
    rest = _linked(materialise(_pairs_of(cells.where(F.col("m") <= WIDE), percent), "jaccard_pairs"), docs, width, percent)
    rest = rest.unionByName(materialise(_hot_links(cells.where(F.col("m") > WIDE), docs, width, percent), "jaccard_wide"))

    label = materialise(of.select("node", "comp").distinct(), "jaccard_comps")
    ends = lambda side: label.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
    final = components(rest.join(ends("a"), "a").join(ends("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")))
    whole = of.join(final.select(F.col("node").alias("old"), F.col("label").alias("new")), F.col("comp") == F.col("old"), "left")
    whole = whole.groupBy("doc_id").agg(F.min(F.coalesce("new", "comp")).alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


JACCARD_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM e),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, g FROM s JOIN m USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r AS a JOIN r AS b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT reach.v, l.b FROM reach JOIN l ON l.a = reach.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(u) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN reach ON v = d.doc_id GROUP BY d.doc_id, n.n
"""

"""Quality classification by nearest-neighbour voting in a latent semantic space.

A text is a row of terms: hashed byte trigrams, hashed four-grams of its shape
(what kind of character stands where), and a few style terms. Terms are
weighted by their rarity over all texts and projected on the leading singular
vectors of a labelled sample. The sample's vectors are broadcast (their number is a
parameter); every text is multiplied with all of them, in blocks, and its
nearest ones vote for their labels with a weight that follows the cosine.

Texts are read once: their rows of terms are written, coded in blocks, and rarities and
scores are both computed from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.llm import packed

SAMPLE = 6000  # labelled texts that vote, those with the smallest hash of their id
RANK = 64  # dimensions of the latent space
NEIGHBOURS = 25
SHARPNESS = 8  # a vote weighs cosine ** SHARPNESS
CUT = 0.7  # score from which a text is predicted to be good
TRIGRAMS, SHAPES, STYLES, LEVELS = 2048, 1024, 8, 16
TERMS = TRIGRAMS + SHAPES + STYLES * LEVELS
SLICE_BYTES = 1 << 21
BLOCK = 512

# Shape of a byte: its own value, but for letters (with all bytes above ASCII), capitals, digits and line ends.
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[ord("a"):ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")
_LETTER = np.isin(_SHAPE, (ord("a"), ord("A")))
_CAPITAL, _DIGIT = _SHAPE == ord("A"), _SHAPE == ord("0")


def _grams(data: np.ndarray, owner: np.ndarray, offset: np.ndarray, n: int, width: int, terms: int) -> np.ndarray:
    """Counts of hashed byte n-grams, one row per text."""
    if len(data) < width:
        return np.zeros((n, terms), np.float32)
    code = np.zeros(len(data) - width + 1, np.uint64)
    for j in range(width):
        code = code * np.uint64(257) + data[j:len(data) - width + 1 + j]
    inside = owner[width - 1:] == owner[:len(code)]
    term = ((code * packed.ODD) >> np.uint64(64 - int(np.log2(terms)))).astype(np.int64)
    return np.bincount(owner[:len(code)][inside] * terms + term[inside], minlength=n * terms).reshape(n, terms).astype(np.float32)


def _level(share: np.ndarray) -> np.ndarray:
    return np.clip((share * LEVELS).astype(int), 0, LEVELS - 1)


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped term counts of each text, with its style terms."""
    n, size = len(offsets) - 1, np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    out = np.zeros((n, TERMS), np.float32)
    out[:, :TRIGRAMS] = np.log1p(_grams(data.astype(np.uint64), owner, offsets, n, 3, TRIGRAMS))
    out[:, TRIGRAMS:TRIGRAMS + SHAPES] = np.log1p(_grams(_SHAPE[data], owner, offsets, n, 4, SHAPES))
    count = lambda mask: np.bincount(owner, weights=mask[data], minlength=n)
    solid, some = count(~packed.SPACE), np.maximum(size, 1)
    hashes, of = packed.word_hashes(data, offsets)
    words = np.bincount(of, minlength=n)
    # Different words of each text: its number above the hash (48 bits of it, more than a block's words can make collide).
    packs = np.unique((of.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16)))
    kinds = np.bincount((packs >> np.uint64(48)).astype(np.int64), minlength=n)
    repeat = np.zeros(n)
    if len(hashes) > 1:
        repeat = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n)
    some_words = np.maximum(words, 1)
    shares = [count(_LETTER) / some, count(_CAPITAL) / np.maximum(count(_LETTER), 1), np.minimum(1, 4 * count(_DIGIT) / some), np.minimum(1, 4 * (solid - count(_LETTER) - count(_DIGIT)) / some),
              kinds / some_words, repeat / some_words, np.minimum(1, solid / some_words / 16), np.minimum(1, np.log2(1 + words) / LEVELS)]
    start = TRIGRAMS + SHAPES
    for k, share in enumerate(shares):
        out[np.arange(n), start + k * LEVELS + _level(share)] = 1.0
    return out


def weighted(rows: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rarity-weighted rows; each kind of term is brought to unit length, so a long text does not drown its style."""
    rows = rows * rarity
    for a, b in ((0, TRIGRAMS), (TRIGRAMS, TRIGRAMS + SHAPES), (TRIGRAMS + SHAPES, TERMS)):
        length = np.sqrt((rows[:, a:b] ** 2).sum(1, keepdims=True))
        np.divide(rows[:, a:b], length, out=rows[:, a:b], where=length > 0)
    return rows


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        step = max(1, min(BLOCK, len(batch) * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes)))
        for at in range(0, len(batch), step):
            part = batch.slice(at, step)
            yield part, term_rows(*packed.text_bytes(part.column(column)))


CODED = "ids array<long>, held array<boolean>, terms binary, texts binary"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of terms in blocks of half-precision numbers, and in how many texts of the block each term is."""
    for part, rows in _parts(batches, 0):
        yield pa.RecordBatch.from_arrays(
            [pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(2).to_pylist()], pa.list_(pa.bool_())), pa.array([packed.squeezed(rows.astype(np.float16))], pa.binary()),
             pa.array([packed.squeezed((rows > 0).sum(0).astype(np.int32))], pa.binary())], names=[c.split()[0] for c in CODED.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray]]:
    for batch in batches:
        for ids, held, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield ids, held, packed.unsqueezed(terms.as_py(), np.float16).reshape(len(ids), TERMS).astype(np.float32)


def _holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, total = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for count, n in zip(batch.column(0), batch.column(1).to_pylist()):
            texts += packed.unsqueezed(count.as_py(), np.int32)
            total += n
    yield pa.RecordBatch.from_arrays([pa.array([np.append(texts, total)], pa.list_(pa.int64()))], names=["texts"])


def rarities(coded: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + texts with the term)) over all texts, for the fixed number of terms."""
    tasks = coded.select("texts", F.size("ids").cast("long")).mapInArrow(_holding, "texts array<long>")
    sums = dict(tasks.select(F.posexplode("texts").alias("term", "n")).groupBy("term").agg(F.sum("n")).collect())
    texts = np.array([sums.get(k, 0) for k in range(TERMS + 1)], float)
    return (np.log((1 + texts[-1]) / (1 + texts[:-1])) + 0.1).astype(np.float32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _parts(batches, 0):
        coded = [packed.squeezed(r.astype(np.float16)) for r in rows]
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(coded, pa.binary())], names=["doc_id", "label", "terms"])


def singular_space(rows: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors of rows, by subspace iteration."""
    rank = min(rank, *rows.shape)
    basis = np.random.default_rng(seed).standard_normal((rows.shape[1], min(rank + 16, rows.shape[1])))
    for _ in range(5):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, v = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ v.T)[:, :rank]


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows**2).sum(1, keepdims=True))
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def votes(rows: np.ndarray, voters: np.ndarray, labels: np.ndarray, neighbours: int, prior: float, own: np.ndarray | None = None) -> np.ndarray:
    """Share of label 1 among the nearest voters of each row, weighted by a power of the cosine.

    Voters that tie for the last places share them equally. own: for each row the voter that it is itself, which has no vote there (-1: none).
    """
    if not len(voters):
        return np.full(len(rows), prior)
    cosine = rows @ voters.T
    if own is not None:
        mine = np.flatnonzero(own >= 0)
        cosine[mine, own[mine]] = -np.inf
    k = min(neighbours, len(voters))
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1:k]
    above = cosine > last
    places, tied = k - above.sum(1), cosine == last
    weight = np.maximum(cosine, 0.0) ** SHARPNESS
    share = np.where(above, weight, 0.0) + np.where(tied, weight * (places / np.maximum(tied.sum(1), 1))[:, None], 0.0)
    total = share.sum(1)
    return np.where(total > 0, (share @ labels) / np.where(total > 0, total, 1), prior).clip(0.0, 1.0)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, space, voters, labels, names, neighbours, prior = model.value
        place = {int(v): i for i, v in enumerate(names)}
        for ids, held, rows in _blocks(batches):
            own = np.array([-1 if i is None else place.get(i, -1) for i in ids])
            # Sums depend on a row's place in its block in their last digits; those are rounded off.
            score = np.round(votes(unit(weighted(rows, rarity).astype(float) @ space), voters, labels, neighbours, prior, own), 9)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on).

    docs: only text is an input of a score; labels: (doc_id, quality).
    Labels are learned from rows whose crc32(doc_id as text) mod 4 is not 2, of
    these the ``sample`` with the smallest hash of their id; term
    rarities come from all texts.

    A row's own label has no vote in its score; voters that tie for the last of the nearest places share them.
    A null or empty text has style terms only and is scored by them. Rows that
    repeat are scored each. A label that is null, or on a document that is not
    there, does not vote; a document with several labels votes with their mean.
    Without any label every score is 0.5. A null doc_id is not held out and does not vote.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    crc = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.avg("quality").alias("label"))
    known = materialise(known.where(crc("l_id") % 4 != 2).orderBy(F.xxhash64("l_id"), "l_id").limit(sample), "quality_labels")
    texts = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"))
    coded = materialise(texts.withColumn("held", crc("doc_id") % 4 == 2).mapInArrow(_coded, CODED), "quality_terms")
    rarity = rarities(coded)
    # At most ``sample`` ids, so their side is broadcast.
    picked = texts.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("text", "doc_id", "label")
    rows = picked.mapInArrow(_sampled, "doc_id long, label double, terms binary").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    if rows:
        matrix = weighted(np.stack([packed.unsqueezed(r["terms"], np.float16) for r in rows]).astype(np.float32), rarity)
        target = np.array([r["label"] for r in rows])
        space = singular_space(matrix.astype(float), rank)
        voters, prior = unit(matrix @ space), float(target.mean())
    else:
        space, voters, target, prior = np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5
    model = spark.sparkContext.broadcast((rarity, space, voters, target, [r["doc_id"] for r in rows], neighbours, prior))
    return coded.select("ids", "held", "terms").mapInArrow(_predict(model), "doc_id long, held_out boolean, score double, predicted int")

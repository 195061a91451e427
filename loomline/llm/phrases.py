"""Collocations from an FM-index over word numbers in every shard of the corpus.

A shard holds a few megabytes of texts of one language. Its words are numbered,
its suffixes sorted to the depth that phrases need, once forward and once
backward, and the two Burrows-Wheeler transforms give a bidirectional FM-index:
extending an interval by a word on either side is a count over the transform
inside it. Starting from single words, extensions enumerate every phrase of the
shard with its count.

A count is only known over all shards. Shards send the sorted, coded hashes of
their phrases with their counts to owners, owners add up and answer each list
with a bitmap of what can be frequent, and shards then send those phrases in
words. Hashes only choose what is sent: the counts that are used are sums over
equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.llm import packed

MOST_WORDS, LEAST_COUNT, TOP = 3, 10, 2000
HELD_PERCENT = 50  # a phrase goes when a longer candidate around it has this share of its count
SHARD_BYTES = 4 << 20
OWNER_GRAMS = 1 << 22  # entries of all shards that one owner adds up
SPARE_BITS = 8  # bits of a hash beyond those that number the corpus' bytes

CUT = 0xFF  # stands for a cut between pieces; no UTF-8 text holds it
_CLEAN = bytes(CUT if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

SHARDS = "shard string, lang string, body binary, n_bytes long, n_words long"


def _n_words(body: bytes) -> int:
    raw = np.frombuffer(body, np.uint8)
    solid = (raw != 0x20) & (raw != CUT)
    return int(solid[:1].sum() + (solid[1:] & ~solid[:-1]).sum())


def _shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, {}, {}

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            body = bytes([CUT]).join(held.pop(lang))
            del size[lang]
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{number}"]), pa.array([lang]), pa.array([packed.squeezed(np.frombuffer(body, np.uint8))], pa.binary()), pa.array([len(body)], pa.int64()), pa.array([_n_words(body)], pa.int64())],
                names=[c.split()[0] for c in SHARDS.split(", ")])

        for part in packed.parts(batches, packed.SLICE // 2):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1)):
                body = (text.as_py() or b"").translate(_CLEAN)
                held.setdefault(lang, []).append(body)
                size[lang] = size.get(lang, 0) + len(body) + 1
                if size[lang] >= shard_bytes:
                    yield shard(lang)
                elif sum(size.values()) >= 4 * shard_bytes:  # many languages in one task
                    yield shard(max(size, key=size.get))
        for lang in list(held):
            yield shard(lang)

    return run


class OneWay:
    """Suffix order to a fixed depth, Burrows-Wheeler transform and LF mapping of word numbers; 0 ends a piece."""

    def __init__(self, x: np.ndarray, depth: int):
        self.v = int(x.max()) + 1
        key = x.astype(np.int64)
        for d in range(1, depth):
            if int(key.max()) >= (1 << 62) // self.v:
                key = np.unique(key, return_inverse=True)[1]
            key = key * self.v
            key[:-d] += x[d:]
        order = np.argsort(key, kind="stable")
        self.bwt = x[order - 1]
        self.lf = np.empty(len(x), np.int32)
        self.lf[np.argsort(self.bwt, kind="stable")] = np.arange(len(x), dtype=np.int32)

    def extend(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every word before the phrases of the intervals: (phrase, word, new low, count, words of the interval that are smaller)."""
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(len(owner)) - begin[owner] + low[owner]
        key = owner * self.v + self.bwt[place]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(key)))
        at = place[order[first]]
        phrase, word = owner[order[first]], self.bwt[at]
        keep = word > 0
        return phrase[keep], word[keep], self.lf[at[keep]].astype(np.int64), count[keep], (first - begin[phrase])[keep]


def phrases_of(x: np.ndarray, most_words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All phrases of one to ``most_words`` words of a shard: for each length their words (one row a phrase) and counts.

    x: word numbers from 1, with 0 between pieces and at both ends. Two words are one extended to the left in the
    forward index; longer phrases are extended to the right in the backward index. Both intervals of a phrase are
    kept in step: what is smaller in the one is skipped in the other.
    """
    ahead = OneWay(x, most_words)
    size = np.bincount(x, minlength=ahead.v)
    low = (np.cumsum(size) - size)[1:]
    words, size = np.arange(1, ahead.v)[:, None], size[1:]
    levels = [(words, size)]
    if most_words > 1:
        phrase, word, _, count, smaller = ahead.extend(low, size)
        del ahead
        words, low, size = np.column_stack((word, words[phrase])), low[phrase] + smaller, count
        levels.append((words, size))
    if most_words > 2:
        back = OneWay(x[::-1].copy(), most_words)
        for _ in range(2, most_words):
            phrase, word, low, size, _ = back.extend(low, size)
            words = np.column_stack((words[phrase], word))
            levels.append((words, size))
    return levels


class _Shard:
    """The phrases of one shard, their hashes in order, and its words."""

    def __init__(self, row: dict, most_words: int, bits: int):
        cut = bytes([CUT])
        body = packed.unsqueezed(row["body"], np.uint8).tobytes().replace(cut, b" \xff ").split()
        number = {cut: 0}
        x = np.zeros(len(body) + 2, np.int32)
        x[1:-1] = [number.setdefault(w, len(number)) for w in body]
        del body
        self.vocabulary = pa.array(list(number), pa.binary())
        hashes = np.concatenate((np.zeros(1, np.uint64), packed.word_hashes(*packed.text_bytes(self.vocabulary[1:]))[0]))
        seed = packed.word_hashes(*packed.text_bytes(pa.array(["x" + row["lang"].replace(" ", "_")])))[0][0]
        self.levels = phrases_of(x, most_words)
        keys = []
        for words, _ in self.levels:
            value = np.full(len(words), seed + np.uint64(words.shape[1]), np.uint64)
            for j in range(words.shape[1]):
                value = value * packed.ODD + hashes[words[:, j]]
            keys.append(packed.mixed(value) >> np.uint64(64 - bits))
        self.keys, self.at = np.unique(np.concatenate(keys), return_inverse=True)

    def counts(self) -> np.ndarray:
        return np.bincount(self.at, weights=np.concatenate([c for _, c in self.levels]), minlength=len(self.keys)).astype(np.uint32)


def _ask(most_words: int, bits: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                row = rows.slice(i, 1).to_pylist()[0]
                shard = _Shard(row, most_words, bits)
                counts, keys = shard.counts(), shard.keys
                del shard
                cuts = np.searchsorted(keys, np.array([(o << bits) // owners + (o > 0) * ((o << bits) % owners > 0) for o in range(owners + 1)], np.uint64))
                out = [(row["shard"], o, packed.golomb(keys[a:b]), packed.squeezed(counts[a:b])) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.binary()))] if out else [pa.array([], t) for t in (pa.string(), pa.int32(), pa.binary(), pa.binary())],
                                                 names=["shard", "owner", "keys", "counts"])
        pa.default_memory_pool().release_unused()

    return run


def _answer(least: int):
    def run(table: pa.Table) -> pa.Table:
        """For every list of one owner the bits of keys whose counts reach ``least`` over all shards."""
        lists = [packed.ungolomb(k) for k in table.column("keys").to_pylist()]
        keys = np.concatenate(lists)
        times = np.concatenate([packed.unsqueezed(c, np.uint32) for c in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) > 0)))
        often = np.add.reduceat(times[order].astype(np.int64), first) >= least
        told = np.empty(len(keys), bool)
        told[order] = np.repeat(often, np.diff(np.append(first, len(keys))))
        cuts = np.cumsum([len(x) for x in lists])[:-1]
        return pa.table({"shard": table.column("shard"), "owner": table.column("owner"), "told": pa.array([np.append(np.uint8(len(x) % 8), np.packbits(x)).tobytes() for x in np.split(told, cuts)], pa.binary())})

    return run


def _bits(raw: bytes) -> np.ndarray:
    rest = raw[0]
    return np.unpackbits(np.frombuffer(raw, np.uint8)[1:], count=8 * (len(raw) - 1) - (8 - rest if rest else 0)).astype(bool)


def _name(most_words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                row = rows.slice(i, 1).to_pylist()[0]
                shard = _Shard(row, most_words, bits)
                often = np.concatenate([_bits(x["told"]) for x in row["answers"]])[shard.at]
                start = 0
                for words, count in shard.levels:
                    here = np.flatnonzero(often[start:start + len(words)])
                    start += len(words)
                    for at in range(0, len(here), 1 << 16):
                        part = here[at:at + (1 << 16)]
                        text = [shard.vocabulary.take(pa.array(words[part, j])) for j in range(words.shape[1])]
                        text = pc.binary_join_element_wise(*text, pa.scalar(b" ")) if len(text) > 1 else text[0]
                        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(part)), text.cast(pa.string()), pa.array(np.full(len(part), words.shape[1], np.int32)), pa.array(count[part].astype(np.int64))],
                                                         names=["lang", "phrase", "k", "f"])
        pa.default_memory_pool().release_unused()

    return run


def phrase_counts(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(counts, sizes): counts holds lang, phrase, k (its words), f for every phrase of up to ``most_words`` words with f >= ``least``; sizes holds lang and n, its words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    shards = materialise(rows.mapInArrow(_shards(shard_bytes), SHARDS), "phrase_shards")
    size = shards.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(62, max(16, int(size).bit_length() + SPARE_BITS))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * most_words // (8 * OWNER_GRAMS)))
    asked = shards.mapInArrow(_ask(most_words, bits, owners), "shard string, owner int, keys binary, counts binary")
    answers = materialise(asked.groupBy("owner").applyInArrow(_answer(least), "shard string, owner int, told binary"), "phrase_answers")
    told = answers.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("owner", "told"))).alias("answers"))
    named = shards.select("shard", "lang", "body").join(told, "shard").mapInArrow(_name(most_words, bits), "lang string, phrase string, k int, f long")
    counts = materialise(named.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "phrase_counts")
    return counts, shards.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST_COUNT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``top`` phrases of every language of ``docs`` (lang and text are read): lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased, texts are split at ``.,;:!?`` and at bytes 0x0A to 0x0D into pieces, pieces at spaces and tabs into
    words. n is the words of the language, a the occurrences of a phrase of two or more words inside pieces,
    overlaps included; phrases with a >= ``least`` are candidates. Cut after its first k words, a phrase scores
    floor(1000000 a^2 / (l r)), l and r the counts of its parts; the lowest-scoring cut counts, of equals the
    first. A candidate inside a longer candidate with at least half its count goes. Order is score, then a, both
    falling, then the bytes of the phrase. Products have 38 digits, enough for a below 10^16; a larger one is an error.

    A null lang is ``und``; a null or empty text has no words. Repeated rows count each. Other columns are
    ignored; an empty table gives no rows. shard_bytes bounds a task's memory unless one text is longer.
    """
    counts, sizes = phrase_counts(docs, most_words, least, shard_bytes)
    words = F.split("phrase", " ")
    long = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", words.alias("w"))
    part = lambda w, start, n: F.array_join(F.slice(w, start, n), " ")
    cut = long.select("lang", "phrase", "a", "w", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "phrase", "a", "cut", part("w", F.lit(1), F.col("cut")).alias("first"), part("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = lambda text, count: counts.where(F.col("k") < most_words).select("lang", F.col("phrase").alias(text), F.col("f").alias(count))
    cut = cut.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"])
    wide = "cast({} as decimal(38,0))".format
    cut = cut.withColumn("score", F.expr(f"({wide(1000000)} * {wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # A part of a longer candidate: every shorter phrase of two or more words inside it.
    inside = long.where("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inside = inside.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("start"))
    around = inside.groupBy("lang", part("w", F.col("start"), F.col("m")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(f"around is null or 100 * around < {HELD_PERCENT} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")


PHRASES_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {MOST_WORDS + 1}) AS r(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST_COUNT}),
x AS (SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT x.lang, x.phrase, x.a, u.f AS l, v.f AS r, 1000000::HUGEINT * a * a // (u.f::HUGEINT * v.f) AS score, cut FROM x JOIN f AS u ON u.lang = x.lang AND u.phrase = first JOIN f AS v ON v.lang = x.lang AND v.phrase = rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
y AS (SELECT lang, sub, max(a) AS around FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS sub FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k = 3)) GROUP BY lang, sub),
z AS (SELECT b.* FROM b LEFT JOIN y ON y.lang = b.lang AND y.sub = b.phrase WHERE around IS NULL OR 100 * around < {HELD_PERCENT} * a)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z) JOIN n USING (lang) WHERE rank <= {TOP}
"""

"""Language-model scoring with a weighted backoff automaton.

The states of the automaton are histories seen in training. From a state, a
seen continuation is an arc with its smoothed log-probability; any other word
takes the failure arc, whose weight is the mass left for unseen words, to the
next shorter history. Reading a text left to right, each word starts in the
longest known history of the words before it.

Counts of a whole corpus do not fit in a task, and a task needs only those of
its own texts. So every batch of texts sends its distinct n-grams with their
training counts, coded, to the owners of their hash ranges; owners add up and
answer each batch in its own order. Training and looking up are one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.session import materialise
from loomline.llm import packed

ORDER = 2
MASS, SHARE = 20.0, 1.0  # belief that a state gives its shorter history: so many words, and so much of its own count
BATCH_WORDS = 1 << 18
OWNER_GRAMS = 1 << 21  # n-grams of all batches that one owner adds up
END = np.uint64(0xC2B2AE3D27D4EB4F)  # the token that ends a text

SEQUENCES = "batch string, ids array<long>, held array<boolean>, lengths binary, words binary, tokens binary, n_tokens long"
_ZSTD = pa.Codec("zstd", compression_level=3)


def _pack(values: np.ndarray) -> bytes:
    return np.int64(values.nbytes).tobytes() + _ZSTD.compress(values.tobytes(), asbytes=True)


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=int(np.frombuffer(raw, np.int64, 1)[0]), asbytes=True), kind)


def _sequences(batch_words: int):
    """Texts as word numbers of a vocabulary per batch, about a third of their size."""

    def row(name: str, ids: list, held: list, lengths: list, hashes: list) -> pa.RecordBatch:
        every = np.concatenate(hashes)
        words, number, times = np.unique(every, return_inverse=True, return_counts=True)
        by_use = np.argsort(-times, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[by_use] = np.arange(len(words), dtype=np.uint32)
        size = np.concatenate(lengths).astype(np.int32)
        cols = [pa.array([name]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([_pack(size)], pa.binary()), pa.array([_pack(words[by_use])], pa.binary()),
                pa.array([_pack(place[number])], pa.binary()), pa.array([len(every) + len(size)], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SEQUENCES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, ids, held, lengths, hashes, size = TaskContext.get().partitionId(), 0, [], [], [], [], 0
        for batch in batches:
            step = max(1, int(len(batch) * batch_words * 6 // max(1, batch.nbytes)))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                data, offsets = packed.text_bytes(part.column(1))
                h, owners = packed.word_hashes(data, offsets)
                ids += part.column(0).to_pylist()
                held += part.column(2).to_pylist()
                lengths.append(np.bincount(owners, minlength=len(part)))
                hashes.append(h)
                size += len(h)
                if size >= batch_words:
                    yield row(f"{task}-{number}", ids, held, lengths, hashes)
                    number, ids, held, lengths, hashes, size = number + 1, [], [], [], [], 0
        if ids:
            yield row(f"{task}-{number}", ids, held, lengths, hashes)

    return run


class _Batch:
    """One batch of texts: its tokens, its distinct n-grams in order, and which n-gram ends at each token."""

    def __init__(self, row: dict, order: int):
        words, tokens, size = _unpack(row["words"], np.uint64), _unpack(row["tokens"], np.uint32), _unpack(row["lengths"], np.int32).astype(np.int64)
        self.ids, self.held, self.sizes = row["ids"], np.array(row["held"], bool), size + 1
        self.starts = np.cumsum(self.sizes) - self.sizes
        spot = np.ones(int(self.sizes.sum()), bool)
        spot[self.starts + size] = False
        seq = np.full(len(spot), END, np.uint64)
        seq[spot] = words[tokens]
        self.place = np.arange(len(seq)) - np.repeat(self.starts, self.sizes)
        self.train = np.repeat(~self.held, self.sizes)
        grams = []
        for k in range(1, order + 1):
            value = np.full(len(seq), k, np.uint64)
            for j in range(k - 1, -1, -1):
                value[k - 1:] = value[k - 1:] * packed.ODD + seq[k - 1 - j:len(seq) - j]
            # The lowest bit tells words from longer n-grams.
            grams.append(packed.mixed(value) & ~np.uint64(1) | np.uint64(k == 1))
        here = [self.place >= k for k in range(order)]
        self.keys, number = np.unique(np.concatenate([g[h] for g, h in zip(grams, here)]), return_inverse=True)
        self.at, start = [], 0
        for h in here:
            at = np.full(len(seq), -1, np.int64)
            at[h] = number[start:start + int(h.sum())]
            self.at.append(at)
            start += int(h.sum())

    def train_counts(self) -> np.ndarray:
        total = np.zeros(len(self.keys), np.int64)
        for at in self.at:
            total += np.bincount(at[self.train & (at >= 0)], minlength=len(self.keys))
        return total.astype(np.uint32)


def _ask(order: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                batch = _Batch(rows.slice(i, 1).to_pylist()[0], order)
                counts = batch.train_counts()
                owner = ((batch.keys >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
                cuts = np.searchsorted(owner, np.arange(owners + 1).astype(np.uint64))
                out = [(int(o), packed.golomb(batch.keys[a:b]), _pack(counts[a:b])) for o, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                name = rows.column(0)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out)), *[pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))]], names=["batch", "owner", "keys", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Corpus counts for every list of one owner, and the owner's share of words and tokens."""
    lists = [packed.ungolomb(x) for x in table.column("keys").to_pylist()]
    keys, number = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(number, weights=np.concatenate([_unpack(x, np.uint32) for x in table.column("counts").to_pylist()]), minlength=len(keys)).astype(np.int64)
    word = (keys & np.uint64(1)).astype(bool)
    told = [_pack(total[x]) for x in np.split(number, np.cumsum([len(x) for x in lists])[:-1])]
    m, owner = len(lists), table.column("owner")[0].as_py()
    return pa.table({"batch": pa.array([*table.column("batch").to_pylist(), None], pa.string()), "owner": pa.array([owner] * (m + 1), pa.int32()), "told": pa.array([*told, None], pa.binary()),
                     "words": pa.array([*[None] * m, int((total[word] > 0).sum())], pa.int64()), "tokens": pa.array([*[None] * m, int(total[word].sum())], pa.int64())})


def _score(order: int, mass: float, share: float, n_train: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                row = rows.slice(i, 1).to_pylist()[0]
                batch = _Batch(row, order)
                count = np.concatenate([_unpack(x["told"], np.int64) for x in row["answers"]])
                seen = count[batch.at[0]]
                uniform = (seen + 0.5) / (n_train + 0.5 * (n_words + 1))
                # Weights of the arcs by length of history; shorter ones first, as they smooth the longer.
                p, arcs = uniform, [(np.zeros(len(seen), np.int64), seen, np.log10(uniform))]
                for k in range(2, order + 1):
                    at, past = batch.at[k - 1], np.concatenate(([-1], batch.at[k - 2][:-1]))
                    here = at >= 0
                    c, h = np.where(here, count[at], 0), np.where(here, count[past], 0)
                    belief = mass + share * h
                    p = np.where(h > 0, (c + belief * p) / (h + belief), p)
                    arcs.append((h, c, np.log10(p)))
                # The traversal: from the longest history down, failing until an arc fits.
                score, failures, moving = np.zeros(len(seen)), np.zeros(len(seen), np.int64), np.ones(len(seen), bool)
                for k in range(order - 1, 0, -1):
                    h, c, weight = arcs[k]
                    fits = moving & (c > 0)
                    fails = moving & (h > 0) & (c == 0)
                    score[fits] += weight[fits]
                    score[fails] += np.log10((mass + share * h[fails]) / (h[fails] + mass + share * h[fails]))
                    failures += fails
                    moving &= ~fits
                score[moving] += arcs[0][2][moving]
                total = lambda x: np.add.reduceat(x, batch.starts)
                m = len(batch.ids)
                cols = [pa.array(batch.ids, pa.int64()), pa.array(batch.held), pa.array(batch.sizes), pa.array(total((seen > 0).astype(np.int64))), pa.array(np.full(m, n_train, np.int64)),
                        pa.array(total(np.log10(uniform))), pa.array(total(score)), pa.array(total(failures))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_failures"])

    return run


def score_texts(docs: DataFrame, order: int = ORDER, mass: float = MASS, share: float = SHARE, batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_failures.

    Tokens are words (maximal runs without white space, A-Z lower-cased) and one
    end. Rows whose crc32(doc_id as text) mod 5 is 1 are held out; the model
    learns from the others. base_score is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))).
    A history h of k words gives p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m) with
    m = mass + share c(h) and h' one word shorter, which sums to 1 over the words and one unknown word;
    score is the sum of log10 p; n_failures counts failure arcs.

    mass, share: belief in the shorter history. batch_words: words of one batch, which bounds a task's memory.

    A null or empty text is its end token alone. A null doc_id counts as an
    empty one (training). Repeated rows are scored, and counted, each. Other
    columns are ignored; an empty table gives no rows. With no training text
    every token has base probability 1. N-grams are compared by 63-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1).alias("held"))
    sequences = materialise(rows.mapInArrow(_sequences(batch_words), SEQUENCES), "lm_sequences")
    size = sequences.agg(F.sum("n_tokens")).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * order // OWNER_GRAMS))
    asked = sequences.mapInArrow(_ask(order, owners), "batch string, owner int, keys binary, counts binary")
    answers = materialise(asked.groupBy("owner").applyInArrow(_answer, "batch string, owner int, told binary, words long, tokens long"), "lm_answers")
    totals = answers.where("batch is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("v")).first()
    told = answers.where("batch is not null").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("owner", "told"))).alias("answers"))
    scored = sequences.join(told, "batch").select("ids", "held", "lengths", "words", "tokens", "answers")
    return scored.mapInArrow(_score(order, mass, share, totals["n"], totals["v"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_failures long")


CRC_SQL = """
crc_step AS (SELECT i, i AS c, 0 AS k FROM range(256) AS r(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM crc_step WHERE k = 8),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc_table)"""

LM_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, crc % 5 = 1 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents JOIN crc USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(list_append(w, '')) AS word, unnest(list_prepend(NULL, w)) AS past FROM d),
u AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
b AS (SELECT past, word, count(*) AS c2 FROM t WHERE NOT held_out AND past IS NOT NULL GROUP BY past, word),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n_train, count(*) AS n_words FROM u),
p AS (SELECT t.doc_id, t.held_out, coalesce(u.c, 0) AS c, coalesce(h.c, 0) AS ch, coalesce(b.c2, 0) AS c2, n_train, (coalesce(u.c, 0) + 0.5::DOUBLE) / (n_train + 0.5::DOUBLE * (n_words + 1)) AS p1
    FROM t CROSS JOIN n LEFT JOIN u USING (word) LEFT JOIN u AS h ON h.word = t.past LEFT JOIN b ON b.past = t.past AND b.word = t.word)
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_known, n_train AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
    round(sum(log10(CASE WHEN ch > 0 THEN (c2 + ({MASS}::DOUBLE + {SHARE}::DOUBLE * ch) * p1) / (ch + {MASS}::DOUBLE + {SHARE}::DOUBLE * ch) ELSE p1 END)), 6) AS score, CAST(sum(CASE WHEN ch > 0 AND c2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failures
FROM p GROUP BY doc_id, held_out, n_train
"""

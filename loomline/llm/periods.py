"""Stretches of words that repeat with a period, found from minimizers at many scales.

A run of smallest period q, with s the power of two that has s/2 < q <= s, holds
equal s-word strings only at multiples of q (two closer ones would give it a
smaller period). Each scale s keeps the least of every s/2 neighbouring s-word
hashes. In a run of four periods these minima come back q words later, so the
next equal minimizer of some minimizer lies exactly q words on: such pairs are
the seeds, and a seed is extended by comparing words. Periods below the
smallest scale are scanned directly, lag by lag.

A text is one row of work: Spark deals the rows, and the arrays here are a few
times the words of one text, or of a pack of short ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import packed
from loomline.llm.lm import CRC_SQL

LEAST, TIMES = 6, 4  # words and periods that make a run
SCANNED = 4  # periods up to this are scanned lag by lag
PACK_WORDS, LONE_WORDS = 1 << 16, 1 << 12  # words of short texts searched at once; a longer text is searched alone

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _scan(x: np.ndarray, q: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, q) of every place where words q apart agree long enough."""
    if len(x) <= q:
        return []
    same = np.zeros(len(x) - q + 2, np.int8)
    same[1:-1] = x[q:] == x[:-q]
    edge = np.flatnonzero(np.diff(same))
    start, end = edge[::2], edge[1::2] + q
    fits = end - start >= max(least, times * q)
    return [(int(a), int(b), q) for a, b in zip(start[fits], end[fits])]


def _agree(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words agree from places i and j (i < j) on, going right (1) or left (-1)."""
    room = len(x) - j if step > 0 else i + 1
    done, size = 0, 64
    while done < room:
        size = min(size, room - done)
        a, b = i + step * done, j + step * done
        same = x[a:a + size] == x[b:b + size] if step > 0 else x[a - size + 1:a + 1][::-1] == x[b - size + 1:b + 1][::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + size, size * 2
    return done


def _minimizers(g: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash of every ``width`` (a power of two) neighbours, the leftmost of equals."""
    bits = max(1, (len(g) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    least, span = (g & ~low) | np.arange(len(g), dtype=np.uint64), 1
    while span < width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    at = (least & low).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def _seeds(g: np.ndarray, scale: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, distance): minimizers of one scale whose next equal one lies ``distance`` on, neighbours in one stretch joined."""
    at = _minimizers(g, scale // 2)
    at = at[np.argsort(g[at], kind="stable")]
    apart = np.diff(at)
    pair = np.flatnonzero((g[at[1:]] == g[at[:-1]]) & (apart > scale // 2) & (apart <= scale))
    order = np.lexsort((at[pair], apart[pair]))
    place, apart = at[pair][order], apart[pair][order]
    if len(place):
        new = np.flatnonzero(np.concatenate(([True], (np.diff(apart) > 0) | (np.diff(place) > scale))))
        for a, b in zip(new, [*new[1:], len(place)]):
            yield int(place[a]), int(place[b - 1]), int(apart[a])


def find_runs(x: np.ndarray, longest: int | None = None, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All maximal runs (start, length, smallest period) of the word numbers ``x``, by start, then period.

    A run has at least ``least`` words and ``times`` (4 or more) periods. longest: no text in ``x`` has more words (its
    texts are kept apart by numbers that occur once).
    """
    longest = len(x) if longest is None else longest
    found = [run for q in range(1, min(SCANNED, longest // times) + 1) for run in _scan(x, q, least, times)]
    scale, g = 1, packed.mixed(x.astype(np.uint64) * packed.ODD + packed.MIX)
    while scale // 2 < longest // times:
        if scale > SCANNED:
            for first, last, q in _seeds(g, scale):
                start = first - _agree(x, first - 1, first + q - 1, -1) if first else 0
                end = last + q + _agree(x, last, last + q, 1)
                if end - start >= max(least, times * q):
                    found.append((start, end, q))
        if len(g) <= scale:
            break
        turned = (g[scale:] << np.uint64(23)) | (g[scale:] >> np.uint64(41))
        g = packed.mixed(g[:-scale] * packed.ODD + turned)
        scale *= 2
    period: dict[tuple[int, int], int] = {}
    for start, end, q in found:  # multiples of a run's period span the same words
        period[start, end] = min(q, period.get((start, end), q))
    return sorted((start, end - start, q) for (start, end), q in period.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods, compared as a fraction; of equals the first, then the one of smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that follow the first period of any run."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0))


def wrapped_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by crc32 of its id gets a tail that goes on with a period; a document without id stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def _search(rewrite: Callable[[list[bytes], int | None], list[bytes]] | None):
    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        x = np.empty(sum(map(len, texts)) + len(texts), np.int64)
        starts, at = [], 0
        for i, words in enumerate(texts):
            starts.append(at)
            x[at:at + len(words)] = [number.setdefault(w, len(number)) for w in words]
            at += len(words) + 1
            x[at - 1] = -1 - i
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        found = find_runs(x, max(map(len, texts)))
        for i, (start, length, q) in zip(np.searchsorted(starts, [r[0] for r in found], "right") - 1 if found else [], found):
            runs[i].append((start - starts[i], length, q))
        named = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
        cols = [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([[named(r) for r in rs] for rs in runs], pa.list_(_RUN)), pa.array([named(strongest(rs)) for rs in runs], _RUN),
                pa.array([collapsed(w, rs) for w, rs in zip(texts, runs)], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for part in packed.parts(batches, packed.SLICE // 2):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = (text.as_py() or b"").split()  # bytes are split at 0x20 and 0x09 to 0x0D
                words = rewrite(words, doc_id) if rewrite else words
                if len(words) > LONE_WORDS:
                    yield answer([doc_id], [words])
                    continue
                ids.append(doc_id)
                texts.append(words)
                size += len(words) + 1
                if size >= PACK_WORDS:
                    yield answer(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield answer(ids, texts)

    return run


def periodic_runs(docs: DataFrame, rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read): doc_id, n_words, runs, strongest, collapsed.

    Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D and are compared byte by byte. runs holds
    every stretch (start, length, period; words from 0) of smallest period q with at least six words and four periods
    that no neighbouring word extends, by start, then period; strongest is the one of most periods (ties: first,
    then smaller period), null without runs; collapsed is the text without the words after a run's first period.
    rewrite(words, doc_id): the words to look at instead of a text's own.

    A null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Repeated rows
    are answered each. Other columns are ignored; an empty table gives no rows. Texts of any length are searched
    whole, and memory follows the longest text. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_search(rewrite), f"doc_id long, n_words long, runs {RUNS}, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and sha256 digests (lowercase hex) of the runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("strongest.start").alias("start"), F.col("strongest.length").alias("length"), F.col("strongest.period").alias("period"),
        F.expr("strongest.length * 1000 div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


PERIODS_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, crc % 10 = 0 AS planted, crc // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents JOIN crc USING (doc_id)),
s AS (SELECT *, len(w) AS n, CAST(g % greatest(len(w), 1) AS BIGINT) AS a, CAST(1 + (len(w) - g % greatest(len(w), 1)) // (3 + g % 8) AS BIGINT) AS p FROM d),
t AS (SELECT doc_id, n, w, unnest(range(n)) AS i, CASE WHEN planted THEN a ELSE n END AS a, p FROM s),
u AS (SELECT doc_id, n, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word FROM t),
g AS (SELECT doc_id, n, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS three, lead(word, 2) OVER o IS NOT NULL AS whole FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT * FROM g WHERE whole),
j AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM h AS x JOIN h AS y ON x.doc_id = y.doc_id AND x.three = y.three AND y.i > x.i AND (y.i - x.i) * {TIMES} <= x.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM j),
r AS (SELECT doc_id, start, length, min(q) AS period FROM (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM k GROUP BY doc_id, q, island) WHERE length >= greatest({LEAST}, {TIMES} * q) GROUP BY doc_id, start, length),
m AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r),
c AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = u.doc_id AND u.i >= r.start + r.period AND u.i < r.start + r.length) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN b ON b.doc_id = d.doc_id AND b.place = 1 LEFT JOIN c ON c.doc_id = d.doc_id
"""

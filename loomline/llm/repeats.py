"""Removing later copies of long substrings, by longest-previous-factor arrays over shards of suffixes.

Suffixes are dealt to shards by content: every substring of ``width`` bytes has
one anchor, the 16 bytes inside it with the least hash, so equal substrings
meet at the same anchor wherever they stand. The substrings of one anchor are a
contiguous range of starts, its segment.

1. Batches of texts send a digest of each distinct segment to the owner of its
   anchor. The owner knows the first place of every segment; each other place holds
   copies throughout. Of the rest, only segments that share the 58 bytes
   left or right of the anchor with another one can hold equal substrings.
2. Those segments move, once each, to shards that sort their suffixes, take the
   longest common prefixes of neighbours, and from the previous and next
   smaller position in suffix order the longest previous factor of every start.
   A start whose factor has ``width`` bytes is a later copy.
3. Where very many segments share one side of an anchor (a line that stands in a large part of
   all texts, each time between other words), the shard would grow with the corpus. Their substrings are
   dealt singly instead, by digest, and the first of each stays.
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

WIDTH = 100
ANCHOR = 16
BATCH_BYTES = 4 << 20
PART = 1 << 20  # starts whose anchors are searched at once
OWNER_SEGMENTS = 1 << 20  # digests that one owner compares
SHARD_SEGMENTS = 1 << 13  # segments whose suffixes are sorted together, on average
HOT_SEGMENTS = 1 << 12  # segments that share one side of an anchor; beyond it their substrings are dealt singly

BATCHES = "batch string, ids array<long>, ties binary, first_row long, lengths binary, body binary, n_bytes long"
SENT = "kind int, owner int, batch string, data binary, n long"
LAST = np.iinfo(np.int64).max  # where a missing id stands
FIRST, SHARED, HOT = 1, 2, 4  # what an owner says of a segment

_rng = np.random.default_rng(20260311)
_CODES, _MORE = (_rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2))


def _batches(batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size, at = TaskContext.get().partitionId(), 0, [], 0, 0

        def row() -> pa.RecordBatch:
            data = np.concatenate([d for _, _, d, _ in held])
            ids = [i for some, _, _, _ in held for i in some]
            array = lambda k: pa.array([packed.squeezed(np.concatenate([h[k] for h in held]))], pa.binary())
            cols = [pa.array([f"{task}-{number}"]), pa.array([ids], pa.list_(pa.int64())), array(1), pa.array([(task << 40) + at], pa.int64()), array(3), pa.array([packed.squeezed(data)], pa.binary()), pa.array([len(data)], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in BATCHES.split(", ")])

        for part in packed.parts(batches, batch_bytes // 4):
            data, offsets = packed.text_bytes(part.column(1))
            held.append((part.column(0).to_pylist(), part.column(2).to_numpy(), data.copy(), np.diff(offsets)))
            size += len(data)
            if size >= batch_bytes:
                yield row()
                number, at, held, size = number + 1, at + sum(len(h[0]) for h in held), [], 0
        if held:
            yield row()
        pa.default_memory_pool().release_unused()

    return run


def _joined(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of the given lengths laid end to end: the number of the range and the place in it, for every element."""
    number = np.repeat(np.arange(len(lengths)), lengths)
    return number, np.arange(len(number)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class _Batch:
    """Texts of one batch and their segments, equal ones found in the batch told apart by their order in the corpus."""

    def __init__(self, row: dict):
        self.name, self.ids = row["batch"], row["ids"]
        self.data = packed.unsqueezed(row["body"], np.uint8)
        self.lengths = packed.unsqueezed(row["lengths"], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.doc_ids = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.ties = packed.unsqueezed(row["ties"], np.int64)
        self.rows = row["first_row"] + np.arange(len(self.ids))
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[np.lexsort((self.rows, self.ties, self.doc_ids))] = np.arange(len(self.ids))

    def order_of(self, doc: np.ndarray) -> list[np.ndarray]:
        """What orders texts in the corpus: id, then a hash of the text, then the row."""
        return [self.doc_ids[doc], self.ties[doc], self.rows[doc]]

    def segments(self, width: int) -> None:
        """Fills doc, start, count (starts of the segment), a and b (its digest), left, right and anchor (hashes; 0: no such side)."""
        found = [self._search(*x, width) for x in self._parts(width)]
        fields = ("doc", "start", "count", "a", "b", "left", "right", "anchor")
        for k, field in enumerate(fields):
            setattr(self, field, np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64 if k < 3 else np.uint64 if field in ("a", "anchor") else np.uint32))
        order = np.lexsort((self.start, self.rank[self.doc], self.b, self.a))
        a, b = self.a[order], self.b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(order) else np.zeros(0, bool)
        sent = order[new]  # the first in the batch of equal segments, sent in corpus order
        self.sent = sent[np.lexsort((self.start[sent], self.rank[self.doc[sent]]))]

    def _parts(self, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc, first start, number of starts) of stretches of about a megabyte together."""
        room = np.maximum(self.lengths - width + 1, 0)
        docs = np.flatnonzero(room)
        cuts = -(-room[docs] // PART)
        doc, piece = _joined(cuts)
        base = piece * PART
        number = np.minimum(room[docs][doc] - base, PART)
        group = (np.cumsum(number) - 1) // PART
        for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1) if len(doc) else []:
            yield docs[doc[part]], base[part], number[part]

    def _search(self, doc: np.ndarray, base: np.ndarray, number: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        length = number + width - 1
        which, place = _joined(length)
        data = self.data[self.offsets[doc][which] + base[which] + place]
        begin = np.cumsum(length) - length
        rolling = packed.Rolling(data, _CODES)
        gram = rolling.every(ANCHOR)
        low = np.uint64((1 << max(1, (len(gram) - 1).bit_length())) - 1)
        least, span, near = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1, width - ANCHOR + 1
        while span * 2 <= near:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < near:
            least = np.minimum(least[:span - near], least[near - span:])
        owner, place = _joined(number)
        place = begin[owner] + place
        anchor = (least[place] & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(owner) != 0))))
        count = np.diff(np.append(first, len(anchor)))
        owner, place, anchor = owner[first], place[first], anchor[first]
        # Every substring holds the bytes of one whole side of its anchor.
        side = (width - ANCHOR) // 2
        size = count + width - 1
        a, b = rolling.hashes(place, size), (packed.Rolling(data, _MORE).hashes(place, size) >> np.uint64(32)).astype(np.uint32)
        left, right = np.zeros(len(a), np.uint32), np.zeros(len(a), np.uint32)
        at = np.flatnonzero(place <= anchor - side)
        left[at] = (rolling.hashes(anchor[at] - side, side + ANCHOR) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        at = np.flatnonzero(place + count - 1 > anchor - side)
        right[at] = (rolling.hashes(anchor[at], width - side) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return doc[owner], place - begin[owner] + base[owner], count, a, b, left, right, packed.mixed(gram[anchor])

    def content(self, at: int | np.ndarray, width: int) -> np.ndarray:
        """The bytes of segments, one after the other."""
        which, place = _joined(self.count[at] + width - 1)
        return self.data[(self.offsets[self.doc[at]] + self.start[at])[which] + place]


def _dealt(hashes: np.ndarray, owners: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _together(arrays: list[np.ndarray]) -> bytes:
    sizes = np.array([x.nbytes for x in arrays], np.int64)
    return packed.squeezed(np.concatenate([np.array([len(arrays)], np.int64).view(np.uint8), sizes.view(np.uint8), *(np.ascontiguousarray(x).view(np.uint8) for x in arrays)]))


def _apart(raw: bytes, kinds: list) -> list[np.ndarray]:
    data = packed.unsqueezed(raw, np.uint8)
    n = int(data[:8].view(np.int64)[0])
    cuts = 8 + 8 * n + np.concatenate(([0], np.cumsum(data[8:8 + 8 * n].view(np.int64))))
    return [data[a:b].copy().view(kind) for a, b, kind in zip(cuts[:-1], cuts[1:], kinds)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64()))], names=[c.split()[0] for c in SENT.split(", ")])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for rows in batches:
        for i in range(len(rows)):
            yield rows.slice(i, 1).to_pylist()[0]


KEYS = [np.uint64, np.uint32, np.int64, np.int64, np.int64, np.int64]  # digest (two parts), id, hash, row, start


def _ask(width: int, owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            batch = _Batch(row)
            batch.segments(width)
            owner, out = _dealt(batch.anchor[batch.sent], owners), []
            for o in np.unique(owner):
                at = batch.sent[owner == o]
                out.append((0, int(o), batch.name, _together([batch.a[at], batch.b[at], *batch.order_of(batch.doc[at]), batch.start[at], batch.left[at], batch.right[at]]), len(at)))
            yield _rows(out)
        pa.default_memory_pool().release_unused()

    return run


def _first_of(a: np.ndarray, b: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which rows hold the earliest place of their digest."""
    by = np.lexsort((*order[::-1], b, a))
    a, b = a[by], b[by]
    first = np.empty(len(by), bool)
    first[by] = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return first


def _judge(hot: int):
    def run(table: pa.Table) -> pa.Table:
        """What the batches should do with their segments: FIRST, SHARED, HOT."""
        lists = [_apart(x, [*KEYS, np.uint32, np.uint32]) for x in table.column("data").to_pylist()]
        *keys, left, right = (np.concatenate(x) for x in zip(*lists))
        first = _first_of(*keys)
        one = np.flatnonzero(first)
        verdict = first.astype(np.uint8)
        for side in (left, right):
            at = one[side[one] > 0]
            _, group, size = np.unique(side[at], return_inverse=True, return_counts=True)
            size = size[group]
            verdict[at] |= np.where(size > hot, HOT, np.where(size > 1, SHARED, 0)).astype(np.uint8)
        cuts = np.cumsum([len(x[0]) for x in lists])[:-1]
        told = np.split(verdict, cuts)
        count = lambda flag: pa.array([int(((x & flag) > 0).sum()) for x in told], pa.int64())
        return pa.table({"batch": table.column("batch"), "owner": table.column("owner"), "told": pa.array([packed.squeezed(x) for x in told], pa.binary()), "shared": count(SHARED), "hot": count(HOT)})

    return run


def _marks(name: str, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    return 0, None, name, _together([doc.astype(np.int64), start.astype(np.int64), end.astype(np.int64)]), len(doc)


def _send(width: int, owners: int, shards: int, singles: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            batch = _Batch(row)
            batch.segments(width)
            verdict = np.zeros(len(batch.sent), np.uint8)
            owner = _dealt(batch.anchor[batch.sent], owners)
            for x in row["answers"]:
                verdict[owner == x["owner"]] = packed.unsqueezed(x["told"], np.uint8)
            later = np.ones(len(batch.doc), bool)
            later[batch.sent[(verdict & FIRST) > 0]] = False
            out = [_marks(batch.name, batch.doc[later], batch.start[later], (batch.start + batch.count)[later] + width - 1)]
            at = batch.sent[(verdict & SHARED) > 0]
            shard = _dealt(packed.mixed(batch.anchor[at]), shards)
            for o in np.unique(shard):
                one = at[shard == o]
                doc = batch.doc[one]
                out.append((1, int(o), batch.name, _together([*batch.order_of(doc), doc, batch.start[one], batch.count[one], batch.content(one, width)]), len(one)))
            at = batch.sent[(verdict & HOT) > 0]
            for some in np.split(at, np.arange(1 << 14, len(at), 1 << 14)):
                if len(some):
                    out += _singles(batch, some, width, singles)
            yield _rows(out)
        pa.default_memory_pool().release_unused()

    return run


def _singles(batch: _Batch, at: np.ndarray, width: int, singles: int) -> list[tuple]:
    """The substrings of hot segments, one by one, for the owners of their digests."""
    size = batch.count[at] + width - 1
    data = batch.content(at, width)
    which, place = _joined(batch.count[at])
    here = (np.cumsum(size) - size)[which] + place
    a, b = packed.Rolling(data, _CODES).hashes(here, width), (packed.Rolling(data, _MORE).hashes(here, width) >> np.uint64(32)).astype(np.uint32)
    doc, start, owner, out = batch.doc[at][which], batch.start[at][which] + place, _dealt(packed.mixed(a), singles), []
    for o in np.unique(owner):
        one = np.flatnonzero(owner == o)
        out.append((2, int(o), batch.name, _together([a[one], b[one], *batch.order_of(doc[one]), start[one], doc[one]]), len(one)))
    return out


def previous_smaller(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For every place of the suffix order the common prefix with the last place before it that has a smaller position (0 without one).

    lcp: common prefix of each place with the one before. Links jump over links until all point at smaller positions.
    """
    link, least = np.arange(-1, len(pos) - 1), lcp.copy()
    active = np.arange(len(pos))
    while True:
        to = link[active]
        active = active[(to >= 0) & (pos[to] > pos[active])]
        if not len(active):
            break
        to = link[active]
        least[active], link[active] = np.minimum(least[active], least[to]), link[to]
    least[link < 0] = 0
    return least


def longest_previous_factors(body: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For every start (in text order, ``width`` bytes follow each) the longest prefix, up to ``width``, that an earlier start has too."""
    eight = np.zeros(len(body) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | body[k:len(body) - 7 + k]
    rank, span = np.unique(eight, return_inverse=True)[1].astype(np.int64), 8
    while span * 2 <= width:  # ranks of all substrings of twice the length
        rank = np.unique((rank[:-span] << 32) | rank[span:], return_inverse=True)[1]
        span *= 2
    key = (rank[starts] << 32) | rank[starts + width - span]
    order = np.argsort(key, kind="stable")
    suffix = starts[order]
    lcp, agree = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        differ = eight[suffix[agree] + at] ^ eight[suffix[agree - 1] + at]
        lcp[agree] = at + 8
        for k in range(1, 9):
            lcp[agree] -= (differ >> np.uint64(64 - 8 * k)) > 0
        agree = agree[differ == 0]
    back = np.concatenate(([0], lcp[:0:-1]))
    longest = np.maximum(previous_smaller(order, lcp), previous_smaller(order[::-1], back)[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = longest
    return out


def _factors(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Later copies among the segments of one shard, by batch."""
        lists = [_apart(x, [np.int64] * 6 + [np.uint8]) for x in table.column("data").to_pylist()]
        *texts, doc, start, count, body = (np.concatenate(x) for x in zip(*lists))
        batch = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
        order = np.lexsort((start, *texts[::-1]))  # text order
        size = count + width - 1
        which, place = _joined(size[order])
        text = body[(np.cumsum(size) - size)[order][which] + place]
        del body, which, place
        begin = np.cumsum(size[order]) - size[order]
        which, place = _joined(count[order])
        copy = np.flatnonzero(longest_previous_factors(text, begin[which] + place, width) >= width)
        seg, at = order[which[copy]], (start[order][which] + place)[copy]
        # Neighbouring starts of one segment are one mark.
        head = np.concatenate(([True], (np.diff(which[copy]) != 0) | (np.diff(place[copy]) != 1))) if len(copy) else np.zeros(0, bool)
        low = np.flatnonzero(head)
        high = np.append(low[1:], len(copy))[:len(low)] - 1
        names, rows = table.column("batch").to_pylist(), []
        for k in np.unique(batch[seg[low]]) if len(low) else []:
            one = batch[seg[low]] == k
            rows.append(_marks(names[k], doc[seg[low[one]]], at[low[one]], at[high[one]] + width))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _single(width: int):
    def run(table: pa.Table) -> pa.Table:
        """Later copies among substrings dealt one by one, by batch."""
        lists = [_apart(x, [*KEYS, np.int64]) for x in table.column("data").to_pylist()]
        *keys, doc = (np.concatenate(x) for x in zip(*lists))
        later, cuts = ~_first_of(*keys), np.cumsum([len(x[0]) for x in lists])
        rows = []
        for name, b, n in zip(table.column("batch").to_pylist(), cuts, [len(x[0]) for x in lists]):
            at = np.arange(b - n, b)[later[b - n:b]]
            if len(at):
                rows.append(_marks(name, doc[at], keys[-1][at], keys[-1][at] + width))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _each(batches):
        data, lengths = packed.unsqueezed(row["body"], np.uint8), packed.unsqueezed(row["lengths"], np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        depth = np.zeros(len(data) + 1, np.int32)
        for raw in row["marks"] or []:
            doc, start, end = _apart(raw, [np.int64] * 3)
            np.add.at(depth, offsets[doc] + start, 1)
            np.subtract.at(depth, offsets[doc] + end, 1)
        gone = np.cumsum(depth[:-1]) > 0
        # Removed runs end where a text ends.
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], gone[:-1])) if len(gone) else gone
        after = np.concatenate((gone[1:], [False])) if len(gone) else gone
        low, high = np.flatnonzero(gone & (~before | edge[:-1])), np.flatnonzero(gone & (~after | edge[1:])) + 1
        owner = np.searchsorted(offsets, low, "right") - 1
        spans = [[] for _ in lengths]
        for o, a, b in zip(owner, low - offsets[owner], high - offsets[owner]):
            spans[o].append({"start": int(a), "end": int(b)})
        kept, held = data[~gone], np.concatenate(([0], np.cumsum(~gone)))[offsets]
        for at in range(0, len(lengths), 4096):
            few = slice(at, min(at + 4096, len(lengths)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"][few], pa.int64()), pa.array(lengths[few], pa.int64()), pa.array(spans[few], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([kept[a:b].tobytes() for a, b in zip(held[few], held[few.start + 1:few.stop + 1])], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
    pa.default_memory_pool().release_unused()


def drop_repeats(docs: DataFrame, width: int = WIDTH, batch_bytes: int = BATCH_BYTES, hot: int = HOT_SEGMENTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id and text are read): doc_id, n_bytes, spans, kept.

    A byte goes when a substring of ``width`` bytes (32 or more) of its text covers it that also starts earlier, in
    a text with a smaller doc_id or before it in the same text; overlapping places count, and what counts is the text as
    given. spans holds the removed stretches (start, end in bytes), kept the other bytes, which may cut a
    character in two. batch_bytes: text read at once in a task. hot: segments with one side of an anchor in common that are still sorted together.

    Texts are UTF-8 bytes; a null one is empty. A null doc_id counts as the largest. Rows with one doc_id and
    different texts are ordered by a hash of the text; of rows that repeat both, one is the first and the others are copies.
    Other columns are ignored; an empty table gives no rows. Very long texts are searched a
    megabyte at a time. Equal segments are told by digests of 96 bits within an owner: at 10^14 bytes the chance of a
    single false match is below 10^-9. Shared and sorted segments are compared by their bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("tie"))
    texts = materialise(rows.mapInArrow(_batches(batch_bytes), BATCHES), "repeat_texts")
    size = texts.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(least, -(-size * 2 // ((width - ANCHOR) * OWNER_SEGMENTS)))
    asked = texts.mapInArrow(_ask(width, owners), SENT)
    answers = materialise(asked.groupBy("owner").applyInArrow(_judge(hot), "batch string, owner int, told binary, shared long, hot long"), "repeat_answers")
    shared, many = answers.agg(F.coalesce(F.sum("shared"), F.lit(0)), F.coalesce(F.sum("hot"), F.lit(0))).first()
    shards, singles = max(least, -(-shared // SHARD_SEGMENTS)), max(least, -(-many * (width - ANCHOR) // (2 * OWNER_SEGMENTS)))
    told = answers.groupBy("batch").agg(F.collect_list(F.struct("owner", "told")).alias("answers"))
    sent = materialise(texts.join(told, "batch").mapInArrow(_send(width, owners, shards, singles), SENT), "repeat_sent")
    marks = sent.where("kind = 0")
    for kind, found in ((1, _factors(width)), (2, _single(width))):
        marks = marks.union(sent.where(f"kind = {kind}").groupBy("owner").applyInArrow(found, SENT))
    marks = marks.where("n > 0").groupBy("batch").agg(F.collect_list("data").alias("marks"))
    return texts.join(marks, "batch", "left").select("ids", "lengths", "body", "marks").mapInArrow(_cut, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def repeat_digests(cut: DataFrame) -> DataFrame:
    """Sizes of what was removed and the sha256 (lowercase hex) of what was kept."""
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, n, spot, substr(h, 2 * spot + 1, {2 * (256 + WIDTH)}) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n, 256)) AS spot FROM d)),
w AS (SELECT doc_id, spot + i AS i, substr(h, 2 * i + 1, {2 * WIDTH}) AS s FROM (SELECT *, unnest(range(least(256, n - spot - {WIDTH} + 1))) AS i FROM k)),
f AS (SELECT s, min(doc_id::HUGEINT * 4294967296 + i) AS first FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id::HUGEINT * 4294967296 + i > first),
b AS (SELECT doc_id, spot + i AS i, substr(h, 2 * i + 1, 2) AS byte FROM (SELECT *, unnest(range(least(256, n - spot))) AS i FROM k)),
c AS (SELECT b.doc_id, b.i, byte, coalesce(b.i - max(m.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) < {WIDTH}, false) AS gone FROM b LEFT JOIN m ON m.doc_id = b.doc_id AND m.i = b.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
g AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""

"""SentencePiece encoding with seeded merge-dropout, and decoding.

Text is encoded by merging neighbouring pieces, best score first, from an
agenda of candidate merges. A candidate that comes up is skipped when a keyed
hash of it falls under the dropout rate. The key holds the seed, the document
and the place of the word in the text, so every occurrence of a word has its own
draws; every segmentation decodes to the text.

All words of a slice that are about as long are one array, a column each: a step
takes the best candidate of every word, draws, and merges or skips. Nothing is
kept from word to word, so neither the number of different words nor how often
they are skipped matters. Only words beyond 64 characters run one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
CACHE = 1 << 16  # characters of words that are merged at once, so that their state stays in a processor's cache
LENGTH = 24  # characters up to which a word is not cut
WIDTHS = np.array([*range(1, 17), 20, 24, 32, 48, 64])  # rows of the arrays that words are laid out in
SPACE = "▁"  # fixed value: how a vocabulary writes a space
SLICE_BYTES = 1 << 20

# Merges never cross these: no piece holds a line end, or a space mark after another character.
_PARTS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model by text, what merges into them, and the ids of its byte pieces."""

    ids: dict[str, int]
    merges: dict[str, tuple[float, int, str]]  # a cost that rises as the score falls, a hash of the piece, the piece
    bytes_: list[int]
    raw: list[bytes]  # what each id decodes to; a space mark is a space
    joins: set[str]  # neighbouring characters inside pieces

    @cached_property
    def tables(self) -> _Tables:
        """Arrays of the vocabulary, built once in a process."""
        return _Tables(self)

    def cut(self, part: str) -> list[str]:
        """``part`` cut between characters that stand side by side in no piece, so no merge can cross."""
        joins, at = self.joins, 0
        out = []
        for i in range(1, len(part)):
            if part[i - 1:i + 1] not in joins:
                out.append(part[at:i])
                at = i
        out.append(part[at:])
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a model with byte fallback; its size is fixed by the model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, merges, fallback, raw = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                fallback[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                ids[piece], merges[piece] = i, (-model.get_score(i), crc32(piece.encode()), piece)
                raw.append(piece.replace(SPACE, " ").encode())
        return cls(ids, merges, fallback, raw, {p[i:i + 2] for p in ids for i in range(len(p) - 1)})


_MASK = (1 << 32) - 1
_MASK64 = (1 << 64) - 1


def _mark(merged: int, cut: int, place: int) -> int:
    """What a candidate merge brings to its draw: the hash of the merged piece, where its two sides meet, and its place in the word."""
    return (merged ^ (cut * 0x9E3779B1 + place * 0x85EBCA6B)) & _MASK


def draw(key: int, merged: int, cut: int, place: int) -> int:
    """A keyed 32-bit hash of a candidate merge."""
    h = ((_mark(merged, cut, place) ^ key) * 0x2C1B3C6D) & _MASK
    h = ((h ^ (h >> 15)) * 0x297A2D39) & _MASK
    return h ^ (h >> 16)


def _draws(marked: np.ndarray) -> np.ndarray:
    """``draw`` of many, from their marks xor their keys."""
    h = marked * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x297A2D39)
    return h ^ (h >> np.uint32(16))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _agenda(part: str, vocabulary: Vocabulary, key: int, limit: int) -> list[str]:
    """The pieces of one word, each where its first character stands, and empty text where the others do.

    The agenda holds candidate merges by falling score and place. Skipped are those whose draw under ``key``
    falls below ``limit``; a skipped candidate is gone, the same two places come up again only after one of them grew.
    """
    merge_of = vocabulary.merges.get
    text, n = list(part), len(part)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        merge = merge_of(part[i:i + 2])
        if merge:
            agenda.append((merge[0], i, i + 1, merge))
    heapify(agenda)
    while agenda:
        _, i, j, (_, merged, both) = heappop(agenda)
        cut = len(text[i])
        if after[i] != j or not cut or cut + len(text[j]) != len(both):
            continue  # one side has merged with another neighbour since
        if draw(key, merged, cut, i) < limit:
            continue
        text[i], text[j] = both, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            merge = merge_of(both + text[k])
            if merge:
                heappush(agenda, (merge[0], i, k, merge))
        p = before[i]
        if p >= 0:
            merge = merge_of(text[p] + both)
            if merge:
                heappush(agenda, (merge[0], p, i, merge))
    return text


def encode_part(part: str, vocabulary: Vocabulary, key: int, dropout: float) -> list[int]:
    """Piece ids of one part of a text, each candidate skipped when its draw under ``key`` falls below ``dropout``."""
    out = []
    for t in _agenda(part, vocabulary, key, int(dropout * (_MASK + 1))):
        if t in vocabulary.ids:
            out.append(vocabulary.ids[t])
        elif t:
            out += [vocabulary.bytes_[b] for b in t.encode("utf-8", "surrogatepass")]
    return out


class _Pairs:
    """Values of pairs of small numbers, looked up many at a time by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(4 * len(values)).bit_length()))
        size = 1 << (64 - int(self.bits))
        self.pairs, self.values, self.last = np.full(size, -1, np.int64), np.full(size, -1, np.int32), size - 1
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slots(pairs)
        while len(pairs):
            free = np.flatnonzero(self.pairs[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.pairs[slots], self.values[slots] = pairs[free[first]], values[free[first]]
            rest = np.ones(len(pairs), bool)
            rest[free[first]] = False
            pairs, values, at = pairs[rest], values[rest], (at[rest] + 1) & self.last

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        mixed = (pairs ^ pairs >> 15).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.bits).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, -1 where it has none."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slots(pairs)
        held = self.pairs[at]
        out = np.where(held == pairs, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != pairs) & (held >= 0))
        while len(todo):
            at = (at if len(at) == len(todo) else at[todo]) + 1 & self.last
            held, mine = self.pairs[at], pairs[todo]
            hit = held == mine
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (held >= 0)
            todo, at = todo[more], at[more]
        return out


class _Tables:
    """What a vocabulary says of its symbols: its pieces and the characters in them, by number."""

    def __init__(self, vocabulary: Vocabulary):
        symbols = [*vocabulary.ids, *sorted({c for p in vocabulary.ids for c in p} - set(vocabulary.ids))]
        self.number = number = {s: i for i, s in enumerate(symbols)}
        self.other = len(symbols)  # a character of no piece, or a space mark that stands in the text
        merges = [vocabulary.merges[s] for s in vocabulary.ids]
        self.rank = np.unique([m[0] for m in merges], return_inverse=True)[1].astype(np.int32)
        self.hash = np.array([m[1] for m in merges], np.uint32)
        self.length = np.array([*map(len, symbols), 1], np.uint32)
        self.piece = np.array([*vocabulary.ids.values(), *[-1] * (self.other + 1 - len(merges))], np.int32)
        self.bytes_ = np.array(vocabulary.bytes_, np.int32)
        self.symbol = np.full(0x110000, self.other, np.int32)  # by code point
        for s, i in number.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        splits = [(number[s[:i]], number[s[i:]], number[s]) for s in vocabulary.ids for i in range(1, len(s)) if s[:i] in number and s[i:] in number]
        self.merged = _Pairs(*np.array(splits, np.int32).reshape(-1, 3).T)
        joins = np.array([(number[j[0]], number[j[1]], 1) for j in vocabulary.joins], np.int32)
        self.joined = _Pairs(*joins.reshape(-1, 3).T)


class Encoder:
    """Encodes texts with one vocabulary, seed and dropout.

    variants: documents' keys are taken modulo this, if given.
    """

    def __init__(self, vocabulary: Vocabulary, seed: int, dropout: float, variants: int | None = None):
        self.vocabulary, self.dropout, self.variants = vocabulary, dropout, variants
        self.seed = (crc32(str(seed).encode()) * 0x9E3779B97F4A7C15 + 1) & _MASK64
        self.tables = vocabulary.tables

    def __call__(self, text: str, variant: int) -> np.ndarray:
        return self.many_texts([text], [variant])[0]

    def keys(self, variant: np.ndarray, place: np.ndarray) -> np.ndarray:
        """32-bit keys of words from the keys of their documents and their places in the text."""
        own = _mix(np.uint64(self.seed) ^ _mix(variant.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        return (_mix(own + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)

    def parts(self, text: str) -> list[str]:
        """The parts of a text; an empty one is a space mark that stands in the text."""
        if not text:
            return []
        if SPACE not in text:
            return _PARTS.findall(SPACE + text.replace(" ", SPACE))
        out = []
        for k, part in enumerate(text.split(SPACE)):
            out += ([""] if k else []) + _PARTS.findall(("" if k else SPACE) + part.replace(" ", SPACE))
        return out

    def words(self, code: np.ndarray, symbol: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the words of texts begin: their ``parts``, cut where no merge can cross unless short and of letters at the end."""
        alone, space = (code == 10) | (code == ord(SPACE)), code == 32
        start = alone | space
        start[1:] &= alone[1:] | ~space[:-1]
        start[1:] |= alone[:-1]
        start[bounds[:-1][np.diff(bounds) > 0]] = True
        first = np.flatnonzero(start)
        size = np.diff(first, append=len(code))
        whole = (size <= LENGTH) & self.tables.alnum[code[first + size - 1]]
        inner = np.flatnonzero(~np.repeat(whole, size) & ~start)
        start[inner[self.tables.joined(symbol[inner - 1], symbol[inner]) < 0]] = True
        return np.flatnonzero(start)

    def many_texts(self, texts: list[str], variants: list[int]) -> list[np.ndarray]:
        """Piece ids of each text, which gets one space put before it."""
        bounds = np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)))
        if not bounds[-1]:
            return [np.zeros(0, np.int32) for _ in texts]
        code = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.tables.symbol[code]
        symbol[code == 32], symbol[code == ord(SPACE)] = self.tables.symbol[ord(SPACE)], self.tables.other
        first = self.words(code, symbol, bounds)
        size = np.diff(first, append=len(code))
        ends = np.searchsorted(first, bounds)
        variant = np.array(variants, np.int64) % self.variants if self.variants else np.array(variants, np.int64)
        key = self.keys(np.repeat(variant, np.diff(ends)), np.arange(len(first)) - np.repeat(ends[:-1], np.diff(ends)))
        width = np.searchsorted(WIDTHS, size)
        order = np.argsort(width, kind="stable")
        each = np.bincount(width, minlength=len(WIDTHS) + 1)
        at = np.cumsum(each) - each
        for w, rows in enumerate(WIDTHS.tolist()):
            if rows > 1:
                step = max(1, CACHE // rows)
                for a in range(at[w], at[w] + each[w], step):
                    some = order[a:min(a + step, at[w] + each[w])]
                    self._lay_out(symbol, first[some], size[some], key[some], rows)
        for u in order[at[-1]:].tolist():
            a, b = first[u], first[u] + size[u]
            word = "".join(map(chr, code[a:b].tolist())).replace(" ", SPACE)
            symbol[a:b] = [self.tables.number.get(t, self.tables.other) if t else -1 for t in _agenda(word, self.vocabulary, int(key[u]), int(self.dropout * (_MASK + 1)))]
        stands = np.flatnonzero(symbol >= 0)
        ids = self.tables.piece[symbol[stands]]
        # What is no piece is a single character, spelled in bytes.
        spelled = np.flatnonzero(ids < 0)
        codes = code[stands[spelled]]
        codes[codes == 32] = ord(SPACE)
        many = np.ones(len(ids), np.int64)
        many[spelled] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        flat = np.repeat(ids, many)
        flat[flat < 0] = self.tables.bytes_[np.frombuffer(codes.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        cuts = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(stands, bounds)]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _lay_out(self, symbol: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, rows: int) -> None:
        """Merges words of at most ``rows`` characters, in place; -1 where a character has gone into a piece before it."""
        row = np.arange(rows)[:, None]
        places, inside = first + row, row < size
        columns = symbol[np.minimum(places, len(symbol) - 1)]
        columns[~inside] = self.tables.other
        done = self._merge(columns, key)
        symbol[places[inside]] = done[inside]

    def _merge(self, columns: np.ndarray, key: np.ndarray) -> np.ndarray:
        """``_agenda`` of many words at once, a column each: a step takes the best candidate of every word."""
        (rows, n), none, limit = columns.shape, np.iinfo(np.int32).max, int(self.dropout * (_MASK + 1))
        # The last row stands for what lies before and after a word.
        text = np.concatenate((columns, np.full((1, n), self.tables.other, np.int32)))
        after = np.repeat(np.arange(1, rows + 2, dtype=np.int8)[:, None], n, 1)
        before = np.repeat(np.array([rows, *range(rows)], np.int8)[:, None], n, 1)
        both = np.full((rows + 1, n), -1, np.int32)
        both[:rows - 1] = self.tables.merged(text[:rows - 1].ravel(), text[1:rows].ravel()).reshape(rows - 1, n)
        # A candidate's order: its score, then its place.
        order = np.where(both >= 0, self.tables.rank[both] << 6 | np.arange(rows + 1, dtype=np.int32)[:, None], none)
        out, column = columns, np.arange(n)
        while True:
            best = order[:rows - 1].min(axis=0)
            live = np.flatnonzero(best != none)
            if len(live) * 2 < n:
                out[:, column] = text[:rows]
                if not len(live):
                    return out
                column, key, best, n = column[live], key[live], best[live], len(live)
                text, after, before, both, order = (x.take(live, axis=1) for x in (text, after, before, both, order))
                live = np.arange(n)
            place = best[live] & 63
            i = place.astype(np.int64) * n + live
            j = after.ravel()[i].astype(np.int64) * n + live
            new = both.ravel()[i]
            # _mark, of many
            mark = self.tables.hash[new] ^ (self.tables.length[text.ravel()[i]] * np.uint32(0x9E3779B1) + place.astype(np.uint32) * np.uint32(0x85EBCA6B))
            order.ravel()[i] = none
            if limit:
                kept = np.flatnonzero(_draws(mark ^ key[live]).astype(np.int64) >= limit)
                i, j, live, place, new = i[kept], j[kept], live[kept], place[kept], new[kept]
            text.ravel()[i], text.ravel()[j], order.ravel()[j] = new, -1, none
            next_, last = after.ravel()[j], before.ravel()[i].astype(np.int32)
            after.ravel()[i] = next_
            k, p = next_.astype(np.int64) * n + live, last.astype(np.int64) * n + live
            before.ravel()[k] = place
            for at, left, right, where in ((i, new, text.ravel()[k], place), (p, text.ravel()[p], new, last)):
                found = self.tables.merged(left, right)
                both.ravel()[at] = found
                order.ravel()[at] = np.where(found >= 0, self.tables.rank[found] << 6 | where, none)


def decode(ids, vocabulary: Vocabulary) -> bytes:
    """UTF-8 of a text from its piece ids: the one space put before the text is taken off."""
    raw = vocabulary.raw
    joined = b"".join([raw[i] for i in ids])
    return joined[1:] if joined[:1] == b" " else joined


_kept: dict[tuple, Encoder] = {}


def _encoder(vocabulary: Vocabulary, seed: int, dropout: float, variants: int | None) -> Encoder:
    """The encoder of this process, whose tables later tasks find again; another setting replaces it."""
    key = (seed, dropout, variants)
    if key not in _kept or _kept[key].vocabulary.ids != vocabulary.ids:
        _kept.clear()
        _kept[key] = Encoder(vocabulary, seed, dropout, variants)
    return _kept[key]


def _encode(shared, seed: int, dropout: float, variants: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        encoder = _encoder(vocabulary, seed, dropout, variants)
        for batch in batches:
            step = max(1, len(batch) * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                names, texts = part.schema.names, part.column(part.num_columns - 2).to_pylist()
                which = part.column(part.num_columns - 1).to_pylist()
                coded = encoder.many_texts(texts, which)
                lossless = [decode(c.tolist(), vocabulary) == t.encode("utf-8", "surrogatepass") for c, t in zip(coded, texts)]
                bounds = np.concatenate(([0], np.cumsum([len(c) for c in coded]))).astype(np.int32)
                flat = pa.array((np.concatenate(coded) if coded else np.zeros(0)).astype(np.int32))
                keep = range(len(names) - 2)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.ListArray.from_arrays(pa.array(bounds), flat), pa.array(np.diff(bounds), pa.int32()), pa.array(lossless)],
                                                 names=[*[names[i] for i in keep], "pieces", "n_pieces", "lossless"])

    return run


def encode(docs: DataFrame, path: str = MODEL, seed: int = 0, dropout: float = DROPOUT, variants: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id by default) of every row of ``docs`` with pieces array<int>, n_pieces int, lossless boolean.

    The column text is encoded whole. Each candidate merge is skipped with
    probability ``dropout`` by a hash of seed, doc_id, the place of the word in the text,
    the two pieces and their place in the word.
    variants: if given, documents share this many keys, chosen by their doc_id.
    With dropout 0 the pieces are those of the plain merge encoding.
    lossless: decoding the pieces gave the text back, byte for byte.

    A null or empty text has no pieces and is lossless. Characters outside the
    vocabulary, line ends, and space marks that stand in the text itself are spelled in byte
    pieces. Repeated rows get equal pieces; a null doc_id has a key like any other.
    Columns of ``keep`` may have any names but pieces, n_pieces and lossless, which
    replace columns of ``docs`` so named. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("pieces", "n_pieces", "lossless")]
    variant = F.xxhash64(F.col("doc_id").cast("string"))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"), variant.alias("_variant"))
    out = T.StructType([*[rows.schema[c] for c in keep], T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("lossless", T.BooleanType())])
    return rows.mapInArrow(_encode(shared, seed, dropout, variants), out)


def decode_texts(coded: DataFrame, path: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id by default) and the text of each row's pieces; null pieces give an empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    keep = ["doc_id"] if keep is None else keep
    out = T.StructType([*[coded.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            texts = [decode(x or [], vocabulary).decode("utf-8", "replace") for x in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return coded.select(*[F.col(f"`{c}`") for c in keep], "pieces").mapInArrow(run, out)

"""Words, n-grams and sorted hash lists of Arrow text columns as numpy arrays.

Everything here works on one Arrow batch inside a task (Spark bounds a batch
by rows and bytes); texts are read in slices of a few megabytes, so memory
follows the slice, not the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20260101)
_CODES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_CODES[ord("A"):ord("Z") + 1] = _CODES[ord("a"):ord("z") + 1]  # ASCII case is folded in the hash
_STEP = np.uint64(pow(5, 27, 2**64))
_UNSTEP = np.uint64(pow(pow(5, 27, 2**64), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], size: int = 2 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows into parts of about ``size`` bytes."""
    for batch in batches:
        step = max(1, len(batch) * size // max(size, batch.nbytes))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def slices(data: np.ndarray, offsets: np.ndarray, step: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of about ``step`` bytes that cut between texts or at white space."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + step, n)
        if end < n:
            limit = int(offsets[np.searchsorted(offsets, end)])
            while end < limit:
                hit = np.flatnonzero(SPACE[data[end:min(end + 65536, limit)]])
                if len(hit):
                    end += int(hit[0])
                    break
                end = min(end + 65536, limit)
        yield start, end
        start = end


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 65537), base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.multiply.accumulate(have)
    return have


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (maximal run of non-space bytes, A-Z folded) and the number of its text."""
    hashes, owners = [], []
    for start, end in slices(data, offsets):
        part = data[start:end]
        solid = ~SPACE[part]
        edge = np.zeros(len(part) + 1, bool)  # a text begins here
        edge[offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, end, "right")] - start] = True
        before = np.concatenate(([False], solid[:-1]))
        after = np.concatenate((solid[1:], [False]))
        first = np.flatnonzero(solid & (~before | edge[:-1]))
        last = np.flatnonzero(solid & (~after | edge[1:])) + 1
        if not len(first):
            continue
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[part] * _power("up", _STEP, len(part))[:len(part)])))
        h = (total[last] - total[first]) * _power("down", _UNSTEP, len(part) + 1)[first]
        hashes.append(mixed(h + (last - first).astype(np.uint64) * ODD))
        owners.append((np.searchsorted(offsets, first + start, "right") - 1).astype(np.int32))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(hashes), np.concatenate(owners)


class Rolling:
    """Hashes of any substrings of ``data`` from one running sum; ``codes`` holds an odd number per byte value."""

    def __init__(self, data: np.ndarray, codes: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * _power("up", _STEP, len(data) + 1)[:len(data)], out=self.total[1:])
        self.down = _power("down", _UNSTEP, len(data) + 1)

    def hashes(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Of the substrings at ``starts``; equal substrings have equal hashes wherever they stand."""
        return mixed((self.total[starts + lengths] - self.total[starts]) * self.down[starts] + np.atleast_1d(lengths).astype(np.uint64) * ODD)

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length at every place."""
        return mixed((self.total[length:] - self.total[:-length]) * self.down[:len(self.total) - length] + np.full(1, length, np.uint64) * ODD)


def bounds_of(owners: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of ``n`` texts begin and end."""
    return np.searchsorted(owners, np.arange(n + 1))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams.

    A text with fewer words than ``width`` has one shingle, its whole word
    sequence; a text without words has none.
    """
    hashes, owners = word_hashes(data, offsets)
    at = bounds_of(owners, len(offsets) - 1)
    for a, b in zip(at[:-1], at[1:]):
        words, n = hashes[a:b], min(width, int(b - a))
        if n == 0:
            yield words
            continue
        m = len(words) - n + 1
        value = np.full(m, n, np.uint64)
        for j in range(n):
            value = value * _STEP + words[j:j + m]
        yield np.unique(mixed(value))


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeezed(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed, behind their number."""
    return np.int64(values.nbytes).tobytes() + _ZSTD.compress(values.tobytes(), asbytes=True)


def unsqueezed(raw: bytes, kind) -> np.ndarray:
    """The array that ``squeezed`` packed."""
    return np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=int(np.frombuffer(raw, np.int64, 1)[0]), asbytes=True), kind)


def golomb(values: np.ndarray) -> bytes:
    """Golomb-Rice code of a sorted list of 64-bit values.

    Layout: count, first value and parameter k, the quotients of the gaps in
    unary, then the k low bits of each gap (whole bytes first).
    """
    n = len(values)
    if n == 0:
        return b""
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / max(1, n - 1)
    k = max(0, int(np.log2(max(mean, 1.0) * 0.69)) if mean * 0.69 >= 1 else 0)
    head = np.array([n, values[0], k], np.uint64).tobytes()
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n - 1, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    whole, rest = divmod(k, 8)
    low = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)
    odd = b""
    if rest:
        top = (gaps >> np.uint64(8 * whole)).astype(np.uint64) & np.uint64((1 << rest) - 1)
        odd = np.packbits(((top[:, None] >> np.arange(rest, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes()
    packed = np.packbits(unary).tobytes()
    return head + np.array([len(unary)], np.uint64).tobytes() + packed + low[:, :whole].tobytes() + odd


def ungolomb(code: bytes) -> np.ndarray:
    """The sorted list that ``golomb`` coded."""
    if not code:
        return np.zeros(0, np.uint64)
    n, first, k, bits = (int(x) for x in np.frombuffer(code, np.uint64, 4))
    at, m, (whole, rest) = 32, n - 1, divmod(k, 8)
    size = (bits + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, at), count=bits))
    gaps = np.diff(ones, prepend=-1).astype(np.uint64) - np.uint64(1)
    gaps <<= np.uint64(k)
    at += size
    low = np.zeros((m, 8), np.uint8)
    low[:, :whole] = np.frombuffer(code, np.uint8, m * whole, at).reshape(m, whole)
    gaps |= low.view(np.uint64).ravel()
    if rest:
        at += m * whole
        bit = np.unpackbits(np.frombuffer(code, np.uint8, len(code) - at, at), count=m * rest).reshape(m, rest).astype(np.uint64)
        gaps |= (bit << np.arange(rest, dtype=np.uint64)).sum(1, dtype=np.uint64) << np.uint64(8 * whole)
    return np.cumsum(np.concatenate((np.array([first], np.uint64), gaps)), dtype=np.uint64)

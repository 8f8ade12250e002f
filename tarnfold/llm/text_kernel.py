"""Vectorised word scanning over the UTF-8 bytes of Arrow string columns.

Every operator that looks at words shares one definition:

* a word is a maximal run of ASCII letters and digits and of non-ASCII characters,
  where the Latin-1 signs U+0080-U+00BF, general punctuation U+2000-U+206F and the
  ideographic signs U+3000-U+303F separate words;
* upper-case ASCII and Latin-1 letters are folded to lower case, byte for byte, so
  byte offsets always refer to the text as it is.

:data:`WORD_SQL` is the same definition as an RE2 pattern for the SQL oracles.
Null texts have no words. Work happens in slices of whole documents of about
:data:`SLICE_BYTES` and at most :data:`SLICE_ROWS` rows; a longer document makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SLICE_ROWS = 8192

WORD_SQL = r"[0-9A-Za-z\x{c0}-\x{1fff}\x{2070}-\x{2fff}\x{3040}-\x{10ffff}]+"

#: glibc's malloc_trim, where there is one
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_P_INV = _U(pow(int(_P), -1, 1 << 64))
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, SLICE_BYTES + (SLICE_BYTES >> 2)), base, dtype=np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if n <= SLICE_BYTES * 2:
            _powers[name] = held
    return held[:n]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal content gives equal hashes anywhere."""
    n = len(values)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.multiply(values, _power("up", _P, n), out=total[1:])
    np.cumsum(total, out=total)
    h = total[ends] - total[starts]
    h *= _power("down", _P_INV, n)[starts]
    return mix64(h)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset at which each value begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches, between rows, into pieces of about limit bytes of text and at most `rows` rows; small ones are put together."""
    release()
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64)).astype(np.int64)
        ends = np.cumsum(lengths)
        at, base = 0, 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, base + limit - size, "right"))
            if to == at and held:
                yield join_batches(held)
                held, size, count = [], 0, 0
                continue
            to = min(max(to, at + 1), at + rows - count)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - base)
            count += to - at
            base, at = int(ends[to - 1]), to
            if size >= limit or count >= rows or at < batch.num_rows:
                yield join_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield join_batches(held)
    del held
    release()


def release() -> None:
    """Give memory that is free back to the system: workers are used again by later stages, and would hold on to the most they ever needed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def join_batches(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case, byte for byte: ASCII and the Latin-1 letters."""
    out = _FOLD[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        tail = raw[lead + 1]
        up = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1
        out[up] += 32
    return out


class Words:
    """Words of a slice: start and end byte, hash, document; first[d]:first[d + 1] are those of document d."""

    def __init__(self, column: pa.Array, hashes: bool = True):
        self.raw, self.offsets = buffers(column)
        raw, offsets = self.raw, self.offsets
        inside = np.zeros(len(raw) + 2, dtype=bool)
        mid = inside[1:-1]
        mid[:] = _WORD[raw]
        if len(raw):
            c2 = np.flatnonzero(raw == 0xC2)
            if len(c2):
                mid[c2] = False
                mid[c2 + 1] = False
            for lead, low, high in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
                at = np.flatnonzero(raw[:-2] == lead) if len(raw) > 2 else np.zeros(0, np.int64)
                if len(at):
                    second = raw[at + 1]
                    third = raw[at + 2]
                    hit = (second >= low) & (second <= high)
                    if lead == 0xE2:
                        hit &= (second == 0x80) | (third <= 0xAF)
                    else:
                        hit &= third <= 0xBF
                    at = at[hit]
                    mid[at] = mid[at + 1] = mid[at + 2] = False
        change = inside[1:] != inside[:-1]
        edges = np.flatnonzero(change)
        starts, ends = edges[0::2], edges[1::2]
        # a document's first byte begins a word even when the one before it, in another document, is inside one
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        if len(cuts):
            cuts = np.unique(cuts)
            cuts = cuts[mid[cuts] & mid[cuts - 1]]
            if len(cuts):
                starts = np.sort(np.concatenate([starts, cuts]))
                ends = np.sort(np.concatenate([ends, cuts]))
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)
        self.folded = fold(raw) if hashes else raw
        self.hash = span_hash(_LETTER[self.folded], starts, ends) if hashes else None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, i: int) -> str:
        return self.folded[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word n-grams, and first as of words. A document of 1 to n - 1 words has one gram: all of them."""
        h, first, counts = self.hash, self.first, self.counts
        if not len(h):
            return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
        per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        to = np.concatenate([[0], np.cumsum(per)])
        acc = np.zeros(len(h), dtype=np.uint64)
        for j in range(n):
            k = _U(2 * int(mix64(np.array([j + 1], np.uint64))[0] >> _U(2)) + 1)
            if j < len(h):
                acc[: len(h) - j] += h[j:] * k
        keep = np.arange(to[-1]) - np.repeat(to[:-1] - first[:-1], per)
        out = acc[keep]
        for d in np.flatnonzero((counts > 0) & (counts < n)):
            value = _U(counts[d])
            for x in h[first[d] : first[d + 1]]:
                with np.errstate(over="ignore"):
                    value = (value * _U(0x100000001B3)) ^ x
            out[to[d]] = value
        return mix64(out), to


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of words given one by one, equal to those in a text."""
    if not words:
        return np.zeros(0, np.uint64)
    raw, offsets = buffers(pa.array(words, pa.string()))
    return span_hash(_LETTER[fold(raw)], offsets[:-1], offsets[1:])


def signatures(grams: np.ndarray, first: np.ndarray, size: int, seed: int) -> np.ndarray:
    """MinHash of each document's grams: (documents, size) uint32; all ones for a document without any."""
    n = len(first) - 1
    out = np.full((n, size), 0xFFFFFFFF, dtype=np.uint32)
    have = np.flatnonzero(np.diff(first) > 0)
    if not len(have):
        return out
    at = first[have]
    multipliers = np.random.default_rng(seed).integers(0, 1 << 63, size, dtype=np.uint64) * _U(2) + _U(1)
    step = 1 << 17
    # blocks of whole documents that stay in the processor's cache
    block = np.zeros(min(len(grams), step), np.uint64)
    i = 0
    while i < len(have):
        j = int(np.searchsorted(at, at[i] + step, "right"))
        j = max(i + 1, j - 1) if j < len(have) else len(have)
        end = first[have[j - 1] + 1]
        while j > i + 1 and end - at[i] > step:
            j -= 1
            end = first[have[j - 1] + 1]
        part = grams[at[i] : end]
        if len(block) < len(part):
            block = np.zeros(len(part), np.uint64)
        room = block[: len(part)]
        rel = at[i:j] - at[i]
        for k in range(size):
            np.multiply(part, multipliers[k], out=room)
            out[have[i:j], k] = (np.minimum.reduceat(room, rel) >> _U(32)).astype(np.uint32)
        i = j
    return out

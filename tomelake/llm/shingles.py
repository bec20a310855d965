"""Words and word shingles as 64-bit hashes, computed over Arrow string buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About so many bytes of text are taken at once (a longer text is taken alone).
SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD ** i and _ODD ** -i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads each input bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each text in bytes and the end) for runs of texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def run_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs raw[first[i] : last[i] + 1], A-Z as a-z."""
    power, inverse = _power(len(raw))
    sums = _BYTE[raw]
    sums *= power
    np.cumsum(sums, out=sums)
    h = sums[last]
    h[first > 0] -= sums[first[first > 0] - 1]
    h *= inverse[first]
    return mixed(h)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts raw[at[i]:at[i + 1]]: hash of each word, number of words of each text, and first and last byte of each word."""
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), np.zeros(len(at) - 1, dtype=np.int64), none, none
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    h = run_hashes(raw, first, last)
    counts = np.diff(np.searchsorted(first, at))
    return h, counts, first, last


def shingle_hashes(word_hashes: np.ndarray, counts: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of `width` words; a text with fewer words has its whole sequence as one, without words none."""
    n = len(word_hashes)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j in range(width if n >= width else 0):
        rolled ^= word_hashes[j : n - width + 1 + j]
        rolled *= _ODD
        rolled ^= rolled >> np.uint64(29)
    at = 0
    for count in counts:
        if count >= width:
            own = np.sort(rolled[at : at + count - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif count:
            h = np.array([count], dtype=np.uint64)
            for x in word_hashes[at : at + count]:
                h = mixed((h ^ x) * _ODD)
            yield h
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += count

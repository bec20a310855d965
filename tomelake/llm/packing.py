"""Packing along a space-filling curve.

Each text's words are hashed into a vector of FEATURES signed counts, which a fixed random matrix projects to DIMS
dimensions; each is cut into 2**BITS steps of about equal share, and the cell's place on a Hilbert curve is the document's
key. Documents are range-sorted by (key, doc_id) and their token ids laid end to end along the curve, so neighbours in a
sequence are alike. Sequences of LENGTH ids are full; the last ids of a range are cut into sequences whose lengths are
powers of two, so nothing is padded.

Edge cases: a null or empty text is one piece with only the end id; repeated rows, and rows without a doc_id, are packed each; a text longer than a
sequence is cut; equal texts (one key) are ordered by doc_id and may fill several ranges; an empty table gives no piece;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import tokens
from .common import shuffle_partitions, table
from .shingles import slices, words

LENGTH = 2048
#: About so many documents are sampled for the bounds of the ranges, and so many for each range where there are more ranges.
SAMPLE_ROWS, SAMPLE_OF_RANGE = 20_000, 100
FEATURES, DIMS, BITS = 512, 4, 8
_PROJECTION = np.random.Generator(np.random.PCG64(5)).standard_normal((FEATURES, DIMS)).astype(np.float32)


def vectors(word_hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A unit vector of signed hashed word counts for each text (zero without words)."""
    rows = np.repeat(np.arange(len(counts)), counts)
    cell = (word_hashes >> np.uint64(8)).astype(np.int64) % FEATURES
    sign = 1.0 - 2.0 * (word_hashes & np.uint64(1)).astype(np.float64)
    out = np.bincount(rows * FEATURES + cell, weights=sign, minlength=len(counts) * FEATURES).reshape(len(counts), FEATURES)
    out = np.sign(out) * np.sqrt(np.abs(out))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def cells(vectors_: np.ndarray) -> np.ndarray:
    """Integer coordinates: the projections are about standard normal, so the logistic curve cuts them into steps of like share."""
    u = vectors_ @ _PROJECTION
    return np.minimum((1 / (1 + np.exp(-1.702 * u)) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of the rows of x (n, dims), by reflecting and exchanging axes from the top bit down, then a Gray decode."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with a column text, and the keys of their texts."""
    for first, end, raw, at in slices(batch.column("text")):
        h, counts, _, _ = words(raw, at)
        yield batch.slice(first, end - first), hilbert_keys(cells(vectors(h, counts)))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, key in curve_keys(batch):
            yield pa.RecordBatch.from_arrays([pa.array(key), part.column("doc_id")], ["curve", "doc_id"])


def along_curve(docs: DataFrame) -> DataFrame:
    """doc_id, curve, text in ranges of (curve, doc_id), sorted. A bounded sample sets the bounds, which decide only how evenly ranges are filled."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    docs = docs.select("doc_id", "text")
    share = min(1.0, max(SAMPLE_ROWS, SAMPLE_OF_RANGE * n) / max(1, docs.count()))
    sample = docs.sample(fraction=share, seed=5) if share < 1 else docs
    rows = sorted((r["curve"], -(1 << 63) if r["doc_id"] is None else r["doc_id"]) for r in sample.mapInArrow(_sampled, "curve long, doc_id long").collect())
    bounds = np.array([rows[len(rows) * i // n] for i in range(1, n)] if rows else [], dtype=[("curve", np.int64), ("doc_id", np.int64)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, key in curve_keys(batch):
                pairs = np.empty(len(key), dtype=bounds.dtype)
                pairs["curve"], pairs["doc_id"] = key, pc.fill_null(part.column("doc_id"), -(1 << 63)).to_numpy(zero_copy_only=False)
                place = np.searchsorted(bounds, pairs, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(key), part.column("text"), pa.array(place)], ["doc_id", "curve", "text", "place"])

    keyed = docs.mapInArrow(placed, "doc_id long, curve long, text string, place int")
    return keyed.repartitionById(n, "place").sortWithinPartitions("curve", "doc_id")


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


class _Packer:
    """Lays documents end to end; rows are the pieces of finished sequences."""

    def __init__(self, sequence_id: int, length: int):
        self.next_id, self.length = sequence_id, length
        self.open: list[tuple[int, int, bytes, int]] = []
        self.filled = 0
        self.rows: list[tuple] = []

    def _close(self, pieces) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(self.length - self.filled, total - at)
            self.open.append((doc, at, ids[4 * at : 4 * (at + n)], total))
            self.filled += n
            at += n
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def finish(self) -> None:
        """What is left becomes sequences whose lengths are powers of two."""
        left, pieces = self.filled, self.open
        while left:
            size = 1 << (left.bit_length() - 1)
            own, need = [], size
            while need:
                doc, start, ids, total = pieces.pop(0)
                n = min(need, len(ids) // 4)
                own.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n :], total))
                need -= n
            self._close(own)
            left -= size
        self.open, self.filled = [], 0

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], _NAMES)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> one row per piece; sequence_id is the number of the range times 2**32 plus the place in it."""
    path = vocabulary or tokens.default_path()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(TaskContext.get().partitionId() << 32, length)
        end = tokens.END_ID.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, coded in tokens.encoded(path, batch.column("text")):
                for doc, found in zip(ids[first:], coded, strict=False):
                    packer.add(doc, found + end)
                if len(packer.rows) > 2000:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return along_curve(docs).select("doc_id", "text").mapInArrow(lay, _PIECES)


def op5_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

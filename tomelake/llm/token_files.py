"""Token-id files: ids of whole documents in ascending doc_id order, range-coded in independent, checksummed blocks.

File layout, little-endian, in groups of at most GROUP_BLOCKS blocks, each of which can be read alone:
    b"TLIDS2\\0\\0", then for each group: number of documents whose last id lies in it, of blocks and of ids (3 x u32), lengths
    of the document table and of the table of shares (2 x u32); the document table (zlib: doc_id i64 and number of ids u64
    each) and its crc32; the group's shares (zlib: ids and their shares, u32 each) and their crc32; for each block its
    number of ids, length, crc32 of its bytes and crc32 of its ids as u32 (4 x u32); the blocks' bytes.
With the group's shares a block is coded from a fresh state (range_coder), so a damaged one is found by its checksum and costs only itself.

Writers work on ranges of doc_id, one file each, under a temporary name that is moved to the final one when the file is
whole: a task that runs again replaces its file by the same one. Files lie in the shared folder and are opened through
pyarrow's file systems.

Edge cases: ids of 16 bits or less are held, others refused; null and empty texts have only the end id; rows without a doc_id come first; rows that repeat a doc_id follow each other in the order of a hash
of their text; a document may span blocks and groups; an empty table gives empty files and an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import saved, scratch, shuffle_partitions, table
from .range_coder import decode_blocks, encode_blocks, shares

MAGIC = b"TLIDS2\0\0"
BLOCK_IDS, GROUP_BLOCKS = 4096, 1536
#: Ids are below it.
MOST_ID = 1 << 16
#: Stands in a file for a missing doc_id.
NO_ID = -(1 << 63)
_HEAD, _BLOCK = struct.Struct("<5I"), struct.Struct("<4I")


class DamagedFile(ValueError):
    pass


class FileWriter:
    """Writes groups to an open binary file as they fill."""

    def __init__(self, out):
        self.out, self.docs, self.parts, self.held = out, [], [], 0
        self.n_docs = self.n_ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.n_docs += 1
        self.n_ids += len(ids) // 4
        while self.held >= BLOCK_IDS * GROUP_BLOCKS:
            self._group(BLOCK_IDS * GROUP_BLOCKS)

    def finish(self) -> None:
        if self.held or self.docs:
            self._group(self.held)

    def _group(self, n: int) -> None:
        stream = b"".join(self.parts)
        now, self.parts = stream[: 4 * n], [stream[4 * n :]]
        self.held -= n
        # All documents but the last are whole here; the last one belongs to the group in which it ends.
        ended = self.docs if not self.held else self.docs[:-1]
        self.docs = self.docs[len(ended) :]
        listed = zlib.compress(np.array([d for d, _ in ended], "<i8").tobytes() + np.array([c for _, c in ended], "<u8").tobytes(), 6)
        ids = np.frombuffer(now, "<u4").astype(np.int64)
        if len(ids) and ids.max() >= MOST_ID:
            raise ValueError(f"the format holds ids below {MOST_ID}, not {ids.max()}")
        blocks = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
        found = shares(ids)
        coded = encode_blocks(blocks, found)
        common = zlib.compress(np.concatenate(found).astype("<u4").tobytes(), 6)
        write = self.out.write
        write(_HEAD.pack(len(ended), len(blocks), n, len(listed), len(common)))
        for part in (listed, common):
            write(part + struct.pack("<I", zlib.crc32(part)))
        for b, c in zip(blocks, coded, strict=True):
            write(_BLOCK.pack(len(b), len(c), zlib.crc32(c), zlib.crc32(b.astype("<u4").tobytes())))
        for c in coded:
            write(c)


def read_groups(source) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(doc ids, their numbers of ids, stream of ids as u32) of each group of an open file."""

    def take(n: int) -> bytes:
        data = source.read(n)
        if len(data) != n:
            raise DamagedFile("the file ends early")
        return data

    if take(len(MAGIC)) != MAGIC:
        raise DamagedFile("not a file of token ids")
    while head := source.read(_HEAD.size):
        n_docs, n_blocks, n, *sizes = _HEAD.unpack(head)
        parts = []
        for size in sizes:
            part = take(size)
            if struct.unpack("<I", take(4))[0] != zlib.crc32(part):
                raise DamagedFile("a group's tables are damaged")
            parts.append(zlib.decompress(part))
        listed, common = parts[0], np.frombuffer(parts[1], "<u4").astype(np.int64).reshape(2, -1)
        docs, counts = np.frombuffer(listed, "<i8", n_docs), np.frombuffer(listed, "<u8", n_docs, 8 * n_docs)
        index = [_BLOCK.unpack(take(_BLOCK.size)) for _ in range(n_blocks)]
        coded = [take(length) for _, length, _, _ in index]
        for i, (c, x) in enumerate(zip(coded, index, strict=True)):
            if zlib.crc32(c) != x[2]:
                raise DamagedFile(f"block {i} is damaged")
        ids = [b.astype("<u4").tobytes() for b in decode_blocks(coded, [x[0] for x in index], (common[0], common[1]))]
        if any(zlib.crc32(b) != x[3] for b, x in zip(ids, index, strict=True)) or sum(x[0] for x in index) != n:
            raise DamagedFile("ids differ from their checksum")
        yield docs.tolist(), counts.tolist(), b"".join(ids)


def read_documents(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as u32) of an open file, in its order."""
    held: list[bytes] = []
    for docs, counts, stream in read_groups(source):
        at = 0
        for doc, count in zip(docs, counts, strict=True):
            need = 4 * count - sum(map(len, held))
            yield None if doc == NO_ID else doc, b"".join([*held, stream[at : at + need]])
            held, at = [], at + need
        if at < len(stream):
            held.append(stream[at:])
    if held:
        raise DamagedFile("the last document isn't whole")


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_files(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> manifest (file_no, path, n_docs, n_ids) of the files written; file_no ascends with doc_id."""
    path = vocabulary or tokens.default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        number, end = task.partitionId(), tokens.END_ID.to_bytes(4, "little")
        final = f"{folder}/part-{number:06d}.tlids"
        system, _ = _opened(folder)
        inside = lambda uri: _opened(uri)[1]
        system.create_dir(inside(folder), recursive=True)
        hidden = f"{folder}/.{number:06d}-{task.taskAttemptId()}"
        with system.open_output_stream(inside(hidden)) as out:
            writer = FileWriter(out)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, coded in tokens.encoded(path, batch.column("text")):
                    for doc, found in zip(ids[first:], coded, strict=False):
                        writer.add(doc, found + end)
            writer.finish()
        system.move(inside(hidden), inside(final))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([final]), pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["file_no", "path", "n_docs", "n_ids"]
        )

    n = shuffle_partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(write, "file_no int, path string, n_docs long, n_ids long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            system, inside = _opened(uri)
            rows = []
            with system.open_input_stream(inside, buffer_size=1 << 20) as source:
                for doc, ids in read_documents(source):
                    rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32. The manifest has a row for each file, so it fits the driver."""
    spark = manifest.sparkSession
    start, files = 0, []
    for r in manifest.orderBy("file_no").collect():
        files.append((len(files), r["path"], start))
        start += r["n_ids"]
    listed = spark.createDataFrame(files, "place int, path string, start long")
    return listed.repartitionById(max(1, len(files)), F.col("place")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = saved(write_files(table(spark, sf_dir, "documents"), scratch(spark, "token-files")))
    return read_files(manifest)

"""SimHash fingerprints of documents, and fingerprints within a Hamming radius by permuted block tables.

Each distinct word of a text votes with weight 1 + ln(count) on BITS signed bits of its hash; the signs of the sums are the
fingerprint. The bits are cut into radius + EQUAL blocks; two fingerprints within the radius agree on some EQUAL of them, so
one table for each choice of blocks, keyed by them, brings each such pair together. `neighbours` puts out every pair;
`near_groups`, which the query runs, never makes all pairs of a bucket: of each bucket it puts out a spanning forest of the
pairs within the radius, and its result is the components. A bucket of more than MOST_IN_BUCKET fingerprints is cut into
blocks, and each two blocks meet in a task of their own.

Edge cases: null counts as empty; a text without words has the fingerprint of zeros; equal texts have equal fingerprints;
rows that repeat a doc_id are ordered by a hash of their text; rows without one come before all others, and a group without any doc_id has no id; the only document of a table is its own next one; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelake.operators.components import connected_components

from .common import saved, shuffle_partitions, stored, table, text_of
from .shingles import mixed, slices, words

BITS = 128
#: Differing bits within which fingerprints count as near, and blocks on which two such agree.
RADIUS, EQUAL = 3, 2
#: Fingerprints of one bucket that are compared in one task.
MOST_IN_BUCKET = 20_000
#: The sign of each of a byte's bits, highest first.
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1.0


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(n, BITS / 8) bytes."""
    out = []
    for _, _, raw, at in slices(texts):
        h, counts, _, _ = words(raw, at)
        n = len(counts)
        place, weight, rows = [], [], []
        begin = 0
        for i, c in enumerate(counts):
            u, times = np.unique(h[begin : begin + c], return_counts=True)
            place.append(u)
            weight.append(1 + np.log(times))
            rows.append(np.full(len(u), i))
            begin += c
        u, weight, rows = np.concatenate(place), np.concatenate(weight), np.concatenate(rows)
        bits = np.zeros((n, BITS), dtype=bool)
        for half in range(BITS // 64):
            own = (u if half == 0 else mixed(u ^ np.uint64(half))).view(np.uint8).reshape(-1, 8)
            for byte in range(8):
                votes = np.bincount(rows * 256 + own[:, byte], weights=weight, minlength=256 * n).reshape(n, 256)
                bits[:, 64 * half + 8 * byte : 64 * half + 8 * byte + 8] = votes @ _SIGNS > 0
        out.append(np.packbits(bits, axis=1))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), dtype=np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / (8 * a.shape[1])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hexes = [x.tobytes().hex() for x in fingerprints(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hexes, pa.string())], ["doc_id", "fingerprint"])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprint, "doc_id long, fingerprint string")


def neighbours(prints: DataFrame, radius: int = 6, equal: int = 2) -> DataFrame:
    """prints(fingerprint) -> (a, b, distance): all pairs a < b of different fingerprints within the radius.

    Copies fold into one row first. A pair is kept in the first table that brings it together, so no pair is made twice.
    """
    digits = BITS // 4
    blocks = radius + equal
    cuts = [digits * i // blocks for i in range(blocks + 1)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    tables = list(combinations(range(blocks), equal))
    prints = prints.select("fingerprint").distinct()

    def part(name: str, i: int):
        return F.substring(name, spans[i][0] + 1, spans[i][1] - spans[i][0])

    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.concat(*[part("fingerprint", i) for i in chosen]).alias("key")) for t, chosen in enumerate(tables)])
    keyed = prints.select("fingerprint", F.explode(keys).alias("k")).select("fingerprint", "k.t", "k.key")
    pairs = keyed.withColumnRenamed("fingerprint", "a").join(keyed.withColumnRenamed("fingerprint", "b"), ["t", "key"]).filter("a < b")
    long = lambda c, i: F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long")
    distance = sum(F.bit_count(long("a", i).bitwiseXOR(long("b", i))) for i in range(digits // 8))
    same = [part("a", i) == part("b", i) for i in range(blocks)]
    first = F.least(*[F.when(_all(same[i] for i in chosen), t) for t, chosen in enumerate(tables)])
    return pairs.filter(F.col("t") == first).withColumn("distance", distance).filter(F.col("distance") <= radius).select("a", "b", "distance")


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _masks(radius: int) -> np.ndarray:
    """(tables, 2) words of bits: those that a table's key holds."""
    cuts = [BITS * i // (radius + EQUAL) for i in range(radius + EQUAL + 1)]
    out = []
    for chosen in combinations(range(radius + EQUAL), EQUAL):
        bits = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        out.append((bits >> 64, bits & ((1 << 64) - 1)))
    return np.array(out, dtype=np.uint64)


_ROW = "key long, id long, hi long, lo long"


def _table_rows(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """A row for each fingerprint (id, fingerprint in hex) and table."""
    masks = _masks(radius)
    for batch in batches:
        words_ = np.frombuffer(bytes.fromhex("".join(batch.column("fingerprint").to_pylist())), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        for t, (hi, lo) in enumerate(masks):
            key = mixed(mixed((words_[:, 0] & hi) ^ np.uint64(t + 1)) ^ (words_[:, 1] & lo))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id"), pa.array(words_[:, 0].view(np.int64)), pa.array(words_[:, 1].view(np.int64))], ["key", "id", "hi", "lo"])


def _forest(ids: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what pairs within the radius connect: each print is compared with those that aren't reached yet."""
    links = []
    left = np.arange(len(ids))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]).sum(axis=1) <= radius
            reached, left = left[near], left[~near]
            links += [(int(ids[i]), int(ids[j])) for j in reached]
            todo.extend(reached)
    return links


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows by key -> links (a, b) of each bucket; of a bucket beyond `most` its rows."""
    now, held, size, large = None, [], 0, False

    def links():
        ids, hi, lo = (np.concatenate([p[i] for p in held]) for i in range(3))
        return _forest(ids, np.stack((hi, lo), axis=1).view(np.uint64), radius) if len(ids) > 1 else []

    def rows(parts, key):
        n = sum(len(p[0]) for p in parts)
        cols = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        empty = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, pa.array(np.full(n, key, dtype=np.int64)), *map(pa.array, cols)], ["a", "b", "key", "id", "hi", "lo"])

    def found(pairs):
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), empty, empty, empty, empty], ["a", "b", "key", "id", "hi", "lo"])

    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in ("key", "id", "hi", "lo")]
        key = cols[0]
        if not len(key):
            continue
        at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        several = np.diff(at)
        out = []
        for g in np.flatnonzero((several > 1) | (np.arange(len(several)) == 0) | (np.arange(len(several)) == len(several) - 1)):
            part = tuple(c[at[g] : at[g + 1]] for c in cols[1:])
            if key[at[g]] != now:
                if held and not large:
                    out += links()
                now, held, size, large = int(key[at[g]]), [], 0, False
            held.append(part)
            size += len(part[0])
            if large or size > most:
                large = True
                yield rows(held, now)
                held = []
        if out:
            yield found(out)
    if held and not large and (out := links()):
        yield found(out)


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints(doc_id, fingerprint) -> (fingerprint, near_group): the smallest doc_id that fingerprints within the radius, one after the other, connect to; every different fingerprint has one row."""
    n, most = shuffle_partitions(prints.sparkSession), MOST_IN_BUCKET
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "fingerprint", "doc_id"), "prints")
    keyed = classes.select("id", "fingerprint").mapInArrow(lambda x: _table_rows(x, radius), _ROW)
    schema = f"a long, b long, {_ROW}"
    found = stored(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda x: _bucket_links(x, radius, most), schema), "near-prints")
    links = found.filter("a is not null").select("a", "b")
    large = found.filter("a is null").select("key", "id", "hi", "lo")
    if not large.isEmpty():
        sizes = large.groupBy("key").agg(F.ceil(2 * F.count(F.lit(1)) / most).alias("blocks"))
        rows = large.join(sizes, "key").withColumn("x", F.pmod(F.xxhash64("id"), "blocks"))
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")).alias("key"), "id", "hi", "lo")
        met = rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda x: _bucket_links(x, radius, 1 << 62), schema)
        links = links.unionByName(met.select("a", "b"))
    part = connected_components(links, "a", "b", cut=saved)
    classes = classes.join(part.selectExpr("vertex as id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("near_group"))
    return classes.join(least, "component").select("fingerprint", "near_group")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _EDITED.split(", ")]
_RUN = 1 << 19


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (bucket, context first, doc_id): each text with the one before it, which is the next in descending order."""
    before = ""
    for batch in batches:
        ids, context, texts = batch.column("doc_id").to_pylist(), batch.column("context").to_pylist(), batch.column("text").to_pylist()
        run, size = [], 0
        for k, (doc, aside, text) in enumerate(zip(ids, context, texts, strict=True)):
            if not aside:
                half = len(text) // 2
                run.append((doc, text, text[: len(text) - half] + before[:half], before))
                size += 3 * len(text)
            before = text
            if run and (size > _RUN or k == len(ids) - 1):
                yield _compare(run)
                run, size = [], 0


def _compare(run: list[tuple[int, str, str, str]]) -> pa.RecordBatch:
    n = len(run)
    # The text before is the row before, but for the first row and where a bucket begins.
    alone = [i for i in range(n) if i == 0 or run[i][3] is not run[i - 1][1]]
    texts = [r[1] for r in run] + [r[2] for r in run] + [run[i][3] for i in alone]
    prints = fingerprints(pa.array(texts, pa.large_string()))
    own, edited = prints[:n], prints[n : 2 * n]
    following = np.roll(own, 1, axis=0)
    following[alone] = prints[2 * n :]
    columns = [
        pa.array([r[0] for r in run], pa.int64()),
        pa.array([len(r[1]) for r in run], pa.int64()),
        pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in run]),
        pa.array([x.tobytes().hex() for x in own]),
        pa.array([x.tobytes().hex() for x in edited]),
        pa.array(likeness(own, edited)),
        pa.array(likeness(own, following)),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: the last half of the code points replaced by the beginning of the next document in descending doc_id.

    Texts are shuffled once, to ranges of doc_id. The last row of each range also goes to the range above, whose smallest
    document it follows; the largest of all goes to the lowest range.
    """
    n = shuffle_partitions(docs.sparkSession)
    docs = docs.select("doc_id", text_of().alias("text"), F.coalesce("doc_id", F.lit(-(1 << 62)).cast("long")).alias("_order"))
    bounds = docs.approxQuantile("_order", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    if bounds is None or not docs.select("_order").head(1):
        return docs.sparkSession.createDataFrame([], _EDITED)
    bounds = sorted({int(b) for b in bounds})
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= F.col("_order"))) if bounds else F.lit(0)
    placed = docs.withColumn("bucket", bucket)
    tops = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max("_order").alias("top")).collect())
    above = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}
    goes = F.element_at(F.create_map(*[F.lit(x) for pair in above.items() for x in pair]), F.col("_order"))
    targets = F.array(F.struct(F.col("bucket"), F.lit(False).alias("context")), F.struct(goes.alias("bucket"), F.lit(True).alias("context")))
    targets = F.when(F.col("_order").isin(*above), targets).otherwise(F.slice(targets, 1, 1))
    rows = placed.select("doc_id", "_order", "text", F.explode(targets).alias("t")).select("doc_id", "_order", "text", "t.bucket", "t.context")
    rows = rows.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket", F.desc("context"), "_order", F.xxhash64("text"))
    return rows.select("doc_id", "context", "text").mapInArrow(_with_next, _EDITED)


def op4_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = stored(edit_likeness(table(spark, sf_dir, "documents")), "edited")
    return edited.join(near_groups(edited.select("doc_id", "fingerprint")), "fingerprint").select(*_NAMES, "near_group")

"""MinHash near-duplicate detection by a multi-index Hamming join over b-bit signatures.

1. `signatures`: each text's set of distinct five-word shingles gives SYMBOLS minimum hashes of BITS bits. Texts with the
   same set form one class with a number of its own.
2. `buckets`: the signature is cut into chunks of CHUNK symbols. Two signatures that differ in at most RADIUS symbols
   differ, by pigeonhole, in at most one symbol of some chunk; so every chunk is indexed once for each symbol that may be
   wrong, and all pairs within the radius meet in a bucket.
3. `stars`: each member of a bucket is tried with the bucket's least one on full sets. The components of these links
   collapse groups of near copies, however large, before any pairs are made: from here on only pairs of different
   components matter, and a bucket of one component is done.
4. `meetings`: what is left of a bucket becomes one set, if it has at most MOST_IN_BUCKET members; else members outside
   its largest component are cut into blocks, which meet each other and each block of the largest component, whose own
   blocks needn't meet.
5. `families`: within a set only stars of the components that its near pairs connect are put out. The components of
   these stars are families: every pair that can still link two components lies in one.
6. `confirmed`: a family (or, where it is too large for a task, each of its sets) is brought together with its members'
   full shingle sets, and near pairs of different components are tried. A link holds where
   100 * intersection >= 75 * union. Only the links that join two components are put out.
7. Components over the links of 3 and 6.

Two texts of similarity 0.75 lie within the radius and so surely meet with probability 0.9997, and meet in any case with
probability 1 - 2e-6; for more similar texts both are higher. A pair that has met is tried on full sets unless more than NEAR
symbols differ, which at similarity 0.75 happens to one pair in 10**7.

Edge cases: null and empty texts, and texts of white space, have an empty set, are linked with nothing and stay; a row
that repeats doc_id and text is the same document and stays or goes with it; rows that repeat a doc_id with other texts
are judged each by their own text; a row without a doc_id is linked like others but has no component unless a linked one has a doc_id,
and of a group without any doc_id the rows of one text stay; texts of one to four words are one shingle; ties go to the smallest doc_id;
an empty table gives an empty result; extra columns are ignored by `near_duplicates` and kept by `drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.operators.components import connected_components

from .common import saved, shuffle_partitions, stored, table
from .exact_dedup import marked
from .shingles import mixed, shingle_hashes, slices, words

WIDTH = 5
#: Percent of the union that the intersection must reach.
PERCENT = 75
SYMBOLS, BITS, CHUNK = 40, 16, 4
CHUNKS = SYMBOLS // CHUNK
#: Differing symbols within which all pairs are found: fewer than two for each chunk.
RADIUS = 2 * CHUNKS - 1
#: Pairs that have met are tried on full sets up to so many differing symbols.
NEAR = 24
MOST_IN_BUCKET = 6000
#: Members of a block of a larger bucket.
BLOCK = 1500
#: Pairs that one task tries with a bucket's least member.
STAR = 2000
#: Shingles (of 8 bytes) that are compared in one task at once, about.
MOST_SHINGLES = 4_000_000
_rng = np.random.Generator(np.random.PCG64(6))
_XOR = _rng.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_TIMES = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS b-bit minimum hashes of a set that isn't empty."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        block = shingles[i : i + 4096, None] ^ _XOR
        block *= _TIMES
        np.minimum(least, block.min(axis=0), out=least)
    return mixed(least).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, signs = [], [], []
        for _, _, raw, at in slices(batch.column("text")):
            h, counts, _, _ = words(raw, at)
            for s in shingle_hashes(h, counts, WIDTH):
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.string()), pa.array(signs, pa.binary())],
            ["doc_id", "row_key", "n_shingles", "set_key", "signature"],
        )


def row_key():
    """Stands for a document: 128 bits of its doc_id and its text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, set_key (128-bit hash of the whole set), signature."""
    return docs.select("doc_id", row_key().alias("row_key"), "text").mapInArrow(_sign, "doc_id long, row_key string, n_shingles long, set_key string, signature binary")


def _hashed(parts: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(parts[-1]), dtype=np.uint64)
    for p in parts:
        h = mixed((h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return h


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key for each chunk and each symbol of it that may be wrong."""
    for batch in batches:
        sign, ids = _matrix(batch.column("signature")), batch.column("id").to_numpy()
        for c in range(CHUNKS):
            for wrong in range(CHUNK):
                right = [sign[:, CHUNK * c + j] for j in range(CHUNK) if j != wrong]
                key = _hashed([np.full(len(ids), CHUNK * c + wrong, dtype=np.uint64), *right])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids)], ["key", "id"])


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) -> (key, least, members): of each key with several ids its least id and its members, in one row
    without the key up to `most`, else in rows of 500 with it."""
    now, held, least, large = None, [], 0, False
    out: list[tuple] = []

    def done():
        if held and not large and (len(held) > 1 or len(held[0]) > 1):
            out.append((None, least, np.concatenate(held)))

    def put():
        rows = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.int64()), pa.array([m for _, _, m in out], pa.list_(pa.int64()))], ["key", "least", "members"]
        )
        out.clear()
        return rows

    for batch in batches:
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(key):
            continue
        at = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        size = np.diff(at)
        for g in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)):
            k, own = int(key[at[g]]), ids[at[g] : at[g + 1]]
            if k != now:
                done()
                now, held, least, large = k, [], int(own[0]), False
            held.append(own)
            if large or sum(map(len, held)) > most:
                large = True
                out.extend((k, least, part[i : i + 500]) for part in held for i in range(0, len(part), 500))
                held = []
        if out:
            yield put()
    done()
    if out:
        yield put()


def _grouped(keyed: DataFrame) -> DataFrame:
    n, most = shuffle_partitions(keyed.sparkSession), MOST_IN_BUCKET
    return keyed.repartition(n, "key").sortWithinPartitions("key", "id").mapInArrow(lambda x: _groups(x, most), "key long, least long, members array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """classes(id, signature) -> (key, least, members): every pair within RADIUS is in one bucket. key is null for a bucket that is whole in its row."""
    return stored(_grouped(classes.select("id", "signature").mapInArrow(_chunk_keys, "key long, id long")), "buckets")


def stars(found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that hold on the full sets between buckets' least members and the others."""
    pairs = found.select(F.col("least").alias("a"), F.explode("members").alias("b")).filter("a <> b").distinct()
    own = classes.select("id", "n", "signature")
    pairs = pairs.join(own.selectExpr("id as b", "n as nb", "signature as sb"), "b").join(own.selectExpr("id as a", "n as na", "signature as sa"), "a")
    pairs = stored(pairs.filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).mapInArrow(_near_pairs, "a long, b long"), "stars")
    sets = shingle_sets(pairs.select("a").union(pairs.select("b")), classes, docs)
    # The least one's set is copied once for each STAR of its pairs, so a centre of any size is spread over tasks.
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    spread = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    centres = size.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "shingles")
    rows = centres.unionByName(spread.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "shingles"))
    n = shuffle_partitions(found.sparkSession)
    return rows.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(_confirm_stars, "a long, b long")


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = (_matrix(batch.column("sa")) != _matrix(batch.column("sb"))).sum(axis=1) <= NEAR
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _confirm_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (a, part), the centre's first -> the links that hold."""
    centre = np.zeros(0, dtype=np.uint64)
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        links = []
        for i, s in enumerate(batch.column("shingles")):
            own = np.frombuffer(s.as_buffer(), dtype=np.uint64)
            if b[i] is None:
                centre = own.copy()
            elif linked(centre, own):
                links.append(i)
        yield batch.select(["a", "b"]).take(pa.array(links, pa.int64()))


def meetings(found: DataFrame, classes: DataFrame) -> DataFrame:
    """classes(id, signature, part) -> members: sets of classes so that each near pair of different parts of a bucket is in one."""
    part = classes.select("id", "part")
    out = _small(found.filter("key is null"), part)
    large = found.filter("key is not null").select("key", "members")
    if large.isEmpty():
        return out
    return out.unionByName(_split(saved(_parted(large, part))))


def _small(rows: DataFrame, part: DataFrame) -> DataFrame:
    """members of the different whole buckets that have several parts. Two buckets whose hashes agree become one, which does no harm."""
    lists = rows.groupBy(F.xxhash64("members").alias("key"), F.xxhash64(F.lit(1), "members").alias("key2")).agg(F.first("members").alias("members"))
    parted = _parted(lists.select("key", "members"), part)
    several = F.min("part") < F.max("part")
    return parted.groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("members"), several.alias("several")).filter("several").select("members")


def _parted(rows: DataFrame, part: DataFrame) -> DataFrame:
    return rows.select("key", F.explode("members").alias("id")).join(part, "id").select("key", "id", "part")


def _split(rows: DataFrame) -> DataFrame:
    """members of large buckets (key, id, part), two blocks each."""
    sizes = rows.groupBy("key", "part").count()
    main = saved(sizes.groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.max("count").alias("inside"), F.sum("count").alias("all")).filter("inside < all"))
    outside = F.col("all") - F.col("inside")
    blocks = rows.join(main, "key")
    of = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK))
    # Blocks of the main part are numbered below zero. Each set of two blocks has at least one outside it.
    inner = F.col("part") == F.col("main")
    own = F.when(inner, -1 - F.pmod(F.xxhash64("id"), of(F.col("inside")))).otherwise(F.pmod(F.xxhash64("id"), of(outside)))
    others = F.when(inner, F.sequence(F.lit(0).cast("long"), of(outside) - 1)).otherwise(F.sequence(-of(F.col("inside")), of(outside) - 1))
    met = blocks.select("key", "id", own.alias("b"), others.alias("o")).select("key", "id", "b", F.explode("o").alias("o"))
    members = met.groupBy("key", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y")).agg(F.array_sort(F.collect_set("id")).alias("members"))
    return members.select("members")


def listed(members: DataFrame) -> DataFrame:
    """members -> distinct (bucket, id)."""
    lists = members.groupBy(F.xxhash64("members").alias("bucket"), F.xxhash64(F.lit(1), "members").alias("bucket2")).agg(F.first("members").alias("members"))
    return lists.select("bucket", F.explode("members").alias("id"))


def _runs(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[list[pa.Array]]:
    """The columns of each run of rows with one key."""
    now, parts = None, []

    def joined():
        return [pa.concat_arrays([p.column(n) for p in parts]) for n in names]

    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if keys[lo] != now:
                if parts:
                    yield joined()
                now, parts = keys[lo], []
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield joined()


def _near(sign: np.ndarray, n: np.ndarray, i: int, of: np.ndarray) -> np.ndarray:
    """Distances of signature i from those of `of`; beyond NEAR, or where the sizes rule a link out, SYMBOLS + 1."""
    d = (sign[of] != sign[i]).sum(axis=1)
    d[(d > NEAR) | (100 * np.minimum(n[of], n[i]) < PERCENT * np.maximum(n[of], n[i]))] = SYMBOLS + 1
    return d


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket -> (a, b): each part b with the least one that near pairs of the bucket connect it to. Those of the last buckets aren't repeated."""
    told: set[tuple[int, int]] = set()
    for ids, n, sign, part in _runs(batches, "bucket", ["id", "n", "signature", "part"]):
        ids, n, sign, part = ids.to_numpy(), n.to_numpy(), _matrix(sign), part.to_numpy()
        order = np.argsort(ids, kind="stable")
        n, sign, part = n[order], sign[order], part[order]
        values, group = np.unique(part, return_inverse=True)
        pairs = set()
        # A part reaches another through any near pair: walk over parts, smallest first, against all that aren't reached yet.
        size = np.bincount(group)
        left = np.ones(len(group), dtype=bool)
        for start in np.argsort(size, kind="stable"):
            if not left[group == start].any():
                continue
            todo, tree = [start], [start]
            left[group == start] = False
            while todo:
                now = todo.pop()
                for i in np.flatnonzero(group == now):
                    of = np.flatnonzero(left)
                    if not len(of):
                        break
                    near = of[_near(sign, n, i, of) <= NEAR]
                    if len(near):
                        reached = np.unique(group[near])
                        left[np.isin(group, reached)] = False
                        todo.extend(reached.tolist())
                        tree.extend(reached.tolist())
            # A star, so that buckets that connect the same parts name the same pairs.
            own = np.sort(values[tree]).tolist()
            pairs.update((own[0], x) for x in own[1:])
        fresh = pairs - told
        if fresh:
            if len(told) > 500_000:
                told.clear()
            told |= fresh
            a, b = np.array(sorted(fresh), dtype=np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def families(members: DataFrame) -> DataFrame:
    """members(bucket, id, n, signature, part) -> (id, family) of all classes of parts that may be linked with another."""
    n = shuffle_partitions(members.sparkSession)
    rows = members.repartition(n, "bucket").sortWithinPartitions("bucket").select("bucket", "id", "n", "signature", "part")
    pairs = saved(rows.mapInArrow(_forest, "a long, b long").distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("family"))
    grouped = connected_components(thinned(pairs), "a", "b", cut=saved)
    met = members.select("id", "part").distinct()
    return met.join(grouped.selectExpr("vertex as part", "component as family"), "part").select("id", "part", "family")


def _active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket -> (bucket, id, n) of the classes that are near one of another part there."""
    for bucket, ids, n, sign, part in _runs(batches, "bucket", ["bucket", "id", "n", "signature", "part"]):
        ids, n, sign, part = ids.to_numpy(), n.to_numpy(), _matrix(sign), part.to_numpy()
        values, size = np.unique(part, return_counts=True)
        active = np.zeros(len(ids), dtype=bool)
        for i in np.flatnonzero(part != values[size.argmax()]):  # each pair of two parts has one outside the largest
            of = np.flatnonzero(part != part[i])
            near = of[_near(sign, n, i, of) <= NEAR]
            active[near] = True
            active[i] |= len(near) > 0
        yield pa.RecordBatch.from_arrays([bucket.filter(pa.array(active)), pa.array(ids[active]), pa.array(n[active])], ["bucket", "id", "n"])


def units(members: DataFrame, family: DataFrame, classes: DataFrame) -> DataFrame:
    """(unit, id): sets of classes that fit into a task, so that every near pair of different parts is in one."""
    family = saved(family.join(classes.select("id", "n"), "id"))
    sizes = saved(family.groupBy("family").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("size")))
    fits = (F.col("shingles") <= MOST_SHINGLES) & (F.col("size") <= MOST_IN_BUCKET)
    small = family.join(sizes.filter(fits), "family").select(F.col("family").alias("unit"), "id")
    large = saved(sizes.filter(~fits))
    if large.isEmpty():
        return small
    rows = members.join(family.join(large, "family").select("id"), "id").select("bucket", "id", "n", "signature", "part")
    rows = saved(rows.repartition(shuffle_partitions(members.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_active, "bucket long, id long, n long"))
    blocks = rows.groupBy("bucket").agg(F.ceil(2 * F.sum("n") / MOST_SHINGLES).alias("blocks"))
    rows = rows.join(blocks, "bucket").withColumn("b", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return small.unionByName(rows.select(F.xxhash64(F.lit("bucket"), "bucket", F.least("b", "o"), F.greatest("b", "o")).alias("unit"), "id"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for _, _, raw, at in slices(batch.column("text")) for h, counts, _, _ in [words(raw, at)] for s in shingle_hashes(h, counts, WIDTH)]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(s) for s in sets], pa.string()), pa.array(sets, pa.binary())], ["set_key", "shingles"])


def shingle_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the classes `ids`. Only texts that a Bloom filter of their classes' documents lets through are shuffled."""
    wanted = saved(ids.toDF("id").distinct().join(classes.select("id", "set_key", "row_key"), "id"))
    texts = marked(docs.select(row_key().alias("row_key"), "text"), "row_key", wanted.select("row_key")).filter("_may").select("row_key", "text")
    found = texts.join(wanted.select("row_key").distinct(), "row_key", "left_semi").select("text").mapInArrow(_sets, "set_key string, shingles binary").dropDuplicates(["set_key"])
    return stored(found.join(wanted, "set_key").select("id", "shingles"), "sets")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * same >= PERCENT * (len(x) + len(y) - same)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by unit -> (a, b): links of the unit that join two components, parts being components already."""
    for ids, n, sign, sets, part in _runs(batches, "unit", ["id", "n", "signature", "shingles", "part"]):
        links = _joining(ids.to_numpy(), n.to_numpy(), _matrix(sign), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sets], part.to_numpy())
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _joining(ids, n, sign, sets, part) -> list[tuple[int, int]]:
    """Each class outside the largest part is held against all classes of other parts: of each two parts one is outside it."""
    _, part, size = np.unique(part, return_inverse=True, return_counts=True)
    if len(size) < 2:
        return []
    links = []
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(sets)), n)[order]
    first = part.copy()
    for i in np.argsort(size[first], kind="stable"):
        if first[i] == size.argmax():
            continue
        of = np.flatnonzero(part != part[i])
        if not len(of):
            break
        of = of[_near(sign, n, i, of) <= NEAR]
        if not len(of):
            continue
        # The classes that hold each of its shingles, counted.
        low, high = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
        many = high - low
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        same = np.bincount(owner[at], minlength=len(ids))[of]
        of = of[100 * same >= PERCENT * (n[i] + n[of] - same)]
        if len(of):
            reached, one = np.unique(part[of], return_index=True)
            links += [(int(ids[i]), int(ids[j])) for j in of[one]]
            part[np.isin(part, reached)] = part[i]
    return links


def confirmed(unit: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that hold on the full shingle sets. classes(id, n, signature, part)."""
    sets = shingle_sets(unit.select("id"), classes, docs)
    rows = unit.join(sets, "id").join(classes.select("id", "n", "signature", "part"), "id").select("unit", "id", "n", "signature", "shingles", "part")
    rows = rows.repartition(shuffle_partitions(unit.sparkSession), "unit").sortWithinPartitions("unit", "id")
    return rows.mapInArrow(_confirm, "a long, b long")


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components: a class is linked with the least of its lesser ones, and that one with the others, so members of many stars are linked once."""
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    first = F.min("a").over(W.partitionBy("b"))
    return ends.withColumn("f", first).select("f", F.when(F.col("a") == F.col("f"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct().withColumnRenamed("f", "a")


def _components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with a column part: the least id that links connect to."""
    part = connected_components(thinned(links), "a", "b", cut=saved)
    return classes.drop("part").join(part.selectExpr("vertex as id", "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")


def linked_rows(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row_key, n_shingles, component_id (null where no linked row has a doc_id), kept."""
    signed = stored(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    classes = signed.filter("n_shingles > 0").groupBy("set_key").agg(first.alias("f"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    # Numbers are unique in the written table, so two classes are never taken for one.
    classes = stored(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("f.doc_id").alias("doc_id"), F.col("f.row_key").alias("row_key"), "n", "signature"), "classes")
    found = buckets(classes)
    star = stored(stars(found, classes, docs), "star-links")
    classes = stored(_components(star, classes), "parted")
    members = stored(listed(meetings(found, classes)).join(classes.select("id", "n", "signature", "part"), "id"), "members")
    family = families(members)
    links = star
    if not family.isEmpty():
        unit = saved(units(members, family, classes))
        links = stored(star.unionByName(confirmed(unit, classes, docs)), "links")
        classes = _components(links, classes)
    classes = classes.select("set_key", "part", "doc_id", "row_key")
    stays = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    head = saved(classes.groupBy("part").agg(stays.alias("f"))).select("part", F.col("f.doc_id").alias("_component"), F.col("f.row_key").alias("_head"))
    ids = classes.select("set_key", "part").join(head, "part").select("set_key", "_component", "_head")
    out = signed.join(ids, "set_key", "left")
    return out.select(
        "doc_id",
        "row_key",
        "n_shingles",
        F.coalesce("_component", "doc_id").alias("component_id"),
        (F.col("set_key").isNull() | (F.col("row_key") == F.col("_head"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept (doc_id = component_id; of a component without doc_ids, the row that stays)."""
    return linked_rows(docs).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), "kept").alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, all columns as they were. Rows are shuffled only where a Bloom filter of what goes lets them through."""
    dropped = saved(linked_rows(docs).filter("not kept").select("row_key").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key().alias("row_key"))
    flagged = marked(rows, "row_key", dropped)
    stay = flagged.filter("_may").join(dropped, "row_key", "left_anti")
    return flagged.filter("not _may").select("_row").unionByName(stay.select("_row")).select("_row.*")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

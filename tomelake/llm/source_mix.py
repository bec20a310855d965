"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed order, are cut into blocks. With integer weights w_s of sum D, block k (from 0) of
source s is released at slot floor(k D / w_s) and due by slot ceil((k + 1) D / w_s). Earliest deadline first over one
period of D slots, one block to a slot, gives every block its place; the schedule repeats with period D. While no source
is exhausted, after any number of slots each source deviates from its share by less than one block. Once a source ends,
its slots stay empty and the others keep their order, so every document keeps a place and none is dropped.

Within a source, documents are ordered by the MD5 of their id. The rank is counted in two steps: inside small ranges of
that hash, and from the sizes of the ranges before, so a source with most of the rows is never sorted by one task.

Edge cases: sources without a weight, null included, share the pseudo-source `other`; a document with repeated id gets
one place for each row (in `in_mix_order` the first of them); one without an id is placed too, and comes first in `in_mix_order`; weight 0 is refused; empty tables give empty results; extra columns are kept by `in_mix_order`.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, table

OTHER = "other"
#: Documents in a block.
BLOCK = 8
#: Rows of one source that are ranked by one task, about.
RANGE_ROWS = 20_000
#: The period is part of the plan, so it is bounded.
MOST_SLOTS = 10_000


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks, ties by source."""
    total = sum(weights.values())
    if min(weights.values()) < 1 or total > MOST_SLOTS:
        raise ValueError(f"weights must be integers from 1 with a sum of at most {MOST_SLOTS}")
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        slots.append(s)
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * total // weights[s], s, k + 1))
    return slots


def source_ranks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, mix_source, ...) with rank long: the place, from 0, of the row in its source by MD5 of the id."""
    n = docs.count()
    digits = 1
    while 16**digits * RANGE_ROWS < n or digits < 2:
        digits += 1
    docs = docs.withColumn("_md5", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_range", F.substring("_md5", 1, digits))
    sizes = docs.groupBy("mix_source", "_range").count()
    before = F.sum("count").over(W.partitionBy("mix_source").orderBy("_range")) - F.col("count")
    sizes = saved(sizes.select("mix_source", "_range", before.alias("_before")))
    inside = F.row_number().over(W.partitionBy("mix_source", "_range").orderBy("_md5", "doc_id"))
    ranked = docs.withColumn("_inside", inside.cast("long")).join(sizes, ["mix_source", "_range"])
    return ranked.withColumn("rank", F.col("_before") + F.col("_inside") - 1).drop("_md5", "_range", "_inside", "_before")


def mix(docs: DataFrame, weights: dict[str, int], block: int = BLOCK) -> DataFrame:
    """doc_id, source, mix_source, block long, slot long, position long: position orders the mix; slots of ended sources leave gaps."""
    weights = weights if OTHER in weights else weights | {OTHER: 1}
    slots = period(weights)
    places: dict[str, list[int]] = {}
    for at, s in enumerate(slots):
        places.setdefault(s, []).append(at)
    known = [s for s in weights if s != OTHER]
    named = docs.select("doc_id", "source", F.when(F.col("source").isin(known), F.col("source")).otherwise(F.lit(OTHER)).alias("mix_source"))
    ranked = source_ranks(named).withColumn("block", F.expr(f"rank div {block}"))
    number, slot = F.lit(None), F.lit(None).cast("long")
    for s in weights:
        at = F.element_at(F.array(*[F.lit(x) for x in places[s]]), (F.col("block") % len(places[s]) + 1).cast("int"))
        slot = F.when(F.col("mix_source") == s, F.expr(f"block div {len(places[s])}") * len(slots) + at).otherwise(slot)
    ranked = ranked.withColumn("slot", slot.cast("long"))
    return ranked.select("doc_id", "source", "mix_source", "block", "slot", (F.col("slot") * block + F.col("rank") % block).alias("position"))


def in_mix_order(docs: DataFrame, weights: dict[str, int], block: int = BLOCK) -> DataFrame:
    """All of docs, with their columns, range-partitioned and sorted by place in the mix: written files are the interleaved order."""
    places = mix(docs, weights, block).groupBy("doc_id").agg(F.min("position").alias("position"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id").join(places, "doc_id", "left")
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", "doc_id")
    return ordered.sortWithinPartitions("position", "doc_id").select("_row.*")


#: Target weights of the production mix: every fourth source counts four times as much as the least.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


_NAMES = sorted([*WEIGHTS, OTHER])
_W = [(WEIGHTS | {OTHER: 1})[s] for s in _NAMES]
_D = sum(_W)
ORACLE = f"""
WITH RECURSIVE names AS (SELECT {_NAMES!r} AS s, {_W!r} AS w, {_D} AS d),
edf(t, used, pick) AS (
  SELECT 0, list_transform(w, lambda x: 0), 0 FROM names
  UNION ALL
  SELECT t + 1, list_transform(used, lambda u, i: CASE WHEN i = p THEN u + 1 ELSE u END), p FROM (
    SELECT t, used, list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i:
        CASE WHEN used[i] < w[i] AND (used[i] * d) // w[i] <= t
             THEN [ceil((used[i] + 1) * d / w[i])::BIGINT, i::BIGINT] END), lambda x: x IS NOT NULL))[1][2] AS p
    FROM edf, names WHERE t < d)),
slots AS (SELECT t - 1 AS slot0, s[pick] AS mix_source, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS r FROM edf, names WHERE t > 0),
d AS (
  SELECT doc_id, source, CASE WHEN list_contains(s, source) AND source <> '{OTHER}' THEN source ELSE '{OTHER}' END AS mix_source FROM documents, names),
k AS (SELECT *, row_number() OVER (PARTITION BY mix_source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rnk FROM d),
p AS (SELECT k.*, rnk // {BLOCK} AS block, list_position(s, mix_source) AS i, w, d FROM k, names)
SELECT doc_id, source, p.mix_source, block, (block // w[i]) * d + slot0 AS slot, ((block // w[i]) * d + slot0) * {BLOCK} + rnk % {BLOCK} AS position
FROM p JOIN slots ON slots.mix_source = p.mix_source AND r = block % w[i]
"""

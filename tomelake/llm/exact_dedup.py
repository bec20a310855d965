"""Exact deduplication: a two-pass Bloom filter keeps rows that cannot repeat out of the shuffle.

Pass 1 hashes each normalised text to `hashes` cells of a filter and marks the cells that more than one row hit (cells are
counted in the task first, so a repeated text sends a few numbers, whatever its copies). A row none of whose cells is marked
is alone; pass 2 sends only the others to the grouping shuffle, by the SHA-256 of the normalised text. A false positive
costs a shuffled row, never a wrong group. A filter has at most MOST_BITS bits, as it is broadcast: beyond 2**24 rows the
rows are cut into slices by another hash, each with a filter of its own, one after the other.

Groups of more than HOT rows (at most one for each HOT rows of the table) are broadcast to their members, so that no task
gets a hot group.

Edge cases: null text counts as empty; empty texts (and texts of white space alone) are equal to each other; a row that
repeats both doc_id and text belongs to the group like any copy, and each repetition of the kept doc_id is marked kept;
a null doc_id is an id like others and comes last among ties; an empty table gives an empty result; extra columns are ignored by `duplicate_groups` and kept by `drop_copies`,
which keeps exactly one row of each group, also where doc_ids repeat or lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, saved, table, text_of

#: Bits in one row of the filter table: what bitmap_construct_agg makes.
BITMAP_BITS = 32768
BITS_PER_ROW = 16
#: One filter never has more bits: 2**28 bits are 32 MB, the bound of what is broadcast; it serves 2**24 rows.
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 18
#: Groups of more rows are broadcast.
HOT = 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: id, n_code_points of the original text, SHA-256 of the normalised text."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(text).cast("long").alias("n_code_points"),
        F.sha2(F.regexp_replace(text, f"{SPACES}+", ""), 256).alias("text_sha256"),
    )


def _cells(key: str, bits: int, hashes: int) -> list:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def repeated_cells(rows: DataFrame, key: str, bits: int, hashes: int, least: int = 2) -> DataFrame:
    """The filter: (bucket, bitmap) of the cells that at least `least` rows hit, one row for 32,768 cells."""
    hit = rows.select(F.explode(F.array(*_cells(key, bits, hashes))).alias("cell")).groupBy("cell").count()
    return (
        hit.filter(F.col("count") >= least)
        .withColumn("bucket", F.expr(f"cell div {BITMAP_BITS}"))
        .groupBy("bucket")
        .agg(F.expr(f"bitmap_construct_agg(cell % {BITMAP_BITS})").alias("bitmap"))
    )


def may_hit(rows: DataFrame, key: str, filter_table: DataFrame, bits: int, hashes: int) -> DataFrame:
    """rows with a boolean _may: false only where the filter has not all cells of the key. The filter table is broadcast: bits / 8 bytes at most."""
    names = rows.columns
    filter_table = F.broadcast(filter_table)
    seen = F.lit(True)
    for i, cell in enumerate(_cells(key, bits, hashes)):
        part = filter_table.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bitmap").alias(f"_bitmap{i}"))
        rows = rows.withColumn(f"_cell{i}", cell).withColumn(f"_bucket{i}", F.expr(f"_cell{i} div {BITMAP_BITS}"))
        rows = rows.join(part, f"_bucket{i}", "left")
        bit = F.expr(f"(conv(hex(substring(_bitmap{i}, cast((_cell{i} % {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) >> cast(_cell{i} % 8 as int)) & 1")
        seen = seen & F.coalesce(bit == 1, F.lit(False))
    return rows.withColumn("_may", seen).select(*names, "_may")


def filter_bits(n_rows: int) -> int:
    """A power of two near BITS_PER_ROW * n_rows, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n_rows * BITS_PER_ROW - 1).bit_length()))


def filter_slices(n_rows: int) -> int:
    """So many filters of at most MOST_BITS bits serve n_rows keys."""
    return max(1, -(-n_rows * BITS_PER_ROW // MOST_BITS))


def marked(rows: DataFrame, key: str, keys: DataFrame, least: int = 1, hashes: int = 2) -> DataFrame:
    """rows with a boolean _may: false only for keys that fewer than `least` rows of `keys` (a saved table with the column) have."""
    n = keys.count()
    slices, bits = filter_slices(n), filter_bits(n)
    out = None
    for i in range(slices):
        mine = F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(slices)) == i if slices > 1 else F.lit(True)
        cells = repeated_cells(keys.filter(mine), key, bits, hashes, least)
        part = may_hit(rows.filter(mine), key, saved(cells) if slices > 1 else cells, bits, hashes)
        out = part if out is None else out.unionByName(part)
    return out


def _order(n: str, doc_id: str):
    """The greatest of this is the row that stays: most code points, then a doc_id, then the smallest one (~ turns the order round, for all longs)."""
    return F.struct(F.col(n), F.col(doc_id).isNotNull(), F.bitwise_not(F.coalesce(F.col(doc_id), F.lit(0).cast("long"))))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = 2) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the one with the most code points in its original text stays, then the smallest id."""
    small = saved(digests(docs, id_col, text_col))
    flagged = marked(small, "text_sha256", small, 2, hashes)
    alone = flagged.filter(~F.col("_may")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    shuffled = flagged.filter("_may").drop("_may")
    groups = saved(shuffled.groupBy("text_sha256").agg(F.max_by("doc_id", _order("n_code_points", "doc_id")).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    hot = F.broadcast(groups.filter(F.col("group_size") > HOT))
    joined = shuffled.join(hot, "text_sha256").unionByName(
        shuffled.join(hot, "text_sha256", "left_anti").join(groups.filter(F.col("group_size") <= HOT), "text_sha256").select(*shuffled.columns, "keep_id", "group_size")
    )
    grouped = joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, all columns as they were.

    Rows that are alone pass straight through. The others are aggregated to the row that stays, in the task before the
    shuffle, so a group sends at most one row from each task and no text is joined. Of rows with one doc_id and one
    text, the one with the greatest hash of its columns stays.
    """
    names, normal = docs.columns, F.regexp_replace(text_of(text_col), f"{SPACES}+", "")
    keys = saved(docs.select(F.xxhash64(normal).alias("_key")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.xxhash64(normal).alias("_key"))
    flagged = marked(rows, "_key", keys, 2).drop("_key")
    normal = F.regexp_replace(F.coalesce(F.col(f"_row.`{text_col}`"), F.lit("")), f"{SPACES}+", "")
    own = flagged.filter("_may").select("_row", F.sha2(normal, 256).alias("_sha"), F.coalesce(F.char_length(F.col(f"_row.`{text_col}`")), F.lit(0)).alias("_n"), F.col(f"_row.`{id_col}`").alias("_id"))
    hashable = [F.col(f"_row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    best = F.struct(_order("_n", "_id").alias("o"), F.xxhash64(*hashable))
    stay = own.groupBy("_sha").agg(F.max_by("_row", best).alias("_row"))
    return flagged.filter(~F.col("_may")).select("_row").unionByName(stay.select("_row")).select("_row.*")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""

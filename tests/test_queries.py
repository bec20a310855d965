"""Queries on small tables of odd rows, held against their SQL."""

import random
import string
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomelake.functions import text as T
from tomelake.operators import evidence as E


def both(spark, folder, name: str, **tables) -> tuple[list, list]:
    """Rows of a query and of its SQL over tables given as (rows, schema), sorted."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


LINEITEM = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def test_crop_widths_of_halves(spark, tmp_path):
    rows = [(17068, 3, 17092, 19, 2.0, 16057.0, 0.0, 0.07), (94701, 2, 8501, 411, 2.0, 72323.0, 0.09, 0.06), (127075, 7, 17902, 969, 4.0, 71857.0, 0.08, 0.0)]
    got, want = both(spark, tmp_path, "box_corners", lineitem=(rows, LINEITEM))
    assert got == want


def test_tokens_of_mostly_digits(spark, tmp_path):
    lines = ["a token 186661156f3f9905942d70850a01cbf23a203f12 here", "ISBN 9780743273565 and 030640615x", "isbn 12345a 2024 night", "gone 99999b", ""]
    rows = [(1, "\n".join(lines)), (2, None), (3, "")]
    got, want = both(spark, tmp_path, "evidence_line_functions", documents=(rows, "doc_id long, text string"))
    assert got == want
    assert len(got) == 6


def regexes(spark, folder, name: str) -> int:
    """How many regular expressions a query's plan runs over a line."""
    rows = [(1, "The Road\nNEW YORK TIMES\nBESTSELLER by Ann Brown"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    plan = entry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("regexp_") + plan.count("RLIKE")


def test_penalty_normalises_a_line_once(spark, tmp_path):
    assert regexes(spark, tmp_path, "generic_penalty") < 20


def test_line_classes_normalise_a_line_once(spark, tmp_path):
    assert regexes(spark, tmp_path, "classified_lines") < 20


def test_penalties_of_odd_lines(spark, tmp_path):
    lines = ["The Book", "", "  ", "Introduction", "essentials of\tthe  story", "it", "Ünal's guide", "anthology principles fundamentals", "a_b", "novel", "Complete  Guide", "of the", "x 1 2 3"]
    got, want = both(spark, tmp_path, "generic_penalty", documents=([(1, "\n".join(lines)), (2, None)], "doc_id long, text string"))
    assert got == want


def test_one_file_is_dealt_over_tasks(spark, tmp_path):
    from tomelake.plans import tables

    spark.createDataFrame([(i, "a\nb") for i in range(100)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = tables.lines(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 4


def test_likeness_by_bounded_edits_is_that_by_all(spark):
    r = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", "a"), ("ab", "abc"), ("x" * 20, "x" * 17), ("x" * 20, "x" * 16)]
    for n in [6, 7, 13, 14, 20, 40, 60, 100] * 12:
        a = "".join(r.choice("acdefg") for _ in range(n))
        b = list(a)
        for _ in range(r.randint(0, max(1, n // 4))):
            i = r.randrange(len(b))
            b[i : i + 1] = r.choice([["h"], [], [b[i], "h"]]) or ["h"] if len(b) < 2 else r.choice([["h"], [], [b[i], "h"]])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(T.similar_forms(F.col("a"), F.col("b")).alias("new"), ((F.col("a") == F.col("b")) | (T.line_similarity(F.col("a"), F.col("b")) >= 0.85)).alias("old")).collect()
    assert [x["new"] for x in got] == [x["old"] for x in got]
    assert 20 < sum(x["new"] for x in got) < len(got) - 20


def test_many_long_lines_are_folded(spark):
    r = random.Random(5)
    plain = ["".join(r.choice(string.ascii_lowercase + " ") for _ in range(300)).strip() for _ in range(500)]
    rows = [(0, 0, 1.0, i, t, 0.5) for i, t in enumerate(plain)] + [(0, 1, 0.5, i, t[:100] + "!?" + t[103:], 0.9) for i, t in enumerate(plain[:100])]
    began = time.time()
    got = E.merge_lines(spark.createDataFrame(rows, "candidate_id int, crop_idx int, crop_score double, line_idx int, text string, confidence double")).first()
    assert time.time() - began < 40
    texts = [x["text"] for x in got["merged_lines"]]
    assert texts == [rows[500 + i][4] for i in range(100)] + plain[100:]


def test_evidence_normalises_an_array_once(spark, tmp_path):
    assert regexes(spark, tmp_path, "evidence_tokens") < 300


def test_evidence_lines_are_those_of_the_lines_as_they_are(spark):
    from tomelake.functions import evidence_lines as X

    rows = [(1, ["[NICHOLAS  SPARKS]", "  Ünal Æon! ", "$9.99", "THE LORD OF", "THE RINGS"]), (2, ["theGreat Gatsby", "J. K. Rowling"]), (3, [""])]
    df = X.with_evidence(spark.createDataFrame(rows, "i int, l array<string>"), "l")
    got = df.select("evidence_lines", X.clean_lines(F.col("l")).alias("want")).collect()
    assert all(r["evidence_lines"] == r["want"] for r in got)
    one = spark.createDataFrame(rows, "i int, l array<string>").select(X.normalize_lines(F.col("l")).alias("a"), F.transform("l", X.normalize_line).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in one)

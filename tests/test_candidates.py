"""Search candidates, hints and decisions' books on cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tomelake.functions import candidates as C

LINES = "l array<struct<text:string,confidence:double>>"


def test_candidates_are_ordered(spark):
    df = spark.createDataFrame([("the road first edition 978-0-7432-7356-5", 0.99, "usable", ["9780743273565"]), ("the road", None, "strong", []), ("x", 0.9, "strong", []), ("the road", 0.9, "unusable", ["1"])], "t string, c double, tier string, n array<string>")
    got = [[(x["query"], x["kind"], x["confidence"]) for x in r["v"]] for r in df.select(C.search_candidates(F.col("t"), F.col("c"), F.col("tier"), F.col("n")).alias("v")).collect()]
    # 0.99 * 0.85 goes before 0.95 * 0.85; without lines a text's confidence is 0.5.
    assert got == [[("the road 9780743273565", "merged", pytest.approx(0.8415)), ("9780743273565", "isbn", pytest.approx(0.8075))], [("the road", "merged", 0.5)], [], []]


def test_hints(spark):
    rows = [([("Stephen King", 0.9), ("The Stand", 0.95), ("A much longer subtitle line", 0.7)],), ([("by J. K. Rowling", 0.4), ("written by Ann Lee", 0.8)],), ([],), ([("12", 0.9), ("copyright 1999", 0.99)],)]
    got = spark.createDataFrame(rows, LINES).select(C.title_hint(F.col("l")).alias("t"), C.author_hint(F.col("l")).alias("a")).collect()
    # The form of a bare name asks for an initial between the two words, so "Stephen King" alone is none.
    assert [(r["t"], r["a"]) for r in got] == [("A much longer subtitle line", None), (None, "Ann Lee"), (None, None), (None, None)]
    named = spark.createDataFrame([([("Stephen M. King", 0.9), ("It", 0.95)],)], LINES)
    assert tuple(named.select(C.title_hint(F.col("l")), C.author_hint(F.col("l"))).first()) == ("It", "Stephen M. King")


def test_decisions(spark):
    one = spark.range(1).select(
        C.shown_books(F.lit("suggest"), F.lit("b"), F.array(F.lit("a")), F.array(F.lit("c"))).alias("s"), C.primary_book(F.lit("ambiguous"), F.lit("b"), F.array().cast("array<string>")).alias("p"),
        C.changes(F.lit(None).cast("string"), F.lit("x"), F.lit("t"), F.lit("x")).alias("same"), C.changes(F.lit("u"), F.lit(None).cast("string"), F.lit("t"), F.lit("x")).alias("new"),
        C.content_hash(F.array().cast("array<string>"), F.lit("")).alias("h"), C.ocr_only_fallback(F.lit(True), F.lit(""), F.lit("y")).alias("f"),
    ).first()
    assert (one["s"], one["p"], one["same"], one["new"], one["h"], one["f"]) == (["b", "a"], None, False, True, "empty-evidence", "ocr-only")
    left = C.without_keys(spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int"), spark.createDataFrame([("a",), ("a",), (None,)], "key string"))
    assert [tuple(r) for r in left.collect()] == [("b", 2)]

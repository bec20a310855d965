"""Works and rotations on cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tomelake.functions import works as W


def books(spark, rows):
    df = spark.createDataFrame([(rows,)], "b array<struct<title:string,authors:array<string>>>")
    return df.withColumn("w", F.transform("b", lambda x: W.work(x["title"], x["authors"])))


def test_works(spark):
    king = ["Stephen King"]
    rows = [("The Dark Tower", king), ("Dark Tower, The Dark Tower Notes", ["X"]), ("The Dark Tover (2003)", king), ("The Dark Tower: Stephen King summary", ["Y"]), ("It", king), ("It", ["Z"])]
    one = books(spark, rows).select(
        W.same_work(F.get("w", F.lit(0)), F.get("w", F.lit(2))).alias("same"), W.same_work(F.get("w", F.lit(0)), F.get("w", F.lit(4))).alias("other"), W.is_derived(F.get("w", F.lit(3)), F.get("w", F.lit(0))).alias("derived"),
        W.distinct_second(F.col("w")).alias("second"), W.best_spelled(F.col("w")).alias("best"),
    ).first()
    # The second title holds the first and speaks of notes; the third is one letter off; the fourth is a summary; "It" is the first other work.
    assert (one["same"], one["other"], one["derived"], one["second"], one["best"]) == (True, False, True, 4, 0)
    few = books(spark, rows[:1]).select(W.distinct_second(F.col("w")), W.best_spelled(F.col("w"))).first()
    assert tuple(few) == (None, 0)
    worse = books(spark, [("The Dark Tover", king), ("The Dark Tower", king), ("The Dark Tower II", king)]).select(W.best_spelled(F.col("w"))).first()
    assert worse[0] == 1


def test_lines_are_deduplicated(spark):
    pairs = spark.createDataFrame([("The Road", "the road!"), ("abcdefghij", "abcdefghxx"), ("ab", "abcdefg"), ("", "x"), ("x", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(W.prefix_similarity(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0.8, 0.0, 0.0, 1.0])
    rows = [[("The Road", 0.5), ("Dune", 0.9), ("the road", 0.8), ("THE ROAD", 0.6)], []]
    df = spark.createDataFrame([(r,) for r in rows], "l array<struct<text:string,confidence:double>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(W.dedupe_lines(F.col("l"))).collect()] == [[("the road", 0.8), ("Dune", 0.9)], []]


def test_rotations_are_merged(spark):
    trials = [(0, 0.4, [("The Dark Tower of Long Names", 0.7), ("x", 0.9)]), (90, 0.9, [("by Stephen King", 0.8)]), (180, 0.1, [("The Dark Tower of Long Names", 0.99)])]
    schema = "t array<struct<rotation:int,quality:double,l:array<struct<text:string,confidence:double>>>>"
    df = spark.createDataFrame([(trials,), ([],)], schema).withColumn("e", F.transform("t", lambda x: F.struct(x["rotation"].alias("rotation"), x["quality"].alias("quality"), W.rotation_evidence(x["l"]).alias("e"))))
    chosen = F.array(F.struct(F.lit(" Own line ").alias("text"), F.lit(0.5).alias("confidence")))
    got = [r["m"] for r in df.select(W.merged_rotations(F.col("e"), F.lit(270), chosen).alias("m")).collect()]
    assert [tuple(x) for x in got[0]["lines"]] == [("by Stephen King", 0.8), ("The Dark Tower of Long Names", 0.7)]
    assert (got[0]["title_rotation"], got[0]["author_rotation"], got[0]["mixed"], got[0]["strategy"]) == (0, 90, True, "mixed_rotation")
    assert [tuple(x) for x in got[1]["lines"]] == [("Own line", 0.5)] and got[1]["strategy"] == "fallback_chosen" and got[1]["title_rotation"] == 270

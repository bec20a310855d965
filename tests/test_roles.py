"""Line roles, assembly and the swap guard on cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tomelake.functions import roles as R
from tomelake.functions import spine as P


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_name_and_title_scores(spark):
    # 0.35 + 0.15 for two to four words + 0.15 for capitals + 0.15 for an initial + 0.2 for the whole form, at most 1.
    assert values(spark, ["John M. Smith", "The Shining", "x", "Dr. Who", "1984"], P.score_as_name) == pytest.approx([1.0, 0.45, 0.0, 0.75, 0.1])
    assert values(spark, ["The Shining", "Stephen King", "1984", "x"], P.score_as_title) == pytest.approx([0.6, 0.25, 0.6, 0.0])
    assert [tuple(v) for v in values(spark, ["by Stephen King", "It by Stephen King", "Written by  X", "Abyss"], P.by_pattern)] == [(True, "Stephen King"), (True, "Stephen King"), (True, "X"), (False, None)]
    assert values(spark, ["DUNE", "Dune", "12"], P.caps_modifier) == [0.1, 0.0, 0.0]


def test_lines_are_taken_apart(spark):
    assert [tuple(v) for v in values(spark, ["Dune: Messiah", "Dune", ": x", "A - B: C"], P.subtitle)] == [("Dune", "Messiah"), ("Dune", None), (": x", None), ("A - B", "C")]
    assert values(spark, ["A B and C D", "A, B, C", "A with B", "A"], P.authors_of) == [["A B", "C D"], ["A", "B", "C"], ["A", "B"], ["A"]]
    got = values(spark, ["The Shining - Stephen King", "by Stephen King | It", "Dune", "a - b", "x / y / z"], P.split_combined)
    assert [v and tuple(v) for v in got] == [("The Shining", "Stephen King"), ("It", "Stephen King"), None, None, None]


def test_swaps(spark):
    row = spark.range(1).select(P.quick_swap(F.lit("Stephen King"), F.lit("The Shining")).alias("q"), P.swap_analysis(F.lit("The Shining"), F.lit("Stephen King")).alias("s")).first()
    assert (row["q"]["swap"], row["q"]["title"], row["q"]["author"]) == (True, "The Shining", "Stephen King") and row["q"]["confidence"] == pytest.approx(0.55)
    assert not row["s"]["detected"] and row["s"]["reason"] is None


def assembled(spark, lines):
    rows = [(0, [(i, t, p) for i, (t, p) in enumerate(lines)])]
    df = spark.createDataFrame(rows, "id int, lines array<struct<index:int,text:string,position:double>>")
    df = P.with_assembly(df.withColumn("labels", P.labels(F.col("lines"))), "labels")
    return df.withColumn("guarded", P.guarded(F.col("pairings"))).withColumn("quick", P.quick_assembly(F.transform("lines", lambda x: x["text"]))).first()


def test_assembly(spark):
    both = assembled(spark, [("The Shining - Stephen King", 0.7)])
    assert both["strategy"] == "combined_split" and both["pairings"][0]["title"]["full"] == "The Shining" and both["pairings"][0]["author"]["full"] == "Stephen King"
    apart = assembled(spark, [("The Girl Who Played with the Very Large Fire", 0.7), ("by John M. Smith", 0.3)])
    assert apart["strategy"] == "separate_lines" and apart["author"]["full"] == "John M. Smith" and apart["author"]["method"] == "by_pattern"
    assert tuple(apart["quick"]) == ("The Girl Who Played with the Very Large Fire", "John M. Smith")
    none = assembled(spark, [])
    assert none["strategy"] == "none" and none["pairings"] == [] and none["guarded"] == [] and none["title"] is None


def test_roles(spark):
    got = values(spark, ["STEPHEN KING", "THE DARK TOWER", "", "BANTAM"], R.role)
    # Person: 0.5 + 0.2 letters + 0.2 capitals + 0.15 + 0.15 names; title: 0.5 - 0.4 for names.
    assert [(r["person"], r["title"], r["role"]) for r in got] == [(1.0, pytest.approx(0.1), "author"), (pytest.approx(0.35), 1.0, "title"), (0.0, 0.0, "ambiguous"), (pytest.approx(0.4), 0.0, "author")]
    assert values(spark, ["THE DARK TOWER", "STEPHEN KING", "DARK NIGHT", "A MAN"], R.rejects_as_author) == [True, False, True, True]


def test_titles_are_joined(spark):
    df = spark.createDataFrame([(["DARK", "TOWER RISING", "STEPHEN KING", "THE", "SHINING"],)], "l array<string>")
    titles = df.select(R.joined_titles(F.col("l"), R.BRIDGES).alias("t")).first()["t"]
    assert {(t["text"], t["reason"]) for t in titles} == {("DARK TOWER RISING", "adjacent_title_lines"), ("THE SHINING", "adjacent_title_lines"), ("THE SHINING", "stopword_bridge:THE")}
    assert [t["score"] for t in titles] == sorted((t["score"] for t in titles), reverse=True)
    over = df.select(R.person_override(F.lit("STEPHEN KING"), R.joined_titles(F.col("l"), R.BRIDGES)).alias("o"), R.person_override(F.lit("THE DARK"), R.joined_titles(F.col("l"), R.BRIDGES)).alias("n")).first()
    assert over["o"]["overrides"] and not over["n"]["overrides"] and over["n"]["reason"] == "not_person_like_role"

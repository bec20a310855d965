"""Line cleaning, evidence tokens, the line filter and record projections on cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tomelake.functions import evidence_lines as E
from tomelake.functions import line_filter as LF
from tomelake.functions import records as R
from tomelake.operators import catalog as C
from tomelake.streaming import limits as L


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def lines(spark, rows, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t array<string>")
    return [r["v"] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_lines_are_normalised(spark):
    got = values(spark, ["[NICHOLAS  SPARKS]", "  Ünal Æon! ", '"(The Shining"', "--", "don't", ""], E.normalize_line)
    assert [(r["original"], r["normalized"], r["wrapped"]) for r in got] == [
        ("NICHOLAS SPARKS", "nicholas sparks", True), ("Unal AEon", "unal aeon", False), ("The Shining", "the shining", False), ("", "", False), ("don't", "don't", False), ("", "", False),
    ]
    assert values(spark, ["theGreat Gatsby", "abCd", "McDonald"], E.split_joined) == ["the Great Gatsby", "abCd", "McDonald"]


def test_noise_is_cut_out(spark):
    assert values(spark, ["PENGUIN The Road $9.99", "ISBN: 9780743273565", "us $12 Dune", "us12 Dune", "Random House", "*** a"], E.strip_embedded_noise) == ["The Road", "9780743273565", "us Dune", "Dune", "", "a"]
    assert values(spark, ["fiction", "printed in china", "$12", "x", "staff picks", "can)", "the road", "12.5"], E.is_noise) == [True] * 6 + [False, True]
    assert values(spark, ["new york times bestseller dune", "killing floor", "hardcover", "work"], E.is_marketing) == [True, False, True, True]
    assert values(spark, ["#1 New York Times Bestseller DUNE", "A NOVEL of war", "over and over", "plain"], E.remove_marketing) == ["#1 DUNE", "of war", "and", "plain"]


def test_split_lines_are_merged(spark):
    rows = [["THE LORD OF", "THE RINGS"], ["under-", "ground"], ["LISA", "JACKSON", "Night"], ["A", "B"], ["only one "], [" ", "x y"], ["J", "MARK", "TWAIN", "ANNE", "RICE", "the end"], ["of", "the", "and"]]
    assert lines(spark, rows, E.merge_split_lines) == [
        ["THE LORD OF THE RINGS"], ["underground"], ["LISA JACKSON Night", "LISA", "JACKSON", "Night"], ["A", "B"], ["only one "], ["x y"],
        ["J", "MARK TWAIN ANNE", "MARK", "TWAIN", "ANNE", "RICE", "the end"], ["of", "the and"],
    ]


def test_tokens(spark):
    got = values(spark, ["the road's 'end' 1984 9780743273565 x ''", "mystery night"], lambda c: F.array_join(E.tokens(c), "|"))
    assert got == ["the|road's|end|9780743273565", "mystery|night"]
    assert values(spark, ["mystery night night 12", "THE BOOK"], lambda c: F.array_join(E.tokens_from_text(c), "|")) == ["night", "the|book"]
    assert values(spark, ["The Story of Dune", "Gone", "The Book", "Gone Girl"], E.is_generic_title) == [False, True, True, False]
    assert values(spark, ["isbn 978-0-7432-7356-5", "0 306 40615 x", "12"], E.line_isbn) == ["9780743273565", "030640615X", None]


def test_names_and_titles(spark):
    names = ["STEPHEN KING", "J. K. Rowling", "The Road", "Random House", "nGAIO MARSH", "one", "ab c1 de", "made in china"]
    assert values(spark, names, E.looks_like_person) == [True, True, False, False, True, False, False, False]
    assert values(spark, ["The Road", "Stephen King", "Gone", "A long title here", "the new york times"], E.looks_like_title) == [True, False, False, True, False]


def test_evidence_of_a_spine(spark):
    df = spark.createDataFrame([(1, ["[NICHOLAS SPARKS]", "The Notebook", "PENGUIN", "$9.99", "#1 bestseller"]), (2, ["THE SHINING STEPHEN KING", "GRISHAM"]), (3, [])], "i int, l array<string>")
    got = {r["i"]: r for r in E.with_recovered_authors(E.with_evidence(df, "l")).collect()}
    assert got[1]["cleaned"] == ["NICHOLAS SPARKS", "The Notebook"] and got[1]["tokens"] == ["nicholas", "sparks", "the", "notebook"]
    assert got[1]["title_lines"] == ["The Notebook"] and got[1]["person_lines"] == ["NICHOLAS SPARKS"]
    authors = {i: [(a["line"], a["confidence"], a["reason"]) for a in r["recovered_authors"]] for i, r in got.items()}
    assert authors[1] == [("NICHOLAS SPARKS", 0.9, "bracketed_author_name")]
    # The pattern of a middle initial ignores case, so it reads one into the surname.
    assert authors[2] == [("STEPHEN K. ING", 0.55, "extracted_from_merged_line_middle_initial"), ("GRISHAM", 0.45, "single_word_surname_candidate")]
    assert got[2]["title_lines"] == ["THE SHINING STEPHEN KING"] and got[2]["person_lines"] == []
    assert got[3]["tokens"] == [] and got[3]["recovered_authors"] == []


def test_lines_are_filtered(spark):
    texts = ["x", "ISBN 978-0-7432-7356-5", "$ 9.99", "www.example.com", "© 1999", "all rights reserved", "12345678", "1999", "a1234", "2nd edition", "Viking Press", "del rey", "library", "Thomas", "Dune", "y" * 151]
    reasons = ["too_short", "isbn", "price", "url", "copyright", "copyright", "barcode", "year_only", "numeric_heavy", "edition", "publisher", "publisher", "publisher_token", None, None, "too_long"]
    assert values(spark, texts, LF.other_reason) == reasons
    assert values(spark, ["Thomas"], lambda c: LF.other_reason(c, F.lit(True))) == ["publisher_name_context"]
    assert values(spark, ["Dunne Books", "road"], LF.speaks_of_publisher) == [True, False]


def test_query_hash_follows_double_arithmetic(spark):
    def model(text):
        h = 2166136261
        for ch in text:
            signed = h - (1 << 32) if h >= 1 << 31 else h
            x = signed ^ ord(ch)
            x = x - (1 << 32) if x >= 1 << 31 else x
            h = int(float(x) * 16777619.0) % (1 << 32)
        return f"{h:x}"

    texts = ["the shining", "", "A Long Title With MANY words and 123 numbers", "x"]
    assert values(spark, texts, lambda c: R.query_hash(F.lit("text"), c)) == [model("text:" + t.strip().lower()) for t in texts]


def test_search_query_takes_the_surest_lines(spark):
    rows = [[("The Road", 0.9), ("copyright 1999", 0.99), ("x", 0.9), ("Cormac first edition", 0.8), ("low", 0.4), ("a b c", 0.9)]]
    df = spark.createDataFrame([(r,) for r in rows], "l array<struct<text:string,confidence:double>>")
    assert df.select(R.search_query(F.col("l"))).first()[0] == "the road cormac"


@pytest.mark.parametrize(("args", "expected"), [((0, 0, 0), "skip_no_rejects"), ((10, 1, 9), "proceed_fix"), ((10, 0, 8), "ocr_pipeline_first"), ((10, 0, 7), "manual_investigation")])
def test_recommendation(spark, args, expected):
    assert spark.range(1).select(R.recommendation(*map(F.lit, args))).first()[0] == expected


def test_corrections_survive_export_and_import(spark):
    rows = [("isbn:1", "h", "T", "A"), ("hash:2", None, "ü\"x", None)]
    df = spark.createDataFrame(rows, "key string, content_hash string, title string, author string")
    out = C.export_corrections(df)
    back = C.import_corrections(out, "content_hash string, title string, author string")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    both = spark.createDataFrame([('{"a":{"title":"x"},"b":{"title":"y"}}',), ("broken",)], "json string")
    assert C.import_corrections(both, "title string").count() == 2
    kept = C.correction_rows(spark.createDataFrame([("isbn:1", "h", "T", "A"), ("", None, "T", "")], df.schema)).collect()
    assert len(kept) == 1 and kept[0]["authors"] == ["A"]


def test_session_cache_is_refreshed_only_by_misses(spark):
    minute = 60_000
    rows = [(1, "a", 0), (2, "a", 20 * minute), (3, "a", 31 * minute), (4, "a", 60 * minute), (5, "b", 60 * minute)]
    got = {r["id"]: r["hit"] for r in L.session_cache(spark.createDataFrame(rows, "id long, k string, ms long"), ["k"], "ms", "id").collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False}

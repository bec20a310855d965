"""Fields of lines and the whole token-set score on cases worked by hand."""

import pytest
from pyspark.sql import functions as F

from tomelake.functions import fields as D
from tomelake.functions import text as T


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", build(F.col("t")).alias("v")).orderBy("i").collect()]


def test_fields(spark):
    assert [[tuple(x)[:2] for x in v] for v in values(spark, ["ISBN 978-0-7432-7356-5", "0-306-40615-2 and 9780306406157", "978-0-7432-7356-6"], D.isbns)] == [[("9780743273565", "isbn13")], [("9780306406157", "isbn13"), ("9780306406157", "isbn10")], []]
    got = values(spark, ["Random House, New York", "Viking Press", "published by Faber; 1999", "Dune"], lambda c: D.publishers(c, F.lit(1.0)))
    assert [[(x["value"], x["method"]) for x in v] for v in got] == [[("Random House", "known-publisher")], [("Viking Press", "keyword")], [("Faber", "pattern")], []]
    editions = values(spark, ["2nd Edition", "First edition", "a reprint", "3. baskı", "Dune", "edition 12"], D.edition)
    assert [v and (v["number"], v["type"]) for v in editions] == [(2, "numbered"), (1, "numbered"), (None, "reprint"), (3, "numbered"), None, (12, "numbered")]
    years = values(spark, ["© 1999, first edition 2001, 1999", "published 1850 and 2031", "12345"], D.years)
    assert [[tuple(x) for x in v] for v in years] == [[(1999, "copyright"), (2001, "edition")], [(1850, "publisher")], []]
    assert values(spark, ["Stephen King", "The Road", "Dr. X. Y", "x"], D.person_score) == pytest.approx([0.7, 0.4, 0.95, 0.0])
    assert values(spark, ["The Road", "Dune", "It"], D.title_score) == pytest.approx([0.65, 0.3, 0.3])
    assert values(spark, ["İSTANBUL Şık"], D.normalize_turkish) == ["istanbul sik"]


def test_token_set_score(spark):
    rows = [("Stephen King Shining", "The Shining", ["Stephen King"], False), ("home alone", "Home", ["Nora Roberts"], False), ("nothing here", "Dune", ["Frank Herbert"], True), ("", "", [], False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e string, t string, a array<string>, isbn boolean")
    got = [r["s"] for r in df.select("i", T.token_set_score(F.col("e"), F.col("t"), F.col("a"), F.col("isbn")).alias("s")).orderBy("i").collect()]
    # Evidence has three tokens, the candidate four ("the" is kept): precision 1, recall 3/4.
    assert (got[0]["overlap"], got[0]["signal"]) == (3, True) and got[0]["f1"] == pytest.approx(2 * 0.75 / 1.75) and got[0]["score"] == pytest.approx(got[0]["f1"])
    # One match of two and of three tokens: F1 0.4, less 0.15 for the generic title, capped at 0.1 for one match.
    assert got[1]["generic"] and got[1]["weak"] and got[1]["score"] == pytest.approx(0.1)
    assert got[2]["overlap"] == 0 and got[2]["score"] == pytest.approx(0.1)
    assert got[3]["score"] == 0.0

"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from tomelake.sources import readers as R


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.1 0.1 0.3 0.1 0.3 0.2 0.1 0.2\nshort line\n\n0 0.5 0.5 0.6 0.5 0.6 0.9 0.5 0.9")
    rows = {r["line_no"]: r for r in R.read_label_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {0, 3}
    assert (round(rows[0]["cx"], 6), round(rows[0]["width"], 6), round(rows[0]["height"], 6)) == (128.0, 128.0, 64.0)
    assert rows[3]["width"] > rows[3]["height"]
    lines = spark.createDataFrame([("f", 0, "64 0 128 0 128 64 64 64 spine 0"), ("f", 1, "1 2")], "file string, line_no int, value string")
    assert [r["value"] for r in R.convert_labels(lines).collect()] == ["0 0.100000 0.000000 0.200000 0.000000 0.200000 0.100000 0.100000 0.100000"]


def test_search_docs(spark):
    docs = ['{"key": "k", "title": "T", "isbn": ["bad", "0-306-40615-2", "9780306406157"], "publish_year": [1999], "edition_count": 3, "subject": ["a","b","c","d","e","f"]}', "not json", None]
    rows = R.books_of_search_docs(spark.createDataFrame(list(enumerate(docs)), "i int, doc string")).orderBy("i").collect()
    assert (rows[0]["isbn13"], rows[0]["isbn10"], rows[0]["publish_year"], rows[0]["edition"], len(rows[0]["subjects"])) == ("9780306406157", "0306406152", 1999, "3 editions", 5)
    assert rows[1]["title"] is None and rows[2]["authors"] == []


@pytest.mark.parametrize("kind", R.FORMATS)
def test_formats_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    R.write_table(df, str(tmp_path / kind), kind)
    back = R.read_table(spark, str(tmp_path / kind), kind, "id int, name string")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        R.read_table(spark, "x", "json")


def test_reject_export(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "reject"), ("s", 2, "accept")], "session_id string, candidate_id int, decision string")
    counts = {(r["session_id"], r["decision"]): r["n"] for r in R.export_rejects(rows, str(tmp_path / "r")).collect()}
    assert counts == {("s", "reject"): 1, ("s", "accept"): 1}
    assert spark.read.json(str(tmp_path / "r")).filter(F.col("session_id") == "s").count() == 1

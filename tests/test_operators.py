"""Table operators against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tomelake.functions import text as T
from tomelake.operators import catalog as C
from tomelake.operators import detections as X
from tomelake.operators import evidence as E
from tomelake.operators import search as SE
from tomelake.operators import stats as ST
from tomelake.operators.components import connected_components
from tomelake.streaming import limits as LI


def grams(text):
    return {("  " + w + " ")[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() for i in range(len(w) + 1)}


def test_search_many_finds_what_comparing_all_finds(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 6)))
    books = [(i, f"{word()} {word()}") for i in range(120)]
    queries = [(i, f"{word()} {word()}") for i in range(40)] + [(99, "")]
    found = SE.search_many(spark.createDataFrame(books, "id long, title string"), spark.createDataFrame(queries, "query_id long, query string"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    expected = {}
    for q, text in queries:
        g = grams(text)
        scored = [(len(g & grams(t)) / len(g | grams(t)), i) for i, t in books if g | grams(t)]
        for rank, (_, i) in enumerate(sorted([(-s, i) for s, i in scored if s >= 0.3])[:5]):
            expected[q, rank + 1] = i
    assert got == expected


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 4), (4, 1), (20, 11)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1}
    assert {got[i] for i in (10, 11, 20)} == {10}
    assert {got[i] for i in range(100, 141)} == {100}
    assert 5 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fuzzy_fold_depends_on_order(spark):
    lines = [("The Great Gatsby", 0.5), ("The Great Gatsbv", 0.9), ("Fitzgerald", 0.7), ("the great gatsby!", 0.6)]
    rows = spark.createDataFrame([(lines,)], "l array<struct<text:string,confidence:double>>")
    kept = rows.select(E.fold_similar_lines(F.col("l")).alias("k")).first()["k"]
    assert [(k["text"], k["confidence"]) for k in kept] == [("The Great Gatsbv", 0.9), ("Fitzgerald", 0.7)]
    empty = spark.createDataFrame([([],)], "l array<struct<text:string,confidence:double>>")
    assert empty.select(E.fold_similar_lines(F.col("l")).alias("k")).first()["k"] == []


def test_upsert_keeps_what_is_missing(spark):
    columns = "id string, provider string, provider_id string, title string, authors array<string>, publisher string"
    old = spark.createDataFrame([("x", "p", "1", "Old", ["A"], "Pub")], columns)
    new = spark.createDataFrame([("p", "1", "New", ["B"], "", 1), ("p", "2", "Two", ["C"], "P2", 1), ("p", "2", "Two!", None, None, 2)], "provider string, provider_id string, title string, authors array<string>, publisher string, seq int")
    rows = {r["provider_id"]: r for r in C.upsert_books(old, new).collect()}
    assert (rows["1"]["id"], rows["1"]["title"], rows["1"]["publisher"]) == ("x", "New", "Pub")
    assert (rows["2"]["title"], rows["2"]["publisher"]) == ("Two!", "P2")


def test_box_overlap():
    square = (0.0, 0.0, 10.0, 10.0, 0.0)
    assert X.box_iou(square, square) == pytest.approx(1)
    assert X.box_iou(square, (50.0, 0.0, 10.0, 10.0, 0.0)) == 0
    assert 0.30 < X.box_iou(square, (5.0, 0.0, 10.0, 10.0, 0.0)) < 0.36
    assert X.box_iou((0, 0, 20, 10, 0.5), (0, 0, 20, 10, 0.5)) == pytest.approx(1)


def test_suppression(spark):
    rows = [(1, i, 100.0 + i, 100.0, 50.0, 10.0, 0.0, 0.9 - i / 100) for i in range(3)] + [(1, 9, 400.0, 400.0, 50.0, 10.0, 0.0, 0.3), (2, 0, 1.0, 1.0, 5.0, 1.0, 0.0, 0.5)]
    detections = spark.createDataFrame(rows, "session_id long, det_idx int, cx double, cy double, width double, height double, angle double, score double")
    kept = {(r["session_id"], r["det_idx"]) for r in X.suppress(detections).collect()}
    assert kept == {(1, 0), (1, 9), (2, 0)}
    soft = X.soft_nms([r[2:7] for r in rows[:4]], [r[7] for r in rows[:4]])
    assert [i for i, _ in soft][0] == 0 and len(soft) == 4 and soft[-1][1] < 0.3
    counts = {r["session_id"]: (r["tp"], r["fp"], r["fn"]) for r in X.match_predictions(detections, detections.filter("det_idx in (0, 9)")).collect()}
    assert counts == {1: (2, 2, 0), 2: (1, 0, 0)}


def test_grouping_falls_back_for_a_whole_session(spark):
    box = lambda s, i, x: (s, i, x, 100.0, 50.0, 50.0, 0.0, 0.5)
    rows = [box(1, 0, 100.0), box(1, 1, 101.0), box(1, 2, 300.0)] + [box(2, i, 100.0 + i) for i in range(4)] + [box(2, 7, 500.0)]
    detections = spark.createDataFrame(rows, "session_id long, det_idx int, cx double, cy double, width double, height double, angle double, score double")
    texts = spark.createDataFrame([], "session_id long, det_idx int, full_text string")
    groups = X.group_detections(detections, X.merge_pairs(detections, texts)).collect()
    assert sorted(g["det_indices"] for g in groups if g["session_id"] == 1) == [[0, 1], [2]]
    assert sorted(g["det_indices"] for g in groups if g["session_id"] == 2) == [[0], [1], [2], [3], [7]]


def test_percentiles_take_the_floor_index(spark):
    rng = random.Random(2)
    values = [float(rng.randint(0, 20)) for _ in range(101)]
    got = ST.exact_percentiles(spark.createDataFrame([(1, v) for v in values], "g int, v double"), "v", [0, 10, 50, 99, 100], ["g"]).first()
    s = sorted(values)
    assert [got[f"p{p}"] for p in (0, 10, 50, 99, 100)] == [s[int(p / 100 * (len(s) - 1))] for p in (0, 10, 50, 99, 100)]


def test_rate_limit_window_begins_with_the_first_request(spark):
    events = [("a", i, i * 100) for i in range(40)] + [("a", 100, 60_001), ("b", 200, 5)]
    rows = {r["event_id"]: (r["allowed"], r["remaining"]) for r in LI.limit_rates(spark.createDataFrame(events, "client string, event_id long, ms long")).collect()}
    assert rows[29] == (True, 0) and rows[30] == (False, 0)
    assert rows[100] == (True, 29) and rows[200] == (True, 29)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    events = spark.createDataFrame([(rng.randint(0, 2), i, i * 900) for i in range(300)], "client long, event_id long, ms long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = LI.limit_rates_stream(stream).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: {(r["event_id"], r["allowed"]) for r in df.collect()}
    assert key(spark.table("limited")) == key(LI.limit_rates(events))


def test_cache_states(spark):
    cache = spark.sql("select 'p' provider, 't' query_type, k query_hash, j response_json, e expires_at from values ('1', '{}', timestamp'2024-02-01'), ('2', '{\"__cache_miss\":true}', timestamp'2024-02-01'), ('3', '{}', timestamp'2024-01-01') as v(k, j, e)")
    asked = spark.sql("select 'p' provider, 't' query_type, k query_hash from values ('1'), ('2'), ('3'), ('4') as v(k)")
    found = {r["query_hash"]: r["state"] for r in C.lookup_cache(asked, cache, F.lit("2024-01-15").cast("timestamp")).collect()}
    assert found == {"1": "hit", "2": "known_miss", "3": "miss", "4": "miss"}


def test_entry_point_has_all_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60
    assert T.FOLD_FROM and len(T.FOLD_FROM) == len(T.FOLD_TO)


def test_merged_evidence_takes_all_documents_and_whole_lines(spark, tmp_path):
    from tomelake.plans import registry

    words = lambda i: " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest()[:6] for k in range(9))
    texts = {i: words(i) for i in range(1500)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["candidate_id"]: (r["n_lines"], r["text_sha256"]) for r in registry.queries()["merged_evidence"](spark, str(tmp_path)).collect()}
    assert len(got) == 500
    for c in range(500):
        order = sorted(range(3 * c, 3 * c + 3), key=lambda i: (-(len(texts[i]) % 10), -(i % 7), i))
        assert got[c] == (3, hashlib.sha256("\n".join(texts[i] for i in order).encode()).hexdigest())

"""Queries of record projections, attempts, corrections, rejects and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import records as R
from tomelake.operators import catalog as C
from tomelake.streaming import limits as L

from . import sql as S
from . import tables as B
from .sql import q, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELDS = ["title", "authors", "isbn13", "isbn10", "publisher", "publish_year", "cover_url", "source", "source_id"]


def _parts(spark, sf_dir):
    """Parts with made-up numbers, dates and pictures."""
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    rows = part.join(B.isbns(spark, sf_dir), "id")
    number, k = F.col("id").cast("string"), F.col("id") % 4
    date = F.when(k == 0, F.concat((F.col("id") % 1100 + 1000).cast("string"), F.lit("-05"))).when(k == 1, F.concat(F.lit("May "), (F.col("id") % 80 + 1950).cast("string"))).when(k == 2, "c2001x")
    return rows.withColumns({"number": number, "date": date, "picture": F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("http://i/"), number))})


_PARTS = f"""{S.ISBNS}, rows AS (
  SELECT p_partkey AS id, p_name, p_brand, p_type, isbn13, isbn10, p_partkey::VARCHAR AS number,
    CASE id % 4 WHEN 0 THEN (id % 1100 + 1000)::VARCHAR || '-05' WHEN 1 THEN 'May ' || (id % 80 + 1950)::VARCHAR WHEN 2 THEN 'c2001x' END AS date,
    CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://i/' || id END AS picture
  FROM part JOIN isbns ON p_partkey = id)"""


def provider_books(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    identifier = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("identifier"))
    volume = F.struct(
        F.col("number").alias("id"),
        F.struct(
            F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("publisher"), F.col("date").alias("publishedDate"),
            F.array(identifier("ISBN_13", F.col("isbn13")), identifier("ISBN_10", F.col("isbn10"))).alias("industryIdentifiers"),
            F.struct(F.col("picture").alias("thumbnail"), F.concat(F.lit("http://s/"), "number").alias("smallThumbnail")).alias("imageLinks"),
        ).alias("volumeInfo"),
    )
    one = lambda c: F.array(F.col(c))
    none = F.lit(None).cast("array<string>")
    by = F.when(F.col("id") % 2 == 0, F.col("isbn13")).otherwise(F.col("isbn10"))
    kinds = {
        "volume": R.volume_to_book(F.from_json(F.to_json(volume), R.VOLUME)),
        "isbn_response": R.isbn_response_to_book(F.col("p_name"), F.when(F.col("id") % 3 == 0, one("isbn13")), none, one("p_type"), F.col("date"), F.array(F.col("id") % 5), F.when(F.col("id") % 7 > 0, F.col("number")), by),
        "catalog_row": R.catalog_row_to_book(F.when(F.col("id") % 2 == 0, "googleBooks").otherwise("other"), F.col("number"), F.col("isbn13"), F.col("isbn10"), F.col("p_name"), one("p_brand"), F.col("p_type"), F.col("date"), F.col("picture")),
        "match": R.match_to_book(F.col("p_name"), one("p_brand"), by, F.col("p_type"), F.col("date"), F.col("picture"), F.lit("m"), F.col("number")),
    }
    every = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("book")) for k, v in kinds.items()])
    out = rows.select("id", F.explode(every).alias("x")).select("id", "x.kind", "x.book.*")
    return out.withColumn("authors", F.array_join("authors", "|")).withColumn("key", R.volume_resolver_key(F.col("isbn13"), F.col("isbn10"), F.col("source_id")))


def _bare(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^0-9Xx]', '', 'g'))"


QUERIES["provider_books"] = provider_books
_YEAR = "nullif(regexp_extract(date, '(?:^|[^A-Za-z0-9_])(1[0-9]{3}|20[0-2][0-9])(?:[^A-Za-z0-9_]|$)', 1), '')"
_BY = "CASE WHEN id % 2 = 0 THEN isbn13 ELSE isbn10 END"
ORACLES["provider_books"] = f"""WITH {_PARTS},
books AS (
  SELECT id, 'volume' AS kind, p_name AS title, p_brand AS authors, {_bare('isbn13')} AS isbn13, {_bare('isbn10')} AS isbn10, p_type AS publisher, {_YEAR} AS publish_year,
    regexp_replace(coalesce(nullif(picture, ''), 'http://s/' || number), '^http://', 'https://') AS cover_url, 'googleBooks' AS source, number AS source_id FROM rows
  UNION ALL SELECT id, 'isbn_response', p_name, '', CASE WHEN id % 3 = 0 THEN {_bare('isbn13')} WHEN id % 2 = 0 THEN {_bare('isbn13')} END, CASE WHEN id % 2 = 1 THEN {_bare('isbn10')} END, p_type,
    nullif(regexp_extract(date, '[0-9]{{4}}'), ''), CASE WHEN id % 5 <> 0 THEN '{R.COVER}' || (id % 5) || '-M.jpg' END, 'openLibrary', CASE WHEN id % 7 > 0 THEN number ELSE '/isbn/' || {_bare(_BY)} END FROM rows
  UNION ALL SELECT id, 'catalog_row', p_name, p_brand, isbn13, isbn10, p_type, nullif(regexp_extract(date, '^[0-9]+'), ''), picture, CASE WHEN id % 2 = 0 THEN 'googleBooks' ELSE 'openLibrary' END, number FROM rows
  UNION ALL SELECT id, 'match', p_name, p_brand, CASE WHEN id % 2 = 0 THEN regexp_replace(isbn13, '-', '', 'g') END, CASE WHEN id % 2 = 1 THEN isbn10 END, p_type, date, picture, 'm', number FROM rows)
SELECT *, CASE WHEN coalesce(isbn13, '') <> '' THEN 'isbn:' || isbn13 WHEN coalesce(isbn10, '') <> '' THEN 'isbn:' || isbn10 ELSE 'googleBooks:' || source_id END AS key FROM books"""


def query_hashes(spark, sf_dir):
    rows = B.read(spark, sf_dir, "part")
    return rows.select("p_partkey", R.query_hash(F.lit("text"), F.concat(F.lit(" "), "p_name")).alias("text_hash"), R.query_hash(F.lit("isbn"), F.col("p_partkey").cast("string")).alias("isbn_hash"))


def _fnv(x: str) -> str:
    signed = "(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)"
    step = f"((((xor({signed}, c))::DOUBLE * 16777619.0)::BIGINT % 4294967296) + 4294967296) % 4294967296"
    return f"lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, c: {step}), 16))"


QUERIES["query_hashes"] = query_hashes
ORACLES["query_hashes"] = f"SELECT p_partkey, {_fnv(chr(39) + 'text:' + chr(39) + ' || lower(p_name)')} AS text_hash, {_fnv(chr(39) + 'isbn:' + chr(39) + ' || p_partkey')} AS isbn_hash FROM part"


def search_queries(spark, sf_dir):
    """Lines get a made-up confidence."""
    docs = B.read(spark, sf_dir, "documents").filter("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), ((F.col("doc_id") * 7 + i * 13) % 100 / 100).alias("confidence")))
    return docs.select("doc_id", R.search_query(lines).alias("query"))


QUERIES["search_queries"] = search_queries
ORACLES["search_queries"] = f"""WITH {S.LINES},
good AS (SELECT doc_id, line_idx, {S.strip('line')} AS t, ((doc_id * 7 + line_idx * 13) % 100) / 100 AS confidence FROM lines
  WHERE ((doc_id * 7 + line_idx * 13) % 100) / 100 > 0.5 AND length({S.comparison('line')}) >= 2 AND NOT ({' OR '.join(f'regexp_matches(line, {q(p)})' for p in R.SKIPPED_LINES)})),
best AS (SELECT doc_id, string_agg(t, ' ' ORDER BY confidence DESC, line_idx) AS raw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, line_idx) AS r FROM good) WHERE r <= 5 GROUP BY doc_id)
SELECT d.doc_id, array_to_string(list_filter({S.comparison_tokens("coalesce(raw, '')")}, lambda x: x NOT IN {words(R.QUERY_NOISE)} AND length(x) > 1), ' ') AS query
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id WHERE text IS NOT NULL"""

QUERIES["pairing_problems"] = lambda spark, sf_dir: B.read(spark, sf_dir, "part").select(
    "p_partkey", R.pairing_problem(F.col("p_name"), F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 1, F.split("p_name", " ")[0]).when(F.col("p_partkey") % 5 == 2, F.concat("p_name", F.lit(" "), "p_brand")).otherwise(F.col("p_brand"))).alias("problem")
)
ORACLES["pairing_problems"] = """WITH x AS (SELECT p_partkey, trim(lower(p_name)) AS t,
  trim(lower(CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN string_split(p_name, ' ')[1] WHEN 2 THEN p_name || ' ' || p_brand ELSE p_brand END)) AS a FROM part)
SELECT p_partkey, CASE WHEN t = a THEN 'title_and_author_identical' WHEN length(a) > 3 AND contains(t, a) THEN 'author_contained_in_title'
  WHEN length(t) > 3 AND contains(a, t) THEN 'title_contained_in_author' END AS problem FROM x"""

_MARKS = ["FORVOUR", "NGRIO", "CRANKIN", "x ONF y", "MACDO", "VISICA", "my jovi", "A\nFALLS\nB", "BERK! x", "DEAD J. SMITH", "oystery", "plain"]


def _rejects(spark, sf_dir):
    """Rejected candidates made of orders: text, reason, hypotheses, queries and top score."""
    k = F.col("o_orderkey")
    marks = F.array(*[F.lit(m) for m in _MARKS])
    reasons = F.array(*[F.lit(r) for r in _REASONS])
    return B.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("payload"), F.when(k % 6 == 0, "a1").otherwise(F.element_at(marks, (k % len(_MARKS) + 1).cast("int"))).alias("text"),
        F.element_at(reasons, (F.col("o_custkey") % len(_REASONS) + 1).cast("int")).alias("reason"), (k % 3).alias("hypotheses"), (F.col("o_custkey") % 2).alias("queries"), (k % 100 / 100.0).alias("top_score"),
    )


_REASONS = ["low_title_confidence", "No candidates found ", "no_evidence", "", "OCR failed", "other", "manual_review: x"]
_REJECTS = f"""rejects AS (SELECT o_orderkey AS id, o_custkey % 40 AS payload, CASE WHEN o_orderkey % 6 = 0 THEN 'a1' ELSE {S.array(_MARKS)}[o_orderkey % {len(_MARKS)} + 1] END AS text,
  {S.array(_REASONS)}[o_custkey % {len(_REASONS)} + 1] AS reason, o_orderkey % 3 AS hypotheses, o_custkey % 2 AS queries, (o_orderkey % 100) / 100.0 AS top_score FROM orders)"""


def reject_issues(spark, sf_dir):
    rows = _rejects(spark, sf_dir).select("id", F.explode(R.issues(F.col("text"), F.col("hypotheses"), F.col("top_score"))).alias("x")).select("id", "x.*")
    return rows.groupBy("category", "issue").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


QUERIES["reject_issues"] = reject_issues
_FOUND = " UNION ALL ".join(f"SELECT id, {q(c)} AS category, {q(i)} AS issue FROM rejects WHERE regexp_matches(text, {q(p)})" for c, p, i in R.ISSUES)
ORACLES["reject_issues"] = f"""WITH {_REJECTS}, found AS ({_FOUND}
  UNION ALL SELECT id, 'NO_HYPOTHESES', 'No hypotheses generated' FROM rejects WHERE hypotheses = 0
  UNION ALL SELECT id, 'LOW_SCORE', 'Top score too low: ' || printf('%.2f', top_score::DOUBLE) FROM rejects WHERE top_score > 0 AND top_score < 0.5)
SELECT category, issue, count(*) AS n, min(id) AS first FROM found GROUP BY ALL"""


def reject_triage(spark, sf_dir):
    rows = _rejects(spark, sf_dir)
    return C.triage(rows.withColumn("s", R.triage_signals(F.col("text"), F.col("reason"), F.col("hypotheses"), F.col("queries"), F.col("top_score"))), "payload")


def _holds(x: str, parts) -> str:
    return S.has(x, parts)


QUERIES["reject_triage"] = reject_triage
ORACLES["reject_triage"] = f"""WITH {_REJECTS},
a AS (SELECT payload, CASE WHEN trim(lower(reason)) = '' THEN 'unknown' ELSE trim(lower(reason)) END AS reason, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) < 4 AS weak, hypotheses = 0 AND queries = 0 AS none, top_score FROM rejects),
b AS (SELECT *, {S.has('reason', R.FIXABLE)} OR none AS fixable FROM a),
c AS (SELECT *, {S.has('reason', R.UNREADABLE)} OR (weak AND NOT fixable) AS unreadable, contains(reason, 'low_title_confidence') OR top_score < 0.45 AS low FROM b),
t AS (SELECT payload, count(*) AS rejects, count(*) FILTER (fixable) AS fixable, count(*) FILTER (unreadable) AS unreadable, count(*) FILTER (weak) AS weak_text, count(*) FILTER (none) AS no_hypotheses,
  count(*) FILTER (low) AS low_confidence FROM c GROUP BY payload),
r AS (SELECT payload, string_agg(reason || ':' || n, '|' ORDER BY n DESC, reason) AS top_reasons FROM (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY n DESC, reason) AS k FROM (SELECT payload, reason, count(*) AS n FROM c GROUP BY ALL)) WHERE k <= 6 GROUP BY payload)
SELECT t.*, top_reasons, CASE WHEN fixable > 0 THEN 'proceed_fix' WHEN unreadable >= greatest(1, floor(rejects * 0.8)) THEN 'ocr_pipeline_first' ELSE 'manual_investigation' END AS recommendation FROM t JOIN r USING (payload)"""


def _attempts(spark, sf_dir):
    """Candidates made of orders, with an answer for some."""
    k = F.col("o_orderkey")
    book = lambda name: F.struct(F.concat(F.lit(name), k.cast("string")).alias("title"), F.lit("openLibrary").alias("source"), k.cast("string").alias("source_id"))
    kinds = F.array(*[F.lit(x) for x in ("auto-accept", "suggest", "ambiguous", "no-match")])
    return B.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("candidate_id"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("answer"), book("d").alias("book"), (k % 97 / 97.0).alias("confidence"),
        F.when(k % 8 < 5, book("a")).alias("ambiguous"), F.when(k % 3 == 0, book("m")).alias("matched"), (k % 89 / 89.0).alias("match_score"), F.when(k % 5 == 0, book("c")).alias("canonical"),
        F.when(k % 7 == 0, book("r")).alias("resolved"), (k % 83 / 83.0).alias("resolved_confidence"), F.when(k % 11 == 0, F.lit("debug")).alias("debug_title"), (k % 79 / 79.0).alias("debug_score"),
        F.when(k % 4 == 1, "accept").when(k % 4 == 2, "pending").alias("decision"), F.when(k % 10 == 0, "why").alias("reason"), (k % 2).alias("hypotheses"),
    )


QUERIES["resolver_attempts"] = lambda spark, sf_dir: C.resolver_attempts(_attempts(spark, sf_dir))
ORACLES["resolver_attempts"] = """WITH c AS (SELECT o_custkey AS session_id, o_orderkey AS candidate_id, o_orderkey AS k FROM orders),
p AS (SELECT *, CASE WHEN k % 4 IN (0, 1) THEN 'd' WHEN k % 4 = 2 AND k % 8 < 5 THEN 'a' WHEN k % 3 = 0 THEN 'm' WHEN k % 5 = 0 THEN 'c' END AS answered,
  CASE WHEN k % 4 IN (0, 1) THEN (k % 97) / 97.0::DOUBLE WHEN k % 4 = 2 AND k % 8 < 5 THEN NULL WHEN k % 3 = 0 THEN (k % 89) / 89.0::DOUBLE END AS answer_score FROM c),
r AS (SELECT *, coalesce(answered, CASE WHEN k % 7 = 0 THEN 'r' END) AS top, CASE k % 4 WHEN 1 THEN 'accept' ELSE 'pending' END AS d, CASE WHEN k % 10 = 0 THEN 'why' END AS why FROM p)
SELECT session_id, candidate_id, k % 2 AS hypotheses, CASE WHEN top IS NOT NULL THEN 'openlibrary:' || k END AS resolver_key,
  coalesce(top || k, CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN 'debug' END) AS title,
  coalesce(answer_score, CASE WHEN k % 7 = 0 THEN (k % 83) / 83.0::DOUBLE WHEN k % 11 = 0 THEN (k % 79) / 79.0::DOUBLE END) AS score,
  CASE WHEN d = 'pending' AND k % 2 = 0 THEN 'reject' ELSE d END AS decision, CASE WHEN d = 'pending' AND k % 2 = 0 THEN coalesce(why, 'no_evidence') ELSE why END AS reason FROM r"""


def _corrections(spark, sf_dir):
    k = F.col("c_custkey")
    key = F.when(k % 3 == 0, F.concat(F.lit("isbn:978"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("hash:"), k.cast("string"))).otherwise(k.cast("string"))
    return B.read(spark, sf_dir, "customer").select(key.alias("key"), F.when(k % 2 == 0, F.concat(F.lit("h"), k.cast("string"))).alias("content_hash"), F.col("c_name").alias("title"), F.when(k % 4 > 0, F.col("c_mktsegment")).alias("author"))


_CORRECTIONS = """corrections AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'isbn:978' || c_custkey WHEN 1 THEN 'hash:' || c_custkey ELSE c_custkey::VARCHAR END AS key,
  CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey END AS content_hash, c_name AS title, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS author FROM customer)"""
QUERIES["correction_rows"] = lambda spark, sf_dir: C.correction_rows(_corrections(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))
ORACLES["correction_rows"] = f"""WITH {_CORRECTIONS} SELECT CASE WHEN key LIKE 'isbn:%' THEN key END AS resolver_key,
  CASE WHEN key LIKE 'isbn:%' THEN content_hash WHEN key LIKE 'hash:%' THEN substr(key, 6) ELSE key END AS evidence_hash, title, author AS authors FROM corrections"""
QUERIES["exported_corrections"] = lambda spark, sf_dir: C.import_corrections(C.export_corrections(_corrections(spark, sf_dir)), "content_hash string, title string, author string")
ORACLES["exported_corrections"] = f"WITH {_CORRECTIONS} SELECT key, content_hash, title, author FROM corrections"


def collected_books(spark, sf_dir):
    k, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = B.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), line.alias("candidate_id"), F.when(k % 3 == 0, "accept").when(k % 3 == 1, "suggested").otherwise("rejected").alias("decision"),
        F.when(line % 4 == 0, F.concat(F.lit("cover"), line.cast("string"))).alias("cover_url"), F.when(line % 5 > 0, line).alias("first_crop"),
    )
    crops = B.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") + 1).alias("det_idx"), F.concat(F.lit("crop"), F.col("l_linenumber").cast("string")).alias("crop_uri"))
    return C.collected_books(rows, crops)


QUERIES["collected_books"] = collected_books
ORACLES["collected_books"] = """SELECT a.l_orderkey AS session_id, a.l_linenumber AS candidate_id, CASE a.l_orderkey % 3 WHEN 0 THEN 'accept' ELSE 'suggested' END AS decision,
  coalesce(CASE WHEN a.l_linenumber % 4 = 0 THEN 'cover' || a.l_linenumber END, 'crop' || b.l_linenumber) AS cover_uri
FROM lineitem a LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1 AND a.l_linenumber % 5 > 0 WHERE a.l_orderkey % 3 <> 2"""


def enriched_books(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    candidates = parts.select(F.col("number").alias("olid"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.lit("1999").alias("publish_year"), F.col("picture").alias("cover_url"))
    found = parts.select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), "number")).otherwise(F.col("number")).alias("olid"), F.when(F.col("id") % 5 == 0, "").otherwise(F.upper("p_name")).alias("title"), F.when(F.col("id") % 2 == 0, F.array("p_type")).alias("authors"),
        "isbn13", "isbn10", F.col("p_type").alias("publisher"), F.col("date").alias("publish_date"), F.lit("big").alias("cover"),
    )
    return C.enriched(candidates, found).withColumn("authors", F.array_join("authors", "|"))


QUERIES["enriched_books"] = enriched_books
ORACLES["enriched_books"] = f"""WITH {_PARTS} SELECT CASE WHEN id % 3 = 0 THEN p_name WHEN id % 5 = 0 THEN p_name ELSE upper(p_name) END AS title, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN p_type ELSE p_brand END AS authors,
  CASE WHEN id % 3 <> 0 THEN {_bare('isbn13')} END AS isbn13, CASE WHEN id % 3 <> 0 THEN {_bare('isbn10')} END AS isbn10, CASE WHEN id % 3 <> 0 THEN p_type END AS publisher,
  coalesce(CASE WHEN id % 3 <> 0 THEN {_YEAR} END, '1999') AS publish_year, CASE WHEN id % 3 <> 0 THEN 'big' ELSE picture END AS cover_url, 'openLibrary' AS source, number AS source_id FROM rows"""


def session_cache(spark, sf_dir):
    """Each event asks for its type's and user's answer; answers are kept half an hour from when they were fetched."""
    rows = B.millis(B.read(spark, sf_dir, "events")).select("event_id", "user_id", "event_type", "ms")
    return L.session_cache(rows, ["user_id", "event_type"], "ms", "event_id")


QUERIES["session_cache"] = session_cache
ORACLES["session_cache"] = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_ms(ts::TIMESTAMP) AS ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts::TIMESTAMP), event_id) AS r FROM events),
f AS (SELECT event_id, user_id, event_type, ms, r, ms AS put, false AS hit FROM e WHERE r = 1
  UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.ms, e.r, CASE WHEN e.ms - f.put > {L.SESSION_CACHE_MS} THEN e.ms ELSE f.put END, e.ms - f.put <= {L.SESSION_CACHE_MS}
    FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.r = f.r + 1)
SELECT event_id, hit FROM f"""


def offline_sessions(spark, sf_dir):
    rows = B.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 37 % 100003).alias("timestamp"))
    return L.requeue(rows, "session_id", "seq", "timestamp")


QUERIES["offline_sessions"] = offline_sessions
ORACLES["offline_sessions"] = f"""WITH x AS (SELECT o_custkey AS session_id, max(o_orderkey) AS seq, count(*) - 1 AS retries, arg_max(o_orderkey * 37 % 100003, o_orderkey) AS timestamp FROM orders GROUP BY 1)
SELECT session_id, timestamp, retries FROM x ORDER BY timestamp DESC, session_id LIMIT {L.OFFLINE_QUEUE}"""
QUERIES["processed_sessions"] = lambda spark, sf_dir: L.process_all(
    B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 3).alias("retries"), (F.col("c_custkey") % 4 > 0).alias("success"))
)
ORACLES["processed_sessions"] = "SELECT c_custkey AS session_id, c_custkey % 3 + 1 AS retries FROM customer WHERE c_custkey % 4 = 0"


def merged_splits(spark, sf_dir):
    images = B.read(spark, sf_dir, "part").select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_size") % 5 == 0, "val").otherwise("train").alias("split"), F.col("p_size").alias("labels"))
    more = B.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("train").alias("split"), (F.col("s_nationkey")).alias("labels"))
    return C.merged_splits({"first": images, "second": more})


QUERIES["merged_splits"] = merged_splits
ORACLES["merged_splits"] = """SELECT split, dataset, count(*) AS images, sum(labels)::BIGINT AS labels FROM (
  SELECT CASE WHEN p_size % 5 = 0 THEN 'val' ELSE 'train' END AS split, 'first' AS dataset, p_size AS labels FROM part
  UNION ALL SELECT 'train', 'second', s_nationkey FROM supplier) GROUP BY ALL"""


def touched_books(spark, sf_dir):
    rows = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    changes = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    out = C.touched(rows, changes, ["id"], F.lit("2024-06-01").cast("timestamp"))
    return out.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd"))


QUERIES["touched_books"] = touched_books
ORACLES["touched_books"] = """SELECT p_partkey AS id, coalesce(s_name, p_name) AS title, CASE WHEN s_suppkey IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated_at FROM part LEFT JOIN supplier ON s_suppkey = p_partkey"""
QUERIES["book_by_id"] = lambda spark, sf_dir: C.book_by_id(B.catalog(spark, sf_dir), 7).withColumn("authors", F.array_join("authors", "|"))
ORACLES["book_by_id"] = "SELECT p_partkey AS id, p_name AS title, p_brand || '|' || p_type AS authors FROM part WHERE p_partkey = 7"

"""Queries of search, catalog, scoring, decision and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import decisions as D
from tomelake.functions import text as T
from tomelake.operators import catalog as C
from tomelake.operators import evidence as E
from tomelake.operators import search as SE
from tomelake.streaming import limits as LI

from . import sql as S
from . import tables as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_NOW = "timestamp '2024-01-15 00:00:00'"


def _query(name: str, run, oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# Search.
_SIM = S.trigram_similarity(S.trigrams("p_name"), S.trigrams("'smal rng'"))
for _name, _strict, _op in (("search_fuzzy", False, ">="), ("search_fuzzy_strict", True, ">")):
    _query(
        _name,
        lambda spark, d, strict=_strict: SE.search_fuzzy(B.catalog(spark, d), "smal rng", strict=strict).select("id", "title", F.round("similarity", 5).alias("similarity")),
        f"SELECT id, title, round(s::FLOAT, 5) AS similarity FROM (SELECT p_partkey AS id, p_name AS title, {_SIM} AS s FROM part) WHERE s {_op} 0.3 ORDER BY s DESC, id LIMIT 5",
    )
_TA = f"SELECT p_partkey AS id, {S.trigram_similarity(S.trigrams('p_name'), S.trigrams(S.q('smal rng')))} AS t, {S.trigram_similarity(S.trigrams(S.q('') + ' || p_brand || ' + S.q(' ') + ' || p_type'), S.trigrams(S.q('Brand#2 ECONOM')))} AS a FROM part"
for _name, _by, _order in (("search_title_author", False, "t"), ("search_title_author_combined", True, "0.7 * t + 0.3 * a")):
    _query(
        _name,
        lambda spark, d, by=_by: SE.search_title_author(B.catalog(spark, d), "smal rng", "Brand#2 ECONOM", by_combined=by).select("id", *[F.round(c, 5).alias(c) for c in ("title_similarity", "author_similarity", "combined_score")]),
        f"SELECT id, round(t::FLOAT, 5) AS title_similarity, round(a::FLOAT, 5) AS author_similarity, round((0.7 * t + 0.3 * a)::FLOAT, 5) AS combined_score FROM ({_TA}) WHERE t {'>' if _by else '>='} 0.3 AND a > 0.25 ORDER BY {_order} DESC, id LIMIT 5",
    )


def _misspelt(spark, d):
    """Names of parts without their second letter, as queries."""
    return B.read(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("query"))


_query(
    "search_many",
    lambda spark, d: SE.search_many(B.catalog(spark, d), _misspelt(spark, d)).withColumn("similarity", F.round("similarity", 6)),
    f"""WITH t AS (SELECT title, {S.trigrams('title')} AS g FROM (SELECT DISTINCT p_name AS title FROM part)),
q AS (SELECT query, {S.trigrams('query')} AS h FROM (SELECT DISTINCT p_name[1] || p_name[3:] AS query FROM part)),
s AS (SELECT query, title, {S.trigram_similarity('h', 'g')} AS s FROM q, t),
r AS (SELECT s.query, p_partkey AS id, title, s, row_number() OVER (PARTITION BY s.query ORDER BY s DESC, p_partkey) AS rank FROM s JOIN part ON p_name = title WHERE s >= 0.3)
SELECT p_partkey AS query_id, r.id, r.title, round(s, 6) AS similarity, rank FROM part JOIN r ON query = p_name[1] || p_name[3:] WHERE rank <= 5""",
)

# Scoring and decisions of the edge service: for each part, three neighbouring parts are candidates.


def _scored(spark, d):
    part = B.catalog(spark, d)
    case = _misspelt(spark, d).withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = case.join(part, (F.col("query_id") + F.col("position")) == part.id)
    hint = F.when(F.col("query_id") % 2 == 0, F.get("authors", F.lit(0)))
    none, one = F.array().cast("array<string>"), lambda c: F.array(c.cast("string"))
    wanted = F.when(F.col("query_id") % 3 == 0, one(F.col("query_id"))).otherwise(none)
    rows = rows.withColumn("isbns", one(F.col("id"))).withColumn("wanted", wanted).withColumn("hint", hint)
    rows = rows.withColumn("signals", D.edge_signals(F.col("title"), F.col("authors"), F.col("isbns"), F.col("query"), F.lit(None).cast("string"), F.col("hint"), F.col("wanted"), F.col("position")))
    rows = rows.withColumn("score", D.edge_composite(F.col("signals")))
    flags = D.edge_flags(F.col("title"), F.col("authors"), F.col("isbns"), F.lit(None).cast("string"), F.col("id") % 2100, F.col("hint"), F.col("wanted"), T.query_tokens(F.col("query")), F.lit(2026))
    tier = F.when(F.col("query_id") % 2 == 0, "strong").otherwise("usable")
    return rows.withColumn("flags", flags).withColumn("tier", tier)


_qq = S.query_tokens("query")
_SCORED = f"""WITH c AS (SELECT p_partkey AS query_id, p_name[1] || p_name[3:] AS query, unnest([0, 1, 2]) AS position FROM part),
j AS (SELECT query_id, query, position, p_partkey AS id, p_name AS title, p_brand, p_type, CASE WHEN query_id % 2 = 0 THEN p_brand END AS hint FROM c JOIN part ON p_partkey = query_id + position),
s AS (SELECT *, {S.line_similarity(S.query('title'), S.query('query'))} AS title_similarity, CASE WHEN hint IS NULL THEN 0.5 ELSE 1.0 END AS author_presence,
  CASE WHEN query_id % 3 = 0 AND id = query_id THEN 1.0 ELSE 0.0 END AS isbn_match,
  len(list_filter({_qq}, lambda t: list_contains(list_concat({S.query_tokens('title')}, {S.query_tokens('p_brand')}, {S.query_tokens('p_type')}), t)))::DOUBLE / len({_qq}) AS word_coverage, 1 - position * 0.1 AS result_rank FROM j),
f AS (SELECT *, least(1.0, greatest(0.0, title_similarity * 0.3 + author_presence * 0.25 + isbn_match * 0.2 + word_coverage * 0.15 + result_rank * 0.05)) AS score,
  (CASE WHEN query_id % 3 = 0 AND id <> query_id THEN 0.4 ELSE 0 END) AS isbn_flag, (CASE WHEN word_coverage < 0.4 THEN 0.2 ELSE 0 END) + (CASE WHEN id % 2100 <> 0 AND (id % 2100 < 1400 OR id % 2100 > 2027) THEN 0.1 ELSE 0 END) AS other,
  CASE WHEN query_id % 2 = 0 THEN 'strong' ELSE 'usable' END AS tier FROM s)"""
_query(
    "edge_scores",
    lambda spark, d: _scored(spark, d).select("query_id", "position", *[F.round(f"signals.{c}", 6).alias(c) for c in ("title_similarity", "author_presence", "isbn_match", "word_coverage", "result_rank")], F.round("score", 6).alias("score"), F.round(D.penalty(F.col("flags")), 6).alias("penalty")),
    f"{_SCORED} SELECT query_id, position, round(title_similarity, 6) AS title_similarity, author_presence, isbn_match, round(word_coverage, 6) AS word_coverage, round(result_rank, 6)::DOUBLE AS result_rank, round(score, 6) AS score, round(isbn_flag + other, 6)::DOUBLE AS penalty FROM f",
)
_query(
    "edge_decisions",
    lambda spark, d: E.decide_edge(_scored(spark, d), ["query_id"], "tier", "flags").select("query_id", "top", "type", "reason", F.round("confidence", 6).alias("confidence")),
    f"""{_SCORED}, r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS second FROM f WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, position)),
t AS (SELECT *, greatest(0.0, score - isbn_flag - other) AS adj FROM r WHERE rank = 1), u AS (SELECT *, adj - coalesce(second, 0) >= 0.15 AS alone, {S.threshold('tier', 0)} AS t0, {S.threshold('tier', 1)} AS t1, {S.threshold('tier', 2)} AS t2 FROM t)
SELECT query_id, position AS top, CASE WHEN isbn_flag > 0 THEN 'ambiguous' WHEN adj >= t0 AND alone THEN 'auto-accept' WHEN adj >= t1 THEN 'suggest' WHEN adj >= t2 THEN 'ambiguous' ELSE 'no-match' END AS type,
  CASE WHEN isbn_flag > 0 THEN 'verification_error' WHEN adj >= t0 AND alone THEN 'high_confidence' WHEN adj >= t1 THEN CASE WHEN alone THEN 'good_match' ELSE 'multiple_viable' END WHEN adj >= t2 THEN 'multiple_possible' ELSE 'below_threshold' END AS reason,
  CASE WHEN isbn_flag = 0 AND adj >= t1 THEN round(adj, 6) END AS confidence FROM u""",
)


def _client(spark, d):
    """Decisions over made-up scores: thresholds and gaps on all sides."""
    tier = F.element_at(F.array(*[F.lit(t) for t in D.TIERS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    top, second = F.round(F.col("l_quantity") / 50, 6), F.round(F.col("l_quantity") / 50 - F.col("l_discount") * 4, 6)
    flags = F.when(F.col("l_partkey") % 11 == 0, F.array(F.lit("isbn-mismatch"))).when(F.col("l_partkey") % 7 == 0, F.array(F.lit("year-implausible"))).otherwise(F.array().cast("array<string>"))
    rows = B.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", top.alias("top"), second.alias("second"), tier.alias("tier"), flags.alias("flags"))
    rows = rows.withColumn("d", D.client_decision(F.col("top"), F.col("second"), F.col("tier"), F.col("flags")))
    return rows.select("l_orderkey", "l_linenumber", "d.action", "d.fallback", F.round("d.confidence", 6).alias("confidence"), D.has_resolved_book(F.col("d.action")).alias("has_book"), D.needs_confirmation(F.col("d.action")).alias("asks"), D.dominates(F.col("top"), F.col("second")).alias("dominates"))


_query(
    "client_decisions",
    _client,
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 50, 6) AS top, round(l_quantity / 50 - l_discount * 4, 6) AS second, ['strong', 'usable', 'weak', 'unusable'][l_suppkey % 4 + 1] AS tier FROM lineitem),
g AS (SELECT *, top - second >= CASE WHEN top > 0.85 THEN 0.15 WHEN top > 0.7 THEN 0.2 ELSE 0.3 END AS dominates, {S.threshold('tier', 0)} AS t0, {S.threshold('tier', 1)} AS t1, {S.threshold('tier', 2)} AS t2 FROM r),
a AS (SELECT *, CASE WHEN l_partkey % 11 = 0 THEN 'ambiguous' WHEN l_partkey % 7 = 0 THEN 'suggest' WHEN top >= t0 AND dominates THEN 'auto-accept' WHEN top >= t1 THEN 'suggest' WHEN top >= t2 THEN 'ambiguous' ELSE 'no-match' END AS action FROM g)
SELECT l_orderkey, l_linenumber, action, CASE WHEN action = 'no-match' THEN 'manual-entry' END AS fallback, CASE WHEN action IN ('auto-accept', 'suggest') THEN CASE WHEN l_partkey % 7 = 0 THEN round(greatest(0.0, top - 0.1), 6) ELSE top END END AS confidence,
  action IN ('auto-accept', 'suggest') AS has_book, action <> 'auto-accept' AS asks, dominates FROM a""",
)
_query("token_set_scores", lambda spark, d: _scored(spark, d).withColumn("m", T.token_set_overlap(F.array_distinct(T.fuzzy_tokens(F.col("query"))), T.candidate_tokens(F.col("title"), F.col("authors")))).select("query_id", "position", F.size("m").alias("overlap"), F.array_join(F.transform("m", lambda x: x["candidate"]), " ").alias("matched")))
_query("best_author_match", lambda spark, d: B.catalog(spark, d).withColumn("m", T.best_match(F.get("authors", F.lit(1)), F.col("authors"))).select("id", "m.match", F.round("m.score", 6).alias("score"), "m.place"))

# Catalog upserts, caches, corrections, attempts.


def _existing(spark, d):
    """All orders; every third one under a key that no incoming row has."""
    o, key = B.read(spark, d, "orders"), F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("id"), F.lit("openLibrary").alias("provider"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("provider_id"), F.col("o_orderpriority").alias("title"), F.array("o_orderstatus").alias("authors"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("old")).alias("publisher")
    )


def _incoming(spark, d):
    rows = B.read(spark, d, "lineitem")
    return rows.select(
        F.lit("openLibrary").alias("provider"), F.col("l_orderkey").cast("string").alias("provider_id"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("title"), F.array("l_returnflag").alias("authors"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).otherwise("").alias("publisher"), F.expr("cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000").alias("seq")
    )


_query(
    "upsert_books",
    lambda spark, d: C.upsert_books(_existing(spark, d), _incoming(spark, d)).select("provider_id", "title", F.array_join("authors", ",").alias("authors"), "publisher"),
    """WITH l AS (SELECT l_orderkey AS k, arg_max('t' || l_partkey::VARCHAR, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000) AS title, arg_max(l_returnflag, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000) AS a, arg_max(l_linestatus, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000) FILTER (l_linenumber % 2 = 0) AS p FROM lineitem GROUP BY 1),
e AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS k, o_orderpriority AS title, o_orderstatus AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'old' END AS p FROM orders)
SELECT coalesce(l.k::VARCHAR, e.k) AS provider_id, coalesce(l.title, e.title) AS title, coalesce(l.a, e.a) AS authors, coalesce(l.p, e.p) AS publisher FROM l FULL JOIN e ON l.k::VARCHAR = e.k""",
)
_query(
    "last_writer_wins",
    lambda spark, d: C.last_writer_wins(_existing(spark, d).select("provider_id", "title"), _incoming(spark, d).select("provider_id", "title", "seq"), ["provider_id"], "seq"),
    """WITH l AS (SELECT l_orderkey AS k, arg_max('t' || l_partkey::VARCHAR, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000) AS title FROM lineitem GROUP BY 1)
SELECT k::VARCHAR AS provider_id, title FROM l UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey NOT IN (SELECT k FROM l)""",
)


def _cache(spark, d):
    """A cache made of signups and purchases: one entry for each user, expiring a week after."""
    e = B.read(spark, d, "events").filter("event_type IN ('signup', 'purchase')").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max("value").alias("v"))
    payload = F.when(F.col("user_id") % 5 == 0, F.lit(C.MISS)).otherwise(F.format_string('{"v": %s}', F.col("user_id")))
    return e.select(F.lit("openLibrary").alias("provider"), F.lit("text").alias("query_type"), F.col("user_id").cast("string").alias("query_hash"), payload.alias("response_json"), F.expr("ts + INTERVAL 7 DAYS").alias("expires_at"))


_EC = "e AS (SELECT user_id, max(ts) + INTERVAL 7 DAYS AS x FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)"


def _at():
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")



def _requests(spark, d):
    return B.read(spark, d, "events").select("event_id", F.lit("openLibrary").alias("provider"), F.lit("text").alias("query_type"), F.col("user_id").cast("string").alias("query_hash"))


_query("cache_lookup", lambda spark, d: C.lookup_cache(_requests(spark, d), _cache(spark, d), _at()).select("event_id", "state"),
       f"WITH {_EC} SELECT event_id, CASE WHEN x IS NULL OR NOT x > {_NOW} THEN 'miss' WHEN events.user_id % 5 = 0 THEN 'known_miss' ELSE 'hit' END AS state FROM events LEFT JOIN e USING (user_id)")
_query("cache_hits", lambda spark, d: C.hit_counts(C.lookup_cache(_requests(spark, d), _cache(spark, d), _at())).select("query_hash", "hits"),
       f"WITH {_EC} SELECT user_id::VARCHAR AS query_hash, count(*) AS hits FROM events JOIN e USING (user_id) WHERE x > {_NOW} GROUP BY 1")
_query("expired_cache", lambda spark, d: C.count_expired(_cache(spark, d), _at()), f"WITH {_EC} SELECT count(*) FILTER (x < {_NOW}) AS deleted FROM e")
_query("live_cache", lambda spark, d: C.live(_cache(spark, d), _at()).select("query_hash"), f"WITH {_EC} SELECT user_id::VARCHAR AS query_hash FROM e WHERE x > {_NOW}")
_query("cache_entries", lambda spark, d: C.cache_entries(B.read(spark, d, "events").select("event_id", F.when(F.col("value") > 10, F.col("props")).alias("response_json")), _at()).select("event_id", "response_json", F.date_format("expires_at", "yyyy-MM-dd").alias("expires")),
       f"SELECT event_id, CASE WHEN value > 10 THEN props ELSE '{C.MISS}' END AS response_json, '2024-01-22' AS expires FROM events")
_query("isbn_lookup", lambda spark, d: C.lookup_by_isbn(B.isbns(spark, d).select(F.col("id").alias("request_id"), F.col("isbn10").alias("isbn")), B.isbns(spark, d).withColumn("isbn10", F.when(F.col("id") % 2 == 0, F.col("isbn10"))).withColumn("isbn13", F.when(F.col("id") % 2 == 0, F.col("isbn13")))).select("request_id", "id"),
       f"WITH {S.ISBNS} SELECT r.id AS request_id, c.id FROM isbns r LEFT JOIN (SELECT upper(isbn10) AS n, min(id) AS id FROM (SELECT id, CASE WHEN id % 2 = 0 THEN isbn10 END AS isbn10 FROM isbns) GROUP BY 1) c ON upper(r.isbn10) = n")


def _resolved(spark, d):
    """Candidates with resolved books made of order lines."""
    part = B.read(spark, d, "part")
    rows = B.read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_orderkey").alias("session_seq"), F.expr("cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000").alias("ordering_key"), F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "suggested").otherwise("accept").alias("decision"), F.col("l_quantity").alias("confidence"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).alias("isbn13"), F.lit(None).cast("string").alias("isbn10"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
    )


_LIB = """WITH r AS (SELECT l_orderkey AS session_id, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordering_key, CASE l_returnflag WHEN 'R' THEN 'reject' WHEN 'A' THEN 'suggested' ELSE 'accept' END AS decision, l_quantity AS confidence,
  CASE WHEN p_partkey % 4 = 0 THEN 'isbn:' || p_partkey::VARCHAR ELSE 'ta:' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || ':' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') END AS dedupe_key FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_query("library", lambda spark, d: E.library(_resolved(spark, d)).select("dedupe_key", "session_id", "ordering_key", "confidence"),
       f"{_LIB} SELECT dedupe_key, session_id, ordering_key, confidence FROM r WHERE decision <> 'reject' QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY confidence DESC, session_id DESC, ordering_key) = 1")
_query("session_decision_counts", lambda spark, d: _resolved(spark, d).groupBy("session_id").agg(*[F.count_if(F.col("decision") == x).alias(x) for x in ("accept", "suggested", "reject")]),
       f"{_LIB} SELECT session_id, {', '.join(f'''count(*) FILTER (decision = '{x}') AS {x}''' for x in ('accept', 'suggested', 'reject'))} FROM r GROUP BY 1")
_query("first_seen_books", lambda spark, d: C.first_seen(_resolved(spark, d).withColumn("key", D.identity_key(F.lit("s"), F.lit(None).cast("string"), F.col("isbn13"), F.col("isbn10"), F.col("title"))), "key", ["session_id"], "ordering_key").select("session_id", "ordering_key", "key"),
       """WITH r AS (SELECT l_orderkey AS session_id, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordering_key, 's||' || CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR ELSE '' END || '||' || lower(p_name) AS key FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session_id, key ORDER BY ordering_key) = 1""")  # fmt: skip
_query("waterfall", lambda spark, d: C.with_fallback(_resolved(spark, d).filter("decision = 'accept'").select("session_id", "title", "ordering_key"), _resolved(spark, d).filter("decision <> 'accept'").select("session_id", "title", "ordering_key"), "session_id", "title", "ordering_key").select("session_id", "title", "place"),
       """WITH r AS (SELECT l_orderkey AS session_id, p_name AS title, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS o, CASE WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 0 END AS s FROM lineitem JOIN part ON l_partkey = p_partkey),
k AS (SELECT * FROM r WHERE s = 0 OR (SELECT count(*) FROM r q WHERE q.session_id = r.session_id AND q.s = 0) < 3),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY session_id, title ORDER BY s, o) = 1)
SELECT session_id, title, row_number() OVER (PARTITION BY session_id ORDER BY s, o) AS place FROM u QUALIFY place <= 10""")  # fmt: skip


def _corrections(spark, d):
    c = B.read(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("isbn:"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("hash:"), F.col("c_name")))
    # Two of three customers' corrections are kept under a key that no candidate has.
    return c.select(F.when(F.col("c_custkey") % 3 == 0, key).otherwise(F.concat(key, F.lit(":x"))).alias("key"), F.col("c_mktsegment").alias("corrected_title"), (F.col("c_custkey") % 9).alias("apply_count"))


def _corrected(spark, d):
    cand = B.read(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey").cast("string")).alias("isbn"), F.col("c_name").alias("content_hash"))
    rows = C.find_corrections(cand, _corrections(spark, d))
    return rows.withColumn("hints", C.apply_hint(F.when(F.col("candidate_id") % 2 == 0, F.array("content_hash")), F.col("corrected_title"))).select("candidate_id", "correction_key", "corrected_title", F.array_join("hints", "|").alias("hints"))


_query("corrections", _corrected,
       """WITH c AS (SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 4 <> 0 THEN 'isbn:' || c_custkey::VARCHAR END AS ik, 'hash:' || c_name AS hk, c_name FROM customer),
k AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'isbn:' || c_custkey::VARCHAR ELSE 'hash:' || c_name END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ':x' END AS key, c_mktsegment AS t FROM customer),
j AS (SELECT c.*, coalesce(a.t, b.t) AS corrected_title FROM c LEFT JOIN k a ON a.key = ik LEFT JOIN k b ON b.key = hk)
SELECT candidate_id, coalesce(ik, hk) AS correction_key, corrected_title, CASE WHEN candidate_id % 2 = 0 THEN coalesce(corrected_title || '|', '') || c_name END AS hints FROM j""")  # fmt: skip
_query("correction_stats", lambda spark, d: C.correction_stats(_corrections(spark, d)),
       """WITH k AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'isbn:' || c_custkey::VARCHAR ELSE 'hash:' || c_name END || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ':x' END AS key, c_custkey % 9 AS n FROM customer)
SELECT count(*) AS total, sum(n)::BIGINT AS applied, first(key ORDER BY n DESC, key DESC) AS most_applied FROM k""")  # fmt: skip
_query("newest_corrections", lambda spark, d: C.newest(B.read(spark, d, "orders").select("o_orderkey", "o_orderdate"), 500, ["o_orderdate", "o_orderkey"]).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500")
_query("missing_results", lambda spark, d: C.missing_results(B.read(spark, d, "documents").select("doc_id"), B.read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "accept").otherwise("suggest").alias("decision"), F.lit("scored").alias("reason")), "doc_id"),
       "SELECT doc_id, CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'suggest' ELSE 'reject' END AS decision, CASE WHEN quality IS NULL THEN 'resolution_incomplete' ELSE 'scored' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
_query("constraint_violations", lambda spark, d: C.violations(B.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"quantity": F.col("l_quantity") < 50, "flag": F.col("l_returnflag").isin("A", "N", "R")}),
       "SELECT l_orderkey, l_linenumber, 'quantity' AS constraint FROM lineitem WHERE l_quantity >= 50 UNION ALL SELECT l_orderkey, l_linenumber, 'unique' FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
_query("resolver_keys", lambda spark, d: _resolved(spark, d).select("session_id", "ordering_key", D.resolver_key(F.lit("googleBooks"), F.col("title"), F.col("isbn13"), F.col("isbn10")).alias("resolver_key"), F.round(D.fallback_score(F.col("title"), F.array("author"), F.col("isbn13"), F.col("isbn10"), F.upper("title")), 6).alias("fallback_score")),
       "SELECT l_orderkey AS session_id, cast(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordering_key, CASE WHEN p_partkey % 4 = 0 THEN 'isbn:' || p_partkey::VARCHAR ELSE 'googleBooks:' || p_name END AS resolver_key, CASE WHEN p_partkey % 4 = 0 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS fallback_score FROM lineitem JOIN part ON l_partkey = p_partkey")
_query("merged_evidence", lambda spark, d: E.merge_lines(B.lines(spark, d).select(F.floor(F.col("doc_id") / 3).alias("candidate_id"), F.col("doc_id").alias("crop_idx"), (F.col("doc_id") % 7 / 7).alias("crop_score"), "line_idx", F.col("line").alias("text"), (F.length("line") % 10 / 10).alias("confidence"))).select("candidate_id", F.size("merged_lines").alias("n_lines"), F.sha2("text_block", 256).alias("text_sha256")))

# Events.


def _clients(spark, d):
    return B.millis(B.read(spark, d, "events")).select((F.col("user_id") % 3).alias("client"), "event_id", (F.col("ms") / 100).cast("long").alias("ms"))


_query("rate_limit", lambda spark, d: LI.limit_rates(_clients(spark, d)).select("event_id", "allowed", "remaining"))
_query("debounced_events", lambda spark, d: LI.debounce(B.millis(B.read(spark, d, "events")), ["user_id"], "event_type", "ms", 86_400_000).select("event_id", "skipped"),
       "SELECT event_id, coalesce(lag(event_type) OVER w = event_type AND epoch_ms(ts) - epoch_ms(lag(ts) OVER w) < 86400000, false) AS skipped FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)")
_query("query_budget", lambda spark, d: LI.within_budget(B.read(spark, d, "events"), ["user_id"], ["ts", "event_id"], 50).select("event_id"), "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 50")
_query("offline_queue", lambda spark, d: LI.enqueue(B.read(spark, d, "events"), "user_id", "ts", 100).select("user_id", "retries"), "SELECT user_id, count(*) - 1 AS retries FROM events GROUP BY 1 ORDER BY min(ts) DESC, user_id LIMIT 100")
_query("windowed_counts", lambda spark, d: LI.windowed_counts(B.read(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
       "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
_query("event_rollup", lambda spark, d: B.read(spark, d, "events").rollup("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("day").cast("string").alias("day"), "n"),
       "SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, ts::DATE))")
_query("unexpired_items", lambda spark, d: B.read(spark, d, "events").filter(F.col("ts") >= F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")).select("event_id"), "SELECT event_id FROM events WHERE ts >= timestamp '2024-01-08 00:00:00'")
_query("reject_fingerprint", lambda spark, d: B.read(spark, d, "events").groupBy("user_id").agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_type", F.col("event_id").cast("string")))), "|")).alias("fingerprint")),
       "SELECT user_id, sha1(array_to_string(list_sort(list(event_type || ':' || event_id::VARCHAR)), '|')) AS fingerprint FROM events GROUP BY 1")
_query("event_props", lambda spark, d: B.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, (props::JSON ->> '$.k')::INT AS k FROM events")

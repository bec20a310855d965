"""Queries of search candidates, hints, the books of decisions and the client's flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import candidates as C
from tomelake.functions import decisions as D
from tomelake.functions import geometry as G
from tomelake.functions import isbn as I
from tomelake.functions import records as R
from tomelake.functions import text as T

from . import sql as S
from . import tables as B
from .role_queries import LINES, _lines
from .sql import q, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TIERS = ["strong", "usable", "weak", "unusable"]


def _confident(spark, sf_dir):
    """Documents of seven lines made of parts, each with a made-up confidence: doc, lines."""
    conf = ((F.col("doc") * 7 + F.col("line_idx") * 13) % 100) / 100
    return _lines(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.col("line").alias("text"), conf.alias("confidence")))).alias("l"))


def search_candidates(spark, sf_dir):
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").join(B.isbns(spark, sf_dir), "id")
    tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (F.col("id") % 4 + 1).cast("int"))
    text = F.concat("p_name", F.lit(" first edition "), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("isbn13")))
    rows = part.withColumn("tier", tier).withColumn("text", text).withColumn("numbers", I.extract_isbns(F.col("text")))
    found = C.search_candidates(F.col("text"), F.when(F.col("id") % 5 > 0, F.col("id") % 10 / 10.0), F.col("tier"), F.col("numbers"))
    rows = rows.select("id", "tier", F.posexplode(found).alias("place", "c"))
    return rows.select("id", "tier", "place", "c.query", "c.isbn", F.round("c.confidence", 6).alias("confidence"), "c.kind")


QUERIES["search_candidates"] = search_candidates
_N13 = "regexp_replace(isbn13, '[^0-9X]', '', 'g')"
_V13 = f"(list_sum(list_transform(range(1, 14), lambda i: substr({_N13}, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0)"
_MULTIPLIER = S.by_key("tier", {t: f"{D.TIER_MULTIPLIERS[t]}::DOUBLE" for t in D.TIER_MULTIPLIERS})
ORACLES["search_candidates"] = f"""WITH {S.ISBNS},
a AS (SELECT id, {S.array(TIERS)}[id % 4 + 1] AS tier, p_name || ' first edition ' || CASE WHEN id % 3 = 0 THEN '' ELSE isbn13 END AS text, CASE WHEN id % 3 <> 0 AND {_V13} THEN {_N13} END AS n,
  CASE WHEN id % 5 > 0 THEN (id % 10) / 10.0::DOUBLE ELSE 0.5::DOUBLE END AS conf FROM isbns JOIN part ON p_partkey = id),
b AS (SELECT *, array_to_string(list_filter({S.comparison_tokens('text')}, lambda x: x NOT IN {words(R.QUERY_NOISE)} AND length(x) > 1), ' ') AS query, {_MULTIPLIER} AS m FROM a WHERE tier <> 'unusable'),
c AS (SELECT id, tier, n AS query, n AS isbn, 0.95::DOUBLE * m AS confidence, 'isbn' AS kind, 0 AS k FROM b WHERE n IS NOT NULL UNION ALL SELECT id, tier, query, n, conf * m, 'merged', 1 FROM b WHERE length(query) >= 3)
SELECT id, tier, (row_number() OVER (PARTITION BY id ORDER BY confidence DESC, k) - 1)::INT AS place, query, isbn, round(confidence, 6) AS confidence, kind FROM c"""


def line_hints(spark, sf_dir):
    rows = _confident(spark, sf_dir)
    rows = rows.withColumn("title", C.title_hint(F.col("l"))).withColumn("author", C.author_hint(F.col("l")))
    return rows.select("doc", "title", "author", C.ocr_only_fallback(F.col("doc") % 5 > 0, F.col("title"), F.col("author")).alias("fallback"))


QUERIES["line_hints"] = line_hints
_AUTHOR = " OR ".join(f"regexp_matches(line, {q(p)})" for p in C.AUTHOR_LINES)
_NAMED = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(line, {q(p)}) THEN trim(regexp_extract(line, {q(p)}, 1)) END" for p in C.AUTHOR_LINES) + ")"
ORACLES["line_hints"] = f"""WITH {LINES},
c AS (SELECT *, ((doc * 7 + line_idx * 13) % 100) / 100 AS confidence FROM lines),
g AS (SELECT * FROM c WHERE confidence >= 0.6 AND NOT ({_AUTHOR}) AND length({S.comparison('line')}) >= 2 AND NOT ({' OR '.join(f'regexp_matches(line, {q(p)})' for p in R.SKIPPED_LINES)})),
t AS (SELECT doc, arg_min(line, [-confidence::DOUBLE, line_idx::DOUBLE]) AS first, arg_min(line, [-length(line)::DOUBLE, -confidence::DOUBLE, line_idx::DOUBLE]) AS longest FROM g GROUP BY doc),
a AS (SELECT doc, arg_min({_NAMED}, line_idx) AS author FROM c WHERE confidence >= 0.5 AND ({_AUTHOR}) GROUP BY doc),
h AS (SELECT DISTINCT doc FROM lines)
SELECT doc, trim(CASE WHEN length(longest) > length(first) * 0.8 THEN longest ELSE first END) AS title, author,
  CASE WHEN doc % 5 > 0 AND (coalesce(first, '') <> '' OR coalesce(author, '') <> '') THEN 'ocr-only' ELSE 'manual-entry' END AS fallback FROM h LEFT JOIN t USING (doc) LEFT JOIN a USING (doc)"""


def decision_books(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda items: F.element_at(F.array(*[F.lit(x) for x in items]), (k % len(items) + 1).cast("int"))
    book = lambda n: F.concat(F.lit(n), k.cast("string"))
    several = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(book("c"), book("d")))
    rows = B.read(spark, sf_dir, "orders").select("o_orderkey", pick(["auto-accept", "suggest", "ambiguous", "no-match"]).alias("action"), pick(["accept_high", "accept_medium", "suggested", "suggested_weak", "reject"]).alias("decision"), several.alias("c"))
    name = F.when(k % 4 == 0, F.lit(None)).otherwise(book("t"))
    return rows.select(
        "o_orderkey", C.primary_book(F.col("action"), book("b"), F.col("c")).alias("primary"), F.array_join(C.shown_books(F.col("action"), book("b"), F.array(book("a")), F.col("c")), "|").alias("shown"),
        C.persists(F.col("decision")).alias("persists"), C.shows(F.col("decision")).alias("shows"), C.changes(name, F.lit(None).cast("string"), F.when(k % 2 == 0, book("t")), F.lit("x")).alias("changes"),
    )


QUERIES["decision_books"] = decision_books
ORACLES["decision_books"] = """WITH o AS (SELECT o_orderkey, o_orderkey AS k, ['auto-accept', 'suggest', 'ambiguous', 'no-match'][o_orderkey % 4 + 1] AS action,
  ['accept_high', 'accept_medium', 'suggested', 'suggested_weak', 'reject'][o_orderkey % 5 + 1] AS decision, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['c' || o_orderkey, 'd' || o_orderkey] END AS c FROM orders)
SELECT o_orderkey, CASE WHEN action IN ('auto-accept', 'suggest') THEN 'b' || k WHEN action = 'ambiguous' THEN c[1] END AS primary,
  CASE action WHEN 'auto-accept' THEN 'b' || k WHEN 'suggest' THEN 'b' || k || '|a' || k WHEN 'ambiguous' THEN coalesce(array_to_string(c, '|'), '') ELSE '' END AS shown,
  decision IN ('accept_high', 'accept_medium') AS persists, decision <> 'reject' AS shows, k % 4 <> 0 AND k % 2 <> 0 AS changes FROM o"""


def box_bounds(spark, sf_dir):
    left, right, top, bottom = G.bounds(G.Box.of())
    return B.detections(spark, sf_dir).select("session_id", "det_idx", *[F.round(v, 4).alias(n) for n, v in zip(("x1", "x2", "y1", "y2"), (left, right, top, bottom), strict=True)])


QUERIES["box_bounds"] = box_bounds
_X = [f"cx + ({sx}width / 2) * cos(angle) - ({sy}height / 2) * sin(angle)" for sx in ("-", "") for sy in ("-", "")]
_Y = [f"cy + ({sx}width / 2) * sin(angle) + ({sy}height / 2) * cos(angle)" for sx in ("-", "") for sy in ("-", "")]
ORACLES["box_bounds"] = f"WITH {S.DETECTIONS} SELECT session_id, det_idx, " + ", ".join(f"round({f}({', '.join(v)}), 4) AS {n}" for n, f, v in (("x1", "least", _X), ("x2", "greatest", _X), ("y1", "least", _Y), ("y2", "greatest", _Y))) + " FROM detections"


def client_flags(spark, sf_dir):
    """Each part against the hints of the next one."""
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type").join(B.isbns(spark, sf_dir), "id")
    k = F.col("id")
    year = F.when(k % 4 == 0, (k % 2300).cast("string")).otherwise("1999")
    flags = D.client_flags(
        F.col("p_name"), F.array("p_brand"), F.col("isbn13"), F.col("isbn10"), F.when(k % 2 == 0, F.concat("p_type", F.lit(" House"))), F.when(k % 3 == 0, F.lit("2nd edition")), year,
        T.comparison_tokens(F.when(k % 5 == 0, F.lit("other words here")).otherwise(F.col("p_name"))), F.when(k % 7 == 0, F.lit("9780306406157")), F.when(k % 6 == 0, F.lit("Nobody")), F.lit(None).cast("string"),
        F.when(k % 4 == 1, F.lit("3rd edition")), F.when(k % 3 == 1, F.concat(F.lit("from "), "p_type")).otherwise(""), F.lit(2026), F.when(k % 12 == 0, F.lit(0.7)).otherwise(0.2),
    )
    return part.select("id", F.array_join(flags, "|").alias("flags"))


QUERIES["client_flags"] = client_flags
_TYPE = "list_filter(list_concat(string_split(lower(p_type), ' '), ['house']), lambda t: length(t) > 3)"
ORACLES["client_flags"] = f"""WITH {S.ISBNS},
a AS (SELECT id, p_name, p_brand, p_type, {_N13} AS n, CASE WHEN id % 5 = 0 THEN 'other words here' ELSE p_name END AS evidence, CASE WHEN id % 3 = 1 THEN 'from ' || p_type ELSE '' END AS block FROM part JOIN isbns ON id = p_partkey),
b AS (SELECT *, {S.comparison_tokens('evidence')} AS e, {S.comparison_tokens("p_name || ' ' || p_brand")} AS known FROM a),
f AS (SELECT id, [CASE WHEN id % 6 = 0 AND id % 12 <> 0 THEN 'author-mismatch' END, CASE WHEN id % 7 = 0 AND n <> '9780306406157' THEN 'isbn-mismatch' END,
  CASE WHEN len(e) > 0 AND len(list_filter(e, lambda t: list_contains(known, t)))::DOUBLE / len(e) < 0.5 THEN 'token-coverage-low' END,
  CASE WHEN id % 2 = 0 AND len({S.comparison_tokens('p_name')}) <= 4 AND NOT (len(list_filter({_TYPE}, lambda t: contains({S.comparison('block')}, t))) > 0) THEN 'suspicious-edition' END,
  CASE WHEN id % 4 = 0 AND (id % 2300 > 2027 OR id % 2300 < 1800) THEN 'year-implausible' END, CASE WHEN id % 4 = 1 AND id % 3 = 0 THEN 'edition-conflict' END] AS x FROM b)
SELECT id, array_to_string(list_filter(x, lambda t: t IS NOT NULL), '|') AS flags FROM f"""

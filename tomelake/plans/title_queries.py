"""Queries of token repair and of title variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import evidence_lines as E
from tomelake.functions import titles as X

from . import sql as S
from . import tables as B
from .role_queries import LINES, _lines
from .sql import q, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_TAILS = ["of the king", "james king", "ghosts", "is for alibi", "and her"]


def _titles(spark, sf_dir):
    """Titles and authors made of lines: doc, line_idx, title, author, times."""
    rows = _lines(spark, sf_dir).filter("trim(line) <> ''")
    k = F.col("doc") * 7 + F.col("line_idx")
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (k % len(_TAILS) + 1).cast("int"))
    title = F.lower(F.when(k % 3 == 0, F.concat("line", F.lit(" "), tail)).when(k % 3 == 1, F.concat(F.lit("a "), tail, F.lit(" "), "line")).otherwise(F.col("line")))
    author = F.when(k % 4 == 0, "james king").when(k % 4 == 1, "king").when(k % 4 == 2, F.lower("line"))
    return rows.select("doc", "line_idx", title.alias("title"), author.alias("author"), (k % 3).alias("times"))


_TITLES = f"""{LINES}, titles AS (SELECT doc, line_idx, lower(CASE (doc * 7 + line_idx) % 3 WHEN 0 THEN line || ' ' || tail WHEN 1 THEN 'a ' || tail || ' ' || line ELSE line END) AS title,
  CASE (doc * 7 + line_idx) % 4 WHEN 0 THEN 'james king' WHEN 1 THEN 'king' WHEN 2 THEN lower(line) END AS author, (doc * 7 + line_idx) % 3 AS times
  FROM (SELECT *, {S.array(_TAILS)}[(doc * 7 + line_idx) % {len(_TAILS)} + 1] AS tail FROM lines) WHERE trim(line) <> '')"""


def title_variants(spark, sf_dir):
    t, a = F.col("title"), F.col("author")
    return _titles(spark, sf_dir).select(
        "doc", "line_idx", X.surname(a).alias("surname"), X.without_author(t, a).alias("without_author"), X.series_core(t).alias("series_core"), X.without_repeated_tail(t, F.col("times")).alias("without_repeated_tail"),
        X.without_author_tail(t).alias("without_author_tail"), X.leading_swapped(t).alias("leading_swapped"), X.without_connectors(t).alias("without_connectors"), X.reordered_of(t).alias("reordered_of"),
        F.array_join(X.drop_low_signal(X._words(t)), " ").alias("without_low_signal"), X.query_key(F.upper(t)).alias("query_key"), X.changed(t, a).alias("changed"),
        F.array_join(F.transform(X.simple_queries(t, a), lambda x: F.concat_ws(":", x["priority"], x["type"], x["query"])), "|").alias("queries"),
    )


def _in(x: str, items) -> str:
    return f"{x} IN {words(items)}"


_WORTH = f"NOT {_in('x', X.CONNECTORS)} AND NOT {_in('x', X.NOISE)}"
_ENDS = f"length(t[-1]) >= 5 AND NOT {_in('t[-1]', X.CONNECTORS)}"
_STRUCTURED = f"len(list_filter(t[:-2], lambda x: {_in('x', X.CONNECTORS)})) > 0"
_J = "array_to_string({}, ' ')"
QUERIES["title_variants"] = title_variants
ORACLES["title_variants"] = f"""WITH {_TITLES},
w AS (SELECT *, list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '') AS t, list_filter(regexp_split_to_array(coalesce(author, ''), '\\s+'), lambda x: x <> '') AS a FROM titles),
v AS (SELECT *, list_filter(t, lambda x: NOT {_in('x', X.CONNECTORS)}) AS less, list_filter(t, lambda x: NOT {_in('x', X.LOW_SIGNAL)}) AS high, regexp_replace(title, '^(the|a|an)[0-9]*\\s+', '') AS bare FROM w)
SELECT doc, line_idx, CASE WHEN len(a) >= 2 AND length(a[-1]) >= 3 THEN a[-1] END AS surname,
  CASE WHEN author IS NULL OR len(a) = 0 THEN title WHEN len(a) >= 2 AND len(t) > len(a) AND t[len(t) - len(a) + 1:] = a THEN {_J.format('t[:len(t) - len(a)]')}
    WHEN len(t) >= 3 AND t[-1] = a[-1] THEN CASE WHEN len(a) = 1 AND len(t) >= 4 AND length(t[-2]) BETWEEN 3 AND 8 AND NOT {_in('t[-2]', X.CONNECTORS)} AND NOT {_in('t[-2]', X.NOISE)} THEN {_J.format('t[:len(t) - 2]')} ELSE {_J.format('t[:len(t) - 1]')} END
    ELSE title END AS without_author,
  CASE WHEN len(t) >= 4 AND regexp_matches(t[1], '^[a-z]$') AND t[2] = 'is' AND t[3] = 'for' AND length(t[4]) >= 3 AND NOT {_in('t[4]', X.CONNECTORS)} AND NOT {_in('t[4]', X.NOISE)} THEN {_J.format('t[:4]')} END AS series_core,
  CASE WHEN len(t) >= 4 AND {_ENDS} AND {_STRUCTURED} AND times >= 2 THEN {_J.format('t[:len(t) - 1]')} END AS without_repeated_tail,
  CASE WHEN len(t) >= 4 AND {_ENDS} AND NOT {_in('t[-1]', X.NOISE)} AND {_STRUCTURED} AND len(list_filter(t[:len(t) - 1], lambda x: length(x) >= 3 AND {_WORTH})) >= 2 THEN {_J.format('t[:len(t) - 1]')} END AS without_author_tail,
  CASE WHEN length(t[1]) >= 3 AND length(t[2]) >= 3 AND t[1] <> t[2] AND NOT {_in('t[1]', X.CONNECTORS)} AND NOT {_in('t[2]', X.CONNECTORS)} THEN {_J.format('list_concat([t[2], t[1]], t[3:])')} END AS leading_swapped,
  CASE WHEN len(t) >= 3 AND len(less) >= 2 AND len(less) < len(t) THEN {_J.format('less')} END AS without_connectors,
  CASE WHEN len(t) >= 3 AND t[2] = 'of' AND t[1] <> 'of' AND length(t[1]) >= 3 AND NOT {_in('t[1]', X.CONNECTORS)} AND NOT {_in('t[1]', X.NOISE)} AND len(list_filter(t[3:], lambda x: length(x) >= 3 AND {_WORTH})) > 0
    THEN {_J.format(f'list_append(list_filter(t[3:], lambda x: length(x) >= 3 AND {_WORTH}), t[1])')} END AS reordered_of,
  CASE WHEN len(t) <= 2 OR len(list_filter(t, lambda x: length(x) >= 4 AND {_WORTH} AND NOT {_in('x', X.LOW_SIGNAL)})) < 2 OR len(high) < 2 THEN {_J.format('t')} ELSE {_J.format('high')} END AS without_low_signal,
  {S.collapse(S.strip('lower(title)'))} AS query_key, {S.collapse(S.strip('lower(title)'))} <> {S.collapse(S.strip("lower(coalesce(author, ''))"))} AS changed,
  CASE WHEN author IS NULL THEN '20:title_only:' || title ELSE '10:title_author:' || title || ' ' || author || '|11:author_title:' || author || ' ' || title || CASE WHEN bare <> title THEN '|15:stripped:' || bare || ' ' || author ELSE '' END END AS queries
FROM v"""
_TOKENS = ["straighi", "lightand", "thefallen", "worldofwar", "hoagland", "McDonaldHouse", "cglad", "igloo", "1984", "12", "9.99", "a12", "2024", "12-345", "uuvwnbcd", "bestsellernational", "Ünal", "fortheloveofgod", "catei", "novel"]


def token_repairs(spark, sf_dir):
    """Words of parts with known damage."""
    k = F.col("p_partkey")
    made = F.element_at(F.array(*[F.lit(t) for t in _TOKENS]), (k % len(_TOKENS) + 1).cast("int"))
    word = F.when(k % 3 == 0, F.regexp_replace("p_name", " ", "and")).when(k % 3 == 1, F.regexp_replace(F.initcap("p_name"), " ", "")).otherwise(made)
    rows = B.read(spark, sf_dir, "part").select("p_partkey", word.alias("word")).withColumn("token", X.canonical_token(F.col("word")))
    return rows.select(
        "p_partkey", "token", X.is_year(F.col("token")).alias("year"), X.is_numeric_noise(F.col("word"), F.col("token")).alias("numeric_noise"), X.is_badge_noise(F.col("token")).alias("badge_noise"),
        F.array_join(X.split_case(F.col("word")), "|").alias("split_case"), F.array_join(X.letter_swaps(F.col("token")), "|").alias("letter_swaps"), X.mended_ending(F.col("token")).alias("mended"),
        F.array_join(X.split_fused(F.col("token")), "|").alias("split_fused"),
    )


def _fused() -> str:
    mend = lambda b: f"CASE WHEN {b} LIKE '%i' AND length({b}) >= 6 THEN substr({b}, 1, length({b}) - 1) || 't' ELSE {b} END"
    out = [f"WHEN token IN {words(X.NOT_FUSED)} THEN token"]
    for j in X.JOINERS:
        n, base, at = len(j), f"substr(token, 1, length(token) - {len(j)})", f"strpos(token, {q(j)})"
        left, right = f"substr(token, 1, {at} - 1)", f"substr(token, {at} + {n})"
        long, ends = f"length(token) > {n + 3}", f"token LIKE '%{j}'"
        out.append(f"WHEN {long} AND {ends} AND length({base}) >= 4 THEN ({mend(base)}) || '|{j}'")
        out.append(f"WHEN {long} AND NOT {ends} AND token LIKE '{j}%' AND length(substr(token, {n + 1})) >= 4 THEN '{j}|' || substr(token, {n + 1})")
        out.append(f"WHEN {long} AND NOT {ends} AND {at} > 4 AND length({right}) >= 3 THEN ({mend(left)}) || '|{j}|' || {right}")
    return "CASE " + " ".join(out) + " ELSE token END"


QUERIES["token_repairs"] = token_repairs
_DIG, _LET = "length(regexp_replace(token, '[^0-9]', '', 'g'))", "length(regexp_replace(token, '[^a-z]', '', 'g'))"
_YEAR = "regexp_matches(token, '^(1[5-9][0-9]{2}|20[0-9]{2})$')"
_GARBAGE = "(length(token) >= 7 AND regexp_matches(token, '^[a-z]+$') AND ((length(token) >= 9 AND regexp_matches(token, '[bcdfghjklmnpqrstvwxyz]{6,}')) OR (regexp_matches(token, 'uu|uw|gv|vn|nngv|rnr') AND length(regexp_replace(token, '[aeiou]', '', 'g')) >= 5 AND length(regexp_replace(token, '[^aeiou]', '', 'g')) <= 2)))"
ORACLES["token_repairs"] = f"""WITH w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', 'and') WHEN 1 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '')
  ELSE {S.array(_TOKENS)}[p_partkey % {len(_TOKENS)} + 1] END AS word FROM part),
t AS (SELECT *, regexp_replace(lower({S.fold("translate(word, 'ıİşŞğĞüÜöÖçÇ', 'iIsSgGuUoOcC')")}), '[^a-z0-9]', '', 'g') AS token FROM w),
s AS (SELECT *, list_filter(list_concat(CASE WHEN length(token) >= 4 AND regexp_matches(token, '[il]') THEN [replace(token, 'i', 'l'), replace(token, 'l', 'i')] ELSE [] END,
  CASE WHEN length(token) >= 5 THEN [translate(substr(token, 1, 1), 'cg', 'gc') || substr(token, 2), substr(token, 1, 1) || translate(substr(token, 2, 1), 'cg', 'gc') || substr(token, 3)] ELSE [] END), lambda x: x <> token) AS swaps FROM t)
SELECT p_partkey, token, {_YEAR} AS year,
  token = '' OR regexp_matches(word, '^\\$?[0-9]+\\.[0-9]{{2}}$') OR regexp_matches(token, '^[0-9]{{1,3}}$') OR (regexp_matches(token, '^[0-9]{{4}}$') AND NOT {_YEAR}) OR ({_DIG} >= 2 AND {_LET} <= 1)
    OR ({_DIG} > {_LET} AND length(token) <= 5) OR regexp_matches(token, '^[0-9]{{5,}}$') AS numeric_noise,
  token IN {words(X.NOISE)} OR {_GARBAGE} OR (length(token) >= 6 AND (regexp_matches(token, {q(X.BADGES[0])}) OR regexp_matches(token, {q(X.BADGES[1])}))) AS badge_noise,
  CASE WHEN length(word) < 6 THEN word ELSE regexp_replace(word, '([a-zçğıöşü])([A-ZÇĞİÖŞÜ])', '\\1|\\2', 'g') END AS split_case,
  array_to_string(list_filter(swaps, lambda x, i: list_position(swaps, x) = i), '|') AS letter_swaps,
  CASE WHEN regexp_matches(token, '(straigh|righ|lef|figh|weigh|heigh)i$') THEN substr(token, 1, length(token) - 1) || 't' ELSE token END AS mended, {_fused()} AS split_fused
FROM s"""


def line_queries(spark, sf_dir):
    """Of each document: queries over the edges of lines, its first line's last word of weight, and its corrected tokens."""
    docs = _lines(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("l")).withColumn("lines", F.transform("l", lambda x: x["line"]))
    docs = docs.withColumn("tokens", F.flatten(F.transform("lines", lambda x: E.tokens(F.lower(x)))))
    return docs.select("doc", F.array_join(X.boundary_queries(F.col("lines")), "|").alias("boundary"), F.array_join(F.transform("lines", X.title_tail), "|", "-").alias("tails"), F.array_join(X.correct_phrases(F.col("tokens")), " ").alias("corrected"))


QUERIES["line_queries"] = line_queries

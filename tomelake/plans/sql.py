"""DuckDB spellings of the Column expressions, for the oracles."""

from __future__ import annotations

from tomelake.functions import decisions as D
from tomelake.functions import lines as L
from tomelake.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def array(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def collapse(x: str) -> str:
    return sub(x, r"\s+", " ")


def fold(x: str) -> str:
    return f"translate(replace(replace({x}, 'ß', 'ss'), 'æ', 'ae'), {q(T.FOLD_FROM)}, {q(T.FOLD_TO)})"


def comparison(x: str) -> str:
    return strip(collapse(sub(f"lower({x})", r"[^a-z0-9_\s]")))


def parts(x: str, least: int = 1) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: length(t) >= {least})"


def comparison_tokens(x: str) -> str:
    return parts(comparison(x))


def fuzzy(x: str) -> str:
    """An apostrophe between word characters is set aside (twice, as matches may share a character) while the others go."""
    x = sub(fold(f"lower({x})"), r"[^a-z0-9_\s']", " ")
    for _ in range(2):
        x = sub(x, "([a-z0-9_])'([a-z0-9_])", "\\1\x01\\2")
    return strip(collapse(f"replace(replace({x}, '''', ' '), chr(1), '''')"))


def fuzzy_tokens(x: str) -> str:
    bare = f"list_transform({parts(fuzzy(x))}, lambda t: regexp_replace(t, '''s$', ''))"
    return f"list_filter({bare}, lambda t: length(t) >= 3 AND t NOT IN {words(T.NOISE_TOKENS)} AND (NOT regexp_matches(t, '^[0-9]+$') OR length(t) IN (10, 13)))"


def match(x: str) -> str:
    return strip(collapse(sub(f"upper({fold(x)})", r"[^A-Z0-9_\s]", " ")))


def match_tokens(x: str) -> str:
    return parts(match(x))


def alpha(x: str) -> str:
    solid = f"length({sub(x, chr(92) + 's')})"
    return f"CASE WHEN {solid} = 0 THEN 0.0 ELSE length({sub(x, '[^A-Za-z]')})::DOUBLE / {solid} END"


def levenshtein_similarity(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {longest} = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b})::DOUBLE / {longest} END"


def line_similarity(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE {levenshtein_similarity(a, b)} END"


def ocr(x: str) -> str:
    return f"translate({strip(f'upper({x})')}, {q(T.OCR_FROM)}, {q(T.OCR_TO)})"


def ocr_line(x: str) -> str:
    return f"translate({comparison(x)}, {q(T.LINE_OCR_FROM)}, {q(T.LINE_OCR_TO)})"


def query(x: str) -> str:
    return collapse(sub(strip(f"lower({x})"), r"[^a-z0-9_\s]"))


def query_tokens(x: str) -> str:
    return parts(query(x), 2)


def title(x: str) -> str:
    return strip(collapse(sub(strip(f"upper(replace({x}, 'ß', 'SS'))"), r"[^A-Z0-9_\s]", " ")))


def title_tokens(x: str) -> str:
    return f"list_distinct(list_filter({parts(title(x))}, lambda t: lower(t) NOT IN {words(T.TITLE_STOPWORDS)}))"


def trigrams(x: str) -> str:
    words_ = f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words_}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def trigram_similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"coalesce({shared}::DOUBLE / nullif(len({a}) + len({b}) - {shared}, 0), 0.0)"


def by_key(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in values.items()) + " END"


def threshold(tier: str, which: int) -> str:
    return by_key(tier, {t: v[which] for t, v in D.THRESHOLDS.items()})


def price(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({strip(x)}, {q(p)})" for p in L.PRICES) + ")"


def fragment(x: str) -> str:
    t, s = match_tokens(x), strip(x)
    return (
        f"(length({s}) <= 2 OR (len({t}) = 1 AND length({t}[1]) <= 2) OR ({alpha(s)} < 0.5 AND length({s}) < 8) OR (len({t}) = 1 AND length({t}[1]) <= 4 AND {alpha(s)} < 0.8))"
    )


def has(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


#: Lines of documents: doc_id, line_idx (from 0), line.
LINES = "lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_idx FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
#: Distinct pairs of neighbouring words, ASCII only.
PAIRS = (
    "ws AS (SELECT list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(" + fold("w") + ", '[^\\x20-\\x7E]', '', 'g')) AS w FROM documents), "
    "pairs AS (SELECT DISTINCT p.a AS a, p.b AS b FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: {'a': w[i], 'b': w[i + 1]})) AS p FROM ws))"
)
#: A made-up number for each part: id, isbn13 and isbn10 (every third one with a wrong check digit), and a text around them.
ISBNS = """
base AS (SELECT p_partkey AS id, lpad((p_partkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS d FROM part),
dig AS (
  SELECT id, d,
    (10 - (38 + list_sum(list_transform(range(1, 10), lambda i: substr(d, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)))::BIGINT % 10) % 10 AS c13,
    (11 - list_sum(list_transform(range(1, 10), lambda i: substr(d, i, 1)::INT * (11 - i)))::BIGINT % 11) % 11 AS c10
  FROM base),
isbns AS (
  SELECT id, '978-' || d || '-' || ((c13 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) % 10)::VARCHAR AS isbn13,
    d || CASE WHEN (c10 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) % 11 = 10 THEN 'x' ELSE ((c10 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) % 11)::VARCHAR END AS isbn10
  FROM dig)
"""
#: Boxes made of order lines: session_id, det_idx, box, score.
DETECTIONS = """
detections AS (
  SELECT l_orderkey AS session_id, l_linenumber AS det_idx, (l_partkey * 37 % 640)::DOUBLE AS cx, (l_suppkey * 53 % 640)::DOUBLE AS cy,
    l_quantity * 8 + 5 AS width, (l_extendedprice % 90) + 3 AS height, (l_discount * 100 - 5) * 0.5 AS angle, l_tax * 10 + 0.15 AS score
  FROM lineitem)
"""

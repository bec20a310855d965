"""Queries of role scores and of titles joined from lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import lines as L
from tomelake.functions import roles as R

from . import sql as S
from . import tables as B
from .sql import array, q, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _lines(spark, sf_dir):
    """Lines of names, titles and scraps made of parts: doc (seven lines each), line_idx, line."""
    k = F.col("p_partkey")
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (F.floor(k / n) % len(items) + 1).cast("int"))
    first, last, content, more = pick(R.FIRST_NAMES, 1), pick(R.LAST_NAMES, 2), pick(R.TITLE_CONTENT, 3), pick(R.TITLE_CONTENT, 5)
    kind = (k * 5 + F.floor(k / 7)) % 8
    line = (
        F.when(kind == 0, F.concat(first, F.lit(" "), last))
        .when(kind == 1, F.concat(F.lit("THE "), content, F.lit(" "), F.upper("p_name")))
        .when(kind == 2, F.initcap("p_name"))
        .when(kind == 3, F.concat(F.initcap(content), F.lit(" of "), F.initcap(more)))
        .when(kind == 4, F.when(k % 2 == 0, "of").otherwise("The"))
        .when(kind == 5, F.concat(F.initcap(first), F.lit(" "), F.initcap(content), F.lit(" Press")))
        .when(kind == 6, F.when(k % 3 == 0, "$4.99").when(k % 3 == 1, "BANTAM").otherwise(" "))
        .otherwise(F.concat(F.initcap(first), F.lit(" Q. "), F.initcap(last)))
    )
    return B.read(spark, sf_dir, "part").select(F.floor(k / 7).alias("doc"), (k % 7).alias("line_idx"), line.alias("line"))


def _pick(items, n: int) -> str:
    return f"{array(items)}[(p_partkey // {n}) % {len(items)} + 1]"


def _cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


_F, _L, _C, _M = _pick(R.FIRST_NAMES, 1), _pick(R.LAST_NAMES, 2), _pick(R.TITLE_CONTENT, 3), _pick(R.TITLE_CONTENT, 5)
LINES = f"""lines AS (SELECT p_partkey // 7 AS doc, p_partkey % 7 AS line_idx, CASE (p_partkey * 5 + p_partkey // 7) % 8 WHEN 0 THEN {_F} || ' ' || {_L} WHEN 1 THEN 'THE ' || {_C} || ' ' || upper(p_name)
  WHEN 2 THEN array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') WHEN 3 THEN {_cap(_C)} || ' of ' || {_cap(_M)}
  WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN 'of' ELSE 'The' END WHEN 5 THEN {_cap(_F)} || ' ' || {_cap(_C)} || ' Press' WHEN 6 THEN CASE p_partkey % 3 WHEN 0 THEN '$4.99' WHEN 1 THEN 'BANTAM' ELSE ' ' END
  ELSE {_cap(_F)} || ' Q. ' || {_cap(_L)} END AS line FROM part)"""


def role_scores(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("r", R.role(F.col("line")))
    return rows.select("doc", "line_idx", "r.person", "r.title", "r.role", R.rejects_as_author(F.col("line")).alias("rejected"))


def _if(condition: str, value: float) -> str:
    return f"(CASE WHEN {condition} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END)"


def _n(items) -> str:
    return f"len(list_filter(t, lambda x: x IN {words(items)}))"


QUERIES["role_scores"] = role_scores
_CAPS = "len(w) >= 2 AND len(list_filter(w, lambda y: NOT (length(y) <= 2 OR y = upper(y)))) = 0"
_CASED = "len(list_filter(w, lambda y: NOT (length(y) <= 1 OR substr(y, 1, 1) = upper(substr(y, 1, 1))))) = 0"
_NAMES = R.FIRST_NAMES + R.LAST_NAMES
ORACLES["role_scores"] = f"""WITH {LINES},
a AS (SELECT *, {S.match_tokens('line')} AS t, {S.alpha('line')} AS a, regexp_split_to_array({S.strip('line')}, '\\s+') AS w, {S.strip('line')} AS s FROM lines),
b AS (SELECT *, len(t) AS n, {_n(R.TITLE_CONTENT)} AS content, {_n(_NAMES)} AS names FROM a),
c AS (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN n BETWEEN 2 AND 4 THEN 0.5::DOUBLE WHEN n = 1 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END) + {_if('a >= 0.85', 0.2)}
    + (CASE WHEN {_CAPS} THEN 0.2::DOUBLE WHEN {_CASED} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + {_if(f't[1] IN {words(R.FIRST_NAMES)}', 0.15)} + {_if(f't[-1] IN {words(R.LAST_NAMES)}', 0.15)} - {_if('a < 0.7', 0.3)}
    - {_if(f'{_n(L.ORG_MARKERS)} > 0', 0.5)} - {_if(f't[1] IN {words(R.TITLE_INDICATORS)}', 0.4)} - (CASE WHEN content = 0 THEN 0.0::DOUBLE WHEN content::DOUBLE / n >= 0.5 THEN 0.35::DOUBLE ELSE 0.15::DOUBLE END))) END AS person,
  CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CASE WHEN n BETWEEN 2 AND 6 THEN 0.5::DOUBLE WHEN n = 1 AND length(t[1]) >= 4 THEN 0.3::DOUBLE WHEN n > 6 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END)
    + {_if(f't[1] IN {words(R.ARTICLES)}', 0.25)} + {_if(f'{_n(R.TITLE_INDICATORS)} > 0', 0.1)} + {_if('content >= 1', 0.15)} + {_if('n >= 3 AND names = 0', 0.1)} - {_if('a < 0.6', 0.2)} - {_if('names >= 2 AND names >= n * 0.6', 0.4)}
    - {_if(f"{S.match('s')} IN {words(L.IMPRINTS)}", 0.5)} - {_if(S.price('s'), 0.5)} - {_if(S.fragment('s'), 0.3)})) END AS title FROM b),
d AS (SELECT *, CASE WHEN person > title + 0.15::DOUBLE THEN 'author' WHEN title > person + 0.15::DOUBLE THEN 'title' ELSE 'ambiguous' END AS role FROM c)
SELECT doc, line_idx, person, title, role, (role = 'title' AND title >= 0.6::DOUBLE) OR coalesce(t[1] IN {words(R.ARTICLES)}, false) OR content >= 2 AS rejected FROM d"""


def joined_titles(spark, sf_dir):
    docs = _lines(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("l")).withColumn("lines", F.transform("l", lambda x: x["line"]))
    docs = docs.withColumn("titles", R.joined_titles(F.col("lines"), R.BRIDGES)).withColumn("over", F.transform("lines", lambda x: R.person_override(x, F.col("titles"))))
    best = F.get("titles", F.lit(0))
    return docs.select(
        "doc", F.size("titles").alias("n"), best["text"].alias("text"), best["score"].alias("score"), best["reason"].alias("reason"), F.array_join(F.transform("titles", lambda x: F.concat_ws(":", x["first"], x["size"])), "|").alias("places"),
        F.array_join(F.transform("over", lambda x: x["reason"]), "|").alias("overrides"),
    )


QUERIES["joined_titles"] = joined_titles

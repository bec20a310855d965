"""Queries of the fields of spine lines and of the whole token-set score."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.functions import fields as D
from tomelake.functions import text as T

from . import tables as B
from .catalog_queries import _scored
from .spine_queries import SPINES, _clamp, _if, _m

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def field_scores(spark, sf_dir):
    rows = B.spine_lines(spark, sf_dir).withColumn("person", D.person_score(F.col("line")))
    return rows.select("session_id", "line_idx", "person", D.title_score(F.col("line"), F.col("person")).alias("title"))


QUERIES["spine_field_scores"] = field_scores
_N = "len(regexp_split_to_array(line, '\\s+'))"
_PERSON = (
    f"0.5::DOUBLE + {_if(_N + ' BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array(line, ' + chr(39) + chr(92) + 's+' + chr(39) + '), lambda x: NOT ' + _m('x', '^[A-Z]') + ')) = 0', 0.2)} + {_if(_m('line', '(?i)' + chr(92) + 'b[A-Z]' + chr(92) + '.'), 0.15)}"
    f" + {_if(_m('line', '(?i)^(?:dr|prof|mr|mrs|ms|sir)' + chr(92) + '.?' + chr(92) + 's+'), 0.1)} - {_if(_N + ' > 5', 0.2)} - {_if(_m('line', '(?i)^(?:the|a|an)' + chr(92) + 's+'), 0.3)} - {_if(_m('line', '[0-9]'), 0.2)}"
)
_TITLE = (
    f"0.5::DOUBLE + {_if('length(line) > 20', 0.1)} + {_if('length(line) > 40', 0.1)} + {_if(_m('line', '[:–—-]'), 0.1)} + {_if(_m('line', '(?i)^(?:the|a|an)' + chr(92) + 's+'), 0.15)} - {_if('person > 0.7::DOUBLE', 0.3)}"
    f" + (CASE WHEN {_N} = 1 AND person < 0.5::DOUBLE THEN 0.1::DOUBLE WHEN {_N} = 1 THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)"
)
ORACLES["spine_field_scores"] = f"""WITH {SPINES}, p AS (SELECT *, CASE WHEN length(line) < 2 THEN 0.0::DOUBLE ELSE {_clamp(_PERSON)} END AS person FROM spines)
SELECT session_id, line_idx, person, CASE WHEN length(line) < 2 THEN 0.0::DOUBLE ELSE {_clamp(_TITLE)} END AS title FROM p"""


def spine_fields(spark, sf_dir):
    """Fields of lines made of parts, with numbers, publishers, editions and years."""
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").join(B.isbns(spark, sf_dir), "id")
    k = F.col("id") % 6
    line = (
        F.when(k == 0, F.concat(F.lit("ISBN "), "isbn13", F.lit(" or "), "isbn10")).when(k == 1, F.concat(F.initcap("p_name"), F.lit(" Press, 2nd Edition 1999")))
        .when(k == 2, F.concat(F.lit("© 20"), F.lpad((F.col("id") % 25).cast("string"), 2, "0"), F.lit(" Penguin, reprint 1987"))).when(k == 3, F.concat(F.lit("Published by "), F.initcap("p_name"), F.lit("; 2011")))
        .when(k == 4, F.concat(F.lit("First Edition of "), "p_name")).otherwise(F.col("p_name"))
    )
    rows = part.select("id", line.alias("line")).withColumn("e", D.edition(F.col("line")))
    flat = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n] for n in names])), "|")
    return rows.select(
        "id", flat(D.isbns(F.col("line")), "value", "type").alias("isbns"), flat(D.publishers(F.col("line"), F.lit(0.8)), "value", "method").alias("publishers"), F.col("e.value").alias("edition"), F.col("e.number").alias("number"),
        F.col("e.type").alias("type"), flat(D.years(F.col("line")), "year", "context").alias("years"),
    )


QUERIES["spine_fields"] = spine_fields


def fuzzy_ranked(spark, sf_dir):
    """Candidates of each query by the whole score, and how far the best leads (1 where it is alone)."""
    score = T.token_set_score(F.col("query"), F.col("title"), F.col("authors"), F.col("query_id") % 5 == 0, F.when(F.col("query_id") % 2 == 0, F.get("authors", F.lit(0))))
    rows = _scored(spark, sf_dir).withColumn("s", score)
    by = W.partitionBy("query_id")
    order = by.orderBy(F.desc("s.score"), "position")
    rows = rows.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("s.score").over(order))
    gap = F.when(F.col("rank") == 1, F.coalesce(F.col("s.score") - F.col("second"), F.lit(1.0)))
    return rows.select("query_id", "position", "rank", F.round("s.score", 6).alias("score"), "s.overlap", F.round("s.f1", 6).alias("f1"), "s.signal", "s.generic", "s.weak", F.round(gap, 6).alias("gap"))


QUERIES["fuzzy_ranked"] = fuzzy_ranked

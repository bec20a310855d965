"""Queries of equal and derived works and of merged rotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomelake.functions import works as W

from . import tables as B
from .role_queries import _lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _ranked(spark, sf_dir):
    """Each part as the best of four ranked records: itself with a slip or brackets, a book about it, and the part after it."""
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" chronicles")).alias("t"), "p_brand")
    after = part.select((F.col("id") - 1).alias("id"), F.col("t").alias("u"), F.col("p_brand").alias("other"))
    slip = F.when(F.col("id") % 3 == 0, F.concat("t", F.lit(" (Deluxe)"))).when(F.col("id") % 3 == 1, F.regexp_replace("t", "c", "e")).otherwise(F.regexp_replace("t", "chronicles", "chronides"))
    return part.join(after, "id").select("id", F.col("t"), slip.alias("s"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Summary of "), "t")).otherwise(F.concat("t", F.lit(" by "), "p_brand")).alias("d"), "u", "p_brand", "other")


def same_works(spark, sf_dir):
    rows = _ranked(spark, sf_dir)
    one, two = F.array(F.concat(F.lit("A "), "p_brand")), F.array(F.concat(F.lit("B "), "other"))
    record = lambda t, a: W.work(F.col(t), a)
    rows = rows.select("id", record("t", one).alias("t"), record("s", one).alias("s"), record("d", two).alias("d"), record("u", two).alias("u"))
    rows = rows.withColumn("w", F.array("t", "s", "d", "u"))
    return rows.select(
        "id", W.same_work(F.col("t"), F.col("s")).alias("same"), W.same_work(F.col("t"), F.col("u")).alias("next_same"), W.is_derived(F.col("d"), F.col("t")).alias("derived"), W.distinct_second(F.col("w")).alias("second"), W.best_spelled(F.col("w")).alias("best"),
    )


QUERIES["same_works"] = same_works
_K = lambda x: f"regexp_replace(lower(regexp_replace({x}, '\\s*[\\[(][^\\])]*[\\])]\\s*', ' ', 'g')), '[^a-z0-9]', '', 'g')"
_P = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
_DIGITS = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
_SAME = lambda a, b, names: f"({a} = {b} OR ({names} AND least(length({a}), length({b})) >= 10 AND {_DIGITS(a)} = {_DIGITS(b)} AND levenshtein({a}, {b}) <= 2))"
ORACLES["same_works"] = f"""WITH p AS (SELECT p_partkey AS id, p_name || ' chronicles' AS t, p_brand FROM part),
r AS (SELECT a.id, a.t, CASE a.id % 3 WHEN 0 THEN a.t || ' (Deluxe)' WHEN 1 THEN replace(a.t, 'c', 'e') ELSE replace(a.t, 'chronicles', 'chronides') END AS s,
  CASE WHEN a.id % 2 = 0 THEN 'Summary of ' || a.t ELSE a.t || ' by ' || a.p_brand END AS d, b.t AS u, a.p_brand, b.p_brand AS other FROM p a JOIN p b ON b.id = a.id + 1),
k AS (SELECT *, {_K('t')} AS kt, {_K('s')} AS ks, {_K('d')} AS kd, {_K('u')} AS ku, {_P('t')} AS pt, {_P('s')} AS ps, {_P('d')} AS pd, {_P('u')} AS pu, {_P('p_brand')} AS n1, {_P('other')} AS n2 FROM r),
x AS (SELECT *, {_SAME('kt', 'ks', 'true')} AS same, {_SAME('kt', 'ku', 'n1 = n2')} AS tu, {_SAME('ks', 'ku', 'n1 = n2')} AS su, {_SAME('kt', 'kd', 'n1 = n2')} AS td, {_SAME('ks', 'kd', 'n1 = n2')} AS sd,
  length(pt) >= 8 AND pd <> pt AND contains(pd, pt) AND (contains(pd, n1) OR regexp_matches(d, '(?i)summary')) AS derived, length(ps) >= 8 AND pd <> ps AND contains(pd, ps) AND (contains(pd, n1) OR regexp_matches(d, '(?i)summary')) AS sderived,
  length(pt) >= 8 AND ps <> pt AND contains(ps, pt) AND contains(ps, n1) AS s_of_t, length(pt) >= 8 AND pu <> pt AND contains(pu, pt) AND contains(pu, n1) AS u_of_t FROM k),
y AS (SELECT *, CASE WHEN NOT same AND NOT s_of_t THEN 1 WHEN NOT (td OR (same AND sd)) AND NOT (derived OR (same AND sderived)) THEN 2 WHEN NOT (tu OR (same AND su)) AND NOT u_of_t THEN 3 END AS second,
  (contains(pt, pt)::INT + contains(ps, pt)::INT + contains(pd, pt)::INT + contains(pu, pt)::INT) AS st, (contains(pt, ps)::INT + contains(ps, ps)::INT + contains(pd, ps)::INT + contains(pu, ps)::INT) AS ss,
  (contains(pt, pu)::INT + contains(ps, pu)::INT + contains(pd, pu)::INT + contains(pu, pu)::INT) AS su_ FROM x)
SELECT id, same, tu AS next_same, derived, second, CASE WHEN (tu OR (same AND su)) AND su_ > greatest(st, CASE WHEN same THEN ss ELSE 0 END) THEN 3 WHEN same AND ss > st THEN 1 ELSE 0 END AS best FROM y"""


def merged_rotations(spark, sf_dir):
    """Documents of seven lines made of parts, as if recognised in three rotations."""
    conf = ((F.col("doc") * 7 + F.col("line_idx") * 13) % 100) / 100
    rows = _lines(spark, sf_dir).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("line_idx", F.col("line").alias("text"), conf.alias("confidence")))).alias("l"))
    rows = rows.withColumn("lines", F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"))))
    trial = lambda rotation, quality, first, n: F.struct(F.lit(rotation).alias("rotation"), quality.alias("quality"), W.rotation_evidence(F.slice("lines", first, n)).alias("e"))
    rows = rows.withColumn("trials", F.array(trial(0, F.col("doc") % 10 / 10, 1, 4), trial(90, F.col("doc") % 7 / 7, 4, 4), trial(270, F.col("doc") % 3 / 3, 2, 2)))
    rows = rows.withColumn("m", W.merged_rotations(F.col("trials"), F.lit(0), F.col("lines"))).withColumn("crops", W.merged_crops(F.array("m.lines", "lines")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "|")
    return rows.select("doc", text("m.lines").alias("lines"), "m.title_rotation", "m.author_rotation", "m.mixed", "m.strategy", text("crops").alias("crops"))


QUERIES["merged_rotations"] = merged_rotations

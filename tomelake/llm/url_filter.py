"""URL filters: explicit host and path rules first, then association rules mined with Spark's FP-growth.

The mined part takes labelled URLs as baskets of tokens (host labels, words of the path) plus one item for a blocked
page, keeps the rules tokens -> block of any length that pass support and confidence, drops those to which a more general
kept rule of at least the same confidence belongs, and matches a URL through an inverted index from each rule's rarest
token. Support is a count of blocked pages that doesn't rise with the table, so a small host gets its rules in any of them.

Edge cases: a null url, and one without `://`, has empty host and path and the verdict allow; a page without a label is
no basket; repeated pages and labels count as they come; without labels, or where nothing passes, no rule is mined;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved, table

BLOCK = "=block"
#: Up to so many mined rules go into the plan as one literal index; more are matched by a join.
LITERAL_RULES = 2000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _SPLIT, 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _SPLIT, 2)


def tokens_of(host: str = "host", path: str = "path") -> Column:
    """Distinct tokens: labels of the host, and runs of letters in the path."""
    labels = F.filter(F.split(F.col(host), r"\."), lambda x: x != "")
    words = F.filter(F.split(F.translate(F.col(path), UPPER, LOWER), "[^a-z]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.transform(words, lambda x: F.concat(F.lit("p:"), x))))


def explicit_rule(rules: tuple[Rule, ...], take) -> Column:
    """take(rule) of the longest rule that fits host and path, else null. Of rules of one length the first wins."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        out = F.when(fits, F.lit(take(rule))).otherwise(out)
    return out


def mine_rules(baskets: DataFrame, min_count: int, min_confidence: float) -> DataFrame:
    """baskets(tokens, blocked) -> rules (items, confidence, anchor): pruned, each with its rarest token as anchor."""
    baskets = saved(baskets.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    spark = baskets.sparkSession
    none = spark.createDataFrame([], "items array<string>, confidence double, anchor string")
    if not n:
        return none
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (min_count - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    mined = saved(
        model.associationRules.filter(F.element_at("consequent", 1) == BLOCK).select(F.array_sort("antecedent").alias("items"), "confidence")
    )
    counts = model.freqItemsets.filter((F.size("items") == 1)).select(F.element_at("items", 1).alias("item"), "freq")
    rarest = (
        mined.withColumn("item", F.explode("items")).join(counts, "item").groupBy("items").agg(F.min(F.struct("freq", "item")).alias("_least"))
    )
    # A rule is not needed where another one with a proper subset of its tokens is as sure: subsets are found by the anchor they share with it.
    narrow = mined.select(F.explode("items").alias("anchor"), F.col("items").alias("own"), F.col("confidence").alias("sure"))
    rules = mined.join(rarest, "items").select("items", "confidence", F.col("_least.item").alias("anchor"))
    needless = (
        narrow.join(rules, "anchor")
        .filter((F.size("items") < F.size("own")) & (F.size(F.array_except("items", "own")) == 0) & (F.col("confidence") >= F.col("sure")))
        .select(F.col("own").alias("items"))
        .distinct()
    )
    return saved(rules.join(needless, "items", "left_anti"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (with tokens) plus block_confidence: the highest confidence of a mined rule all of whose tokens the url has, else null."""
    if rules.count() <= LITERAL_RULES:
        index: dict[str, list[dict]] = {}
        for r in rules.orderBy("items").collect():
            index.setdefault(r["anchor"], []).append({"items": r["items"], "confidence": r["confidence"]})
        kind = "array<struct<items:array<string>,confidence:double>>"
        table_ = F.from_json(F.lit(json.dumps(index)), f"map<string,{kind}>")
        found = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(table_, t), F.array().cast(kind))))
        fit = F.filter(found, lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0)
        return urls.withColumn("block_confidence", F.array_max(F.transform(fit, lambda r: r["confidence"])))
    sets = urls.select("tokens").distinct()
    hit = (
        sets.withColumn("anchor", F.explode("tokens"))
        .join(rules, "anchor")
        .filter(F.size(F.array_except("items", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.max("confidence").alias("block_confidence"))
    )
    return urls.join(hit, "tokens", "left")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    min_count: int = 5,
    min_confidence: float = 0.6,
) -> DataFrame:
    """pages(page_id, url), labels(page_id, blocked) -> page_id, host, path, rule, verdict, block_confidence."""
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path")).withColumn("tokens", tokens_of())
    baskets = urls.filter("host != ''").join(labels.select("page_id", "blocked"), "page_id").select("tokens", "blocked")
    urls = match_rules(urls, mine_rules(baskets, min_count, min_confidence))
    verdict = F.when(F.col("block_confidence").isNotNull(), "block").otherwise("allow")
    return urls.select(
        "page_id",
        "host",
        "path",
        explicit_rule(rules, lambda r: r.text).alias("rule"),
        F.coalesce(explicit_rule(rules, lambda r: r.verdict), verdict).alias("verdict"),
        "block_confidence",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled as blocked where the row of its id in labels has quality 0 or toxic 1."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels.filter("blocked is not null"))


_FITS = "(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"
_CASES = [(r, _FITS.format(h=r.host, p=r.path)) for r in sorted(RULES, key=lambda r: -len(r.text))]
ORACLE = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_SPLIT}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{_SPLIT}', 2) AS path FROM pages),
w AS (
  SELECT *, list_sort(list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
    list_transform(list_filter(regexp_split_to_array(translate(path, '{UPPER}', '{LOWER}'), '[^a-z]+'), lambda x: x <> ''), lambda x: 'p:' || x)))) AS toks
  FROM u),
b AS (
  SELECT row_number() OVER () AS i, toks, quality = 0 OR toxic = 1 AS blocked FROM w JOIN labels ON page_id = doc_id
  WHERE host <> '' AND (quality = 0 OR toxic = 1) IS NOT NULL),
least AS (SELECT greatest(5, ceil(count(*) * 10 / 1000.0)) AS n FROM b),
e AS (SELECT i, blocked, unnest(toks) AS t FROM b),
sets AS (
  SELECT i, blocked, [t] AS items FROM e
  UNION ALL SELECT x.i, x.blocked, [x.t, y.t] FROM e x JOIN e y ON x.i = y.i AND x.t < y.t
  UNION ALL SELECT x.i, x.blocked, [x.t, y.t, z.t] FROM e x JOIN e y ON x.i = y.i AND x.t < y.t JOIN e z ON x.i = z.i AND y.t < z.t),
rules AS (
  SELECT items, count(*) FILTER (blocked) / count(*)::DOUBLE AS confidence FROM sets GROUP BY items
  HAVING count(*) FILTER (blocked) >= (SELECT n FROM least) AND count(*) FILTER (blocked) / count(*)::DOUBLE >= 0.6),
hit AS (
  SELECT page_id, max(confidence) AS block_confidence FROM w JOIN rules ON list_has_all(toks, items) GROUP BY page_id)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {c} THEN '{r.text}'" for r, c in _CASES)} END AS rule,
  CASE {' '.join(f"WHEN {c} THEN '{r.verdict}'" for r, c in _CASES)}
       ELSE CASE WHEN block_confidence IS NULL THEN 'allow' ELSE 'block' END END AS verdict,
  block_confidence
FROM w LEFT JOIN hit USING (page_id)
"""

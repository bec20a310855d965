"""Fuzzy catalog search by trigrams, for one query and for tables of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.functions import text as T


def search_fuzzy(catalog: DataFrame, query: str, limit: int = 5, threshold: float = 0.3, strict: bool = False, key: str = "id") -> DataFrame:
    """catalog plus similarity (float): titles at least (strict: more than) as similar as the threshold, best first, ties by key."""
    similarity = T.trigram_similarity(T.trigrams(F.col("title")), T.trigrams(F.lit(query)))
    found = catalog.withColumn("similarity", similarity)
    found = found.filter(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)
    return found.orderBy(F.desc("similarity"), key).limit(limit).withColumn("similarity", F.col("similarity").cast("float"))


def search_title_author(
    catalog: DataFrame, title: str, author: str | None = None, limit: int = 5, title_threshold: float = 0.3, author_threshold: float = 0.25, by_combined: bool = False, key: str = "id"
) -> DataFrame:
    """catalog(title, authors) plus title_similarity, author_similarity, combined_score. Ordered by the title's similarity, or by the combined score."""
    names = T.trigrams(F.array_join("authors", " "))
    with_author = bool(author)
    t = T.trigram_similarity(T.trigrams(F.col("title")), T.trigrams(F.lit(title)))
    a = T.trigram_similarity(names, T.trigrams(F.lit(author))) if with_author else F.lit(0.0)
    found = catalog.withColumn("title_similarity", t).withColumn("author_similarity", a)
    found = found.filter(F.col("title_similarity") > title_threshold if by_combined else F.col("title_similarity") >= title_threshold)
    if with_author:
        found = found.filter(F.col("author_similarity") > author_threshold)
    both = F.col("title_similarity") * 0.7 + F.col("author_similarity") * 0.3 if with_author else F.col("title_similarity")
    found = found.withColumn("combined_score", both)
    found = found.orderBy(F.desc("combined_score" if by_combined else "title_similarity"), key).limit(limit)
    return found.withColumns({c: F.col(c).cast("float") for c in ("title_similarity", "author_similarity", "combined_score")})


def search_many(catalog: DataFrame, queries: DataFrame, limit: int = 5, threshold: float = 0.3) -> DataFrame:
    """queries(query_id, query) against catalog(id, title): query_id, id, title, similarity, rank; the best `limit` of each query.

    Titles and queries meet on their trigrams. Of a query's trigrams only the rarest are looked up: a title that is as
    similar as the threshold shares at least ceil(threshold * n) of the query's n trigrams, so it shares one of any
    n - ceil(threshold * n) + 1 of them. Equal titles are searched once.
    """
    titles = catalog.select("title").distinct().withColumn("grams", T.trigrams(F.col("title")))
    postings = titles.select("title", F.col("grams").alias("title_grams"), F.explode("grams").alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = queries.select("query_id", T.trigrams(F.col("query")).alias("query_grams")).withColumn("gram", F.explode("query_grams"))
    rarest = W.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "gram")
    needed = F.size("query_grams") - F.ceil(F.size("query_grams") * threshold) + 1
    asked = asked.join(frequency, "gram", "left").withColumn("place", F.row_number().over(rarest)).filter(F.col("place") <= needed)
    pairs = asked.join(postings, "gram").select("query_id", "query_grams", "title", "title_grams").dropDuplicates(["query_id", "title"])
    scored = pairs.withColumn("similarity", T.trigram_similarity(F.col("query_grams"), F.col("title_grams"))).filter(F.col("similarity") >= threshold)
    # Equal titles have equal similarity, so of each only the first ids can be among the best.
    few = W.partitionBy("title").orderBy("id")
    ids = catalog.select("title", "id").withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= limit).drop("_n")
    best = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    found = scored.select("query_id", "title", "similarity").join(ids, "title").withColumn("rank", F.row_number().over(best))
    return found.filter(F.col("rank") <= limit).select("query_id", "id", "title", "similarity", "rank")


def extract_year(c: Column) -> Column:
    """The first year from 1000 to 2029 as text, else null."""
    found = F.regexp_extract(c, r"\b(1[0-9]{3}|20[0-2][0-9])\b", 1)
    return F.when(found != "", found)

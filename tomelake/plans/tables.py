"""The engine's logical tables, derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelake.functions import text as T
from tomelake.sources.scratch import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, dealt by doc_id: a file is read by one task, whatever its texts cost later."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text").repartition(n, "doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: doc_id, line_idx (from 0), line."""
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of neighbouring words, ASCII only: a, b."""
    ascii_ = lambda w: F.regexp_replace(T.fold(w), r"[^\x20-\x7E]", "")
    w = read(spark, sf_dir, "documents").select(F.transform(F.split("text", r"\s+"), ascii_).alias("w")).filter(F.size("w") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))
    return w.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def isbns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up number for each part: id, isbn13 and isbn10, every third one with a wrong check digit."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0").alias("d"))
    digit = lambda i: F.substring("d", i, 1).cast("int")
    c13 = (10 - (sum((digit(i) * (3 if i % 2 else 1) for i in range(1, 10)), F.lit(38)) % 10)) % 10
    c10 = (11 - (sum((digit(i) * (11 - i) for i in range(1, 10)), F.lit(0)) % 11)) % 11
    wrong = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    last = (c10 + wrong) % 11
    return rows.select(
        "id",
        F.concat(F.lit("978-"), "d", F.lit("-"), ((c13 + wrong) % 10).cast("string")).alias("isbn13"),
        F.concat("d", F.when(last == 10, "x").otherwise(last.cast("string"))).alias("isbn10"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes made of order lines: a session is an order."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").alias("det_idx"),
        (F.col("l_partkey") * 37 % 640).cast("double").alias("cx"),
        (F.col("l_suppkey") * 53 % 640).cast("double").alias("cy"),
        (F.col("l_quantity") * 8 + 5).alias("width"),
        (F.col("l_extendedprice") % 90 + 3).alias("height"),
        ((F.col("l_discount") * 100 - 5) * 0.5).alias("angle"),
        (F.col("l_tax") * 10 + 0.15).alias("score"),
    )


def session_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for most boxes: the name of the part."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("det_idx"), F.when(F.col("l_linenumber") < 6, F.col("p_name")).alias("full_text"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books made of parts: id, title, authors."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("authors"))


def millis(events: DataFrame) -> DataFrame:
    """events with ms since the epoch."""
    return events.withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def spine_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of spines made of the parts of orders: session_id, line_idx, line; a session has each line number once."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.initcap("p_name").alias("cap"), F.upper("p_name").alias("up"))
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"))
    one, two = F.initcap(F.col("w")[0]), F.initcap(F.element_at("w", -1))
    k = F.col("p_partkey") % 9
    line = (
        F.when(k == 0, F.col("cap"))
        .when(k == 1, F.col("up"))
        .when(k == 2, F.concat(F.lit("by "), one, F.lit(" "), two))
        .when(k == 3, F.concat(F.lit("The "), one, F.lit(" - "), two, F.lit(" "), one))
        .when(k == 4, F.concat("cap", F.lit(": How "), two, F.lit(" Was Made")))
        .when(k == 5, F.upper(two))
        .when(k == 6, F.concat(one, F.lit(" M. "), two))
        .when(k == 7, F.concat("cap", F.lit(" by "), two, F.lit(" "), one))
        .otherwise(F.concat(one, F.lit(" "), two, F.lit(" and "), two, F.lit(" "), one))
    )
    return items.join(part, "p_partkey").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("line_idx"), line.alias("line"))

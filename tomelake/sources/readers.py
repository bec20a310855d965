"""Sources and sinks: label files, JSON folders, provider responses, and tables in other formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomelake.functions import isbn as I
from tomelake.operators.detections import parse_labels

FORMATS = ("parquet", "orc", "json", "csv")


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in one of FORMATS. Text formats want a schema, so that no pass over the data is spent on guessing one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}; known are {', '.join(FORMATS)}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Spark's committers make the write atomic per task; readers see whole files only."""
    writer = df.write.mode(mode).option("header", True) if kind == "csv" else df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(path)


def read_label_files(spark: SparkSession, path: str, width: float = 640, height: float = 640) -> DataFrame:
    """Boxes of label text files (class and eight shares of the image a line): file, line_no, cx, cy, width, height, angle.

    Files are small and read whole, so that lines keep their number.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_labels(files, width, height)


def convert_labels(lines: DataFrame, size: float = 640) -> DataFrame:
    """lines(file, line_no, value) of `x1 y1 ... x4 y4 name difficulty` in pixels -> lines of `0` and eight shares with six places. Short lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    shares = [F.format_string("%.6f", F.col("f")[i].cast("double") / size) for i in range(8)]
    return lines.withColumn("f", f).filter(F.size("f") >= 9).select("file", "line_no", F.concat_ws(" ", F.lit("0"), *shares).alias("value"))


SEARCH_DOC = "key string, title string, author_name array<string>, first_publish_year int, publish_year array<int>, publisher array<string>, isbn array<string>, cover_i long, edition_count int, subject array<string>"


def books_of_search_docs(responses: DataFrame, column: str = "doc") -> DataFrame:
    """responses with JSON documents -> one book a row: first number of each length, first publisher, first year, five subjects. A document that isn't JSON gives a row of nulls."""
    rows = responses.withColumn("_d", F.from_json(F.col(column), SEARCH_DOC))
    d = lambda c: F.col(f"_d.{c}")
    none = F.array().cast("array<string>")
    numbers = F.coalesce(d("isbn"), none)
    return rows.select(
        *[c for c in responses.columns if c != column],
        d("title").alias("title"),
        F.coalesce(d("author_name"), none).alias("authors"),
        I.first_isbn_of_length(numbers, 13).alias("isbn13"),
        I.first_isbn_of_length(numbers, 10).alias("isbn10"),
        F.get(d("publisher"), F.lit(0)).alias("publisher"),
        F.coalesce(d("first_publish_year"), F.get(d("publish_year"), F.lit(0))).alias("publish_year"),
        F.when(d("edition_count") > 0, F.concat(d("edition_count").cast("string"), F.lit(" editions"))).alias("edition"),
        d("key").alias("source_id"),
        F.slice(d("subject"), 1, 5).alias("subjects"),
    )


def export_rejects(candidates: DataFrame, path: str) -> DataFrame:
    """Writes rejected candidates as JSON, one folder a session, and returns counts by decision and session."""
    write_table(candidates.filter("decision = 'reject'"), path, "json", ["session_id"], "overwrite")
    return candidates.groupBy("session_id", "decision").agg(F.count(F.lit(1)).alias("n"))

"""Statistics of tensors, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def floor_percentile(sorted_values: Column, p: float) -> Column:
    """sorted[floor(p / 100 * (n - 1))]: no interpolation. Null for an empty array."""
    return F.get(sorted_values, F.floor(F.lit(p) / 100 * (F.size(sorted_values) - 1)).cast("int"))


def exact_percentiles(rows: DataFrame, value: str, ps: list[float], by: list[str], cut=lambda df: df.checkpoint()) -> DataFrame:
    """Floor-index percentiles per group from counts of distinct values, so that no group of rows is collected in one place.

    Distinct values are dealt to ranges of (group, value). The sizes of a group's ranges tell what comes before each, and a
    running count inside a range does the rest, so no group is sorted by one task. The value at an index is the first whose
    running count exceeds it. `cut` keeps the ranges as they were dealt; the default is a reliable checkpoint.
    """
    from pyspark.sql import Window as W

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut(counts.repartitionByRange(n, *by, value).withColumn("_range", F.spark_partition_id()))
    sizes = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by)
    sizes = sizes.withColumn("_before", F.sum("_size").over(group.orderBy("_range")) - F.col("_size")).withColumn("_all", F.sum("_size").over(group))
    inside = F.sum("_n").over(W.partitionBy(*by, "_range").orderBy(value))
    counts = counts.withColumn("_inside", inside).join(sizes, [*by, "_range"]).withColumn("_upto", F.col("_before") + F.col("_inside"))
    pick = lambda p: F.min(F.when(F.col("_upto") > F.floor(F.lit(p) / 100 * (F.col("_all") - 1)), F.col(value)))
    return counts.groupBy(*by).agg(*[pick(p).alias(f"p{p:g}") for p in ps])


def tensor_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Per group: n, min, max, mean, sample standard deviation (0 for one value), and how many values are not a number or infinite."""
    v = F.col(value).cast("double")
    nan, inf = F.isnan(v), F.abs(v) == float("inf")
    good = F.when(~nan & ~inf, v)
    return rows.groupBy(*by).agg(
        F.count(good).alias("n"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.avg(good).alias("mean"),
        F.coalesce(F.stddev_samp(good), F.lit(0.0)).alias("std"),
        F.count_if(nan).alias("n_nan"),
        F.count_if(inf).alias("n_inf"),
    )


def threshold_counts(rows: DataFrame, value: str, thresholds: list[float], by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.count_if(F.col(value) >= t).alias(f"ge_{str(t).replace('.', '_')}") for t in thresholds])


def is_blank_crop(mean: Column, std: Column, low: Column, high: Column) -> Column:
    """Even grey, one value, or hardly any range."""
    return ((std * std < 50) & (F.abs(mean - 114) <= 10)) | (low == high) | (high - low < 10)


def decision_summary(rows: DataFrame, decision: str, correct: str, ms: str) -> DataFrame:
    """One row: counts and rates (percent) of decisions, precision of acceptances, mean time; zeros for an empty table."""
    n = F.count(F.lit(1))
    of = lambda k: F.count_if(F.col(decision) == k)
    rate = lambda c: F.when(n > 0, c / n * 100).otherwise(0.0)
    accepted = of("auto-accept")
    right = F.count_if((F.col(decision) == "auto-accept") & F.col(correct))
    return rows.agg(
        n.alias("total"),
        *[of(k).alias(k.replace("-", "_")) for k in ("auto-accept", "suggest", "ambiguous", "no-match")],
        rate(accepted).alias("auto_accept_rate"),
        F.when(accepted > 0, right / accepted * 100).otherwise(0.0).alias("auto_accept_precision"),
        F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_ms"),
    )


def confusion(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """For each threshold: tp, fp, fn, precision, recall, f1 (four places)."""
    grid = rows.select(F.col(score).alias("s"), (F.col(label) == 1).alias("y"), F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    c = grid.groupBy("threshold").agg(F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"), F.count_if(~hit & F.col("y")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))

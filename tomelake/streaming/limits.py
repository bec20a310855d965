"""Stateful processing of events: rate limits, debouncing, budgets, bounded queues, and their streaming twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Requests in a window, and its length in milliseconds.
MOST_REQUESTS, WINDOW_MS = 30, 60_000


def limit_rates(events: DataFrame, most: int = MOST_REQUESTS, window_ms: int = WINDOW_MS) -> DataFrame:
    """events(client, event_id, ms) -> with allowed and remaining. A client's window begins with its first request and ends when more than window_ms have gone.

    The fold goes through a client's requests in the order of time; it holds only the window's begin and count, and
    streams through a sorted partition, so a client of any size fits.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, begin, count = None, 0, 0
        for batch in batches:
            allowed, remaining = [], []
            for c, ms in zip(batch["client"], batch["ms"], strict=True):
                if c != client or ms - begin > window_ms:
                    client, begin, count = c, ms, 0
                ok = count < most
                count += ok
                allowed.append(ok)
                remaining.append(most - count if ok else 0)
            yield batch.assign(allowed=allowed, remaining=remaining)

    kind = dict(events.dtypes)["client"]
    rows = events.select("client", "event_id", "ms").repartition("client").sortWithinPartitions("client", "ms", "event_id")
    return rows.mapInPandas(fold, f"client {kind}, event_id long, ms long, allowed boolean, remaining long")


def limit_rates_stream(events: DataFrame, most: int = MOST_REQUESTS, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same for a streaming frame, with the window of a client as state. Within a micro-batch requests are taken in the order of time."""

    def update(key, batches, state):
        begin, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        allowed = []
        for ms in rows["ms"]:
            if begin is None or ms - begin > window_ms:
                begin, count = ms, 0
            ok = count < most
            count += ok
            allowed.append(ok)
        state.update((int(begin), int(count)))
        yield rows.assign(allowed=allowed)[["client", "event_id", "ms", "allowed"]]

    kind = dict(events.dtypes)["client"]
    return events.select("client", "event_id", "ms").groupBy("client").applyInPandasWithState(
        update, f"client {kind}, event_id long, ms long, allowed boolean", "begin long, count long", "append", "NoTimeout"
    )


def debounce(events: DataFrame, by: list[str], fingerprint: str, ms: str, cooldown_ms: int) -> DataFrame:
    """Adds skipped: the row before of the group has the same fingerprint and is less than the cooldown ago."""
    at = W.partitionBy(*by).orderBy(ms, "event_id")
    again = (F.lag(fingerprint).over(at) == F.col(fingerprint)) & (F.col(ms) - F.lag(ms).over(at) < cooldown_ms)
    return events.withColumn("skipped", F.coalesce(again, F.lit(False)))


def within_budget(queries: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    at = W.partitionBy(*by).orderBy(*order)
    return queries.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= most).drop("_n")


def enqueue(items: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """A queue after all items: of an item that came again the first stays, with how often it came (retries); the newest `most` are kept."""
    once = items.groupBy(by).agg(F.min(order).alias(order), (F.count(F.lit(1)) - 1).alias("retries"))
    return once.orderBy(F.desc(order), by).limit(most)


def process_queue(queue: DataFrame, order: str, batch: int = 5) -> DataFrame:
    """queue(item, order, outcome) after one run over the first `batch` items: success and failure go, offline and timeout return to the front, one more attempt counted."""
    head = queue.orderBy(order).limit(batch)
    back = head.filter(F.col("outcome").isin("offline", "timeout")).withColumn("attempts", F.col("attempts") + 1).withColumn("_part", F.lit(0))
    rest = queue.join(head.select("item"), "item", "left_anti").withColumn("_part", F.lit(1))
    return back.unionByName(rest).orderBy("_part", order).drop("_part")


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts by event type and tumbling window, for batch or streaming frames; late rows are dropped by a stream's watermark."""
    t = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return t.groupBy(F.window("_at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated_stream(events: DataFrame, key: list[str], time: str = "ts", within: str = "30 minutes") -> DataFrame:
    """Each key once within the time that state is kept."""
    return events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", within).dropDuplicatesWithinWatermark(key).drop("_at")


#: How long a session keeps an answer, and how many sessions wait for a network.
SESSION_CACHE_MS = 30 * 60 * 1000
OFFLINE_QUEUE = 50


def session_cache(requests: DataFrame, by: list[str], ms: str, order: str, ttl_ms: int = SESSION_CACHE_MS) -> DataFrame:
    """(order, hit): whether an answer fetched at most ttl_ms ago is at hand; a miss fetches and keeps it. Rows of a key stream through in order, so a key may have any number of rows."""
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.array(*[F.col(c).cast("string") for c in by]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, put = None, 0
        for batch in batches:
            hits = []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                hit = k == now and t - put <= ttl_ms
                if not hit:
                    now, put = k, t
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(hits, pa.bool_())], [order, "hit"])

    rows = requests.select(key.alias("k"), F.col(ms).alias("t"), F.col(order).cast("long").alias("o"))
    return rows.repartition(n, "k").sortWithinPartitions("k", "t", "o").mapInArrow(look, f"{order} long, hit boolean")


def requeue(items: DataFrame, by: str, seq: str, timestamp: str, most: int = OFFLINE_QUEUE) -> DataFrame:
    """A queue of sessions after all items: an item that comes again replaces the one before and counts a retry; the newest `most` stay."""
    last = items.groupBy(by).agg(F.max_by(timestamp, seq).alias(timestamp), (F.count(F.lit(1)) - 1).alias("retries"))
    return last.orderBy(F.desc(timestamp), by).limit(most)


def process_all(queue: DataFrame) -> DataFrame:
    """What stays of a queue(..., retries, success) after a run over all of it: what failed, one more retry counted."""
    return queue.filter(~F.coalesce(F.col("success"), F.lit(False))).withColumn("retries", F.col("retries") + 1).drop("success")

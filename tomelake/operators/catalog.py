"""Catalog, cache, correction and attempt tables: upserts, lookups, expiry and audits. Results are new tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.functions import decisions as D
from tomelake.functions import isbn as I
from tomelake.functions import records as R

MISS = '{"__cache_miss":true}'


def _filled(c: str | Column) -> Column:
    return F.nullif(c if isinstance(c, Column) else F.col(c), F.lit(""))


def upsert_books(catalog: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """catalog and incoming(provider, provider_id, title, ..., seq) -> catalog after all incoming rows in the order of seq.

    Title and authors are overwritten by the last row; every other column keeps its value unless a later row has one.
    Empty strings count as missing. New keys get an id from the key, so that a rerun gives the same one.
    """
    key = ["provider", "provider_id"]
    others = [c for c in catalog.columns if c not in (*key, "id", "title", "authors")]
    # Title and authors come from one row: of equal seq the one with the greatest title and authors.
    folded = incoming.groupBy(*key).agg(
        F.max(F.struct(seq, "title", "authors")).alias("_last"),
        *[F.max_by(c, F.when((_filled(c) if t == "string" else F.col(c)).isNotNull(), F.col(seq))).alias(f"_{c}") for c, t in catalog.dtypes if c in others],
    )
    joined = catalog.join(folded, key, "full_outer")
    return joined.select(
        F.coalesce("id", F.sha2(F.concat_ws("|", *key), 256)).alias("id"),
        *key,
        F.coalesce("_last.title", "title").alias("title"),
        F.coalesce("_last.authors", "authors").alias("authors"),
        *[F.coalesce(f"_{c}", c).alias(c) for c in others],
    )


def last_writer_wins(table: DataFrame, incoming: DataFrame, key: list[str], seq: str) -> DataFrame:
    """table after upserts that overwrite whole rows, nulls too; the greatest seq of a key wins."""
    rest = [c for c in table.columns if c not in key]
    fresh = incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(seq, *rest)).alias("_row")).select(*key, "_row.*").select(*table.columns)
    old, new = table.alias("old"), fresh.select(*[F.col(k).alias(f"_{k}") for k in key])
    same = [F.col(f"old.{k}").eqNullSafe(F.col(f"_{k}")) for k in key]
    kept = old.join(new, same, "left_anti").select(*table.columns)
    return kept.unionByName(fresh)


def live(cache: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return cache.filter(F.col(expires) > now)


def count_expired(cache: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """One row: deleted."""
    return cache.agg(F.count_if(F.col(expires) < now).alias("deleted"))


def lookup_cache(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """requests(provider, query_type, query_hash, ...) plus response and state: hit, known_miss (the sentinel is stored) or miss."""
    key = ["provider", "query_type", "query_hash"]
    found = requests.join(live(cache, now).select(*key, "response_json"), key, "left")
    state = F.when(F.col("response_json").isNull(), "miss").when(is_miss(F.col("response_json")), "known_miss").otherwise("hit")
    return found.withColumn("state", state).withColumn("response", F.when(state == "hit", F.col("response_json"))).drop("response_json")


def is_miss(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.__cache_miss") == "true", F.lit(False))


def hit_counts(looked_up: DataFrame) -> DataFrame:
    key = ["provider", "query_type", "query_hash"]
    return looked_up.filter(F.col("state") != "miss").groupBy(*key).agg(F.count(F.lit(1)).alias("hits"))


def cache_entries(responses: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Rows to be written: a missing response becomes the sentinel; they expire after some days."""
    return responses.withColumn("response_json", F.coalesce("response_json", F.lit(MISS))).withColumn("expires_at", now + F.expr(f"INTERVAL {days} DAYS"))


def lookup_by_isbn(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests(request_id, isbn) with the first catalog row of that number (thirteen digits or ten), null where none."""
    asked = requests.withColumn("_isbn", I.normalize_isbn(F.col("isbn")))
    keyed = catalog.select(F.explode(F.array_compact(F.array(I.catalog_isbn(F.col("isbn13"), 13), I.catalog_isbn(F.col("isbn10"), 10)))).alias("_isbn"), "id")
    first = keyed.groupBy("_isbn").agg(F.min("id").alias("id"))
    return asked.join(first, "_isbn", "left").drop("_isbn")


def first_seen(books: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """Of rows with an equal key (within `by`) the first stays."""
    at = W.partitionBy(*by, key).orderBy(order)
    return books.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def with_fallback(primary: DataFrame, fallback: DataFrame, by: str, key: str, order: str, enough: int = 3, most: int = 10) -> DataFrame:
    """Per group of `by`: primary rows where there are enough, else primary and fallback rows that don't repeat a key, `most` at most."""
    n = primary.groupBy(by).agg(F.count(F.lit(1)).alias("_found"))
    rows = primary.withColumn("_source", F.lit(0)).unionByName(fallback.withColumn("_source", F.lit(1)))
    rows = rows.join(n, by, "left").filter((F.col("_source") == 0) | (F.coalesce("_found", F.lit(0)) < enough))
    once = W.partitionBy(by, key).orderBy("_source", order)
    place = W.partitionBy(by).orderBy("_source", order)
    rows = rows.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= most).drop("_source", "_n", "_found")


def find_corrections(candidates: DataFrame, corrections: DataFrame) -> DataFrame:
    """candidates(candidate_id, isbn, content_hash) with the correction of their isbn key, else of their hash key (corrections: key, ...)."""
    other = [c for c in corrections.columns if c != "key"]
    by_isbn = corrections.select(F.col("key").alias("_isbn_key"), F.struct(*other).alias("_by_isbn"))
    by_hash = corrections.select(F.col("key").alias("_hash_key"), F.struct(*other).alias("_by_hash"))
    keyed = candidates.withColumn("_isbn_key", F.concat(F.lit("isbn:"), _filled("isbn"))).withColumn("_hash_key", F.concat(F.lit("hash:"), F.col("content_hash")))
    found = keyed.join(by_isbn, "_isbn_key", "left").join(by_hash, "_hash_key", "left").withColumn("_c", F.coalesce("_by_isbn", "_by_hash"))
    return found.select(*candidates.columns, F.coalesce("_isbn_key", "_hash_key").alias("correction_key"), *[F.col(f"_c.{c}").alias(c) for c in other])


def apply_hint(hints: Column, corrected: Column) -> Column:
    """The corrected value goes before the hints, if there are hints at all."""
    return F.when(corrected.isNotNull() & hints.isNotNull(), F.concat(F.array(corrected), hints)).otherwise(hints)


def correction_stats(corrections: DataFrame) -> DataFrame:
    """One row: total, applied, most_applied (null where nothing was applied)."""
    return corrections.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("apply_count"), F.lit(0)).alias("applied"),
        F.when(F.max("apply_count") > 0, F.max_by("key", F.struct("apply_count", F.col("key")))).alias("most_applied"),
    )


def newest(rows: DataFrame, n: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The n newest rows, of each group if `by` is given."""
    if not by:
        return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    at = W.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= n).drop("_n")


def missing_results(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Every input row, with its output where there is one, else decision reject and reason resolution_incomplete."""
    found = inputs.join(outputs, key, "left")
    return found.withColumn("reason", F.when(F.col("decision").isNull(), "resolution_incomplete").otherwise(F.col("reason"))).withColumn("decision", F.coalesce("decision", F.lit("reject")))


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """Rows that break a constraint: key columns and the constraint's name. As in SQL, a check that is null isn't broken; a repeated key is."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for name, c in checks.items()]))
    named = rows.select(*key, F.explode(broken).alias("constraint"))
    return named.unionByName(rows.groupBy(*key).count().filter("count > 1").select(*key, F.lit("unique").alias("constraint")))


def book_by_id(catalog: DataFrame, book_id) -> DataFrame:
    return catalog.filter(F.col("id") == F.lit(book_id))


def touched(table: DataFrame, changes: DataFrame, key: list[str], now: Column) -> DataFrame:
    """table after changes (key and some of its columns, one row a key) that set updated_at to now."""
    names = [c for c in changes.columns if c not in key]
    own = changes.select(*key, F.struct(*names).alias("_new"))
    new = F.col("_new")
    joined = table.join(own, key, "left")
    of = {n: F.when(new.isNotNull(), new[n]).otherwise(F.col(n)) for n in names} | {"updated_at": F.when(new.isNotNull(), now).otherwise(F.col("updated_at"))}
    return joined.select(*[of[c].alias(c) if c in of else F.col(c) for c in table.columns])


def resolver_attempts(candidates: DataFrame) -> DataFrame:
    """One audit row a candidate. Of the answer: answer, book, confidence, ambiguous, matched, match_score, canonical; of the candidate itself: resolved, resolved_confidence, debug_title, debug_score."""
    col = F.col
    top = R.top_match(col("answer"), col("book"), col("confidence"), col("ambiguous"), col("matched"), col("match_score"), col("canonical"))
    rows = candidates.withColumn("_top", top).withColumn("_book", F.coalesce("_top.book", "resolved")).withColumn("_d", R.attempt_decision(col("decision"), col("reason"), col("hypotheses")))
    own = F.when(col("resolved").isNotNull(), col("resolved_confidence")).when(col("debug_title").isNotNull(), col("debug_score"))
    named = F.when(col("resolved").isNull(), col("debug_title"))
    return rows.select(
        "session_id",
        "candidate_id",
        "hypotheses",
        F.when(col("_book").isNotNull(), D.resolver_key(col("_book.source"), col("_book.source_id"), F.lit(None).cast("string"), F.lit(None).cast("string"))).alias("resolver_key"),
        F.coalesce("_book.title", named).alias("title"),
        F.coalesce("_top.score", own).alias("score"),
        "_d.decision",
        "_d.reason",
    )


def correction_rows(corrections: DataFrame) -> DataFrame:
    """corrections(key, content_hash, title, author) as rows to append; those without any key are left out."""
    rows = corrections.withColumn("_k", R.correction_keys(F.col("key"), F.col("content_hash")))
    return rows.select("_k.resolver_key", "_k.evidence_hash", "title", F.when(_filled("author").isNotNull(), F.array("author")).alias("authors")).filter(_filled("resolver_key").isNotNull() | _filled("evidence_hash").isNotNull())


def export_corrections(corrections: DataFrame) -> DataFrame:
    """One JSON object {key: correction} a row, so that rows can be written side by side and read again one by one."""
    rest = [c for c in corrections.columns if c != "key"]
    return corrections.select(F.to_json(F.create_map("key", F.struct(*rest))).alias("json"))


def import_corrections(exported: DataFrame, schema: str) -> DataFrame:
    """Rows (key, ...) of JSON objects {key: correction}, whatever number of keys an object has; damaged ones give no row."""
    return exported.select(F.explode(F.from_json("json", f"map<string, struct<{', '.join(p.strip().replace(' ', ':', 1) for p in schema.split(','))}>>"))).select("key", "value.*")


def collected_books(candidates: DataFrame, crops: DataFrame) -> DataFrame:
    """Matched candidates of sessions with a cover: candidates(session_id, candidate_id, decision, cover_url, first_crop), crops(session_id, det_idx, crop_uri)."""
    own = candidates.filter(F.col("decision").isin("accept", "suggested"))
    first = crops.groupBy("session_id", F.col("det_idx").alias("first_crop")).agg(F.min("crop_uri").alias("crop_uri"))
    joined = own.join(first, ["session_id", "first_crop"], "left")
    return joined.select("session_id", "candidate_id", "decision", R.cover_uri(F.col("cover_url"), F.col("crop_uri")).alias("cover_uri"))


def enriched(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """candidates with what a batch lookup found under their olid; the others stay as they are."""
    own = found.select("olid", F.struct(*[c for c in found.columns if c != "olid"]).alias("_found"))
    joined = candidates.withColumn("_candidate", F.struct(*candidates.columns)).join(own, "olid", "left")
    return joined.select(R.enriched_book(F.col("_found"), F.col("_candidate")).alias("b")).select("b.*")


def triage(rejects: DataFrame, by: str) -> DataFrame:
    """rejects(by, s: triage_signals) -> counts, the six commonest reasons and a recommendation for each export."""
    count = lambda n: F.count_if(F.col(f"s.{n}")).alias(n)
    totals = rejects.groupBy(by).agg(F.count(F.lit(1)).alias("rejects"), *[count(n) for n in ("fixable", "unreadable", "weak_text", "no_hypotheses", "low_confidence")])
    reasons = rejects.groupBy(by, F.col("s.reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(by).orderBy(F.desc("n"), "reason")
    six = reasons.withColumn("_r", F.row_number().over(order)).filter("_r <= 6").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "reason", F.col("n").cast("string")).alias("t")))).alias("_l"))
    six = six.select(by, F.array_join(F.transform("_l", lambda x: x["t"]), "|").alias("top_reasons"))
    return totals.join(six, by).withColumn("recommendation", R.recommendation(F.col("rejects"), F.col("fixable"), F.col("unreadable")))


def merged_splits(datasets: dict[str, DataFrame]) -> DataFrame:
    """datasets(name, split, labels) laid together: images and labels of each split by where they come from."""
    rows = None
    for name, df in datasets.items():
        own = df.withColumn("dataset", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("images"), F.sum("labels").alias("labels"))

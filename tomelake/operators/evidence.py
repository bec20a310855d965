"""Evidence: best crops, order-dependent merging of lines, tiers of sessions, ranking of scored matches, aggregated library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.functions import decisions as D
from tomelake.functions import text as T


def fold_similar_lines(lines: Column) -> Column:
    """Lines (structs with text and confidence) in order, each merged into the first kept line it is like: the surer text takes that place.

    The fold depends on the order, as likeness isn't transitive. A line's comparable form is worked out once, before the fold.
    """
    keyed = F.transform(lines, lambda x: F.struct(T.ocr_line(x["text"]).alias("k"), x.alias("x")))

    def step(kept, line):
        # The place of the first similar kept line, from 1; 0 for none.
        hits = F.transform(kept, lambda k: T.similar_forms(line["k"], k["k"]))
        at = F.coalesce(F.array_position(hits, True), F.lit(0)).cast("int")

        def put(i):
            held = F.element_at(kept, i)
            swapped = F.concat(F.slice(kept, F.lit(1), i - 1), F.array(line), F.slice(kept, i + 1, F.size(kept)))
            return F.when(line["x"]["confidence"] > held["x"]["confidence"], swapped).otherwise(kept)

        places = F.transform(F.array(at), lambda i: F.when(i == 0, F.concat(kept, F.array(line))).otherwise(put(F.greatest(i, F.lit(1)))))
        return F.get(places, F.lit(0))

    return F.transform(F.aggregate(keyed, F.slice(keyed, 1, 0), step), lambda x: x["x"])


def prefix_similarity(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length; 0 where lengths differ by more than half of the longer."""
    n, m = F.length(a), F.length(b)
    longest = F.greatest(n, m)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, m))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(longest == 0, 1.0).when(F.abs(n - m) > longest * 0.5, 0.0).when(F.least(n, m) == 0, 0.0).otherwise(same / longest)


def merge_lines(lines: DataFrame, top_crops: int = 3) -> DataFrame:
    """lines(candidate_id, crop_idx, crop_score, line_idx, text, confidence) -> candidate_id, merged_lines, text_block.

    The best crops of a candidate (ties by index) give their lines in order; those of under two characters are left out;
    similar ones are folded; the rest is ordered by confidence, ties in their order.
    """
    best = W.partitionBy("candidate_id").orderBy(F.desc("crop_score"), "crop_idx")
    rows = lines.withColumn("_place", F.dense_rank().over(best)).filter(F.col("_place") <= top_crops)
    rows = rows.withColumn("text", T.strip(F.col("text"))).filter(F.length("text") >= 2)
    ordered = F.array_sort(F.collect_list(F.struct("_place", "line_idx", "text", "confidence", "crop_idx")))
    merged = rows.groupBy("candidate_id").agg(ordered.alias("_lines")).withColumn("_kept", fold_similar_lines(F.col("_lines")))
    final = F.array_sort(F.transform("_kept", lambda x, i: F.struct((-x["confidence"]).alias("o"), i.alias("i"), x["text"].alias("text"), x["confidence"].alias("confidence"), x["crop_idx"].alias("crop_idx"))))
    out = merged.withColumn("merged_lines", F.transform(final, lambda x: F.struct(x["text"].alias("text"), x["confidence"].alias("confidence"), x["crop_idx"].alias("crop_idx"))))
    return out.select("candidate_id", "merged_lines", F.array_join(F.transform("merged_lines", lambda x: x["text"]), "\n").alias("text_block"))


def session_tiers(crops: DataFrame) -> DataFrame:
    """crops(session_id, crop_idx, tier, confidence) -> session_id, counts by tier, session_tier (the best), best_crop (best tier, then surest, then first)."""
    rank = D.tier_rank(F.col("tier"))
    return crops.groupBy("session_id").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in D.TIERS],
        F.min_by("tier", rank).alias("session_tier"),
        F.min_by("crop_idx", F.struct(rank, -F.col("confidence"), F.col("crop_idx"))).alias("best_crop"),
    )


def at_tier_or_better(crops: DataFrame, tier: str) -> DataFrame:
    return crops.filter(D.tier_rank(F.col("tier")) <= D.TIERS.index(tier))


def rank_matches(scored: DataFrame, by: list[str], score: str, order: str) -> DataFrame:
    """Stable ranks by falling score, with the next lower score of the group."""
    at = W.partitionBy(*by).orderBy(F.desc(score), order)
    return scored.withColumn("rank", F.row_number().over(at)).withColumn("next_score", F.lead(score).over(at))


def score_gap(top: Column, second: Column) -> Column:
    """1 for a single candidate, 0 for none."""
    return F.when(top.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(top - second)


def decide_edge(scored: DataFrame, by: list[str], tier: str, flags: str, score: str = "score", order: str = "position") -> DataFrame:
    """Of each group the edge service's decision about its best match: group columns, type, confidence, reason, top order value."""
    top = rank_matches(scored, by, score, order).filter("rank = 1")
    d = D.edge_decision(F.col(score), F.col("next_score"), F.col(tier), F.col(flags))
    return top.withColumn("_d", d).select(*by, F.col(order).alias("top"), "_d.type", "_d.confidence", "_d.reason")


def library(candidates: DataFrame) -> DataFrame:
    """candidates(session_id, session_seq, ordering_key, decision, confidence, isbn13, isbn10, title, author) -> one row per book.

    Accepted and suggested candidates; of one dedupe key the surest stays, ties by arrival (newest session first, then place).
    """
    key = D.dedupe_key(F.col("isbn13"), F.col("isbn10"), F.col("title"), F.col("author"))
    rows = candidates.filter(F.col("decision").isin("accept", "suggested")).withColumn("dedupe_key", key)
    best = W.partitionBy("dedupe_key").orderBy(F.desc("confidence"), F.desc("session_seq"), "ordering_key")
    return rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def rotation_summary(trials: DataFrame) -> DataFrame:
    """trials(session_id, crop_idx, ok, rotation) -> session_id, succeeded, failed, dominant rotation (ties: the smallest)."""
    counts = trials.groupBy("session_id").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    modes = trials.filter("ok").groupBy("session_id", "rotation").agg(F.count(F.lit(1)).alias("n"))
    modes = modes.groupBy("session_id").agg(F.min_by("rotation", F.struct(-F.col("n"), F.col("rotation"))).alias("dominant_rotation"))
    return counts.join(modes, "session_id", "left")


def classify_document_lines(lines: DataFrame, doc: str = "doc_id", order: str = "line_idx", text: str = "line") -> DataFrame:
    """Each line with its exclusion reason, badge confidence and reason, person and title likeness. Neighbours come from a window over the document."""
    from tomelake.functions import lines as L

    line = F.col(text)
    # What several tests look at is a column; only their answers pass the window.
    rows = lines.select(doc, order, T.strip(line).alias("_s"), T.normalize_for_match(line).alias("_norm"))
    rows = rows.withColumns({"_t": F.filter(F.split("_norm", " "), lambda x: x != ""), "_alpha": T.alpha_ratio(F.col("_s")), "_price": L.is_price_like(F.col("_s")), "_imprint": F.col("_norm").isin(*L.IMPRINTS)})
    rows = rows.withColumns({"_orgs": F.size(F.filter("_t", lambda x: x.isin(*L.ORG_MARKERS))), "_fragment": L.is_fragment_of(F.col("_s"), F.col("_t"), F.col("_alpha"))})
    title = ~F.col("_price") & ~F.col("_fragment") & ~F.col("_imprint") & (F.col("_alpha") >= 0.6) & (F.size("_t") > 0)
    person = L.is_person_like_of(F.col("_s"), F.col("_t"), F.col("_alpha"), F.col("_orgs"))
    rows = rows.select(
        doc, order, "_price", "_fragment", "_imprint", L.badge_marks(F.col("_norm")).alias("_marks"),
        L.person_likeness_of(person, L.org_penalty_of(F.col("_orgs"), F.size("_t"))).alias("_person"), L.title_likeness_of(title).alias("_title"),
    )
    at = W.partitionBy(doc).orderBy(order)
    rows = rows.withColumn("_badge", L.badge_of(F.col("_marks"), F.lag("_marks").over(at), F.lead("_marks").over(at)))
    rows = rows.withColumn("exclusion", L.exclusion_of(F.col("_price"), F.col("_fragment"), F.col("_imprint"), F.col("_badge.confidence")))
    kept = F.col("exclusion").isNull()
    return rows.select(
        doc,
        order,
        "exclusion",
        F.col("_badge.confidence").alias("badge_confidence"),
        F.col("_badge.reason").alias("badge_reason"),
        F.when(kept, F.col("_person")).alias("person_likeness"),
        F.when(kept, F.col("_title")).alias("title_likeness"),
    )

"""Search candidates of a text, hints in recognised lines, and what a decision shows or keeps. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decisions as D
from . import isbn as I
from . import records as R
from . import text as T

# The shortest query, the confidence of a number, and lines that name an author.
LEAST_QUERY, ISBN_CONFIDENCE = 3, 0.95
AUTHOR_LINES = [r"(?i)^by\s+(.+)$", r"(?i)^author[:\s]+(.+)$", r"(?i)^written\s+by\s+(.+)$", r"^([A-Z][a-z]+(?:\s+[A-Z]\.?\s+)?[A-Z][a-z]+)$"]


def _row(query: Column, isbn: Column, confidence: Column, kind: str) -> Column:
    return F.struct(query.alias("query"), isbn.alias("isbn"), confidence.cast("double").alias("confidence"), F.lit(kind).alias("kind"))


def isbn_candidate(text: Column, tier: Column) -> Column:
    """The first valid number of a text as a candidate, else null."""
    found = I.first_isbn(text)
    return F.when(found.isNotNull(), _row(found, found, ISBN_CONFIDENCE * D.tier_multiplier(tier), "isbn"))


def merged_candidate(text: Column, confidence: Column, tier: Column) -> Column:
    """The text's words without noise as one query, else null; confidence: the mean of its lines (null without lines)."""
    query = R.without_query_noise(text)
    return F.when(F.length(query) >= LEAST_QUERY, _row(query, I.first_isbn(text), F.coalesce(confidence, F.lit(0.5)) * D.tier_multiplier(tier), "merged"))


def search_candidates(text: Column, confidence: Column, tier: Column, numbers: Column) -> Column:
    """Candidates of the numbers and of the merged text, the surest first, equal ones in that order; none of unusable evidence."""
    by_number = F.transform(numbers, lambda n: _row(n, n, ISBN_CONFIDENCE * D.tier_multiplier(tier), "isbn"))
    every = F.filter(F.array_append(by_number, merged_candidate(text, confidence, tier)), lambda c: c.isNotNull())
    placed = F.transform(every, lambda c, i: F.struct((-c["confidence"]).alias("s"), i.alias("i"), c.alias("c")))
    ordered = F.transform(F.array_sort(placed, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(a["i"] - b["i"])), lambda x: x["c"])
    return F.when(tier == "unusable", F.slice(ordered, 1, 0)).otherwise(ordered)


def is_author_line(c: Column) -> Column:
    out = c.rlike(AUTHOR_LINES[0])
    for p in AUTHOR_LINES[1:]:
        out = out | c.rlike(p)
    return out


def author_hint(lines: Column, author: Column | None = None) -> Column:
    """The author that recognition proposes, else the first sure line (struct(text, confidence)) that names one."""
    named = lambda x: F.coalesce(*[F.when(x["text"].rlike(p), F.coalesce(F.nullif(T.strip(F.regexp_extract(x["text"], p, 1)), F.lit("")), T.strip(x["text"]))) for p in AUTHOR_LINES])
    found = F.get(F.filter(F.transform(F.filter(lines, lambda x: x["confidence"] >= 0.5), named), lambda t: t.isNotNull()), F.lit(0))
    return found if author is None else F.coalesce(F.nullif(author, F.lit("")), found)


def title_hint(lines: Column, title: Column | None = None) -> Column:
    """The title that recognition proposes, else the longest sure line that names no author, if it is not much shorter than the surest one, else that one."""
    good = F.filter(lines, lambda x: (x["confidence"] >= 0.6) & ~R.is_skipped_line(x["text"]) & ~is_author_line(x["text"]))
    # The surest lines first, equal ones as they were; of equally long ones the surest.
    placed = F.transform(good, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x["text"].alias("t"), F.length(x["text"]).alias("n")))
    ordered = F.array_sort(placed)
    first, longest = F.get(ordered, F.lit(0)), F.array_max(F.transform(ordered, lambda x: x["n"]))
    long = F.get(F.filter(ordered, lambda x: x["n"] == longest), F.lit(0))
    found = T.strip(F.when(long["n"] > first["n"] * 0.8, long["t"]).otherwise(first["t"]))
    return found if title is None else F.coalesce(F.nullif(title, F.lit("")), found)


def ocr_only_fallback(has_candidate: Column, title: Column, author: Column) -> Column:
    """What is offered where nothing was looked up: the recognised text, if it has hints, else manual entry."""
    hinted = (F.coalesce(title, F.lit("")) != "") | (F.coalesce(author, F.lit("")) != "")
    return F.when(has_candidate & hinted, "ocr-only").otherwise("manual-entry")


def primary_book(action: Column, book: Column, candidates: Column) -> Column:
    return F.when(action.isin("auto-accept", "suggest"), book).when(action == "ambiguous", F.get(candidates, F.lit(0)))


def shown_books(action: Column, book: Column, alternatives: Column, candidates: Column) -> Column:
    """All books that a decision puts forward."""
    return F.when(action == "auto-accept", F.array(book)).when(action == "suggest", F.concat(F.array(book), alternatives)).when(action == "ambiguous", candidates).otherwise(F.slice(candidates, 1, 0))


def persists(decision: Column) -> Column:
    return decision.isin("accept_high", "accept_medium")


def shows(decision: Column) -> Column:
    return decision.isin("accept_high", "accept_medium", "suggested", "suggested_weak")


def content_hash(lines: Column, block: Column) -> Column:
    """The hash of a candidate's evidence; a fixed word where there is none."""
    return F.when((F.coalesce(F.size(lines), F.lit(0)) <= 0) & (F.coalesce(block, F.lit("")) == ""), "empty-evidence").otherwise(T.evidence_hash(lines))


def changes(new_title: Column, new_author: Column, old_title: Column, old_author: Column) -> Column:
    """Whether a correction says anything: null leaves a field as it is."""
    same = lambda new, old: new.isNull() | new.eqNullSafe(old)
    return ~(same(new_title, old_title) & same(new_author, old_author))


def without_keys(corrections: DataFrame, gone: DataFrame) -> DataFrame:
    """corrections without those whose key is in gone(key)."""
    return corrections.join(gone.select("key").distinct(), "key", "left_anti").select(*corrections.columns)

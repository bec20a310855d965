"""Scores, verification flags and tiered decisions about matches, as Column expressions.

There are two families with their own constants: the client's (Jaro-Winkler titles, dominance that depends on the score)
and the edge service's (Levenshtein titles, one dominance gap). They aren't to be unified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isbn as I
from . import text as T

# Tiers from best to worst, what a tier is worth, and the scores for acceptance, suggestion and ambiguity.
TIERS = ["strong", "usable", "weak", "unusable"]
TIER_MULTIPLIERS = {"strong": 1.0, "usable": 0.85, "weak": 0.6, "unusable": 0.0}
THRESHOLDS = {"strong": (0.85, 0.70, 0.50), "usable": (0.88, 0.75, 0.55), "weak": (0.95, 0.85, 0.70), "unusable": (1.0, 1.0, 1.0)}
# Weights of the signals (the generic penalty is subtracted), and what a flag costs.
WEIGHTS = {"title_similarity": 0.30, "author_presence": 0.25, "isbn_match": 0.20, "word_coverage": 0.15, "result_rank": 0.05}
GENERIC_WEIGHT = 0.05
PENALTIES = {
    "author-mismatch": 0.25,
    "isbn-mismatch": 0.40,
    "token-coverage-low": 0.20,
    "suspicious-edition": 0.15,
    "year-implausible": 0.10,
    "publisher-mismatch": 0.20,
    "edition-conflict": 0.15,
}
SEVERITIES = {"isbn-mismatch": "error", "author-mismatch": "warning", "token-coverage-low": "warning", "publisher-mismatch": "warning", "year-implausible": "info", "suspicious-edition": "info", "edition-conflict": "info"}
EDGE_SEVERITIES = SEVERITIES | {"year-implausible": "warning"}
DOMINANCE_GAP = 0.15


def by_key(c: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def tier_multiplier(tier: Column) -> Column:
    return by_key(tier, TIER_MULTIPLIERS)


def tier_rank(tier: Column) -> Column:
    return by_key(tier, {t: i for i, t in enumerate(TIERS)})


def threshold(tier: Column, which: int) -> Column:
    """0: accept, 1: suggest, 2: ambiguous."""
    return by_key(tier, {t: v[which] for t, v in THRESHOLDS.items()})


def rectification_status(uri: Column, method: Column, skipped_reason: Column) -> Column:
    none = (F.coalesce(uri, F.lit("")) == "") | (F.coalesce(method, F.lit("")) == "skipped")
    return F.when(none, F.when(F.coalesce(skipped_reason, F.lit("")) != "", "skipped").otherwise("failed")).otherwise("success")


def evidence_tier(status: Column, ok: Column, confidence: Column, chars: Column, alnum: Column, blur: Column) -> Column:
    """Of a crop. A missing blur score doesn't stand against `strong`."""
    confidence, chars, alnum = (F.coalesce(c, F.lit(0)) for c in (confidence, chars, alnum))
    return (
        F.when((status == "failed") | ~F.coalesce(ok, F.lit(False)) | (confidence < 0.4) | (chars < 3) | (alnum < 0.3), "unusable")
        .when((status == "skipped") | (confidence < 0.6) | (chars < 8), "weak")
        .when((confidence > 0.8) & (chars > 15) & (blur.isNull() | (blur > 100)), "strong")
        .otherwise("usable")
    )


def crop_score(ok: Column, confidence: Column, alnum: Column, chars: Column, has_title: Column) -> Column:
    size = F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1.0), chars)) / 3)
    return F.when(ok, 0.4 * confidence + 0.2 * alnum + 0.2 * size + 0.2 * has_title.cast("int")).otherwise(0.0)


def composite(title_similarity, author_presence, isbn_match, word_coverage, result_rank, generic_penalty) -> Column:
    """Weighted sum of signals, within [0, 1]."""
    signals = dict(zip(WEIGHTS, (title_similarity, author_presence, isbn_match, word_coverage, result_rank), strict=True))
    total = sum((signals[k] * w for k, w in list(WEIGHTS.items())[1:]), signals["title_similarity"] * WEIGHTS["title_similarity"])
    return clamp(total - generic_penalty * GENERIC_WEIGHT)


def book_tokens(title: Column, authors: Column) -> Column:
    return F.array_distinct(F.concat(T.query_tokens(title), F.flatten(F.transform(authors, T.query_tokens))))


def coverage(tokens: Column, known: Column) -> Column:
    """Share of tokens, repeated ones too, that are known; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.array_contains(known, t))) / F.size(tokens)).otherwise(0.0)


def edge_signals(title: Column, authors: Column, isbns: Column, query: Column, title_hint: Column, author_hint: Column, query_isbns: Column, rank: Column) -> Column:
    """struct of the edge service's six signals; isbns and query_isbns are arrays, rank counts from 0."""
    hint = F.when(F.coalesce(title_hint, F.lit("")) != "", title_hint).otherwise(query)
    author = F.when(F.coalesce(author_hint, F.lit("")) == "", 0.5).otherwise(F.when(T.edge_author_matches(authors, author_hint), 1.0).otherwise(0.0))
    return F.struct(
        clamp(T.query_similarity(title, hint)).alias("title_similarity"),
        author.alias("author_presence"),
        F.when(F.arrays_overlap(isbns, query_isbns), 1.0).otherwise(0.0).alias("isbn_match"),
        coverage(T.query_tokens(query), book_tokens(title, authors)).alias("word_coverage"),
        F.greatest(F.lit(0.0), 1 - rank * 0.1).alias("result_rank"),
        F.when(T.is_generic_query_title(title), 0.15).otherwise(0.0).alias("generic_penalty"),
    )


def edge_composite(signals: Column) -> Column:
    return composite(*[signals[k] for k in WEIGHTS], signals["generic_penalty"])


def _flags(**conditions: Column) -> Column:
    named = [F.when(c, F.lit(name.replace("_", "-"))) for name, c in conditions.items()]
    return F.array_compact(F.array(*named))


def edge_flags(title, authors, isbns, edition, year, author_hint, query_isbns, evidence_tokens, this_year) -> Column:
    """Names of the flags that the edge service raises, in its order. this_year is a parameter, so results don't age."""
    e = F.lower(F.coalesce(edition, F.lit("")))
    odd = e.contains("abridged") | e.contains("condensed") | e.contains("adapted") | e.contains("simplified")
    return _flags(
        isbn_mismatch=(F.size(query_isbns) > 0) & (F.size(isbns) > 0) & ~F.coalesce(F.arrays_overlap(isbns, query_isbns), F.lit(False)),
        author_mismatch=(F.coalesce(author_hint, F.lit("")) != "") & ~T.edge_author_matches(authors, author_hint),
        token_coverage_low=coverage(evidence_tokens, book_tokens(title, authors)) < 0.4,
        suspicious_edition=odd,
        year_implausible=F.coalesce((year != 0) & ((year < 1400) | (year > this_year + 1)), F.lit(False)),
    )


def penalty(flags: Column) -> Column:
    return F.aggregate(flags, F.lit(0.0), lambda s, f: s + F.coalesce(by_key(f, PENALTIES), F.lit(0.0)))


def penalized(score: Column, flags: Column) -> Column:
    return F.greatest(F.lit(0.0), score - penalty(flags))


def severity(flag: Column) -> Column:
    return by_key(flag, SEVERITIES)


def edge_dominates(top: Column, second: Column) -> Column:
    return top - second >= DOMINANCE_GAP


def dominates(top: Column, second: Column) -> Column:
    """The client's gap: the surer the top, the smaller it may be."""
    return top - second >= F.when(top > 0.85, 0.15).when(top > 0.70, 0.20).otherwise(0.30)


def edge_decision(top: Column, second: Column, tier: Column, flags: Column) -> Column:
    """struct(type, confidence, reason). top is null without matches; penalties count before thresholds; the second score is raw."""
    score = penalized(top, flags)
    alone = edge_dominates(score, F.coalesce(second, F.lit(0.0)))

    def out(kind, reason, sure=False):
        return F.struct(F.lit(kind).alias("type"), (score if sure else F.lit(None).cast("double")).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    return (
        F.when(top.isNull(), out("no-match", "no_matches"))
        .when(F.exists(flags, lambda f: severity(f) == "error"), out("ambiguous", "verification_error"))
        .when((score >= threshold(tier, 0)) & alone, out("auto-accept", "high_confidence", True))
        .when(score >= threshold(tier, 1), out("suggest", F.when(alone, "good_match").otherwise("multiple_viable"), True))
        .when(score >= threshold(tier, 2), out("ambiguous", "multiple_possible"))
        .otherwise(out("no-match", "below_threshold"))
    )


def client_flags(title, authors, isbn13, isbn10, publisher, edition, year, tokens, isbn, author_hint, publisher_hint, edition_hint, full_text, this_year, author_score=None, publisher_score=None) -> Column:
    """Names of the flags that the client raises, in its order.

    author_score and publisher_score are the Jaro-Winkler similarities of the hints (T.best_match, T.normalized_jaro_winkler),
    made beforehand, as they need Python.
    """
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    book_isbn = F.when(has(isbn13), isbn13).otherwise(isbn10)
    known = T.comparison_tokens(F.concat_ws(" ", title, authors))
    author_score, publisher_score = (F.lit(None).cast("double") if c is None else c for c in (author_score, publisher_score))
    text = T.normalize_for_comparison(F.coalesce(full_text, F.lit("")))
    named = F.exists(T.comparison_tokens(publisher), lambda t: (F.length(t) > 3) & F.contains(text, t)) | (has(edition) & F.contains(text, T.normalize_for_comparison(edition)))
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")
    year = year.try_cast("int")
    return _flags(
        author_mismatch=has(author_hint) & ((F.size(authors) == 0) | F.coalesce(author_score < 0.6, F.lit(True))),
        isbn_mismatch=has(isbn) & has(book_isbn) & ~I.are_isbns_equivalent(isbn, book_isbn),
        token_coverage_low=(F.size(tokens) > 0) & (coverage(tokens, known) < 0.5),
        suspicious_edition=has(publisher) & (F.size(T.comparison_tokens(title)) <= 4) & ~F.coalesce(named, F.lit(False)),
        year_implausible=F.coalesce((year > this_year + 1) | (year < 1800), F.lit(False)),
        publisher_mismatch=has(publisher_hint) & has(publisher) & F.coalesce(publisher_score < 0.6, F.lit(False)),
        edition_conflict=F.coalesce(number(edition_hint) != number(edition), F.lit(False)),
    )


def client_decision(top: Column, second: Column, tier: Column, flags: Column) -> Column:
    """struct(action, reason, fallback, confidence). A flagged top match is never accepted."""
    second = F.coalesce(second, F.lit(0.0))

    def out(action, confidence=None, reason=None, fallback=None):
        return F.struct(
            F.lit(action).alias("action"), F.lit(reason).cast("string").alias("reason"), F.lit(fallback).cast("string").alias("fallback"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence")
        )

    return (
        F.when(top.isNull(), out("no-match", fallback="ocr-only"))
        .when(F.array_contains(flags, "isbn-mismatch"), out("ambiguous", reason="isbn-conflict"))
        .when(F.size(flags) > 0, out("suggest", penalized(top, flags)))
        .when((top >= threshold(tier, 0)) & dominates(top, second), out("auto-accept", top))
        .when(top >= threshold(tier, 1), out("suggest", top))
        .when(top >= threshold(tier, 2), out("ambiguous"))
        .otherwise(out("no-match", fallback="manual-entry"))
    )


def has_resolved_book(action: Column) -> Column:
    return action.isin("auto-accept", "suggest")


def needs_confirmation(action: Column) -> Column:
    return action.isin("suggest", "ambiguous", "no-match")


def fallback_is_confident(kind: Column, confidence: Column) -> Column:
    return (kind == "auto-accept") | ((kind == "suggest") & (confidence >= 0.9))


def should_try_fallback(kind: Column) -> Column:
    return kind.isin("no-match", "ambiguous")


def fallback_score(title: Column, authors: Column, isbn13: Column, isbn10: Column, query_title: Column) -> Column:
    """0.5, more with a first author, with the very title, and with a number."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.lit(0.5)
        + F.when(has(F.get(authors, F.lit(0))), 0.3).otherwise(0.0)
        + F.when(T.normalize_title(query_title) == T.normalize_title(title), 0.1).otherwise(0.0)
        + F.when(has(isbn13) | has(isbn10), 0.05).otherwise(0.0)
    )


def has_strong_author_hint(author: Column) -> Column:
    a = T.strip(F.coalesce(author, F.lit("")))
    return (a != "") & F.size(F.split(a, r"\s+")).between(2, 4) & (T.alpha_ratio(a) >= 0.85)


def fallback_signal(title: Column, author: Column) -> Column:
    """`ok`, or why a title says too little to search by it alone."""
    norm = T.normalize_title(F.coalesce(title, F.lit("")))
    raw = F.filter(F.split(norm, " "), lambda t: t != "")
    return fallback_signal_of(norm, raw, F.filter(raw, lambda t: ~F.lower(t).isin(*T.TITLE_STOPWORDS)), author)


def fallback_signal_of(norm: Column, raw: Column, telling: Column, author: Column) -> Column:
    """norm: the title's normal form, raw: its words, telling: those that tell titles apart."""
    only = F.coalesce(F.get(telling, F.lit(0)), F.lit(""))
    return (
        F.when(norm == "", "no_title_for_fallback")
        .when((F.size(telling) == 0) | ~norm.rlike("(?:[A-Z0-9][^A-Z0-9]*){5}"), "low_signal_title_for_fallback")
        .when((F.size(raw) == 1) & (F.size(telling) == 1) & ((F.length(only) < 6) | ~has_strong_author_hint(author)), "low_signal_single_token_for_fallback")
        .otherwise("ok")
    )


def resolver_key(source: Column, source_id: Column, isbn13: Column, isbn10: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when((source == "openLibrary") & has(source_id), F.concat(F.lit("openlibrary:"), source_id))
        .when(has(isbn13), F.concat(F.lit("isbn:"), isbn13))
        .when(has(isbn10), F.concat(F.lit("isbn:"), isbn10))
        .when(has(source_id), F.concat(source, F.lit(":"), source_id))
    )


def identity_key(source, source_id, isbn13, isbn10, title) -> Column:
    none = F.lit("")
    return F.concat_ws("|", source, F.coalesce(source_id, none), F.coalesce(isbn13, none), F.coalesce(isbn10, none), T.normalize_query(title))


def dedupe_key(isbn13, isbn10, title, author) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    plain = lambda c: T.normalize_for_dedupe(F.coalesce(c, F.lit("")))
    return F.when(has(isbn13), F.concat(F.lit("isbn:"), isbn13)).when(has(isbn10), F.concat(F.lit("isbn:"), isbn10)).otherwise(F.concat(F.lit("ta:"), plain(title), F.lit(":"), plain(author)))

"""Projections between provider records, catalog rows and books, and the keys and queries built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isbn as I
from . import text as T

#: Words that say nothing in a search query, and lines that are none.
QUERY_NOISE = [
    "copyright", "all rights reserved", "printed in", "isbn", "www", "http", "com", "org", "net", "publishing", "publisher", "press", "books", "library", "congress", "edition",
    "first", "second", "third", "revised", "updated", "reprint", "paperback", "hardcover", "jacket", "cover", "design", "illustration",
]
SKIPPED_LINES = [
    r"(?i)^copyright\s*[0-9]{4}", r"(?i)^isbn[\s\-:]", r"^[0-9]{1,2}[\s/\-][0-9]{1,2}[\s/\-][0-9]{2,4}", r"(?i)^www\.", r"(?i)^http", r"^[0-9]+$", r"(?i)^page\s*[0-9]+",
    r"(?i)^chapter\s*[0-9]+",
]
#: Year of a date, and the addresses of covers.
YEAR = "(?:^|[^A-Za-z0-9_])(1[0-9]{3}|20[0-2][0-9])(?![A-Za-z0-9_])"
COVER = "https://covers.openlibrary.org/b/id/"
#: The provider schema of a volume.
VOLUME = (
    "id string, volumeInfo struct<title: string, authors: array<string>, publisher: string, publishedDate: string, "
    "industryIdentifiers: array<struct<type: string, identifier: string>>, imageLinks: struct<thumbnail: string, smallThumbnail: string>>"
)


def year_of(c: Column) -> Column:
    """The first year from 1000 to 1999 or 2000 to 2029 that stands alone."""
    return F.nullif(F.regexp_extract(c, YEAR, 1), F.lit(""))


def query_hash(kind: Column, query: Column) -> Column:
    """Hex of an FNV-like hash whose product is rounded to a double before it is cut to 32 bits: equal to what JavaScript numbers give, code unit by code unit of ASCII text."""
    codes = F.transform(F.split(F.concat(kind, F.lit(":"), F.trim(F.lower(query))), ""), lambda ch: F.ascii(ch))

    def step(h: Column, code: Column) -> Column:
        signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
        mixed = signed.bitwiseXOR(code.cast("long"))
        # Products stay below 2**56, so the double holds them to 53 bits and casts back to a long.
        rounded = (mixed.cast("double") * F.lit(16777619.0)).cast("long")
        return F.pmod(rounded, F.lit(1 << 32))

    return F.lower(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)))


def volume_resolver_key(isbn13: Column, isbn10: Column, source_id: Column) -> Column:
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(present(isbn13), F.concat(F.lit("isbn:"), isbn13)).when(present(isbn10), F.concat(F.lit("isbn:"), isbn10)).otherwise(
        F.concat(F.lit("googleBooks:"), F.when(present(source_id), source_id).otherwise(F.lit("unknown")))
    )


def _book(**fields: Column) -> Column:
    names = ["title", "authors", "isbn13", "isbn10", "publisher", "publish_year", "cover_url", "source", "source_id"]
    return F.struct(*[fields[n].alias(n) for n in names])


def volume_to_book(volume: Column) -> Column:
    """A volume (VOLUME) as a book; of several numbers of a kind the last counts."""
    info = volume["volumeInfo"]

    def number(kind: str) -> Column:
        of = F.filter(info["industryIdentifiers"], lambda x: x["type"] == kind)
        return F.when(F.size(of) > 0, I.normalize_isbn(F.element_at(of, -1)["identifier"]))

    image = info["imageLinks"]
    cover = F.coalesce(F.nullif(image["thumbnail"], F.lit("")), F.nullif(image["smallThumbnail"], F.lit("")))
    return _book(
        title=F.coalesce(info["title"], F.lit("")), authors=F.coalesce(info["authors"], F.array().cast("array<string>")), isbn13=number("ISBN_13"), isbn10=number("ISBN_10"),
        publisher=info["publisher"], publish_year=year_of(info["publishedDate"]), cover_url=F.regexp_replace(cover, "^http://", "https://"), source=F.lit("googleBooks"), source_id=volume["id"],
    )


def isbn_response_to_book(title, isbn_13, isbn_10, publishers, publish_date, covers, key, isbn) -> Column:
    """An answer to a lookup by number as a book: the number asked for stands in where the answer has none of its length."""
    asked = I.normalize_isbn(isbn)
    own = lambda numbers, n: F.coalesce(I.first_isbn_of_length(numbers, n), F.when(F.length(asked) == n, asked))
    cover = F.get(covers, F.lit(0))
    return _book(
        title=title, authors=F.array().cast("array<string>"), isbn13=own(isbn_13, 13), isbn10=own(isbn_10, 10), publisher=F.get(publishers, F.lit(0)),
        publish_year=F.nullif(F.regexp_extract(publish_date, "[0-9]{4}", 0), F.lit("")).cast("int").cast("string"),
        cover_url=F.when(F.coalesce(cover, F.lit(0)) != 0, F.concat(F.lit(COVER), cover.cast("string"), F.lit("-M.jpg"))), source=F.lit("openLibrary"),
        source_id=F.coalesce(key, F.concat(F.lit("/isbn/"), F.coalesce(asked, isbn))),
    )


def catalog_row_to_book(provider, provider_id, isbn13, isbn10, title, authors, publisher, publish_year, cover_url) -> Column:
    """A catalog row as a book; the year is the number that the text begins with, and no year where that is 0 or missing."""
    year = F.nullif(F.regexp_extract(publish_year, r"^\s*([0-9]+)", 1), F.lit("")).cast("long")
    return _book(
        title=title, authors=F.coalesce(authors, F.array().cast("array<string>")), isbn13=isbn13, isbn10=isbn10, publisher=publisher, publish_year=F.when(year != 0, year).cast("string"),
        cover_url=cover_url, source=F.when(provider == "googleBooks", "googleBooks").otherwise("openLibrary"), source_id=provider_id,
    )


def match_to_book(title, authors, isbn, publisher, publish_year, cover_url, source, source_id) -> Column:
    """A match as a book: its number is told by its length."""
    bare = F.regexp_replace(isbn, "(?i)[^0-9X]", "")
    return _book(
        title=title, authors=authors, isbn13=F.when(F.length(bare) == 13, bare), isbn10=F.when(F.length(bare) == 10, bare), publisher=publisher, publish_year=publish_year, cover_url=cover_url,
        source=source, source_id=source_id,
    )


def enriched_book(found: Column, candidate: Column) -> Column:
    """A candidate with what a lookup found for it (null: nothing): title, authors, isbn13, isbn10, publisher, publish_date and cover of found; title, authors, publish_year, cover_url and olid of the candidate."""
    filled = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return _book(
        title=F.coalesce(filled(found["title"], candidate["title"]), F.lit("")), authors=F.coalesce(found["authors"], candidate["authors"], F.array().cast("array<string>")),
        isbn13=I.normalize_isbn(found["isbn13"]), isbn10=I.normalize_isbn(found["isbn10"]), publisher=found["publisher"], publish_year=F.coalesce(year_of(found["publish_date"]), candidate["publish_year"]),
        cover_url=filled(found["cover"], candidate["cover_url"]), source=F.lit("openLibrary"), source_id=candidate["olid"],
    )


def top_match(decision: Column, book: Column, confidence: Column, ambiguous: Column, matched: Column, match_score: Column, canonical: Column) -> Column:
    """struct(book, score) of a resolver's answer: what was accepted or suggested, else the first ambiguous one, the first match, the canonical book."""
    out = lambda b, s: F.struct(b.alias("book"), s.cast("double").alias("score"))
    none = F.lit(None)
    return (
        F.when(decision.isin("auto-accept", "suggest"), out(book, confidence))
        .when((decision == "ambiguous") & ambiguous.isNotNull(), out(ambiguous, none))
        .when(matched.isNotNull(), out(matched, match_score))
        .otherwise(out(canonical, none))
    )


def attempt_decision(decision: Column, reason: Column, hypotheses: Column) -> Column:
    """struct(decision, reason) as recorded: a pending candidate without a hypothesis is rejected for want of evidence."""
    decision = F.coalesce(decision, F.lit("pending"))
    none = (decision == "pending") & (hypotheses == 0)
    return F.struct(F.when(none, "reject").otherwise(decision).alias("decision"), F.when(none, F.coalesce(reason, F.lit("no_evidence"))).otherwise(reason).alias("reason"))


def correction_keys(key: Column, content_hash: Column) -> Column:
    """struct(resolver_key, evidence_hash) under which a correction is kept."""
    by_isbn, by_hash = F.startswith(key, F.lit("isbn:")), F.startswith(key, F.lit("hash:"))
    return F.struct(
        F.when(by_isbn, key).alias("resolver_key"),
        F.when(by_isbn, F.nullif(content_hash, F.lit(""))).when(by_hash, F.substr(key, F.lit(6))).otherwise(key).alias("evidence_hash"),
    )


def is_skipped_line(c: Column) -> Column:
    out = F.length(T.normalize_for_comparison(c)) < 2
    for p in SKIPPED_LINES:
        out = out | c.rlike(p)
    return out


def without_query_noise(c: Column) -> Column:
    return F.array_join(F.filter(T.comparison_tokens(c), lambda t: ~t.isin(*QUERY_NOISE) & (F.length(t) > 1)), " ")


def search_query(lines: Column) -> Column:
    """The query of an image's lines, array of struct(text, confidence): its five surest lines of some worth, without noise words. Ties keep the lines' order."""
    good = F.filter(lines, lambda x: (x["confidence"] > 0.5) & ~is_skipped_line(x["text"]))
    placed = F.transform(good, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), T.strip(x["text"]).alias("t")))
    return without_query_noise(F.array_join(F.transform(F.slice(F.array_sort(placed), 1, 5), lambda x: x["t"]), " "))


def cover_uri(cover_url: Column, crop_uri: Column) -> Column:
    """The book's cover, else the picture of the candidate's first crop."""
    return F.coalesce(F.nullif(cover_url, F.lit("")), F.nullif(crop_uri, F.lit("")))


def pairing_problem(title: Column, author: Column) -> Column:
    """Why a title and an author can't be a pair, else null."""
    t, a = T.strip(F.lower(title)), T.strip(F.lower(author))
    return (
        F.when(t == a, "title_and_author_identical")
        .when((F.length(a) > 3) & F.contains(t, a), "author_contained_in_title")
        .when((F.length(t) > 3) & F.contains(a, t), "title_contained_in_author")
    )


#: What in a rejected text points to which known issue.
ISSUES = [
    ("OCR_CORRUPTION", r"(?i)FORVOUR", 'OCR merged "FOR YOUR"'),
    ("OCR_CORRUPTION", r"(?i)NGRIO|MOHIO|IGHTO", 'OCR corruption of "NGAIO"'),
    ("OCR_CORRUPTION", r"(?i)CRANKIN", 'OCR corruption of "RANKIN"'),
    ("OCR_CORRUPTION", r"(?i)SHADFORD", 'OCR corruption of "SANDFORD"'),
    ("OCR_CORRUPTION", r"(?i)ECOUNTRY", 'OCR corruption of "COUNTRY"'),
    ("OCR_CORRUPTION", r"(?i)ONF\b", 'OCR error "ONF" instead of "ONE"'),
    ("OCR_CORRUPTION", r"(?i)MACDO\b", 'Truncated "MACDONALD"'),
    ("MISSING_TEXT", r"(?m)^(CRANKIN|FALLS)$", "Missing author name (vertical text not captured)"),
    ("MISSING_TEXT", r"(?m)^(SHADFORD|ECOUNTRY)$", "Missing title/author parts"),
    ("UNFILTERED_NOISE", r"(?i)\bVISICA\b", "VISICA not filtered"),
    ("UNFILTERED_NOISE", r"(?i)\bJOVI\b", "JOVI not filtered"),
    ("UNFILTERED_NOISE", r"(?i)\bTSELLER\b", "TSELLER not filtered"),
    ("UNFILTERED_NOISE", r"(?i)\bVINTASE\b", "VINTASE not filtered"),
    ("UNFILTERED_NOISE", r"(?i)\bBERK!\b", "BERK! not filtered"),
    ("UNFILTERED_NOISE", r"(?i)\bOYSTERY\b", "OYSTERY not filtered"),
    ("MERGED_LINE", r"(?m)\b[A-Z]+\s+[A-Z]\.\s*[A-Z]+$", "Merged title+author with middle initial"),
]


def issues(text: Column, hypotheses: Column, top_score: Column) -> Column:
    """Array of struct(category, issue) of a rejected text."""
    text = F.coalesce(text, F.lit(""))
    found = [F.when(text.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(i).alias("issue"))) for c, p, i in ISSUES]
    found.append(F.when(F.coalesce(hypotheses, F.lit(0)) == 0, F.struct(F.lit("NO_HYPOTHESES").alias("category"), F.lit("No hypotheses generated").alias("issue"))))
    low = (top_score > 0) & (top_score < 0.5)
    found.append(F.when(low, F.struct(F.lit("LOW_SCORE").alias("category"), F.concat(F.lit("Top score too low: "), F.format_string("%.2f", top_score)).alias("issue"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


#: Parts of reasons that a change of rules may mend, and those that better recognition would.
FIXABLE = ["low_title_confidence", "low_author_confidence", "no candidates found", "no_candidates", "weak_title", "manual_review"]
UNREADABLE = ["no_evidence", "ocr", "empty text", "no_text"]


def triage_signals(text: Column, reason: Column, hypotheses: Column, queries: Column, top_score: Column) -> Column:
    """struct(reason, weak_text, no_hypotheses, low_confidence, fixable, unreadable) of a rejected candidate."""
    reason = T.strip(F.lower(F.coalesce(reason, F.lit(""))))
    reason = F.when(reason == "", "unknown").otherwise(reason)
    weak = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]")) < 4
    none = (F.coalesce(hypotheses, F.lit(0)) == 0) & (F.coalesce(queries, F.lit(0)) == 0)
    holds = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(reason, p))
    fixable = holds(FIXABLE) | none
    return F.struct(
        reason.alias("reason"), weak.alias("weak_text"), none.alias("no_hypotheses"), (F.contains(reason, F.lit("low_title_confidence")) | (F.coalesce(top_score, F.lit(0.0)) < 0.45)).alias("low_confidence"),
        fixable.alias("fixable"), (holds(UNREADABLE) | (weak & ~fixable)).alias("unreadable"),
    )


def recommendation(rejects: Column, fixable: Column, unreadable: Column) -> Column:
    mostly = unreadable >= F.greatest(F.lit(1), F.floor(rejects * 0.8))
    return F.when(rejects <= 0, "skip_no_rejects").when(fixable > 0, "proceed_fix").when(mostly, "ocr_pipeline_first").otherwise("manual_investigation")

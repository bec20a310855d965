"""Which lines of a spine may be title or author, and why the others can't. Column expressions over a line and, for the publisher rule, its document's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .evidence_lines import java

# Forms of numbers, prices, addresses, notices and editions, and names of publishers.
ISBN = r"(?i)\b(?:isbn[-:\s]*)?(?:97[89][0-9\-\s]{10,14}[0-9]|[0-9][0-9\-\s]{8,11}[0-9X])\b"
PRICE = [r"\$\s*[0-9]+(?:\.[0-9]{2})?", r"£\s*[0-9]+(?:\.[0-9]{2})?", r"€\s*[0-9]+(?:[,.][0-9]{2})?", r"(?i)[0-9]+(?:\.[0-9]{2})?\s*(?:USD|EUR|GBP|TL|TRY)", r"(?i)(?:price|fiyat)[:\s]+", r"(?i)\bRRP\b"]
URL = [r"(?i)https?://", r"(?i)www\.", r"(?i)\.com\b", r"(?i)\.org\b", r"(?i)\.net\b", r"(?i)\.edu\b", r"(?i)\.co\.uk\b"]
COPYRIGHT = [r"^©", r"(?i)\bcopyright\b", r"(?i)\ball\s+rights\s+reserved\b", r"(?i)\btüm\s+hakları\s+saklıdır\b"]
BARCODE = [r"^[0-9]{8,}$", r"^[0-9\s\-]{10,}$"]
YEAR = r"^(?:©\s*)?[0-9]{4}$"
EDITION = [r"(?i)\b[0-9]+(?:st|nd|rd|th)\s+edition\b", r"(?i)\bedition\b", r"(?i)\breprint\b", r"(?i)\brevised\b", r"(?i)\bupdated\b", r"(?i)\b[0-9]+\.\s*bask[ıi]", r"(?i)\b[0-9]+\.\s*bas[ıi]m", r"(?i)\bcilt\s*[0-9]+"]
PUBLISHER = [r"(?i)\bpress\b", r"(?i)\bpublishing\b", r"(?i)\bpublishers?\b", r"(?i)\bpublications?\b", r"(?i)\byayinlari?\b", r"(?i)\byayinevi\b", r"(?i)\byayincilik\b", r"(?i)\bbasim\b"]
PUBLISHERS = [
    "scribner", "penguin", "random house", "harpercollins", "simon & schuster", "macmillan", "hachette", "prentice hall", "o'reilly", "wiley", "pearson", "mcgraw hill",
    "scholastic", "bloomsbury", "vintage", "anchor", "knopf", "doubleday", "thomas dunne", "thomas dunne books", "st. martin's", "st martin's", "st. martins", "picador",
    "tor books", "tor", "del rey", "bantam", "berkley", "ace", "daw", "orbit", "little brown", "little, brown", "grand central", "atria", "gallery", "pocket books", "avon",
]
PUBLISHER_TOKENS = ["books", "book", "press", "publishing", "publishers", "publication", "publications", "editions", "edition", "imprint", "classics", "library"]
PUBLISHER_FIRST_NAMES = ["thomas", "martin", "martins", "simon", "peter", "john", "james", "william", "henry", "alfred", "george", "charles", "robert", "david", "michael", "richard"]
CONTEXT = ["books", "press", "publishing"]


def _any(c: Column, patterns: list[str]) -> Column:
    out = c.rlike(java(patterns[0]))
    for p in patterns[1:]:
        out = out | c.rlike(java(p))
    return out


def digit_ratio(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0.0).otherwise(F.regexp_count(c, F.lit("[0-9]")) / F.length(c))


def position_score(index: Column, total: Column, y: Column | None = None, height: Column | None = None) -> Column:
    """How likely a title is at this height of the spine: by the line's box where it has one, else by its place."""
    at = index / F.greatest(F.lit(1), total - 1)
    by_index = F.when(at < 0.3, 0.7).when(at < 0.5, 0.5).otherwise(0.3)
    if y is None:
        return by_index
    at = y / (y + height * 2)
    return F.when(height > 0, F.when(at < 0.3, 0.8).when(at < 0.5, 0.6).when(at < 0.7, 0.4).otherwise(0.2)).otherwise(by_index)


def is_publisher_token(c: Column) -> Column:
    return T.strip(F.lower(c)).isin(*PUBLISHER_TOKENS)


def speaks_of_publisher(c: Column) -> Column:
    """The line makes a first name beside it look like a publisher's."""
    low = F.lower(c)
    return is_publisher_token(c) | low.rlike("|".join(CONTEXT))


def is_publisher_first_name(c: Column) -> Column:
    return T.strip(F.lower(c)).isin(*PUBLISHER_FIRST_NAMES)


def other_reason(c: Column, context: Column | None = None) -> Column:
    """The first ground on which a line is neither title nor author, else null; context: whether any of the document's lines speaks of a publisher."""
    c = T.strip(c)
    words = F.size(F.split(c, r"\s+"))
    out = (
        F.when(F.length(c) < 2, "too_short")
        .when(c.rlike(java(ISBN)), "isbn")
        .when(_any(c, PRICE), "price")
        .when(_any(c, URL), "url")
        .when(_any(c, COPYRIGHT), "copyright")
        .when(_any(c, BARCODE), "barcode")
        .when(c.rlike(YEAR), "year_only")
        .when(digit_ratio(c) > 0.5, "numeric_heavy")
        .when((F.length(c) < 30) & _any(c, EDITION), "edition")
        .when(((words <= 3) & _any(c, PUBLISHER)) | F.lower(c).isin(*PUBLISHERS), "publisher")
        .when(is_publisher_token(c), "publisher_token")
    )
    if context is not None:
        out = out.when(is_publisher_first_name(c) & context, "publisher_name_context")
    return out.when(F.length(c) > 150, "too_long")

"""ISBN checks, conversion and extraction as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_isbn(c: Column) -> Column:
    """Upper case, digits and X only."""
    return F.regexp_replace(F.upper(c), "[^0-9X]", "")


def _digit(c: Column, i) -> Column:
    d = F.substring(c, i, F.lit(1)) if isinstance(i, Column) else F.substring(c, i, 1)
    return F.when(d == "X", 10).otherwise(d.try_cast("int"))


def _weighted(c: Column, n: int, weight) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda s, i: s + _digit(c, i) * weight(i))


def _sum13(c: Column, n: int = 13) -> Column:
    return _weighted(c, n, lambda i: F.when(i % 2 == 1, 1).otherwise(3))


def _sum10(c: Column, n: int = 10) -> Column:
    return _weighted(c, n, lambda i: F.lit(11) - i)


def is_valid_isbn10(c: Column) -> Column:
    n = normalize_isbn(c)
    return F.when(n.rlike("^[0-9]{9}[0-9X]$"), _sum10(n) % 11 == 0).otherwise(False)


def is_valid_isbn13(c: Column) -> Column:
    n = normalize_isbn(c)
    return F.when(n.rlike("^[0-9]{13}$"), _sum13(n) % 10 == 0).otherwise(False)


def is_valid_isbn(c: Column) -> Column:
    return is_valid_isbn10(c) | is_valid_isbn13(c)


def validate_isbn_checksum(c: Column) -> Column:
    """Only blanks and hyphens are dropped: any other sign makes it invalid."""
    n = F.upper(F.regexp_replace(c, r"[-\s]", ""))
    return F.when(n.rlike("^[0-9]{9}[0-9X]$"), _sum10(n) % 11 == 0).when(n.rlike("^[0-9]{13}$"), _sum13(n) % 10 == 0).otherwise(False)


def isbn10_to_isbn13(c: Column) -> Column:
    """978, nine digits and a check digit; the input's own check digit isn't looked at."""
    base = F.concat(F.lit("978"), F.substring(normalize_isbn(c), 1, 9))
    return F.when(F.length(normalize_isbn(c)) == 10, F.concat(base, ((10 - _sum13(base, 12) % 10) % 10).cast("string")))


def isbn13_to_isbn10(c: Column) -> Column:
    """Of numbers that begin with 978."""
    n = normalize_isbn(c)
    base = F.substring(n, 4, 9)
    check = (11 - _sum10(base, 9) % 11) % 11
    return F.when((F.length(n) == 13) & n.startswith("978"), F.concat(base, F.when(check == 10, "X").otherwise(check.cast("string"))))


def _as13(n: Column) -> Column:
    return F.when(F.length(n) == 10, isbn10_to_isbn13(n)).when(F.length(n) == 13, n)


def are_isbns_equivalent(a: Column, b: Column) -> Column:
    a, b = normalize_isbn(a), normalize_isbn(b)
    return (a == b) | F.coalesce(_as13(a) == _as13(b), F.lit(False))


def extract_isbns(text: Column) -> Column:
    """Distinct valid numbers of a text as ISBN-13: those of thirteen digits first, then converted ones of ten."""
    long = F.transform(F.regexp_extract_all(text, F.lit(r"\b(97[89][0-9\-\s]{10,14}[0-9])\b"), 1), normalize_isbn)
    short = F.transform(F.regexp_extract_all(text, F.lit(r"\b([0-9][0-9\-\s]{8,11}[0-9Xx])\b"), 1), normalize_isbn)
    ten = F.transform(F.filter(short, is_valid_isbn10), isbn10_to_isbn13)
    return F.array_distinct(F.concat(F.filter(long, is_valid_isbn13), ten))


def first_isbn(text: Column) -> Column:
    return F.get(extract_isbns(text), F.lit(0))


def format_isbn13(c: Column) -> Column:
    n = normalize_isbn(c)
    return F.when(F.length(n) == 13, F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 1), F.substring(n, 5, 4), F.substring(n, 9, 4), F.substring(n, 13, 1))).otherwise(c)


def format_isbn10(c: Column) -> Column:
    n = normalize_isbn(c)
    return F.when(F.length(n) == 10, F.concat_ws("-", F.substring(n, 1, 1), F.substring(n, 2, 4), F.substring(n, 6, 4), F.substring(n, 10, 1))).otherwise(c)


def isbn_type(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]{9}[0-9X]$"), "isbn10").when(c.rlike("^97[89][0-9]{10}$"), "isbn13")


def is_isbn_like_token(c: Column) -> Column:
    """A label, a number of that shape, hyphenated digits, or more than 0.7 digits."""
    shapes = r"^[0-9]{10}$|^[0-9]{9}[xX]$|^97[89][0-9]{10}$|^[0-9]{1,4}-[0-9]{1,6}-[0-9]{1,6}|^[0-9]+-[0-9]+$|^0-[0-9]+"
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return F.lower(c).isin("isbn", "issn") | (c.rlike("[0-9]") & (c.rlike(shapes) | ((F.length(c) >= 4) & (digits / F.length(c) > 0.7))))


def has_isbn_shape(c: Column) -> Column:
    """A number of that shape alone: ten digits (the last may be an x), or thirteen from 978 or 979."""
    return c.rlike("^([0-9]{9}[0-9Xx]|97[89][0-9]{10})$")


def filter_isbn_tokens(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~is_isbn_like_token(t))


def isbn_policy(source_kind: Column, valid: Column) -> Column:
    """What a number found on that kind of image is good for. valid: array of the valid numbers."""
    return (
        F.when(source_kind == "spine_crop", "ignore")
        .when(source_kind.isin("back_cover", "inside_page"), F.when(F.size(valid) > 0, "lookup_first").otherwise("boost_only"))
        .otherwise("boost_only")
    )


def applies_isbn_boost(policy: Column) -> Column:
    return policy.isin("boost_only", "lookup_first")


def catalog_isbn(c: Column, length: int) -> Column:
    """The normalised number if it has that length, else null."""
    n = normalize_isbn(c)
    return F.when(F.length(n) == length, n)


def request_isbns(numbers: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(numbers, normalize_isbn), lambda n: F.length(n).isin(10, 13)))


def first_isbn_of_length(numbers: Column, length: int) -> Column:
    return F.get(F.filter(F.transform(numbers, normalize_isbn), lambda n: F.length(n) == length), F.lit(0))

"""Fields that a line of a spine may hold: numbers, publisher, edition, years, and how much it is like a person or a title. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import isbn as I
from . import text as T

# Words of publishers, publishers, forms of editions and of numbers.
PUBLISHER_WORDS = ["press", "publishing", "publishers", "publications", "books", "house", "yayinlari", "yayinevi", "yayincilik", "basim"]
PUBLISHERS = [
    "oxford", "cambridge", "penguin", "random house", "harpercollins", "simon schuster", "macmillan", "wiley", "pearson", "mcgraw hill", "scholastic", "hachette", "bloomsbury",
    "bantam", "vintage", "anchor", "knopf", "doubleday", "penguin random house", "yapi kredi", "can", "is bankasi", "dogan kitap", "alfa", "epsilon", "remzi", "inkilap",
    "kirmizi kedi",
]
EDITIONS = [
    (r"(?i)\brevised\s+edition\b", "revised", False), (r"(?i)\bupdated\s+edition\b", "updated", False), (r"(?i)\breprint\b", "reprint", False),
    (r"(?i)\b([0-9]+)(?:st|nd|rd|th)\s+edition\b", "numbered", True), (r"(?i)\bedition\s+([0-9]+)\b", "numbered", True), (r"(?i)\bfirst\s+edition\b", "numbered", False),
    (r"(?i)\bsecond\s+edition\b", "numbered", False), (r"(?i)\bthird\s+edition\b", "numbered", False), (r"(?i)\bfourth\s+edition\b", "numbered", False),
    (r"(?i)\bfifth\s+edition\b", "numbered", False), (r"(?i)\b([0-9]+)\s*ed\.?\b", "numbered", True), (r"(?i)\bedition\b", "other", False), (r"(?i)([0-9]+)\.\s*bask[ıi]", "numbered", True),
    (r"(?i)([0-9]+)\.\s*bas[ıi]m", "numbered", True), (r"(?i)cilt\s*([0-9]+)", "numbered", True), (r"(?i)yeni\s+bask[ıi]", "revised", False), (r"(?i)g[üu]ncellenmi[şs]", "updated", False),
]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth"]
ISBN_FORMS = [
    (r"(?i)ISBN[-:\s]*(97[89][0-9\-\s]{10,14}[0-9])", 1), (r"(?i)ISBN[-:\s]*([0-9][0-9\-\s]{8,11}[0-9X])", 1), (r"\b(97[89][0-9\-\s]{10,14}[0-9])\b", 1),
    (r"\b([0-9][0-9\-\s]{8,11}[0-9Xx])\b", 1),
]
LEAST_YEAR, GREATEST_YEAR = 1800, 2030
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", _B)


def normalize_turkish(c: Column) -> Column:
    return F.translate(F.lower(F.translate(c, "İŞĞÜÖÇ", "isguoc")), "ışğüöç", "isguoc")


def isbns(c: Column) -> Column:
    """Array of struct(value, type, raw) of the valid numbers in a line, each once: those of 13 digits first, those of 10 as 13 digits."""
    raw = F.concat(*[F.regexp_extract_all(c, F.lit(_java(p)), F.lit(i)) for p, i in ISBN_FORMS])
    seen = F.transform(raw, lambda r: F.struct(r.alias("raw"), I.normalize_isbn(r).alias("n")))
    once = F.filter(seen, lambda x, i: F.array_position(F.transform(seen, lambda y: y["n"]), x["n"]) == i + 1)
    thirteen = F.filter(once, lambda x: (F.length(x["n"]) == 13) & I.is_valid_isbn13(x["n"]))
    ten = F.filter(once, lambda x: (F.length(x["n"]) == 10) & I.is_valid_isbn10(x["n"]))
    out = lambda x, value, kind: F.struct(value.alias("value"), F.lit(kind).alias("type"), x["raw"].alias("raw"))
    return F.concat(F.transform(thirteen, lambda x: out(x, x["n"], "isbn13")), F.transform(ten, lambda x: out(x, F.coalesce(I.isbn10_to_isbn13(x["n"]), x["n"]), "isbn10")))


def publishers(c: Column, confidence: Column) -> Column:
    """Array of struct(value, confidence, method): the first known publisher, else a line with a publisher's word and what follows `published by`."""
    plain = normalize_turkish(T.normalize_for_comparison(c))
    row = lambda value, share, method: F.struct(value.alias("value"), (confidence * share).alias("confidence"), F.lit(method).alias("method"))
    known = F.get(F.filter(F.array(*[F.lit(p) for p in PUBLISHERS]), lambda p: F.contains(plain, p)), F.lit(0))
    around = F.regexp_substr(c, F.concat(F.lit("(?i)[^,;.]*"), known, F.lit("[^,;.]*")))
    named = row(F.coalesce(T.strip(around), known), 0.9, "known-publisher")
    word = F.when(plain.rlike("|".join(PUBLISHER_WORDS)), F.array(row(T.strip(c), 0.7, "keyword")))
    by = F.regexp_extract(c, r"(?i)published\s+by\s+([^,;.]+)", 1)
    none = F.array().cast("array<struct<value:string,confidence:double,method:string>>")
    return F.when(known.isNotNull(), F.array(named)).otherwise(F.concat(F.coalesce(word, none), F.when(by != "", F.array(row(T.strip(by), 0.8, "pattern"))).otherwise(none)))


def edition(c: Column) -> Column:
    """struct(value, number, type) of the first form of an edition that a line has, else null."""
    low, word = F.lower(c), F.lit(None).cast("int")
    for n in range(len(ORDINALS), 0, -1):
        word = F.when(F.contains(low, F.lit(ORDINALS[n - 1])), F.lit(n)).otherwise(word)
    out = None
    for pattern, kind, numbered in EDITIONS:
        p = _java(pattern)
        number = F.regexp_extract(c, p, 1).try_cast("int") if numbered else word
        found = F.struct(T.strip(F.regexp_extract(c, p, 0)).alias("value"), number.alias("number"), F.lit(kind).alias("type"))
        out = F.when(c.rlike(p), found) if out is None else out.when(c.rlike(p), found)
    return out


def years(c: Column) -> Column:
    """Array of struct(year, context): the year of a copyright first, then the others in order, each once."""
    right = F.regexp_extract(c, r"(?i)(?:copyright|©|\(c\))\s*([0-9]{4})", 1).try_cast("int")
    right = F.when(right.between(LEAST_YEAR, GREATEST_YEAR), right)
    others = F.transform(F.regexp_extract_all(c, F.lit(_java(r"\b(1[89][0-9]{2}|20[0-2][0-9])\b")), F.lit(1)), lambda y: y.cast("int"))
    others = F.filter(F.array_distinct(others), lambda y: ~y.eqNullSafe(right))
    low = F.lower(c)
    context = F.when(F.contains(low, F.lit("edition")) | F.contains(low, F.lit("baskı")), "edition").when(F.contains(low, F.lit("publish")) | F.contains(low, F.lit("yayın")), "publisher").otherwise("standalone")
    row = lambda y, ctx: F.struct(y.alias("year"), ctx.alias("context"))
    rest = F.transform(others, lambda y: row(y, context))
    return F.when(right.isNotNull(), F.concat(F.array(row(right, F.lit("copyright"))), rest)).otherwise(rest)


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def person_score(c: Column) -> Column:
    c = T.strip(c)
    w = F.split(c, r"\s+")
    score = (
        F.lit(0.5)
        + _if(F.size(w).between(2, 4) & F.forall(w, lambda x: x.rlike("^[A-Z]")), 0.2)
        + _if(c.rlike(r"(?i)(?<![A-Za-z0-9_])[A-Z]\."), 0.15)
        + _if(c.rlike(r"(?i)^(?:dr|prof|mr|mrs|ms|sir)\.?\s+"), 0.1)
        - _if(F.size(w) > 5, 0.2)
        - _if(c.rlike(r"(?i)^(?:the|a|an)\s+"), 0.3)
        - _if(c.rlike("[0-9]"), 0.2)
    )
    return F.when(F.length(c) < 2, 0.0).otherwise(_clamp(score))


def title_score(c: Column, person: Column | None = None) -> Column:
    c = T.strip(c)
    person = person_score(c) if person is None else person
    one = F.size(F.split(c, r"\s+")) == 1
    score = (
        F.lit(0.5) + _if(F.length(c) > 20, 0.1) + _if(F.length(c) > 40, 0.1) + _if(c.rlike("[:–—-]"), 0.1) + _if(c.rlike(r"(?i)^(?:the|a|an)\s+"), 0.15) - _if(person > 0.7, 0.3)
        + F.when(one & (person < 0.5), 0.1).when(one, -0.2).otherwise(0.0)
    )
    return F.when(F.length(c) < 2, 0.0).otherwise(_clamp(score))

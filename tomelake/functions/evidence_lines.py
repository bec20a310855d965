"""Cleaning of recognised lines and the evidence tokens in them, as Column expressions. Words are runs of [A-Za-z0-9_], as in `text`."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import isbn as I
from . import text as T

# Genres, shelf labels, and marks of publishers and of damaged recognition.
GENRES = [
    "fiction", "nonfiction", "non-fiction", "mystery", "romance", "thriller", "horror", "fantasy", "scifi", "sci-fi", "science", "biography", "memoir", "history",
    "historical", "contemporary", "literary", "classic", "classics", "poetry", "drama", "comedy", "adventure", "suspense", "crime", "detective", "western", "paranormal",
    "supernatural", "dystopian", "young", "adult", "ya", "childrens", "juvenile", "teen", "picture", "graphic", "manga", "comic", "novel", "novels", "stories", "short", "anthology",
]
SCORING_GENERIC = [
    "the", "a", "an", "of", "in", "to", "for", "with", "on", "at", "by", "from", "and", "or", "book", "books", "story", "stories", "tale", "tales", "novel", "novels",
    "edition", "volume", "part", "series", "collection", "new", "revised", "complete", "illustrated", "original", "classic", "essential", "definitive", "ultimate",
]
MARKETING = [
    "new york times bestseller", "new york times", "new-york times", "newyork times", "new fork times", "new fork", "new vork", "york times", "them-sork tames", "sork tames",
    "nyt bestseller", "#1 bestseller", "number one bestseller", "international bestseller", "bestselling author", "bestseling author", "national bestseller", "bestseller",
    "bestseling", "bestselling", "bestse ling", "bestse", "bestsel", "orki", "ork", "yorki", "a novel", "the novel", "now a major motion picture",
    "soon to be a major motion picture", "the movie", "now a netflix series", "as seen on tv", "oprah book club", "reese witherspoon book club", "book club pick",
    "pulitzer prize", "winner", "finalist", "award winning", "award-winning", "million copies sold", "over", "million", "copies", "worldwide", "introduction by",
    "foreword by", "afterword by", "preface by", "with a new", "revised edition", "updated edition", "special edition", "anniversary edition", "collectors edition",
    "deluxe edition", "illustrated edition", "mass market", "paperback", "hardcover", "trade paperback",
]
SHELF_LABELS = [
    "mystery", "fiction", "romance", "thriller", "biography", "history", "science", "self-help", "business", "cooking", "travel", "art", "music", "religion", "philosophy",
    "psychology", "politics", "economics", "sports", "health", "reference", "staff", "picks", "staff picks", "new arrivals", "bestsellers", "local authors", "author", "writer",
    "times", "ction", "tery", "oystery", "ance", "ller", "nuvil", "nuvel", "stacks", "crime",
]
PUBLISHER_NOISE = [
    "penguin", "random", "house", "randomhouse", "harpercollins", "harper", "collins", "simon", "schuster", "macmillan", "hachette", "scholastic", "vintage", "anchor", "knopf",
    "doubleday", "bantam", "dell", "berkley", "putnam", "ace", "tor", "forge", "orbit", "daw", "baen", "ballantine", "fawcett", "avon", "morrow", "little", "brown", "grand",
    "central", "atria", "pocket", "gallery", "st", "martins", "press", "books", "publishers", "publishing", "ster", "zebra", "jove", "kensington", "oxford", "wadsworth",
    "berkl", "berkel", "pengu", "banta", "visica", "vision", "berk!", "brime", "prime", "jovi", "tseller", "vintase", "zebba", "fork",
]
CONTINUATIONS = [
    "the", "a", "an", "of", "in", "to", "for", "with", "on", "at", "by", "from", "and", "or", "into", "onto", "through", "over", "under", "between", "among", "without",
    "within", "beyond", "before", "after",
]
ORGANISATIONS = ["new york times", "wall street journal", "washington post", "los angeles times", "random house", "simon schuster", "harper collins", "penguin random"]
TITLE_MARKS = ["the", "a", "an", "of", "and", "in", "to", "for", "with", "on", "at"]
SINGLE_GENERIC = [
    "it", "us", "them", "gone", "home", "room", "girl", "boy", "man", "woman", "night", "day", "life", "death", "love", "hate", "fire", "water", "earth", "air", "dark", "light",
    "blood", "bone", "heart", "soul", "mind", "body", "time", "space", "world", "dream", "fall", "rise", "run", "hide", "seek", "lost", "found", "wild", "free", "broken",
    "silent", "hidden",
]
NOT_NAMES = ["the", "and", "for", "with", "from", "into", "over", "left", "right", "last", "first", "one", "two", "life", "death", "night", "day"]
# Patterns of noise, of printing notices and of what is cut out of lines.
NOISE = [
    r"^\s*[\[\](){}<>]+\s*$", r"^[\s\-_=.]+$", r"^[0-9]+(\.[0-9]+)?$", r"^[A-Z]{1,2}[0-9]{1,4}$", r"^\$[0-9]+", r"(?i)^(?:isbn|issn)[\s:]?\s*$",
    r"(?i)^[0-9]+\s*u\.?s\.?$", r"(?i)^[0-9]+\s*can\)?$", r"(?i)^can\)?$", r"(?i)^u\.?s\.?a?$", r"(?i)^uk$", r"(?i)^#?[0-9]+\s+new$",
]
PRINTED = r"(?i)\b(?:in\s+usa|in\s+china|in\s+uk|printed\s+in|made\s+in|manufactured\s+in)\b"
EMBEDDED = [r"\$[0-9]+(?:\.[0-9]{2})?", r"(?i)\b(?:usa|us|uk|can|cdn)\s*\$?[0-9]+", r"(?i)\bISBN[-:\s]*(?=[0-9])", r"(?i)\bNYT\s*#?[0-9]*"]

# Edges of ASCII words, whatever Java takes for a letter.
_BEGIN, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def java(pattern: str) -> str:
    """A pattern whose \\b stand before its first word or after its last one."""
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if rest.startswith(r"\b"):
        rest = _BEGIN + rest[2:]
    return flag + rest.replace(r"\b", _END)


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Phrases that hold another one needn't be looked for."""
    out = F.lit(False)
    for p in [p for p in dict.fromkeys(phrases) if not any(o in p for o in phrases if o != p)]:
        out = out | F.contains(c, F.lit(p))
    return out


def split_joined(c: Column) -> Column:
    """A capitalised word stuck to the end of another one is parted from it."""
    return F.regexp_replace(c, "([a-zà-öø-ÿğış]{3,})([A-ZÀ-ÖØ-ÞĞİŞ][a-zà-öø-ÿğış]{2,})", "$1 $2")


def fold(c: Column) -> Column:
    return F.regexp_replace(T.fold(F.replace(c, F.lit("Æ"), F.lit("AE"))), "[̀-ͯ]", "")


_WRAPPED = r"^[\[({<](.+)[\])}>]$"


def normalize_line(c: Column) -> Column:
    """struct(original, normalized, wrapped): without brackets, quotes and signs at the ends; wrapped if brackets held all of it."""
    clean = T.collapse(T.strip(fold(c)))
    wrapped = clean.rlike(_WRAPPED)
    inside = T.strip(F.regexp_extract(clean, _WRAPPED, 1))
    bare = F.regexp_replace(F.regexp_replace(clean, r"""^[\[\](){}<>"']+""", ""), r"""[\[\](){}<>"']+$""", "")
    out = F.when(wrapped, inside).otherwise(bare)
    out = F.regexp_replace(F.regexp_replace(out, r"^[^A-Za-z0-9_\s]+", ""), r"[^A-Za-z0-9_\s]+$", "")
    out = T.collapse(T.strip(out))
    return F.struct(out.alias("original"), F.lower(out).alias("normalized"), wrapped.alias("wrapped"))


def normalize_lines(lines: Column) -> Column:
    """`normalize_line` of each line of an array. A step is an array of its own, so nothing is worked out twice for a line."""
    clean = F.transform(lines, lambda x: T.collapse(T.strip(fold(x))))
    marked = F.transform(clean, lambda x: F.struct(x.alias("c"), x.rlike(_WRAPPED).alias("w")))

    def bare(x: Column) -> Column:
        ends = F.regexp_replace(F.regexp_replace(x["c"], r"""^[\[\](){}<>"']+""", ""), r"""[\[\](){}<>"']+$""", "")
        out = F.when(x["w"], T.strip(F.regexp_extract(x["c"], _WRAPPED, 1))).otherwise(ends)
        out = F.regexp_replace(F.regexp_replace(out, r"^[^A-Za-z0-9_\s]+", ""), r"[^A-Za-z0-9_\s]+$", "")
        return F.struct(T.collapse(T.strip(out)).alias("o"), x["w"].alias("w"))

    return F.transform(F.transform(marked, bare), lambda x: F.struct(x["o"].alias("original"), F.lower(x["o"]).alias("normalized"), x["w"].alias("wrapped")))


def strip_embedded_noise(c: Column) -> Column:
    """Prices, labels of numbers and publishers' words cut out."""
    for p in EMBEDDED:
        c = F.regexp_replace(c, java(p), " ")
    letters = lambda w: F.regexp_replace(F.lower(w), "[^a-z]", "")
    keep = lambda w: ~letters(w).isin("", *PUBLISHER_NOISE) | (~w.rlike("[a-zA-Z]") & (letters(w) == "") & w.rlike("[0-9]"))
    return F.array_join(F.filter(F.split(c, r"\s+"), lambda w: (w != "") & keep(w)), " ")


def is_incomplete(c: Column) -> Column:
    """The line ends with a word that must go on, or with a hyphen."""
    c = T.strip(c)
    last = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?s)^.*\s", "")), "[^a-z]", "")
    return (F.length(c) >= 3) & (last.isin(*CONTINUATIONS) | F.endswith(c, F.lit("-")))


def is_name_part(c: Column) -> Column:
    """One capitalised word that may be part of a name."""
    c = T.strip(c)
    count = lambda p: F.regexp_count(c, F.lit(p))
    letters, upper, rest = count("[a-zA-Z]"), count("[A-Z]"), F.substr(c, F.lit(2))
    shape = ~F.contains(c, F.lit(" ")) & (F.length(c) >= 2) & (letters >= F.length(c) * 0.8) & c.rlike("^[A-Z]")
    return shape & ((upper >= letters * 0.7) | (F.length(c).between(3, 12) & (rest == F.lower(rest))))


def merge_split_lines(lines: Column) -> Column:
    """Lines that must go on are joined with the next; then two or three name parts in a row are joined too, and kept beside."""
    first = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def push(done: Column, x: Column) -> Column:
        return F.when(F.coalesce(x, F.lit("")) == "", done).otherwise(F.array_append(done, x))

    def join(acc: Column, line: Column) -> Column:
        now, line = acc["open"], T.strip(line)
        goes_on = now.isNotNull() & is_incomplete(now)
        joined = F.when(F.endswith(now, F.lit("-")), F.concat(F.substr(now, F.lit(1), F.length(now) - 1), line)).otherwise(F.concat(now, F.lit(" "), line))
        return F.struct(F.when(goes_on, acc["done"]).otherwise(push(acc["done"], now)).alias("done"), F.when(goes_on, joined).otherwise(line).alias("open"))

    whole = F.aggregate(lines, first, join, lambda acc: push(acc["done"], acc["open"]))
    second = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("names"))

    def flush(acc: Column) -> Column:
        names = acc["names"]
        return F.when(F.size(names) >= 2, F.concat(acc["done"], F.array(F.array_join(names, " ")), names)).otherwise(F.concat(acc["done"], names))

    def gather(acc: Column, x: Column) -> Column:
        name = is_name_part(x)
        more = name & (F.size(acc["names"]) < 3)
        none = F.array().cast("array<string>")
        return F.when(more, F.struct(acc["done"].alias("done"), F.array_append(acc["names"], x).alias("names"))).otherwise(
            F.struct(F.when(name, flush(acc)).otherwise(F.array_append(flush(acc), x)).alias("done"), F.when(name, F.array(x)).otherwise(none).alias("names"))
        )

    return F.when(F.size(lines) <= 1, lines).otherwise(F.aggregate(whole, second, gather, flush))


def is_noise(normalized: Column) -> Column:
    out = (F.length(normalized) <= 1) | normalized.isin(*SHELF_LABELS) | (~F.contains(normalized, F.lit(" ")) & normalized.isin(*GENRES)) | normalized.rlike(java(PRINTED))
    for p in NOISE:
        out = out | normalized.rlike(p)
    return out


def is_marketing(normalized: Column) -> Column:
    return contains_any(normalized, MARKETING)


def remove_marketing(c: Column) -> Column:
    """Phrases of covers cut out, the longest first."""
    phrases = sorted(MARKETING, key=len, reverse=True)
    pattern = lambda p: "(?i)(^|[^a-z0-9])" + r"\s+".join(re.escape(w) for w in p.split()) + "(?![a-z0-9])"
    rules = F.array(*[F.struct(F.lit(p.split()[0]).alias("word"), F.lit(pattern(p)).alias("pattern")) for p in phrases])
    cut = lambda acc, r: F.when(F.contains(F.lower(acc), r["word"]), F.regexp_replace(acc, r["pattern"], F.lit("$1 "))).otherwise(acc)
    return T.strip(T.collapse(F.aggregate(rules, c, cut)))


def tokens(normalized: Column) -> Column:
    """Words with apostrophes inside; no single characters, and numbers only where they look like an ISBN."""
    number = lambda t: t.rlike("^[0-9]+$") & ~t.rlike("^([0-9]{10}|97[89][0-9]{10})$")
    words = F.filter(F.split(normalized, r"[^A-Za-z0-9_']+"), lambda t: (F.length(t) > 1) & ~number(t))
    return F.filter(F.transform(words, lambda t: F.btrim(t, F.lit("'"))), lambda t: F.length(t) > 1)


def evidence_of(tokens_: Column, is_number=I.is_isbn_like_token) -> Column:
    """Of tokens those that count as evidence: no genre, no number."""
    return F.filter(tokens_, lambda t: ~t.isin(*GENRES) & ~t.rlike("^[0-9]+$") & ~is_number(t))


def evidence_tokens(normalized: Column) -> Column:
    return evidence_of(tokens(normalized))


def scoring_of(evidence: Column) -> Column:
    return F.filter(evidence, lambda t: ~t.isin(*SCORING_GENERIC))


def distinct_of(tokens_: Column) -> Column:
    return F.array_distinct(F.filter(tokens_, lambda t: ~t.isin(*GENRES)))


def tokens_from_text(c: Column) -> Column:
    return distinct_of(tokens(normalize_line(c)["normalized"]))


def scoring_tokens(c: Column) -> Column:
    return scoring_of(evidence_tokens(normalize_line(c)["normalized"]))


def is_generic_title(c: Column) -> Column:
    t = scoring_tokens(c)
    return (F.size(t) == 0) | ((F.size(t) == 1) & F.coalesce(F.get(t, F.lit(0)), F.lit("")).isin(*SINGLE_GENERIC))


def strip_leading_article(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)^(the|a|an)[0-9]*\s+", "")


def line_isbn(c: Column) -> Column:
    """The first number of ISBN-13 form in the line without blanks and hyphens, else of ISBN-10 form; check digits aren't looked at."""
    bare = F.regexp_replace(c, r"[-\s]", "")
    ten = F.upper(F.regexp_extract(bare, "[0-9]{9}[0-9Xx]", 0))
    thirteen = F.regexp_extract(bare, "97[89][0-9]{10}", 0)
    return F.when(c.rlike("[0-9]"), F.when(thirteen != "", thirteen).when(ten != "", ten))


def looks_like_person(c: Column) -> Column:
    """Two to four words, mostly letters, that no title, shelf, cover or printer would have."""
    low, w = F.lower(c), F.split(T.strip(c), r"\s+")
    initial = lambda x: x.rlike(r"^[A-Za-z]\.?$")
    letters = lambda x: F.length(F.regexp_replace(x, "[^a-zA-Z]", ""))
    named = F.forall(w, lambda x: initial(x) | ((letters(x) >= 2) & (letters(x) / F.length(x) >= 0.7)))
    capital = F.exists(w, lambda x: x.rlike("^[A-Z]")) | F.forall(w, lambda x: (x == F.upper(x)) | (F.length(x) <= 2))
    other = F.lower(F.get(w, F.lit(0))).isin("the", "a", "an") | low.isin(*GENRES) | low.isin(*SHELF_LABELS) | is_marketing(low) | contains_any(low, ORGANISATIONS) | low.rlike(java(PRINTED))
    return F.size(w).between(2, 4) & ~other & named & capital


def looks_like_title(c: Column) -> Column:
    w = F.split(T.strip(c), r"\s+")
    mark = F.exists(F.split(F.lower(c), r"\s+"), lambda x: x.isin(*TITLE_MARKS))
    return (F.size(w) > 1) & ((F.size(w) >= 3) | mark) & ~is_marketing(F.lower(c))


def clean_lines(lines: Column) -> Column:
    """Merged lines that are neither empty nor noise nor marketing, normalised."""
    return clean_of(normalize_lines(F.transform(merge_split_lines(lines), strip_embedded_noise)))


def clean_of(normal: Column) -> Column:
    kept = F.filter(normal, lambda x: (x["normalized"] != "") & ~is_noise(x["normalized"]) & ~is_marketing(x["normalized"]))
    return F.transform(kept, lambda x: x["original"])


def with_evidence(df: DataFrame, lines: str) -> DataFrame:
    """df with the evidence of its column of line arrays: wrapped, cleaned, tokens (distinct, in order), token_counts, phrases, person_lines, title_lines, isbns, evidence_lines.

    Each step is a column of its own, so nothing is worked out twice for a line.
    """
    df = df.withColumn("_split", F.transform(lines, split_joined)).withColumn("_merged", merge_split_lines(F.col("_split")))
    df = df.withColumn("_bare", F.transform("_merged", strip_embedded_noise)).withColumn("_normal", normalize_lines(F.col("_bare"))).withColumn("_all", F.col("_normal"))
    df = df.withColumn("isbns", F.filter(F.transform(F.filter(F.arrays_zip("_merged", "_normal"), lambda x: x["_normal"]["normalized"] != ""), lambda x: line_isbn(x["_merged"])), lambda x: x.isNotNull()))
    df = df.withColumn("_normal", F.filter("_normal", lambda x: x["normalized"] != ""))
    df = df.withColumn("wrapped", F.transform(F.filter("_normal", lambda x: x["wrapped"]), lambda x: x["original"]))
    df = df.withColumn("_normal", F.filter("_normal", lambda x: ~is_noise(x["normalized"])))
    df = df.withColumn("_normal", F.transform("_normal", lambda x: F.when(is_marketing(x["normalized"]), F.named_struct(F.lit("m"), F.lit(True), F.lit("l"), normalize_line(remove_marketing(x["original"])))).otherwise(F.named_struct(F.lit("m"), F.lit(False), F.lit("l"), x))))
    df = df.withColumn("_kept", F.transform(F.filter("_normal", lambda x: ~x["m"] | (x["l"]["normalized"].rlike("[a-z]{3,}") & ~is_noise(x["l"]["normalized"]))), lambda x: x["l"]))
    df = df.withColumn("cleaned", F.transform("_kept", lambda x: x["original"])).withColumn("_tokens", F.flatten(F.transform("_kept", lambda x: evidence_tokens(x["normalized"]))))
    df = df.withColumn("tokens", F.array_distinct("_tokens"))
    df = df.withColumn("phrases", F.transform(F.filter("_kept", lambda x: (F.regexp_count(x["original"], F.lit("[a-zA-Z]")) >= 3) & (F.size(tokens(x["normalized"])) >= 1)), lambda x: x["original"]))
    df = df.withColumn("person_lines", F.filter("phrases", looks_like_person)).withColumn("title_lines", F.filter("phrases", looks_like_title))
    # Where no words are parted, the lines are the same ones.
    df = df.withColumn("evidence_lines", F.when(F.col("_split") == F.col(lines), clean_of(F.col("_all"))).otherwise(clean_lines(F.col(lines))))
    return df.drop("_merged", "_bare", "_normal", "_kept", "_all")


def with_recovered_authors(df: DataFrame) -> DataFrame:
    """df of `with_evidence` with recovered_authors: array of struct(line, confidence, reason), the surest first, else in the order in which they are found."""
    found = lambda x, confidence, reason: F.struct(x.alias("line"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    size = lambda x: F.size(F.split(T.strip(x), r"\s+"))
    letters = lambda x: F.regexp_count(x, F.lit("[a-zA-Z]"))
    df = df.withColumn("_a", F.array_distinct(F.filter("wrapped", lambda x: size(x).between(2, 4)))).withColumn("_b", F.array_except("person_lines", "_a"))
    df = df.withColumn("_seen", F.concat("_a", "_b")).withColumn("_lines", F.filter(F.transform("_split", T.strip), lambda x: x != ""))
    low = lambda x: F.lower(x)
    surname = lambda x: (size(x) == 1) & (x == F.upper(x)) & (F.length(x) >= 5) & (letters(x) >= F.length(x) * 0.9) & ~low(x).isin(*GENRES) & ~low(x).isin(*SHELF_LABELS) & ~low(x).isin(*PUBLISHER_NOISE)
    df = df.withColumn("_c", F.array_distinct(F.filter("_lines", lambda x: ~F.array_contains("_seen", x) & surname(x)))).withColumn("_seen", F.concat("_seen", "_c"))
    half = F.transform(F.slice("_split", F.expr("int(size(_split) div 2) + 1"), F.size("_split")), T.strip)
    cased = lambda w: (F.length(w) > 1) & (F.substr(w, F.lit(1), F.lit(1)) == F.upper(F.substr(w, F.lit(1), F.lit(1)))) & (F.substr(w, F.lit(2)) == F.lower(F.substr(w, F.lit(2))))
    bottom = lambda x: (x != "") & ~F.array_contains("_seen", x) & ~F.array_contains("person_lines", x) & size(x).between(2, 4) & (letters(x) >= 0.85 * F.length(F.regexp_replace(x, r"\s", ""))) & ~x.rlike("[0-9]{3,}") & F.exists(F.split(x, r"\s+"), cased)
    df = df.withColumn("_d", F.filter(half, bottom))
    middle, two = _BEGIN + r"([A-Z][a-z]*)\s+([A-Z])\.?([A-Z][a-z]+)$", _BEGIN + r"([A-Z][A-Za-z]+)\s+([A-Z][A-Za-z]+)$"
    part = lambda x, p, i: F.regexp_extract(x, p, i)
    loose = "(?i)" + middle

    def merged(x: Column) -> Column:
        name = F.concat(part(x, loose, 1), F.lit(" "), part(x, loose, 2), F.lit(". "), part(x, loose, 3))
        skip = lambda i: low(part(x, two, i)).isin(*NOT_NAMES)
        return F.when(x.rlike(loose), found(name, 0.55, "extracted_from_merged_line_middle_initial")).when(x.rlike(two) & ~skip(1) & ~skip(2), found(part(x, two, 0), 0.4, "extracted_from_merged_line_two_word"))

    ends = F.filter(F.transform(F.filter("_lines", lambda x: ~F.array_contains("_seen", x) & (F.length(x) >= 15)), merged), lambda x: x.isNotNull() & ~F.array_contains("_seen", F.upper(x["line"])))
    # Of names that differ in case alone the first stays.
    df = df.withColumn("_e", ends).withColumn("_e", F.filter("_e", lambda x, i: F.array_position(F.transform("_e", lambda y: F.upper(y["line"])), F.upper(x["line"])) == i + 1))
    every = F.concat(
        F.transform("_a", lambda x: found(x, 0.9, "bracketed_author_name")),
        F.transform("_b", lambda x: found(x, 0.7, "detected_person_name")),
        F.filter("_e", lambda x: x["confidence"] == 0.55),
        F.transform("_d", lambda x: found(x, 0.5, "title_case_pattern_bottom_half")),
        F.transform("_c", lambda x: found(x, 0.45, "single_word_surname_candidate")),
        F.filter("_e", lambda x: x["confidence"] == 0.4),
    )
    return df.withColumn("recovered_authors", every).drop("_a", "_b", "_c", "_d", "_e", "_seen", "_lines")

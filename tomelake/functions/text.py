"""Text normalisers, tokenisers and similarities as Column expressions.

Several of them look alike and differ in a detail (what happens to accents, to trailing blanks, to two empty strings); each
is kept under its own name because decisions downstream depend on the detail. Words are runs of [A-Za-z0-9_].
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# Letters that decompose into an ASCII letter and marks, by rule rather than by list.
_FOLDED = [(c, d) for c in map(chr, range(0xC0, 0x250)) if (d := unicodedata.normalize("NFD", c)[0]) != c and d.isascii()]
FOLD_FROM = "".join(c for c, _ in _FOLDED) + "ıøØłŁđĐ"
FOLD_TO = "".join(d for _, d in _FOLDED) + "ioOlLdD"

# Words that say little about a title.
GENERIC_TOKENS = (
    "the a an of and in to for on with by at from as is it that this be are was were been being have has had do does did "
    "will would could should may might must shall can need book volume vol edition ed part chapter series"
).split()
# Titles that many works share.
COLLISION_TITLES = [
    "the book", "introduction", "guide", "handbook", "manual", "complete guide", "beginners guide", "for dummies", "essentials",
    "fundamentals", "principles", "basics", "collection", "anthology", "selected works", "best of", "greatest hits",
]
# Words of shop shelves and covers that are no evidence.
NOISE_TOKENS = (
    "fiction nonfiction novel memoir biography thriller mystery romance fantasy horror suspense adventure literary historical "
    "contemporary classic bestseller hardcover paperback ebook audiobook edition reprint anniversary revised updated expanded "
    "illustrated mass market trade large print type bestselling award winning national international york times list club "
    "selection oprah reese general adult young new arrivals staff picks"
).split()
# Single words that are titles of many works.
GENERIC_SINGLE_TITLES = "it us them home room gone the a an love life time day night girl boy man woman house place road way story book novel tale".split()


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def collapse(c: Column) -> Column:
    """Single blanks are left alone: each replacement costs more than the search."""
    return _sub(c, r"\s\s+|[\t\n\x0B\f\r]", " ")


def _tidy(c: Column) -> Column:
    """Blanks collapsed and trimmed."""
    return F.trim(collapse(c))


def fold(c: Column) -> Column:
    """Accents off."""
    other = F.translate(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), FOLD_FROM, FOLD_TO)
    return F.when(c.rlike(r"[^\x00-\x7F]"), other).otherwise(c)


def _parts(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) >= least)


def normalize_for_comparison(c: Column) -> Column:
    """Lower case, signs dropped, blanks collapsed and trimmed."""
    return _tidy(_sub(F.lower(c), r"[^a-z0-9_\s]", ""))


def comparison_tokens(c: Column) -> Column:
    return _parts(normalize_for_comparison(c))


def token_overlap(a: Column, b: Column) -> Column:
    """struct(count, ratio): tokens of a, repeated ones too, that b has."""
    left, right = comparison_tokens(a), comparison_tokens(b)
    count = F.size(F.filter(left, lambda t: F.array_contains(right, t)))
    return F.struct(count.alias("count"), F.when(F.size(left) == 0, 0.0).otherwise(count / F.size(left)).alias("ratio"))


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def specific_tokens(c: Column) -> Column:
    return F.filter(comparison_tokens(c), lambda t: ~t.isin(*GENERIC_TOKENS))


def count_specific_tokens(c: Column) -> Column:
    return F.size(specific_tokens(c))


def generic_penalty(query: Column, result: Column) -> Column:
    """How little a query title singles out: 1 when empty; else by its share of generic words, by colliding titles, and for a short result."""
    tokens = comparison_tokens(query)
    return generic_penalty_of(normalize_for_comparison(query), F.size(tokens), count_specific_tokens(query), F.size(comparison_tokens(result)))


def generic_penalty_of(norm: Column, n: Column, specific: Column, result: Column) -> Column:
    """norm: the query's normal form, n: its tokens, specific: those that aren't generic, result: the tokens of the result."""
    collides = F.lit(False)
    for t in [t for t in COLLISION_TITLES if not any(o in t for o in COLLISION_TITLES if o != t)]:  # a title that holds another needn't be looked for
        collides = collides | F.contains(norm, F.lit(t))
    total = (1 - specific / n) * 0.3 + F.when(collides, 0.4).otherwise(0.0) + F.when(result <= 2, 0.1).otherwise(0.0)
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def line_similarity(a: Column, b: Column) -> Column:
    """As levenshtein_similarity, but 0 where exactly one side is empty."""
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(levenshtein_similarity(a, b))


def normalize_fuzzy(c: Column) -> Column:
    """Lower case without accents; signs but for apostrophes inside words become blanks."""
    c = _sub(fold(F.lower(c)), r"[^a-z0-9_\s']", " ")
    return _tidy(_sub(c, r"'(?:(?![a-z0-9_])|(?<![a-z0-9_]'))", " "))


def fuzzy_tokens(c: Column) -> Column:
    """Tokens of three letters or more, digits only where ISBN-long, no noise words, possessive s dropped."""
    bare = F.split(_sub(normalize_fuzzy(c), r"'s(?= |$)", ""), " ")
    # A token above ":" begins with no digit.
    keep = lambda t: (F.length(t) >= 3) & ~t.isin(*NOISE_TOKENS) & ((t > ":") | ~t.rlike(r"^[0-9]+$") | F.length(t).isin(10, 13))
    return F.filter(bare, keep)


def candidate_tokens(title: Column, authors: Column) -> Column:
    return F.array_distinct(fuzzy_tokens(F.concat_ws(" ", title, authors)))


def is_generic_single_word_title(c: Column) -> Column:
    return is_generic_single(fuzzy_tokens(c))


def is_generic_single(t: Column) -> Column:
    return (F.size(t) == 1) & F.element_at(F.concat(t, F.array(F.lit(""))), 1).isin(*GENERIC_SINGLE_TITLES)


def best_token_match(token: Column, candidates: Column) -> Column:
    """struct(token, similarity): the first candidate of the greatest similarity; nothing where all are 0."""
    start = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0.0).alias("similarity"))

    def step(best, c):
        s = levenshtein_similarity(token, c)
        return F.when(s > best["similarity"], F.struct(c.alias("token"), s.alias("similarity"))).otherwise(best)

    return F.aggregate(candidates, start, step)


def token_set_overlap(evidence: Column, candidates: Column, threshold: float = 0.75) -> Column:
    """Greedy one-to-one matches in evidence order: array of struct(evidence, candidate, similarity). Both sides hold distinct tokens."""
    kind = "array<struct<evidence:string,candidate:string,similarity:double>>"

    def step(found, token):
        free = F.filter(candidates, lambda c: ~F.array_contains(F.transform(found, lambda m: m["candidate"]), c))
        best = best_token_match(token, free)
        match = F.array(F.struct(token.alias("evidence"), best["token"].alias("candidate"), best["similarity"].alias("similarity")))
        return F.when(best["similarity"] >= threshold, F.concat(found, match)).otherwise(found)

    return F.aggregate(evidence, F.array().cast(kind), step)


#: A token counts as matched from here; bonus of a matched ISBN, penalty of a generic title, and the cap of scores on fewer matches than needed.
MATCHED, ISBN_BONUS, GENERIC_PENALTY, LEAST_MATCHES, WEAK_CAP = 0.75, 0.15, 0.15, 2, 0.10


def author_signal(evidence: Column, hint: Column | None = None) -> Column:
    """Whether a text speaks of an author: a token of the hint is in it, or two to four capitalised words follow each other."""
    named = evidence.rlike(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}(?![A-Za-z0-9_])")
    if hint is None:
        return named
    tokens = fuzzy_tokens(evidence)
    hinted = F.exists(fuzzy_tokens(F.coalesce(hint, F.lit(""))), lambda h: F.exists(tokens, lambda e: levenshtein_similarity(h, e) >= MATCHED))
    return hinted | named


def token_set_score(evidence: Column, title: Column, authors: Column, isbn_match: Column | None = None, author_hint: Column | None = None) -> Column:
    """struct(score, overlap, precision, recall, f1, signal, generic, weak) of a candidate against the evidence: F1 of matched tokens, plus the ISBN bonus, less the penalty of a
    generic one-word title without a sign of an author, and capped where too few tokens match."""
    looked = F.struct(F.array_distinct(fuzzy_tokens(evidence)).alias("e"), candidate_tokens(title, authors).alias("c"))
    matched = F.transform(F.array(looked), lambda x: F.struct(x["e"].alias("e"), x["c"].alias("c"), F.size(token_set_overlap(x["e"], x["c"], MATCHED)).alias("n")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rates = F.transform(matched, lambda x: F.struct(x["n"].alias("n"), ratio(x["n"], F.size(x["e"])).alias("p"), ratio(x["n"], F.size(x["c"])).alias("r")))
    whole = F.transform(rates, lambda x: F.struct(*[x[k].alias(k) for k in "npr"], F.when(x["p"] + x["r"] > 0, (2 * x["p"] * x["r"]) / (x["p"] + x["r"])).otherwise(F.lit(0.0)).alias("f"), author_signal(evidence, author_hint).alias("s")))
    bonus = F.lit(0.0) if isbn_match is None else F.when(isbn_match, ISBN_BONUS).otherwise(0.0)

    def score(x: Column) -> Column:
        generic = is_generic_single_word_title(title) & ~x["s"] & (x["n"] < 3)
        plain = x["f"] + bonus - F.when(generic, GENERIC_PENALTY).otherwise(0.0)
        weak = (x["n"] < LEAST_MATCHES) & (plain > WEAK_CAP)
        total = F.greatest(F.lit(0.0), F.when(weak, F.lit(WEAK_CAP)).otherwise(plain))
        return F.struct(total.alias("score"), x["n"].alias("overlap"), x["p"].alias("precision"), x["r"].alias("recall"), x["f"].alias("f1"), x["s"].alias("signal"), generic.alias("generic"), weak.alias("weak"))

    return F.get(F.transform(whole, score), F.lit(0))


def normalize_for_match(c: Column) -> Column:
    """Upper case without accents; signs become blanks."""
    return _tidy(_sub(F.upper(fold(c)), r"[^A-Z0-9_\s]", " "))


def match_tokens(c: Column) -> Column:
    return _parts(normalize_for_match(c))


def alpha_ratio(c: Column) -> Column:
    """ASCII letters over characters that aren't blank."""
    solid = F.length(_sub(c, r"\s", ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(_sub(c, r"[^A-Za-z]", "")) / solid)


def is_similar_within_tolerance(a: Column, b: Column, distance: int = 1) -> Column:
    a, b = normalize_for_match(a), normalize_for_match(b)
    return (a == b) | ((F.length(a) <= 12) & (F.length(b) <= 12) & (F.levenshtein(a, b) <= distance))


# Characters that recognition confuses, each with the sign that stands for its group.
OCR_FROM, OCR_TO = "OI|SBZG", "0115826"
LINE_OCR_FROM, LINE_OCR_TO = "01l|58", "oiiisb"


def normalize_for_ocr(c: Column) -> Column:
    return F.translate(strip(F.upper(c)), OCR_FROM, OCR_TO)


def normalize_for_api(c: Column) -> Column:
    return normalize_for_ocr(normalize_for_match(c))


def ocr_line(c: Column) -> Column:
    return F.translate(normalize_for_comparison(c), LINE_OCR_FROM, LINE_OCR_TO)


def are_similar_lines(a: Column, b: Column, threshold: float = 0.85) -> Column:
    a, b = ocr_line(a), ocr_line(b)
    return (a == b) | (line_similarity(a, b) >= threshold)


def similar_forms(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """`are_similar_lines` of comparable forms. Edits are counted only up to those that the lengths allow; the rest is dissimilar anyway."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    # One more than needed, so that rounding decides nothing here.
    most = F.floor(longest * (1 - threshold)).cast("int") + 1
    edits = F.call_function("levenshtein", a, b, most)
    return F.when(a == b, True).when((shortest == 0) | (longest - shortest > most), False).otherwise((edits >= 0) & (1 - edits / longest >= threshold))


def author_similarity(ocr: Column, api: Column) -> Column:
    """struct(similarity, is_match, reason): equal, one or two leading characters missing, few edits for the length, or shared tokens."""
    a, b = normalize_for_api(ocr), normalize_for_api(api)
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    edits = F.levenshtein(a, b)
    tolerance = F.when(longest < 8, 1).when(longest < 15, 2).otherwise(3)
    ta, tb = F.split(a, " "), F.split(b, " ")
    shared = F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    close, overlap = 1 - edits / longest, shared / F.greatest(F.size(ta), F.size(tb))

    def out(similarity, is_match, reason):
        return F.struct(F.lit(similarity).cast("double").alias("similarity") if not isinstance(similarity, Column) else similarity.cast("double").alias("similarity"), (is_match if isinstance(is_match, Column) else F.lit(is_match)).alias("is_match"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    missing = (F.coalesce(ocr, F.lit("")) == "") | (F.coalesce(api, F.lit("")) == "")
    return (
        F.when(missing, out(0.0, False, "missing_input"))
        .when(a == b, out(1.0, True, "exact_match"))
        .when((lb - la).between(1, 2) & b.endswith(a), out(0.95, True, "missing_leading_char"))
        .when(edits <= tolerance, out(close, close >= 0.7, F.when(close >= 0.7, "edit_distance_within_tolerance").otherwise("edit_distance_marginal")))
        .when((shared >= 1) & (shared >= F.size(ta) - 1), out(overlap, overlap >= 0.6, F.when(overlap >= 0.6, "token_overlap_match").otherwise("token_overlap_low")))
        .otherwise(out(1 - F.least(F.lit(1.0), edits / longest), False, "edit_distance_too_high"))
    )


def best_author(ocr: Column, authors: Column) -> Column:
    """struct(author, similarity struct): the first author of the greatest similarity; null without authors."""
    scored = F.transform(authors, lambda x, i: F.struct(author_similarity(ocr, x)["similarity"].alias("s"), (-i).alias("order"), x.alias("author"), author_similarity(ocr, x).alias("similarity")))
    top = F.array_max(F.transform(scored, lambda r: F.struct(r["s"], r["order"])))
    hit = F.element_at(F.filter(scored, lambda r: (r["s"] == top["s"]) & (r["order"] == top["order"])), 1)
    return F.when(F.size(authors) > 0, F.struct(hit["author"].alias("author"), hit["similarity"].alias("similarity")))


def author_matches_with_tolerance(ocr: Column, authors: Column) -> Column:
    return F.coalesce(best_author(ocr, authors)["similarity"]["is_match"], F.lit(False))


def normalize_query(c: Column) -> Column:
    """Lower case, trimmed first, signs dropped, blanks collapsed: a sign at an end may leave a blank there."""
    return collapse(_sub(strip(F.lower(c)), r"[^a-z0-9_\s]", ""))


def query_tokens(c: Column) -> Column:
    return _parts(normalize_query(c), 2)


def query_similarity(a: Column, b: Column) -> Column:
    return line_similarity(normalize_query(a), normalize_query(b))


def is_generic_query_title(c: Column) -> Column:
    return is_generic_query(normalize_query(c))


def is_generic_query(norm: Column) -> Column:
    return norm.isin("the book", "untitled", "novel", "stories", "collection") | (F.length(norm) < 3)


def edge_author_matches(authors: Column, target: Column) -> Column:
    """Any author equal, more than 0.8 similar, with two shared tokens, or with more than 0.7 of the target's."""
    wanted = F.array_distinct(query_tokens(target))
    norm = normalize_query(target)

    def fits(author):
        shared = F.size(F.array_intersect(wanted, query_tokens(author)))
        ratio = F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(0.0)
        return (normalize_query(author) == norm) | (query_similarity(normalize_query(author), norm) > 0.8) | (shared >= 2) | (ratio > 0.7)

    return F.when(F.coalesce(target, F.lit("")) == "", False).otherwise(F.exists(authors, fits))


# Words that don't tell titles apart.
TITLE_STOPWORDS = "the a an of to in on and".split()


def normalize_title(c: Column) -> Column:
    return _tidy(_sub(strip(F.upper(c)), r"[^A-Z0-9_\s]", " "))


def title_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(_parts(normalize_title(c)), lambda t: ~F.lower(t).isin(*TITLE_STOPWORDS)))


def is_title_full_match(a: Column, b: Column) -> Column:
    """Equal titles, or equal sets of telling words."""
    na, nb, ta, tb = normalize_title(a), normalize_title(b), title_tokens(a), title_tokens(b)
    same = (F.size(ta) > 0) & (F.size(ta) == F.size(tb)) & (F.array_sort(ta) == F.array_sort(tb))
    return F.when((na == "") | (nb == ""), False).otherwise((na == nb) | same)


def normalize_for_dedupe(c: Column) -> Column:
    return _sub(F.lower(c), r"[^a-z0-9]", "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over characters, as eight hexadecimal digits. Exact for ASCII."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def evidence_hash(lines: Column) -> Column:
    """Hash of the sorted normalised lines of four characters or more; `empty-evidence` without any."""
    texts = F.array_sort(F.filter(F.transform(lines, normalize_for_comparison), lambda t: F.length(t) >= 4))
    return F.when(F.size(texts) == 0, "empty-evidence").otherwise(fnv1a(F.array_join(texts, "|")))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; a and b are arrays of them."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 0.0).otherwise(shared / total)


def jaro(a: str, b: str) -> float:
    """Jaro similarity that keeps half transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    if not mine:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True))
    n = len(mine)
    return (n / len(a) + n / len(b) + (n - swapped / 2) / n) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """The prefix of up to four characters counts at every similarity."""
    j, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + prefix * min(scale, 0.25) * (1 - j)


def _pairwise(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


jaro_similarity = _pairwise(jaro)
jaro_winkler_similarity = _pairwise(jaro_winkler)


def normalized_jaro_winkler(a: Column, b: Column) -> Column:
    return jaro_winkler_similarity(normalize_for_comparison(a), normalize_for_comparison(b))


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", "", text.lower())).strip()


@F.pandas_udf(StructType([StructField("match", StringType()), StructField("score", DoubleType()), StructField("place", IntegerType())]))
def best_match(query: pd.Series, candidates: pd.Series) -> pd.DataFrame:
    """The first candidate of the greatest Jaro-Winkler similarity to the query; the first one where all are 0; nothing without candidates."""
    rows = []
    for q, options in zip(query, candidates, strict=True):
        options = [] if options is None else list(options)
        found = (options[0], 0.0, 0) if options and q is not None else (None, 0.0, -1)
        for i, c in enumerate(options if q is not None else []):
            score = jaro_winkler(_plain(q), _plain(c))
            if score > found[1]:
                found = (c, score, i)
        rows.append(found)
    return pd.DataFrame(rows, columns=["match", "score", "place"])

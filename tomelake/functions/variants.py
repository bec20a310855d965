"""Spelling variants of recognised tokens, and when two of them may stand for each other. Column expressions over lower-case tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import GENERIC_TOKENS, levenshtein_similarity

#: Similarity from which tokens match, and from which they match if an end of three characters is shared.
SIMILAR, RELAXED = 0.75, 0.68


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    least = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), least)), lambda i: (i <= least) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.size(same)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def signature(t: Column) -> Column:
    """One spelling for tokens that differ in characters often taken for each other."""
    return F.regexp_replace(F.translate(F.lower(t), "01iv", "olly"), "^g", "c")


def _changed(t: Column, options: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.array_compact(F.array(*options)), lambda v: v != t))


def character_variants(t: Column) -> Column:
    """0 and o, 1 and l or i, v and y."""
    digits = F.translate(t, "01", "ol")
    confused = t.rlike("[01]") & (F.length(digits) >= 4) & digits.rlike("[li]")
    long = F.length(t) >= 4
    return _changed(
        t,
        [
            digits,
            F.when(confused, F.translate(digits, "l", "i")),
            F.when(confused, F.translate(digits, "i", "l")),
            F.when(long, F.translate(t, "o", "0")),
            F.when(long, F.translate(t, "v", "y")),
            F.when(long, F.translate(t, "y", "v")),
        ],
    )


def swap_variants(t: Column) -> Column:
    """i and l anywhere; c and g in one of the first two places of longer tokens."""
    long, longer = F.length(t) >= 4, F.length(t) >= 5
    at = lambda i: F.concat(F.substring(t, 1, i), F.translate(F.substring(t, i + 1, 1), "cg", "gc"), F.substr(t, F.lit(i + 2)))
    return _changed(t, [F.when(long, F.translate(t, "i", "l")), F.when(long, F.translate(t, "l", "i")), F.when(longer, at(0)), F.when(longer, at(1))])


def repetition_variants(t: Column) -> Column:
    """Repeated letters as two, and as one."""
    return _changed(t, [F.regexp_replace(t, r"([a-z])\1{2,}", "$1$1"), F.regexp_replace(t, r"([a-z])\1+", "$1")])


def token_variants(t: Column) -> Column:
    """The token and all its variants."""
    t = F.lower(t)
    return F.array_distinct(F.concat(F.array(t), character_variants(t), swap_variants(t), repetition_variants(t)))


def _sorted(a: Column, b: Column) -> tuple[Column, Column]:
    shorter = F.length(a) <= F.length(b)
    return F.when(shorter, a).otherwise(b), F.when(shorter, b).otherwise(a)


def is_truncated_prefix(a: Column, b: Column, weak=tuple(GENERIC_TOKENS)) -> Column:
    """One lacks the other's last character, both are short, and the shorter is no weak word."""
    s, n = _sorted(a, b)
    return (F.length(n) - F.length(s) == 1) & (F.length(s) >= 2) & (F.length(n) <= 6) & n.startswith(s) & ~s.isin(*weak)


def is_leading_drop(a: Column, b: Column, weak=tuple(GENERIC_TOKENS)) -> Column:
    """One lacks the other's first character or two."""
    s, n = _sorted(a, b)
    lost = F.length(n) - F.length(s)
    return lost.between(1, 2) & (F.length(s) >= 2 + lost) & (F.length(n) <= 8) & n.endswith(s) & ~s.isin(*weak)


def is_confusion_equivalent(a: Column, b: Column, weak=tuple(GENERIC_TOKENS)) -> Column:
    """Equal signatures of tokens of four characters or more that share an end."""
    long = (F.length(a) >= 4) & (F.length(b) >= 4) & (F.abs(F.length(a) - F.length(b)) <= 1)
    return long & (signature(a) == signature(b)) & ~signature(a).isin(*weak) & ((common_prefix(a, b) >= 2) | (common_suffix(a, b) >= 2))


def passes_threshold(a: Column, b: Column) -> Column:
    """Whether two spellings may stand for each other."""
    s = levenshtein_similarity(a, b)
    ends = (F.least(F.length(a), F.length(b)) >= 6) & ((common_prefix(a, b) >= 3) | (common_suffix(a, b) >= 3))
    return (s >= SIMILAR) | is_truncated_prefix(a, b) | is_leading_drop(a, b) | is_confusion_equivalent(a, b) | ((s >= RELAXED) & ends)


def is_garbage(t: Column) -> Column:
    """Letters that are hardly a word: six consonants in a row in long tokens, or odd clusters with few vowels."""
    t = F.lower(t)
    vowels = F.length(F.regexp_replace(t, "[^aeiou]", ""))
    odd = t.rlike("uu|uw|gv|vn|nngv|rnr") & (F.length(t) - vowels >= 5) & (vowels <= 2)
    return t.rlike("^[a-z]{7,}$") & (((F.length(t) >= 9) & t.rlike("[bcdfghjklmnpqrstvwxyz]{6}")) | odd)


def is_low_signal(t: Column, weak=tuple(GENERIC_TOKENS)) -> Column:
    t = F.lower(t)
    return (F.length(t) <= 2) | t.isin(*weak) | is_garbage(t) | t.rlike(r"^\$?[0-9]+(?:\.[0-9]+)?$") | t.rlike(r"^[0-9-]{4,}$")


def is_substantive(t: Column, weak=tuple(GENERIC_TOKENS)) -> Column:
    return (F.length(t) >= 4) & ~F.lower(t).isin(*weak) & ~is_garbage(t)


def low_signal_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, is_low_signal)) / F.size(tokens)).otherwise(0.0)

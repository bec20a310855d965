"""What a line of recognised text is: price, fragment, imprint, badge, person, title. Column expressions over a line, or over the array of a document's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Words that begin titles, words common in titles, marks of organisations, and imprints.
TITLE_STARTS = "THE A AN OF IN ON TO FOR INTO UNDER OVER THROUGH BETWEEN BEYOND BENEATH AGAINST".split()
TITLE_WORDS = (
    "DARK NIGHT DAY DEATH LIFE BLOOD FIRE ICE STORM SHADOW SECRET LAST FIRST FINAL DEAD LOST FALLEN BROKEN SILENT HIDDEN "
    "BURIED FORGOTTEN GUARDIAN GUARDIANS FINGERPRINT PELICAN BRIEF GAME GIRL BOY MAN WOMAN WIFE HUSBAND GONE POISON PEN SHINING"
).split()
ORG_MARKERS = (
    "PRESS PUBLISHING PUBLISHERS INC LTD LLC CO CORP CORPORATION COMPANY TIMES JOURNAL TODAY NEWS MEDIA GROUP FOUNDATION "
    "INSTITUTE UNIVERSITY COLLEGE ENTERTAINMENT PRODUCTIONS STUDIOS BOOKS"
).split()
IMPRINTS = [
    *"ZEBRA BANTAM DELL PENGUIN POCKET AVON ACE TOR FORGE ORBIT DAW BAEN BALLANTINE FAWCETT MORROW ANCHOR VINTAGE KNOPF".split(),
    *"DOUBLEDAY BERKLEY PUTNAM ATRIA GALLERY HARLEQUIN SILHOUETTE MIRA PINNACLE KENSINGTON SOURCEBOOKS".split(),
    "LOVE INSPIRED",
]
# Names and qualifiers of badges, as they read once normalised.
BADGE_ENTITIES = [
    "NEW YORK TIMES", "YORK TIMES", "NY TIMES", "NYT", "USA TODAY", "WALL STREET JOURNAL", "WSJ", "WASHINGTON POST", "LOS ANGELES TIMES",
    "LA TIMES", "BOSTON GLOBE", "CHICAGO TRIBUNE", "PUBLISHERS WEEKLY", "PW", "NATIONAL", "INTERNATIONAL", "WORLDWIDE",
]
BADGE_QUALIFIERS = ["BESTSELLER", "BESTSELLING", "BEST SELLER", "BEST SELLING", "1", "NO 1", "NUMBER ONE", "NUMBER 1", "AUTHOR", "WRITER"]
SURE_ENTITIES = ["NEW YORK TIMES", "YORK TIMES", "USA TODAY", "WALL STREET JOURNAL"]
STANDALONE = ["BESTSELLER", "BESTSELLING"]
PRICES = [
    r"^[$£€¥]\s*[0-9]",
    r"[0-9][$£€¥]",
    r"^(?i:us|uk|can|cdn|eur|gbp|usd)\s*[$£€¥]?\s*[0-9]",
    r"^(?i:u\.?s\.?)\s*[$£€¥]\s*[0-9]",
    r"^[0-9]+\.[0-9]{2}$",
    r"[$£€¥][0-9]+(?:\.[0-9]{2})?\s*$",
]


_PRICE = "|".join(f"(?:{p})" for p in PRICES)


def is_price_like(c: Column) -> Column:
    return T.strip(c).rlike(_PRICE)


def is_fragment_of(c: Column, t: Column, alpha: Column) -> Column:
    """c: a line without blanks at its ends, t: its tokens, alpha: its share of letters."""
    only = F.length(F.coalesce(F.get(t, F.lit(0)), F.lit("")))
    one = F.size(t) == 1
    return (F.length(c) <= 2) | (one & (only <= 2)) | ((alpha < 0.5) & (F.length(c) < 8)) | (one & (only <= 4) & (alpha < 0.8))


def is_fragment(c: Column) -> Column:
    c = T.strip(c)
    return is_fragment_of(c, T.match_tokens(c), T.alpha_ratio(c))


def org_count(c: Column) -> Column:
    return F.size(F.filter(T.match_tokens(c), lambda t: t.isin(*ORG_MARKERS)))


def is_org_like(c: Column) -> Column:
    return org_count(c) > 0


def org_penalty(c: Column) -> Column:
    return org_penalty_of(org_count(c), F.size(T.match_tokens(c)))


def org_penalty_of(n: Column, size: Column) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, F.when(size >= 3, 0.3).otherwise(0.5)).otherwise(F.least(F.lit(1.0), n * 0.4))


def is_exact_imprint(c: Column) -> Column:
    return T.normalize_for_match(c).isin(*IMPRINTS)


def contains_imprint(c: Column) -> Column:
    return F.exists(T.match_tokens(c), lambda t: t.isin(*IMPRINTS))


def is_person_like(c: Column) -> Column:
    """Two to four capitalised words of letters that are no organisation, no price and not mostly title words."""
    c = T.strip(c)
    return is_person_like_of(c, T.match_tokens(c), T.alpha_ratio(c), org_count(c))


def is_person_like_of(c: Column, t: Column, alpha: Column, orgs: Column) -> Column:
    """c: a line without blanks at its ends, t: its tokens, alpha: its share of letters, orgs: its marks of organisations."""
    w = F.split(c, r"\s+")
    first = lambda x: F.substring(x, 1, 1)
    title_case = F.forall(w, lambda x: (F.length(x) <= 1) | (first(x) == F.upper(first(x))))
    caps = F.forall(w, lambda x: (F.length(x) <= 2) | (x == F.upper(x)))
    common = F.size(F.filter(t, lambda x: x.isin(*TITLE_WORDS)))
    start = F.coalesce(F.get(t, F.lit(0)), F.lit("")).isin(*TITLE_STARTS)
    shape = F.size(t).between(2, 4) & (alpha >= 0.85) & F.forall(t, lambda x: F.length(x) >= 2) & (title_case | caps)
    return shape & (orgs == 0) & ~is_price_like(c) & ~start & (common < F.size(t) / 2)


def is_title_like(c: Column) -> Column:
    c = T.strip(c)
    return ~is_price_like(c) & ~is_fragment(c) & ~is_exact_imprint(c) & (T.alpha_ratio(c) >= 0.6) & (F.size(T.match_tokens(c)) > 0)


def _has(norm: Column, phrases: list[str]) -> Column:
    out = F.contains(norm, F.lit(phrases[0]))
    for p in phrases[1:]:
        out = out | F.contains(norm, F.lit(p))
    return out


def is_badge_entity(norm: Column) -> Column:
    return _has(norm, BADGE_ENTITIES)


def is_badge_qualifier(norm: Column) -> Column:
    return _has(norm, BADGE_QUALIFIERS)


def _almost_bestseller(norm: Column) -> Column:
    close = lambda t: F.least(*[F.levenshtein(t, F.lit(b)) for b in STANDALONE]) <= 1
    # One edit leaves a half of the word as it is.
    return norm.rlike("BESTS|ELLER|LLING") & F.exists(F.split(norm, " "), lambda t: F.length(t).between(6, 12) & close(t))


def badge_marks(norm: Column) -> Column:
    """struct of what a normalised line says of itself and its neighbours: entity, qualifier, almost, alone, sure."""
    return F.struct(
        is_badge_entity(norm).alias("entity"),
        is_badge_qualifier(norm).alias("qualifier"),
        _almost_bestseller(norm).alias("almost"),
        # Words, not parts of them: a line with such a word holds its letters.
        (F.contains(norm, F.lit("BESTSELL")) & F.exists(F.split(norm, " "), lambda t: t.isin(*STANDALONE))).alias("alone"),
        _has(norm, SURE_ENTITIES).alias("sure"),
    )


def badge(norm: Column, before: Column, after: Column) -> Column:
    """struct(confidence, reason) of a normalised line and its neighbours (null at the ends); confidence 0 where it is no badge."""
    return badge_of(badge_marks(norm), badge_marks(before), badge_marks(after))


def badge_of(own: Column, before: Column, after: Column) -> Column:
    """`badge` of the marks of a line and of its neighbours."""
    entity, qualifier = own["entity"], own["qualifier"]

    def related(x: Column) -> Column:
        return F.coalesce((entity & x["qualifier"]) | (qualifier & x["entity"]) | ((entity | qualifier) & x["almost"]), F.lit(False))

    def out(confidence, reason):
        return F.struct(F.lit(confidence).alias("confidence"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))

    return (
        F.when(own["alone"], out(0.95, "standalone_badge"))
        .when(entity & qualifier, out(0.98, "entity_and_qualifier_same_line"))
        .when(related(before) | related(after), out(0.9, F.when(entity, "entity_with_adjacent_qualifier").otherwise("qualifier_with_adjacent_entity")))
        .when(own["sure"], out(0.85, "probable_badge_entity"))
        .otherwise(out(0.0, "not_badge"))
    )


def exclusion_reason(line: Column, badge_confidence: Column) -> Column:
    """The first ground on which a line is left out, else null."""
    return exclusion_of(is_price_like(line), is_fragment(line), is_exact_imprint(line), badge_confidence)


def exclusion_of(price: Column, fragment: Column, imprint: Column, badge_confidence: Column) -> Column:
    return F.when(price, "price_like").when(fragment, "fragment").when(imprint, "exact_imprint").when(badge_confidence >= 0.85, "badge")


def person_likeness(line: Column) -> Column:
    return person_likeness_of(is_person_like(line), org_penalty(line))


def person_likeness_of(person: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), F.when(person, 0.8).otherwise(0.2) - penalty)


def title_likeness(line: Column) -> Column:
    return title_likeness_of(is_title_like(line))


def title_likeness_of(title: Column) -> Column:
    return F.when(title, 0.8).otherwise(0.3)

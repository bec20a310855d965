"""Tokens of noisy titles mended, and the variants of a title or author that are worth a query. Column expressions; titles are normalised, words parted by blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import evidence_lines as E
from . import text as T
from . import variants as V

# Words that join titles, debris of recognition, words of little worth, joiners that get fused, and phrases with their corrections.
CONNECTORS = ["the", "a", "an", "of", "and", "ve", "ile", "in", "to", "for", "with", "on", "at", "from", "into"]
NOISE = [
    "jove", "berkley", "novel", "fiction", "authors", "author", "writer", "national", "bestsell", "bestseler", "bestsellek", "bestsellin", "besiselling", "bestrellins",
    "bestsellerer", "oll", "pcto", "ati", "att", "eiv", "ana", "eg", "sas", "can", "wi", "un", "ne", "al", "eu", "bh", "rcuior", "rctior", "ties", "mettikes", "iavers", "noblems",
    "prin", "crinis", "mystery", "times", "newyork", "newyorktimes", "noisea", "noisia", "bestseller", "bestselling", "bestsellingauthor", "paperback", "hardcover", "tor", "mass",
    "market", "sili", "siall", "histi", "shous", "isouttesoiai", "isouttesoiat", "leetea", "listemas", "nosta", "nhop", "ilsde", "novei", "stak", "s7ll", "rom", "moll", "ele", "ll",
    "nill", "asth", "frinie", "ets", "ts", "du", "testeerats", "staaboutes", "nofer", "nfer", "noer", "nofr", "ishoe", "edited", "editor", "editors", "afoen", "ayoen", "folol",
    "wiaro", "nvho", "cenuurnr", "achusioe", "tuindo", "duneblnngvn", "cauwn", "uintha", "celatena", "erall", "drr", "cidinia", "idur", "ilad", "lkesi", "othin", "aoia",
    "darinllad", "lkfsi", "ctha", "kkm", "km", "kn", "alttt", "onvulys", "oi3nz", "nyj3ls", "mitinta", "siiaoown", "tiuite",
]
BADGES = [
    r"^(?:newyorktimes?|newyork|times|national|bestsell(?:er|ing|in)?|bestseler|bestsellek|bestsellerer|besiselling|bestrellins)+$",
    r"^(?:jove|berkley|mystery|fiction|novel|paperback|hardcover|mass|market)+$",
]
LOW_SIGNAL = ["he", "she", "him", "her", "his", "hers", "they", "them", "their", "are", "was", "were", "been", "being", "since", "who", "ve", "ile"]
JOINERS = ["into", "and", "with", "from", "the", "for", "your", "god", "of"]
NOT_FUSED = ["hoagland", "anderson", "andersen"]
PHRASES = [
    ("achristina dodd", "christina dodd"), ("buckley neris", "buckley nerds"), ("line of aire", "line of fire"), ("line of aire hoagland", "line of fire hoagland"),
    ("the hear of justice", "the heart of justice"), ("fatale visi", "fatal vision"), ("ort fatale visi", "fatal vision"), ("blindsight numn choke", "blindsight"),
    ("death by desi", "death by design"), ("pincent ranville", "vincent granville"), ("let as robert parker", "robert b parker"), ("testeerats robert parker", "robert b parker"),
    ("ty nhoc ilsoe victory", "city of victory"), ("nhoc ilsoe victory", "city of victory"), ("he emphess ilc tohd cho tuhl chi", "the empress file john d macdonald"),
    ("he emphess ilc tohd tuhl chi", "the empress file john d macdonald"), ("ghost d", "ghost and"), ("catherini ion", "catherine"), ("catherint ion", "catherine"),
    ("deadly game catherine ion", "deadly game catherine"), ("han kellerman", "jonathan kellerman"), ("acuua alia", "a is for alibi"), ("patricia di cornwell", "patricia cornwell"),
    ("the ca saw", "the cat who saw"), ("line of fine", "line of fire"), ("line of fire hodgalan", "line of fire hoagland"), ("line of fi", "line of fire"),
    ("charlaine justice william coughlin", "justice william coughlin"), ("night tai might scents", "night scents"), ("night might scents", "night scents"), ("worlds fire", ""),
    ("city veils", "city of veils"), ("fatale vision", "fatal vision"), ("blind sicht", "blind sight"), ("the fetten", "the fallen"), ("blow back", "blowback"), ("is for for", "is for"),
    ("une de aire", ""), ("the unconquered fire ace", "face the fire"), ("unconquered fi", "unconquered fire"), ("fi ace", "face"), ("stone mon", "stone monkey"),
    ("along cane", "along came"), ("for gotten", "forgotten"), ("edited by", ""), ("jennifer ester", "jennifer estep"), ("boat ofa", "boat of a"),
]
_TURKISH = ("ıİşŞğĞüÜöÖçÇ", "iIsSgGuUoOcC")


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def _join(t: Column) -> Column:
    return F.array_join(t, " ")


def _last(t: Column) -> Column:
    return F.get(t, F.size(t) - 1)


def _front(t: Column, n) -> Column:
    return F.slice(t, 1, F.greatest(F.lit(0), F.size(t) - n))


def is_year(c: Column) -> Column:
    return c.rlike("^(1[5-9][0-9]{2}|20[0-9]{2})$")


def is_numeric_noise(raw: Column, token: Column) -> Column:
    """Prices, numbers that are no years, and tokens that are mostly digits."""
    digits, letters = F.regexp_count(token, F.lit("[0-9]")), F.regexp_count(token, F.lit("[a-z]"))
    return (
        (token == "")
        | raw.rlike(r"^\$?[0-9]+\.[0-9]{2}$")
        | token.rlike("^[0-9]{1,3}$")
        | (token.rlike("^[0-9]{4}$") & ~is_year(token))
        | ((digits >= 2) & (letters <= 1))
        | ((digits > letters) & (F.length(token) <= 5))
        | token.rlike("^[0-9-]{5,}$")
        | token.rlike("^[0-9]{1,4}-[0-9][0-9-]*$")
    )


def is_badge_noise(token: Column) -> Column:
    return token.isin(*NOISE) | V.is_garbage(token) | ((F.length(token) >= 6) & (token.rlike(BADGES[0]) | token.rlike(BADGES[1])))


def fold_token(c: Column) -> Column:
    return E.fold(F.translate(c, *_TURKISH))


def canonical_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold_token(c)), "[^a-z0-9]", "")


def split_case(c: Column) -> Column:
    """A token of six characters or more, parted where a capital follows a small letter."""
    return F.when(F.length(c) < 6, F.array(c)).otherwise(F.split(F.regexp_replace(c, "([a-zçğıöşü])(?=[A-ZÇĞİÖŞÜ])", "$1\u0001"), "\u0001"))


def letter_swaps(token: Column) -> Column:
    """i for l and l for i throughout; c for g and g for c at the first two places."""
    rest = lambda n: F.substr(token, F.lit(n))
    swapped = lambda ch: F.translate(ch, "cg", "gc")
    first, second = F.substr(token, F.lit(1), F.lit(1)), F.substr(token, F.lit(2), F.lit(1))
    il = F.when((F.length(token) >= 4) & token.rlike("[il]"), F.array(F.replace(token, F.lit("i"), F.lit("l")), F.replace(token, F.lit("l"), F.lit("i"))))
    cg = F.when(F.length(token) >= 5, F.array(F.concat(swapped(first), rest(2)), F.concat(first, swapped(second), rest(3))))
    none = F.array().cast("array<string>")
    return F.filter(F.array_distinct(F.concat(F.coalesce(il, none), F.coalesce(cg, none))), lambda t: t != token)


def mended_ending(token: Column) -> Column:
    """A final i that stands for t."""
    return F.when(token.rlike("(?:straigh|righ|lef|figh|weigh|heigh)i$"), F.concat(F.substr(token, F.lit(1), F.length(token) - 1), F.lit("t"))).otherwise(token)


def split_fused(c: Column) -> Column:
    """A token with a joiner fused to its end, its beginning or into its middle, in parts; the first joiner that fits decides."""
    c = F.lower(c)
    n = F.length(c)
    mend = lambda b: F.when(F.endswith(b, F.lit("i")) & (F.length(b) >= 6), F.concat(F.substr(b, F.lit(1), F.length(b) - 1), F.lit("t"))).otherwise(b)
    out = F.when(c.isin(*NOT_FUSED), F.array(c))
    for j in JOINERS:
        k, size = F.lit(j), len(j)
        long, ends, begins = n > size + 3, F.endswith(c, F.lit(j)), F.startswith(c, F.lit(j))
        base, rest, at = F.substr(c, F.lit(1), n - size), F.substr(c, F.lit(size + 1)), F.locate(j, c)
        left, right = F.substr(c, F.lit(1), at - 1), F.substr(c, at + size)
        out = out.when(long & ends & (F.length(base) >= 4), F.array(mend(base), k))
        out = out.when(long & ~ends & begins & (F.length(rest) >= 4), F.array(k, rest))
        out = out.when(long & ~ends & (at > 4) & (F.length(right) >= 3), F.array(mend(left), k, right))
    return out.otherwise(F.array(c))


def correct_phrases(tokens: Column, rules: list[tuple[str, str]] = PHRASES) -> Column:
    """Tokens with known wrong phrases put right; at each place the first rule that fits."""
    all_ = F.array(*[F.struct(F.array(*[F.lit(w) for w in a.split()]).alias("a"), F.array(*[F.lit(w) for w in b.split()]).cast("array<string>").alias("b")) for a, b in rules])
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        fits = F.get(F.filter(all_, lambda r: F.slice(tokens, i + 1, F.size(r["a"])) == r["a"]), F.lit(0))
        found = F.when(fits.isNotNull(), F.struct((i + F.size(fits["a"])).alias("next"), F.concat(acc["out"], fits["b"]).alias("out")))
        plain = F.struct((i + 1).alias("next"), F.array_append(acc["out"], F.get(tokens, i)).alias("out"))
        return F.when(i < acc["next"], acc).otherwise(F.coalesce(found, plain))

    return F.when(F.size(tokens) == 0, tokens).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(tokens) - 1), start, step, lambda acc: acc["out"]))


def drop_low_signal(tokens: Column) -> Column:
    """Tokens without pronouns and the like, if two of substance and two at all stay."""
    solid = F.size(F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*CONNECTORS) & ~t.isin(*NOISE) & ~t.isin(*LOW_SIGNAL)))
    kept = F.filter(tokens, lambda t: ~t.isin(*LOW_SIGNAL))
    return F.when((F.size(tokens) <= 2) | (solid < 2) | (F.size(kept) < 2), tokens).otherwise(kept)


def surname(author: Column) -> Column:
    t = _words(author)
    return F.when((F.size(t) >= 2) & (F.length(_last(t)) >= 3), _last(t))


def title_tail(line: Column) -> Column:
    """The last word of weight of a title line; a name at its end is set aside."""
    w = F.split(T.strip(line), r"\s+")
    named = (F.size(w) >= 4) & E.looks_like_person(_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - 1), 2)))
    own = F.when(named, _join(_front(w, 2))).otherwise(line)
    return _last(F.filter(E.scoring_tokens(own), lambda t: (F.length(t) >= 4) & ~t.isin(*CONNECTORS)))


def without_author(title: Column, author: Column) -> Column:
    """The title without the author at its end: the whole name, else the surname, with a given name before a lone surname."""
    t, a = _words(title), _words(author)
    whole = (F.size(a) >= 2) & (F.size(t) > F.size(a)) & (F.slice(t, F.greatest(F.lit(1), F.size(t) - F.size(a) + 1), F.greatest(F.lit(1), F.size(a))) == a)
    tail = (F.size(t) >= 3) & (_last(t) == _last(a))
    given = F.get(t, F.size(t) - 2)
    named = (F.size(a) == 1) & (F.size(t) >= 4) & F.length(given).between(3, 8) & ~given.isin(*CONNECTORS) & ~given.isin(*NOISE)
    out = F.when(whole, _join(_front(t, F.size(a)))).when(tail & named, _join(_front(t, 2))).when(tail, _join(_front(t, 1))).otherwise(title)
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit(None)).when((F.coalesce(author, F.lit("")) == "") | (F.size(t) == 0) | (F.size(a) == 0), title).otherwise(out)


def series_core(title: Column) -> Column:
    """`x is for word` of a longer title of a series."""
    t = _words(title)
    word = F.get(t, F.lit(3))
    fits = (F.size(t) >= 4) & F.get(t, F.lit(0)).rlike("^[a-z]$") & (F.get(t, F.lit(1)) == "is") & (F.get(t, F.lit(2)) == "for") & (F.length(word) >= 3) & ~word.isin(*CONNECTORS) & ~word.isin(*NOISE)
    return F.when(fits, _join(F.slice(t, 1, 4)))


def without_repeated_tail(title: Column, times: Column) -> Column:
    """The title without its last word, where the evidence has that word several times (times: how often) and the rest has a title's structure."""
    t = _words(title)
    fits = (F.size(t) >= 4) & (F.length(_last(t)) >= 5) & ~_last(t).isin(*CONNECTORS) & F.exists(_front(t, 1), lambda x: x.isin(*CONNECTORS)) & (F.coalesce(times, F.lit(0)) >= 2)
    return F.when(fits, _join(_front(t, 1)))


def without_author_tail(title: Column) -> Column:
    t = _words(title)
    solid = F.size(F.filter(_front(t, 1), lambda x: (F.length(x) >= 3) & ~x.isin(*CONNECTORS) & ~x.isin(*NOISE)))
    fits = (F.size(t) >= 4) & (F.length(_last(t)) >= 5) & ~_last(t).isin(*CONNECTORS) & ~_last(t).isin(*NOISE) & F.exists(_front(t, 1), lambda x: x.isin(*CONNECTORS)) & (solid >= 2)
    return F.when(fits, _join(_front(t, 1)))


def leading_swapped(title: Column) -> Column:
    t = _words(title)
    a, b = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    fits = (F.length(a) >= 3) & (F.length(b) >= 3) & (a != b) & ~a.isin(*CONNECTORS) & ~b.isin(*CONNECTORS)
    return F.when(fits, _join(F.concat(F.array(b, a), F.slice(t, 3, F.greatest(F.size(t), F.lit(1))))))


def without_connectors(title: Column) -> Column:
    t = _words(title)
    less = F.filter(t, lambda x: ~x.isin(*CONNECTORS))
    return F.when((F.size(t) >= 3) & (F.size(less) >= 2) & (F.size(less) < F.size(t)), _join(less))


def reordered_of(title: Column) -> Column:
    """`x of y` as `y x`."""
    t = _words(title)
    head = F.get(t, F.lit(0))
    worth = lambda x: (F.length(x) >= 3) & ~x.isin(*CONNECTORS) & ~x.isin(*NOISE)
    tail = F.filter(F.slice(t, 3, F.greatest(F.size(t), F.lit(1))), worth)
    return F.when((F.size(t) >= 3) & (F.get(t, F.lit(1)) == "of") & (head != "of") & worth(head) & (F.size(tail) > 0), _join(F.array_append(tail, head)))


def query_key(c: Column) -> Column:
    return T.collapse(F.lower(T.strip(c)))


def changed(before: Column, after: Column) -> Column:
    return query_key(F.coalesce(before, F.lit(""))) != query_key(F.coalesce(after, F.lit("")))


def simple_queries(title: Column, author: Column) -> Column:
    """Array of struct(query, type, priority) of a title and an author, of which either may lack."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    row = lambda q, kind, p: F.struct(q.alias("query"), F.lit(kind).alias("type"), F.lit(p).alias("priority"))
    bare = E.strip_leading_article(title)
    both = F.array(row(F.concat_ws(" ", title, author), "title_author", 10), row(F.concat_ws(" ", author, title), "author_title", 11))
    more = F.when(bare != title, F.array_append(both, row(F.concat_ws(" ", bare, author), "stripped", 15))).otherwise(both)
    return F.when(has(title) & has(author), more).when(has(title), F.array(row(title, "title_only", 20))).when(has(author), F.array(row(author, "author_only", 25))).otherwise(F.slice(both, 1, 0))


def boundary_queries(lines: Column) -> Column:
    """Queries over the edge of two lines where a short scrap meets a short beginning: both lines, and with the two scraps as one word. Distinct, in order."""
    at = F.transform(lines, lambda x: T.strip(F.coalesce(x, F.lit(""))))
    bare = lambda w: F.lower(F.regexp_replace(w, "[^a-zA-Z0-9]", ""))
    pairs = F.filter(F.transform(at, lambda x, i: F.struct(x.alias("l"), F.get(at, i + 1).alias("r"))), lambda p: (p["l"] != "") & (p["r"] != ""))
    split = F.transform(pairs, lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), _words(p["l"]).alias("a"), _words(p["r"]).alias("b")))
    ends = F.transform(split, lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), p["a"].alias("a"), p["b"].alias("b"), bare(_last(p["a"])).alias("x"), bare(F.get(p["b"], F.lit(0))).alias("y")))
    meet = F.filter(ends, lambda p: p["x"].rlike("^[a-z]{1,3}$") & p["y"].rlike("^[a-z]{2,5}$"))

    def build(p: Column) -> Column:
        whole = F.concat_ws(" ", p["l"], p["r"])
        merged = F.concat(_front(p["a"], 1), F.array(F.concat(p["x"], p["y"])), F.slice(p["b"], 2, F.greatest(F.size(p["b"]), F.lit(1))))
        return F.when(F.size(merged) >= 2, F.array(whole, _join(merged))).otherwise(F.array(whole))

    every = F.flatten(F.transform(meet, build))
    keys = F.transform(every, query_key)
    return F.filter(every, lambda q, i: F.array_position(keys, query_key(q)) == i + 1)

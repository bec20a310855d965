"""Records of one work: equal and derived books, the second best that is another work, the best spelled record; and lines of rotated recognition laid together. Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import evidence_lines as E
from . import line_filter as LF
from . import spine as P
from . import text as T

# Words of books about books; rotations that are merged, the least quality and content of one, and how alike two lines of one text are.
DERIVED = r"(?i)(?<![A-Za-z0-9_])(summary|summaries|study guide|notes|analysis|workbook|companion|trivia|resumen|critical|interpretations|cliffs|sparknotes)(?![A-Za-z0-9_])"
MOST_ROTATIONS, LEAST_QUALITY, LEAST_CONTENT, SAME_LINE = 2, 0.2, 0.4, 0.85


def plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(E.fold(c)), "[^a-z0-9]", "")


def _key(c: Column) -> Column:
    """A title without what stands in brackets."""
    return plain(F.regexp_replace(c, r"\s*[\[(][^\])]*[\])]\s*", " "))


def work(title: Column, authors: Column) -> Column:
    """struct(key, plain, raw, names): what books are compared by."""
    last = lambda a: F.element_at(F.split(T.strip(a), r"\s+"), -1)
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), lambda a: _key(last(a))), lambda n: F.length(n) >= 3)
    title = F.coalesce(title, F.lit(""))
    return F.struct(_key(title).alias("key"), plain(title).alias("plain"), title.alias("raw"), names.alias("names"))


def same_work(a: Column, b: Column) -> Column:
    """Two works (structs) are one: equal titles, or long titles two edits apart with the same digits and an author's surname in common."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    close = (F.least(F.length(a["key"]), F.length(b["key"])) >= 10) & (digits(a["key"]) == digits(b["key"])) & (F.levenshtein(a["key"], b["key"]) <= 2)
    return (a["key"] != "") & (b["key"] != "") & ((a["key"] == b["key"]) | (F.arrays_overlap(a["names"], b["names"]) & close))


def is_derived(book: Column, of: Column) -> Column:
    """A book about another one: its title holds the other's, and the other's author or a word of such books."""
    holds = (F.length(of["plain"]) >= 8) & (book["plain"] != of["plain"]) & F.contains(book["plain"], of["plain"])
    return holds & (F.exists(of["names"], lambda n: F.contains(book["plain"], n)) | book["raw"].rlike(DERIVED))


def distinct_second(works: Column) -> Column:
    """Place of the first of ranked works that is neither the first one's work nor derived from it, else null."""
    start = F.struct(F.slice(works, 1, 1).alias("one"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, i: Column) -> Column:
        own = F.get(works, i)
        same = F.exists(acc["one"], lambda m: same_work(m, own))
        derived = F.exists(acc["one"], lambda m: is_derived(own, m))
        return F.when(acc["found"].isNotNull(), acc).when(same, F.struct(F.array_append(acc["one"], own).alias("one"), acc["found"].alias("found"))).when(derived, acc).otherwise(F.struct(acc["one"].alias("one"), i.alias("found")))

    return F.when(F.size(works) < 2, F.lit(None).cast("int")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(works) - 1)), start, step, lambda acc: acc["found"]))


def best_spelled(works: Column) -> Column:
    """Place of the record of the first one's work whose title most of the titles hold; of equal ones the first."""
    start = F.array(F.lit(0))
    step = lambda acc, i: F.when(F.exists(acc, lambda m: same_work(F.get(works, m), F.get(works, i))), F.array_append(acc, i)).otherwise(acc)
    one = F.when(F.size(works) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(works) - 1)), start, step))
    support = F.transform(one, lambda m: F.struct((-F.size(F.filter(works, lambda w: F.contains(w["plain"], F.get(works, m)["plain"])))).alias("s"), m.alias("m")))
    return F.array_min(support)["m"]


def prefix_similarity(a: Column, b: Column) -> Column:
    """Share of the longer line that the common beginning makes; 0 where one is twice as long."""
    x, y = T.normalize_for_comparison(a), T.normalize_for_comparison(b)

    def share(v: Column) -> Column:
        p, r = v["x"], v["y"]
        longest, shortest = F.greatest(F.length(p), F.length(r)), F.least(F.length(p), F.length(r))
        common = F.size(F.filter(F.when(shortest > 0, F.sequence(F.lit(1), shortest)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(p, F.lit(1), i) == F.substr(r, F.lit(1), i)))
        return F.when(p == r, 1.0).when((longest - shortest) / longest > 0.5, 0.0).otherwise(common / longest)

    scored = F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), share), F.lit(0))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(scored)


def dedupe_lines(lines: Column) -> Column:
    """lines: array of struct(text, confidence, ...). Each line joins the first kept one that it is like, and takes its place if it is surer."""

    def step(kept: Column, line: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: prefix_similarity(line["text"], k["text"]) >= SAME_LINE), F.lit(True))
        return F.when(at == 0, F.array_append(kept, line)).otherwise(F.transform(kept, lambda k, i: F.when((i + 1 == at) & (line["confidence"] > k["confidence"]), line).otherwise(k)))

    return F.aggregate(lines, F.slice(lines, 1, 0), step)


def rotation_evidence(lines: Column) -> Column:
    """struct(lines, title, author, useful) of one rotation's lines (text, confidence): the best scores of lines that may be title or author."""
    own = F.transform(F.filter(lines, lambda x: F.length(T.strip(x["text"])) >= 2), lambda x: F.struct(T.strip(x["text"]).alias("text"), x["confidence"].alias("confidence")))
    scores = F.transform(F.filter(own, lambda x: LF.other_reason(x["text"]).isNull()), lambda x: P.line_score(x["text"]))
    best = lambda n: F.coalesce(F.array_max(F.transform(scores, lambda s: s[n])), F.lit(0.0))
    title, author = best("title_score"), best("author_score")
    return F.struct(own.alias("lines"), title.alias("title"), author.alias("author"), ((title > LEAST_CONTENT) | (author > LEAST_CONTENT)).alias("useful"))


def merged_rotations(trials: Column, chosen: Column, lines: Column) -> Column:
    """struct(lines, title_rotation, author_rotation, mixed, strategy). trials: array of struct(rotation, quality, e: rotation_evidence); chosen and lines: the rotation that recognition chose, and its lines.

    The best two rotations of some worth are merged, the surest lines first; without any the chosen one's lines stand in.
    """
    placed = F.transform(trials, lambda t, i: F.struct((-t["quality"]).alias("q"), i.alias("i"), t.alias("t")))
    ordered = F.transform(F.array_sort(placed, lambda a, b: F.when(a["q"] < b["q"], -1).when(a["q"] > b["q"], 1).otherwise(a["i"] - b["i"])), lambda x: x["t"])
    first = lambda n: F.coalesce(F.get(F.filter(ordered, lambda t: t["e"][n] > 0.5), F.lit(0))["rotation"], chosen)
    used = F.slice(F.filter(ordered, lambda t: (t["quality"] >= LEAST_QUALITY) & t["e"]["useful"]), 1, MOST_ROTATIONS)
    merged = dedupe_lines(F.flatten(F.transform(used, lambda t: t["e"]["lines"])))
    mixed = F.size(F.array_distinct(F.transform(used, lambda t: t["rotation"]))) > 1
    own = rotation_evidence(lines)["lines"]
    out = F.when(F.size(used) == 0, own).otherwise(_surest(merged))
    strategy = F.when(mixed, "mixed_rotation").when(F.size(used) == 0, "fallback_chosen").otherwise("single_rotation")
    return F.struct(out.alias("lines"), first("title").alias("title_rotation"), first("author").alias("author_rotation"), mixed.alias("mixed"), strategy.alias("strategy"))


def _surest(lines: Column) -> Column:
    placed = F.transform(lines, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(a["i"] - b["i"])), lambda p: p["x"])


def merged_crops(crops: Column) -> Column:
    """Lines of several crops (arrays of lines), alike ones once, the surest first."""
    return _surest(dedupe_lines(F.flatten(crops)))

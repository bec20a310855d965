"""How much a line is like a person or a title, which role that gives it, and titles joined from neighbouring lines. Column expressions; bonuses and penalties are summed in order, as decisions compare the sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lines as L
from . import text as T

# Words that begin or hold titles together, words common in titles, and names.
TITLE_INDICATORS = [
    "THE", "A", "AN", "OF", "IN", "ON", "TO", "FOR", "AND", "OR", "WITH", "INTO", "UNDER", "OVER", "THROUGH", "BETWEEN", "BEYOND", "BENEATH", "AGAINST", "ACROSS", "ALONG",
    "AMONG", "AROUND", "BEFORE", "BEHIND", "BELOW", "BESIDE", "DURING", "AFTER",
]
TITLE_CONTENT = [
    "DARK", "NIGHT", "DAY", "DEATH", "LIFE", "BLOOD", "FIRE", "ICE", "STORM", "SHADOW", "SECRET", "LAST", "FIRST", "FINAL", "DEAD", "LOST", "FALLEN", "BROKEN", "SILENT", "HIDDEN",
    "BURIED", "FORGOTTEN", "GUARDIAN", "GUARDIANS", "FINGERPRINT", "PELICAN", "BRIEF", "GAME", "GIRL", "BOY", "MAN", "WOMAN", "WIFE", "HUSBAND", "GONE", "POISON", "PEN",
    "SHINING", "RISING", "FALLING", "HOUSE", "CASTLE", "KINGDOM", "CITY", "WORLD", "LAND", "BOOK", "STORY", "TALE", "LEGEND", "MYSTERY", "THRILLER",
]
FIRST_NAMES = [
    "JOHN", "JAMES", "DAVID", "MICHAEL", "WILLIAM", "RICHARD", "ROBERT", "THOMAS", "CHARLES", "CHRISTOPHER", "DANIEL", "MATTHEW", "ANTHONY", "MARK", "DONALD", "STEVEN", "PAUL",
    "ANDREW", "JOSHUA", "KENNETH", "MARY", "PATRICIA", "JENNIFER", "LINDA", "ELIZABETH", "BARBARA", "SUSAN", "JESSICA", "SARAH", "KAREN", "NANCY", "LISA", "BETTY", "MARGARET",
    "SANDRA", "ASHLEY", "KIMBERLY", "EMILY", "DONNA", "STEPHEN", "GEORGE", "EDWARD", "BRIAN", "RONALD", "TIMOTHY", "PETER", "NORA", "AGATHA", "NGAIO", "DOROTHY", "ANNE", "ANN",
]
LAST_NAMES = [
    "KING", "GRISHAM", "PATTERSON", "ROBERTS", "STEEL", "SPARKS", "CHILD", "CHILDS", "BROWN", "CLARK", "CORNWELL", "CLANCY", "KOONTZ", "CRICHTON", "FLYNN", "HAWKINS", "PICOULT",
    "WEIR", "MARTIN", "CHRISTIE", "WENTWORTH", "MARSH", "COBEN", "GRAFTON", "KELLERMAN", "CONNELLY", "CRAIS", "DEAVER", "GERRITSEN", "WOODS", "EVANOVICH", "ROBB", "SANDFORD",
    "BALDACCI", "REICHS", "SLAUGHTER",
]
ARTICLES = ["THE", "A", "AN"]


def _if(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _once(value: Column, function) -> Column:
    """function(value) with value worked out once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _looked(line: Column) -> Column:
    return F.struct(line.alias("line"), T.match_tokens(line).alias("t"), T.alpha_ratio(line).alias("a"))


def _count(t: Column, words: list[str]) -> Column:
    return F.size(F.filter(t, lambda x: x.isin(*words)))


def _person(x: Column) -> Column:
    t, line = x["t"], T.strip(x["line"])
    n, w, first, last = F.size(x["t"]), F.split(line, r"\s+"), F.get(x["t"], F.lit(0)), F.element_at(x["t"], -1)
    caps = F.forall(w, lambda y: (F.length(y) <= 2) | (y == F.upper(y))) & (F.size(w) >= 2)
    cased = F.forall(w, lambda y: (F.length(y) <= 1) | (F.substr(y, F.lit(1), F.lit(1)) == F.upper(F.substr(y, F.lit(1), F.lit(1)))))
    content = _count(t, TITLE_CONTENT)
    score = (
        F.when(n.between(2, 4), 0.5).when(n == 1, 0.1).otherwise(0.2)
        + _if(x["a"] >= 0.85, 0.2)
        + F.when(caps, 0.2).when(cased, 0.1).otherwise(0.0)
        + _if(first.isin(*FIRST_NAMES), 0.15)
        + _if(last.isin(*LAST_NAMES), 0.15)
        - _if(x["a"] < 0.7, 0.3)
        - _if(L.is_org_like(line), 0.5)
        - _if(first.isin(*TITLE_INDICATORS), 0.4)
        - F.when(content == 0, 0.0).when(content / n >= 0.5, 0.35).otherwise(0.15)
    )
    return F.when(n == 0, 0.0).otherwise(_clamp(score))


def _title(x: Column) -> Column:
    t, line = x["t"], T.strip(x["line"])
    n, first = F.size(x["t"]), F.get(x["t"], F.lit(0))
    names = _count(t, FIRST_NAMES + LAST_NAMES)
    score = (
        F.when(n.between(2, 6), 0.5).when((n == 1) & (F.length(first) >= 4), 0.3).when(n > 6, 0.35).otherwise(0.1)
        + _if(first.isin(*ARTICLES), 0.25)
        + _if(_count(t, TITLE_INDICATORS) > 0, 0.1)
        + _if(_count(t, TITLE_CONTENT) >= 1, 0.15)
        + _if((n >= 3) & (names == 0), 0.1)
        - _if(x["a"] < 0.6, 0.2)
        - _if((names >= 2) & (names >= n * 0.6), 0.4)
        - _if(L.is_exact_imprint(line), 0.5)
        - _if(L.is_price_like(line), 0.5)
        - _if(L.is_fragment(line), 0.3)
    )
    return F.when(n == 0, 0.0).otherwise(_clamp(score))


def person_likeness(line: Column) -> Column:
    return _once(_looked(line), _person)


def title_likeness(line: Column) -> Column:
    return _once(_looked(line), _title)


def role(line: Column) -> Column:
    """struct(person, title, role, first, marks): role is author or title where one likeness leads by more than 0.15; first: the first token; marks: the title bears a title's words."""
    scored = lambda x: F.struct(_person(x).alias("p"), _title(x).alias("t"), F.get(x["t"], F.lit(0)).alias("first"), ((_count(x["t"], TITLE_INDICATORS) > 0) | (_count(x["t"], TITLE_CONTENT) > 0)).alias("marks"), _count(x["t"], TITLE_CONTENT).alias("content"))
    decide = lambda s: F.struct(s["p"].alias("person"), s["t"].alias("title"), F.when(s["p"] > s["t"] + 0.15, "author").when(s["t"] > s["p"] + 0.15, "title").otherwise("ambiguous").alias("role"), s["first"].alias("first"), s["marks"].alias("marks"), s["content"].alias("content"))
    return _once(_once(_looked(line), scored), decide)


def rejects_as_author(line: Column) -> Column:
    return _once(role(line), lambda r: ((r["role"] == "title") & (r["title"] >= 0.6)) | F.coalesce(r["first"].isin(*ARTICLES), F.lit(False)) | (r["content"] >= 2))


def joined_titles(lines: Column, bridges: list[str]) -> Column:
    """Titles of two or three neighbouring lines, the best first: array of struct(text, first, size, score, reason). bridges: words that alone on a line belong to the next one."""
    looked = F.transform(lines, lambda x, i: F.struct(T.strip(x).alias("line"), i.alias("i"), role(x).alias("r"), T.match_tokens(x).alias("t")))
    fine = lambda x: (x["line"] != "") & (x["r"]["role"] != "author")

    def at(all_: Column, x: Column, k: int) -> Column:
        return F.get(all_, x["i"] + k)

    def build(all_: Column) -> Column:
        one = F.transform(all_, lambda x: F.struct(x.alias("x"), at(all_, x, 1).alias("y"), at(all_, x, 2).alias("z")))
        two = F.filter(one, lambda g: g["y"].isNotNull() & fine(g["x"]) & fine(g["y"]) & ((g["x"]["r"]["title"] >= 0.3) | (g["y"]["r"]["title"] >= 0.3)))
        text = lambda *p: F.concat_ws(" ", *[q["line"] for q in p])
        scored = F.transform(two, lambda g: F.struct(g.alias("g"), title_likeness(text(g["x"], g["y"])).alias("s"), F.when(g["z"].isNotNull() & fine(g["z"]), title_likeness(text(g["x"], g["y"], g["z"]))).alias("s3")))
        out = lambda t, g, n, s, reason: F.struct(t.alias("text"), g["x"]["i"].alias("first"), F.lit(n).alias("size"), s.alias("score"), reason.alias("reason"))
        pairs = F.flatten(
            F.transform(
                scored,
                lambda v: F.when(v["s3"] >= v["s"], F.array(out(text(v["g"]["x"], v["g"]["y"]), v["g"], 2, v["s"], F.lit("adjacent_title_lines")), out(text(v["g"]["x"], v["g"]["y"], v["g"]["z"]), v["g"], 3, v["s3"], F.lit("three_line_join")))).otherwise(
                    F.array(out(text(v["g"]["x"], v["g"]["y"]), v["g"], 2, v["s"], F.lit("adjacent_title_lines")))
                ),
            )
        )
        bridge = F.filter(one, lambda g: g["y"].isNotNull() & (g["x"]["line"] != "") & fine(g["y"]) & (F.size(g["x"]["t"]) == 1) & F.get(g["x"]["t"], F.lit(0)).isin(*bridges) & (g["y"]["r"]["title"] >= 0.3))
        held = F.transform(bridge, lambda g: out(text(g["x"], g["y"]), g, 2, title_likeness(text(g["x"], g["y"])) + 0.1, F.concat(F.lit("stopword_bridge:"), F.get(g["x"]["t"], F.lit(0)))))
        return F.concat(pairs, held)

    placed = F.transform(_once(looked, build), lambda p, i: F.struct((-p["score"]).alias("s"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(placed, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(a["i"] - b["i"])), lambda x: x["p"])


def person_override(line: Column, candidates: Column) -> Column:
    """struct(overrides, reason, text): whether one of the joined titles makes a line that looks like a person a worse title; text: the first that does."""
    looked = F.transform(candidates, lambda c: F.struct(c["text"].alias("text"), role(c["text"]).alias("r")))

    def decide(x: Column) -> Column:
        me = x["me"]
        better = lambda c: ~((c["r"]["role"] == "author") & (c["r"]["person"] >= 0.6)) & (c["r"]["title"] > me["title"] + 0.1) & (c["r"]["title"] >= 0.5) & (F.coalesce(c["r"]["first"].isin(*ARTICLES), F.lit(False)) | c["r"]["marks"] | (c["r"]["title"] >= 0.65))
        first = F.get(F.filter(x["all"], better), F.lit(0))["text"]
        out = lambda o, reason, text: F.struct(o.alias("overrides"), F.lit(reason).alias("reason"), text.alias("text"))
        no, none = F.lit(False), F.lit(None).cast("string")
        return F.when(me["role"] != "author", out(no, "not_person_like_role", none)).when(me["person"] < 0.5, out(no, "low_person_likeness", none)).when(first.isNotNull(), out(F.lit(True), "better_title_candidate_found", first)).otherwise(out(no, "no_better_alternative", none))

    return _once(F.struct(role(line).alias("me"), looked.alias("all")), decide)


#: Words that alone on a line belong to the next one.
BRIDGES = ["THE", "A", "AN", "OF", "IN", "ON", "TO", "FOR", "AND", "OR"]

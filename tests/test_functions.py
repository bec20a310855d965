"""Scalar operators on cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tomelake.functions import decisions as D
from tomelake.functions import geometry as G
from tomelake.functions import isbn as I
from tomelake.functions import lines as L
from tomelake.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (T.normalize_for_comparison, "It's a test!", "its a test"),
        (T.normalize_for_comparison, "  HELLO,   World!  ", "hello world"),
        (T.normalize_fuzzy, "O'Brien's  'quoted' Café", "o'brien's quoted cafe"),
        (T.normalize_for_match, " Öl & más ", "OL MAS"),
        (T.normalize_query, "a !", "a "),
        (T.normalize_title, "War & Peace", "WAR PEACE"),
        (T.normalize_for_ocr, "Go 1l|", "60 1L1"),
        (T.normalize_for_dedupe, "A-b C3", "abc3"),
        (T.fnv1a, "hello", "4f9f2cab"),
        (T.fnv1a, "", "811c9dc5"),
        (I.normalize_isbn, "978-0-x", "9780X"),
        (I.isbn10_to_isbn13, "0306406152", "9780306406157"),
        (I.isbn13_to_isbn10, "9780306406157", "0306406152"),
        (I.format_isbn13, "9780743273565", "978-0-7432-7356-5"),
    ],
)
def test_strings(spark, function, text, expected):
    assert value(spark, function(lit(text))) == expected


@pytest.mark.parametrize(
    ("number", "valid"), [("0-306-40615-2", True), ("9780306406157", True), ("080442957X", True), ("9780306406158", False), ("", False), ("X", False), ("12345678901234", False)]
)
def test_isbn(spark, number, valid):
    assert value(spark, I.is_valid_isbn(lit(number))) is valid


def test_isbn_extraction(spark):
    text = "ISBN 978-0-7432-7356-5 and 0-306-40615-2 and 9780306406157"
    assert value(spark, I.extract_isbns(lit(text))) == ["9780743273565", "9780306406157"]
    assert value(spark, I.extract_isbns(lit(""))) == []
    assert value(spark, I.are_isbns_equivalent(lit("0306406152"), lit("978-0306406157"))) is True


@pytest.mark.parametrize(("a", "b", "expected"), [("", "", 1.0), ("abc", "", 0.0), ("kitten", "sitting", 1 - 3 / 7), ("same", "same", 1.0)])
def test_levenshtein(spark, a, b, expected):
    assert value(spark, T.levenshtein_similarity(lit(a), lit(b))) == pytest.approx(expected)


def test_jaro_winkler_keeps_half_transpositions():
    assert T.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert T.jaro("", "") == 1.0
    assert T.jaro("a", "") == 0.0
    assert T.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert T.jaro_winkler("ab", "xy") == 0.0


@pytest.mark.parametrize(
    ("ocr", "api", "reason"),
    [("SMITH", "smith", "exact_match"), ("ONES", "JONES", "missing_leading_char"), ("John Smlth", "John Smith", "edit_distance_within_tolerance"), ("", "x", "missing_input"), ("Alpha", "Omega", "edit_distance_too_high")],
)
def test_author_similarity(spark, ocr, api, reason):
    assert value(spark, T.author_similarity(lit(ocr), lit(api)))["reason"] == reason


def test_greedy_token_match_consumes_candidates(spark):
    found = value(spark, T.token_set_overlap(F.array(lit("logic"), lit("logik"), lit("zzz")), F.array(lit("logic"), lit("rhetoric"))))
    assert [(m["evidence"], m["candidate"]) for m in found] == [("logic", "logic")]


@pytest.mark.parametrize(("line", "price", "fragment", "person"), [("$14.99", True, True, False), ("9.99", True, True, False), ("Jane Austen", False, False, True), ("Penguin Books", False, False, False), ("of", False, True, False), ("The Hobbit", False, False, False), ("", False, True, False)])
def test_lines(spark, line, price, fragment, person):
    row = spark.range(1).select(L.is_price_like(lit(line)).alias("p"), L.is_fragment(lit(line)).alias("f"), L.is_person_like(lit(line)).alias("n")).first()
    assert (row["p"], row["f"], row["n"]) == (price, fragment, person)


def test_badges_look_at_neighbours(spark):
    norm = lambda s: lit(s) if s is not None else F.lit(None).cast("string")
    at = lambda a, b, c: value(spark, L.badge(norm(b), norm(a), norm(c)))
    assert at(None, "BESTSELLER", None)["confidence"] == 0.95
    assert at(None, "NYT AUTHOR", None)["reason"] == "entity_and_qualifier_same_line"
    assert at("NUMBER ONE", "WSJ", None)["reason"] == "entity_with_adjacent_qualifier"
    assert at(None, "USA TODAY", None)["confidence"] == 0.85
    assert at(None, "PLAIN", None)["confidence"] == 0.0


def test_geometry(spark):
    box = lambda *v: G.Box(*[F.lit(float(x)) for x in v])
    k = value(spark, G.canonical(lit(10.0), lit(20.0), lit(0.0)))
    assert (k["width"], k["height"], k["angle"]) == (20.0, 10.0, pytest.approx(math.pi / 2))
    assert value(spark, G.normalize_angle(lit(3 * math.pi))) == pytest.approx(math.pi)
    assert value(spark, G.bounds_iou(box(0, 0, 10, 10, 0), box(0, 0, 10, 10, 0))) == pytest.approx(1.0)
    assert value(spark, G.bounds_iou(box(0, 0, 10, 10, 0), box(5, 0, 10, 10, 0))) == pytest.approx(1 / 3)
    assert value(spark, G.bounds_iou(box(0, 0, 10, 10, 0), box(50, 0, 10, 10, 0))) == 0.0
    lb = value(spark, G.letterbox(lit(1920.0), lit(1080.0)))
    assert (round(lb["scale"], 6), lb["pad_x"], lb["pad_y"]) == (0.333333, 0, 140)
    assert value(spark, G.js_round(lit(-2.5))) == -2


@pytest.mark.parametrize(
    ("top", "second", "tier", "flags", "kind"),
    [(0.9, 0.5, "strong", [], "auto-accept"), (0.9, 0.8, "strong", [], "suggest"), (0.9, 0.5, "strong", ["isbn-mismatch"], "ambiguous"), (0.9, 0.5, "unusable", [], "no-match"), (None, None, "strong", [], "no-match"), (0.85, 0.70, "strong", [], "auto-accept")],
)
def test_edge_decisions(spark, top, second, tier, flags, kind):
    d = value(spark, D.edge_decision(F.lit(top).cast("double"), F.lit(second).cast("double"), lit(tier), F.array(*map(lit, flags)).cast("array<string>")))
    assert d["type"] == kind


@pytest.mark.parametrize(
    ("args", "tier"),
    [(("success", True, 0.9, 20, 0.9, None), "strong"), (("success", True, 0.9, 20, 0.9, 50), "usable"), (("skipped", True, 0.9, 20, 0.9, None), "weak"), (("failed", True, 0.9, 20, 0.9, None), "unusable"), (("success", None, None, None, None, None), "unusable"), (("success", True, 0.4, 8, 0.3, None), "weak")],
)
def test_tiers(spark, args, tier):
    kinds = ("string", "boolean", "double", "int", "double", "double")
    assert value(spark, D.evidence_tier(*[F.lit(a).cast(k) for a, k in zip(args, kinds, strict=True)])) == tier


def test_token_variants(spark):
    from tomelake.functions import variants as V

    assert set(value(spark, V.token_variants(lit("G0lll")))) >= {"g0lll", "golll", "c0lll", "g0ll", "g0l", "g0iii"}
    assert value(spark, V.token_variants(lit("a"))) == ["a"]
    assert value(spark, V.common_prefix(lit(""), lit("abc"))) == 0
    assert value(spark, V.common_suffix(lit("nation"), lit("station"))) == 5
    assert value(spark, V.is_leading_drop(lit("arry"), lit("harry"))) is True
    assert value(spark, V.is_truncated_prefix(lit("harr"), lit("harry"))) is True
    assert value(spark, V.is_confusion_equivalent(lit("0liver"), lit("oliyer"))) is True
    assert value(spark, V.passes_threshold(lit("abc"), lit("xyz"))) is False
    assert value(spark, V.is_garbage(lit("xbcdfghjk"))) is True

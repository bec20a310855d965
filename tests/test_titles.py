"""Token repair and title variants on cases worked by hand."""

from pyspark.sql import functions as F

from tomelake.functions import titles as X


def values(spark, rows, build):
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, u string")
    return [r["v"] for r in df.select("i", build(F.col("t"), F.col("u")).alias("v")).orderBy("i").collect()]


def test_tokens_are_mended(spark):
    one = lambda f: lambda t, u: f(t)
    assert values(spark, ["McDonaldHouse", "abCd", "UPPER"], one(X.split_case)) == [["Mc", "Donald", "House"], ["abCd"], ["UPPER"]]
    assert values(spark, ["glad", "cool", "abc", "igloo"], one(X.letter_swaps)) == [["giad"], ["cooi"], [], ["lgloo", "igioo", "icloo"]]
    assert values(spark, ["righi", "taxi"], one(X.mended_ending)) == ["right", "taxi"]
    fused = ["lightand", "thefallen", "worldofwar", "hoagland", "island", "weighiand", "into"]
    assert values(spark, fused, one(X.split_fused)) == [["light", "and"], ["the", "fallen"], ["world", "of", "war"], ["hoagland"], ["island"], ["weight", "and"], ["into"]]
    assert values(spark, [("$9.99", "999"), ("1984", "1984"), ("1234", "1234"), ("a12", "a12"), ("abc1", "abc1"), ("", "")], lambda t, u: X.is_numeric_noise(t, u)) == [True, True, True, True, False, True]
    assert values(spark, ["novel", "bestsellernational", "qwrtpsdfgh", "dune"], one(X.is_badge_noise)) == [True, True, True, False]
    assert values(spark, ["Ünal", "Şık-1"], one(X.canonical_token)) == ["unal", "sik1"]


def test_phrases_are_corrected(spark):
    split = lambda t, u: F.array_join(X.correct_phrases(F.filter(F.split(t, " "), lambda x: x != "")), " ")
    assert values(spark, ["the line of aire again", "worlds fire", "along cane a spider", "", "line of"], split) == ["the line of fire again", "", "along came a spider", "", "line of"]


def test_title_variants(spark):
    assert values(spark, [("the dark tower stephen king", "stephen king"), ("the shining king", "king"), ("cat in stephen king", "king"), ("dune", "herbert"), ("dune", None), (None, "x")], X.without_author) == ["the dark tower", "the shining", "cat in", "dune", "dune", None]
    one = lambda f: lambda t, u: f(t)
    assert values(spark, ["a is for alibi sue grafton", "a is for of", "a is alibi x"], one(X.series_core)) == ["a is for alibi", None, None]
    assert values(spark, ["dark tower rises", "the tower", "dark dark"], one(X.leading_swapped)) == ["tower dark rises", None, None]
    assert values(spark, ["city of glass", "of glass", "city glass"], one(X.without_connectors)) == ["city glass", None, None]
    assert values(spark, ["city of fallen angels", "of mice", "city of the"], one(X.reordered_of)) == ["fallen angels city", None, None]
    assert values(spark, ["the city of glass smith", "city glass bones smith"], one(X.without_author_tail)) == ["the city of glass", None]
    assert values(spark, [("the city of smith", "2"), ("the city of smith", "1")], lambda t, u: X.without_repeated_tail(t, u.cast("int"))) == ["the city of", None]
    assert values(spark, ["Stephen King", "King", "Stephen Yu"], one(X.surname)) == ["King", None, None]
    assert values(spark, ["The Dark Tower", "A Dark Road Stephen King", "it"], one(X.title_tail)) == ["tower", "road", None]
    assert values(spark, ["she was here silent night", "she was"], lambda t, u: F.array_join(X.drop_low_signal(F.split(t, " ")), " ")) == ["here silent night", "she was"]


def test_queries(spark):
    got = values(spark, [("The Road", "McCarthy"), ("It", "King"), ("It", None), (None, "King"), (None, None)], X.simple_queries)
    assert [[tuple(q) for q in v] for v in got] == [
        [("The Road McCarthy", "title_author", 10), ("McCarthy The Road", "author_title", 11), ("Road McCarthy", "stripped", 15)], [("It King", "title_author", 10), ("King It", "author_title", 11)],
        [("It", "title_only", 20)], [("King", "author_only", 25)], [],
    ]
    df = spark.createDataFrame([(["The Ca", "ts of", "x", "y z"],), ([],), (["long", "words"],)], "l array<string>")
    assert [r[0] for r in df.select(X.boundary_queries(F.col("l"))).collect()] == [["The Ca ts of", "The cats of"], [], []]

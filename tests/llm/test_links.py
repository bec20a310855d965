"""Links of near copies: fewer of them, the same components."""

import random

import numpy as np
import pyarrow as pa

from tomelake.llm import near_dedup
from tomelake.llm.near_dedup import thinned
from tomelake.operators.components import connected_components


def test_members_of_many_stars_are_linked_once(spark):
    r = random.Random(1)
    stars = [(a, b) for b in range(100, 400) for a in range(20)]
    other = [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(300)]
    links = spark.createDataFrame(stars + other + [(7, 7), (400, 5), (5, 400)], "a long, b long")
    few = thinned(links).localCheckpoint()
    assert few.filter("a < 1000").count() == 300 + 19 + 1 + 1 - 1
    cut = lambda df: df.localCheckpoint()
    assert {tuple(x) for x in connected_components(few, "a", "b", cut=cut).collect()} == {tuple(x) for x in connected_components(links, "a", "b", cut=cut).collect()}


def test_buckets_of_the_same_parts_name_the_same_links():
    # Forty buckets of sixty near parts, another part being the smallest in each.
    sign = np.zeros(near_dedup.SYMBOLS, np.uint16).tobytes()
    rows = [(k, 2 * p + j, 9, sign, p) for k in range(40) for p in range(60) for j in range(1 + (p != k))]
    names = ["bucket", "id", "n", "signature", "part"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)
    links = {(r["a"], r["b"]) for out in near_dedup._forest([batch]) for r in out.to_pylist()}
    assert links == {(0, p) for p in range(1, 60)}

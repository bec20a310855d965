"""Rows that repeat or lack a doc_id, hot groups, and the pipeline as a whole, against brute force."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tomelake.llm import exact_dedup, fingerprints, near_dedup, quality, source_mix, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _may boolean, position long"
WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(random.Random(1000 + i).randint(2, 6))) for i in range(300)]
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "src1", None, "r", True, 3) for i, t in pairs], SCHEMA).repartition(3)


def pairs_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def kept_of_copies(rows):
    """Of equal texts the row with the most code points, then the smallest doc_id (none last)."""
    best = {}
    for i, t in rows:
        rank = (-len(t or ""), i is None, i or 0)
        key = squeezed(t)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (i, t))
    return sorted((row for _, row in best.values()), key=repr)


def test_copies_are_dropped_by_row(spark):
    a, b = prose(30, 1), prose(30, 2)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, "only"), (None, "only"), (LEAST, "x y"), (GREATEST, "xy"), (GREATEST, "x  y"), (7, None), (8, ""), (9, " \n")]
    df = frame(spark, rows)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and pairs_of(out) == kept_of_copies(rows)
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0
    groups = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.duplicate_groups(df).collect()}
    assert (LEAST, GREATEST) in groups and (5, 1) in groups and (8, 9) in groups


def test_filters_in_slices_and_hot_groups(spark, monkeypatch):
    rows = [(i, f"text {i % 700}") for i in range(1000)] + [(2000 + i, "hot") for i in range(60)]
    df = frame(spark, rows)
    plain = sorted(map(tuple, exact_dedup.duplicate_groups(df).collect()))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 12)
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 1 << 10)
    monkeypatch.setattr(exact_dedup, "HOT", 20)
    assert exact_dedup.filter_slices(len(rows)) > 3
    assert sorted(map(tuple, exact_dedup.duplicate_groups(df).collect())) == plain
    assert pairs_of(exact_dedup.drop_copies(df)) == kept_of_copies(rows)


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_parts(rows):
    """Component of each row (by place) over links of 75 percent."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                part = [part[j] if p == part[i] else p for p in part]
    return part


def test_near_copies_are_dropped_by_row(spark):
    base, other = prose(80, 3).split(), prose(80, 4)
    near = [" ".join([*base[:k], "zz", *base[k + 1 :]]) for k in (10, 40, 70)]
    rows = [(3, " ".join(base)), (5, near[0]), (5, other), (None, near[1]), (None, "no other text is like this one"), (8, None), (8, ""), (9, near[2]), (10, other + " end")]
    df = frame(spark, rows)
    out = near_dedup.drop_near_copies(df)
    assert out.columns == df.columns
    assert pairs_of(out) == sorted([(3, " ".join(base)), (5, other), (None, "no other text is like this one"), (8, None), (8, "")], key=repr)
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got[3, 76] == (3, True) and got[9, 76] == (3, False) and got[8, 0] == (8, True)


@pytest.mark.parametrize("outside", [12, 60])
def test_a_hot_group_stays_small(spark, monkeypatch, outside):
    """Near copies of four times a bucket's bound, and texts that share much with them but are linked with none."""
    monkeypatch.setattr(near_dedup, "MOST_IN_BUCKET", 40)
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    monkeypatch.setattr(near_dedup, "STAR", 7)
    monkeypatch.setattr(near_dedup, "MOST_SHINGLES", 6000)
    rng = random.Random(5)
    base = prose(100, 6).split()

    def changed(n):
        w = list(base)
        for k in rng.sample(range(100), n):
            w[k] = f"w{rng.randrange(10**6)}"
        return " ".join(w)

    rows = [(i, changed(rng.choice([1, 2, 3, 4, 5]))) for i in range(160)] + [(1000 + i, changed(12)) for i in range(outside)] + [(2000 + i, prose(60, 9000 + i)) for i in range(20)]
    df = frame(spark, rows)
    part = near_parts(rows)
    least = {p: min(r[0] for r, q in zip(rows, part, strict=True) if q == p) for p in part}
    seen = []
    listed = near_dedup.listed
    monkeypatch.setattr(near_dedup, "listed", lambda m: seen.append(listed(m)) or seen[-1])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {r[0]: least[p] for r, p in zip(rows, part, strict=True)}
    if outside < 20:
        assert seen[0].count() < 100 * len(rows)


def test_near_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    prints = [rng.getrandbits(128) for _ in range(40)]
    for p in prints[:15]:
        for _ in range(6):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 4))))
    rows = [(100 + i, p) for i, p in enumerate(prints)] + [(None, prints[0]), (None, rng.getrandbits(128))]
    distinct = sorted({p for _, p in rows})
    part = {p: p for p in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 3 and part[a] != part[b]:
                part = {k: part[a] if v == part[b] else v for k, v in part.items()}
    least = {q: min((i for i, p in rows if part[p] == q and i is not None), default=None) for q in part.values()}
    df = spark.createDataFrame([(i, f"{p:032x}") for i, p in rows], "doc_id long, fingerprint string")
    for most in (20_000, 3):
        monkeypatch.setattr(fingerprints, "MOST_IN_BUCKET", most)
        got = {int(r["fingerprint"], 16): r["near_group"] for r in fingerprints.near_groups(df).collect()}
        assert got == {p: least[part[p]] for p in distinct}
    assert fingerprints.near_groups(df.limit(0)).count() == 0


def test_weights_solve_the_ridge_equations():
    rng = np.random.default_rng(3)
    x = (rng.random((60, 7)) < 0.3).astype(float)
    y, times = (x[:, 0] + rng.random(60) > 0.8).astype(float), rng.integers(1, 5, 60).astype(float)
    rows, words = np.nonzero(x)
    weights, bias = toxicity._weights(rows, words, y, times, 7)
    p = 1 / (1 + np.exp(-(x @ np.array(weights) + bias)))
    assert np.abs(x.T @ (times * (y - p)) - 0.3 * np.array(weights)).max() < 1e-6
    assert abs((times * (y - p)).sum() - 1e-3 * bias) < 1e-6


@pytest.fixture
def corpus():
    rng = random.Random(9)
    rows = []
    for i in range(300):
        w = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40)]
        if i % 4 == 0:
            w.insert(rng.randrange(40), rng.choice(["grimbol", "snarkfu"]))
        rows.append((i, " ".join(w)))
    return rows


def test_toxic_rows_go_by_their_own_text(spark, corpus):
    labels = [(i, int(i % 4 == 0)) for i, _ in corpus] + [(1, 0), (1, None), (0, 0), (None, 1)]
    clean = next(i for i, _ in corpus if i % 4 == 1 and zlib.crc32(str(i).encode()) % 4 == toxicity.HELD_OUT)
    rows = [*corpus, (None, "a gr1mb0l here"), (None, "all is well"), (clean, "you snarkfu"), (0, "fine words"), (700, None), (701, "")]
    df, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.drop_toxic(df, marks)
    assert out.columns == df.columns
    assert pairs_of(out) == sorted([r for r in rows if not re.search("grimbol|snarkfu|gr1mb0l", r[1] or "")], key=repr)


def test_pipeline_against_brute_force(spark, corpus, tmp_path):
    labels = [(i, int(i % 4 == 0)) for i, _ in corpus]
    base = prose(90, 77).split()
    near = [(900 + k, " ".join([*base[:k], "zz", *base[k + 1 :]])) for k in (10, 50, 80)]
    clean = corpus[1]
    rows = [*corpus, (899, " ".join(base)), *near, clean, (5000, clean[1] + " "), (5, "another text for a used id"), (None, "no id at all " + prose(20, 5)), (None, clean[1]), (800, None), (801, "")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stay = kept_of_copies([r for r in rows if not re.search("grimbol|snarkfu", r[1] or "")])
    left = defaultdict(list)
    for p, row in zip(near_parts(stay), stay, strict=True):
        left[p].append(row)
    stay = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) if shingles(g[0][1]) else g[0] for g in left.values()]
    encode = Tokenizer.from_file(tokens.default_path())
    ids = [(i, np.array([*encode.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in stay]
    expected = sorted(((i, len(x), int(x.sum())) for i, x in ids), key=repr)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r["length"] for r in pieces) == sum(n for _, n, _ in expected)
    starts = sorted(((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0), key=repr)
    assert starts == sorted(((i, n) for i, n, _ in expected), key=repr)
    whole = {(i, zlib.crc32(x.tobytes())) for i, x in ids}
    assert all((r["doc_id"], r["ids_crc32"]) in whole for r in pieces if r["length"] == r["doc_tokens"])


def test_mix_keeps_columns_with_clashing_names(spark):
    df = frame(spark, [(i, f"t{i}") for i in range(20)] + [(3, "again"), (None, "none")])
    out = source_mix.in_mix_order(df, {"src1": 2, "other": 1})
    assert out.columns == df.columns and out.count() == 22 and {r["position"] for r in out.collect()} == {3}


def test_estimation_recovers_planted_accuracies():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(quality.LABELLERS)
    bad = rng.random(n) < 0.15
    hit = np.array([0.9, 0.8, 0.7, 0.6, 0.85, 0.5, 0.75, 0.65, 0.8, 0.7, 0.3])
    alarm = np.array([0.01, 0.05, 0.02, 0.1, 0.03, 0.02, 0.08, 0.01, 0.04, 0.06, 0.3])  # the last one votes alike on both
    votes = np.where(rng.random((n, k)) < np.where(bad[:, None], hit, alarm), quality.BAD, quality.GOOD)
    votes[rng.random((n, k)) < 0.2] = quality.ABSTAIN
    found = quality.patterns(votes)
    keys, counts = np.unique(found, return_counts=True)
    post, rate = quality.posteriors(dict(zip(keys.tolist(), counts.tolist(), strict=True)))
    assert np.abs(rate[:, 0] - alarm).max() < 0.02 and np.abs(rate[:, 1] - hit).max() < 0.03
    assert np.mean([(post[p] < 0.5) == b for p, b in zip(found.tolist(), bad, strict=True)]) > 0.99


def test_low_quality_rows_go_by_their_own_text(spark):
    good = [(i, ". ".join(prose(12, 2000 + 9 * i + k).capitalize() for k in range(8)) + ".") for i in range(120)]
    bad = [(1000 + i, " | ".join(prose(80, 5000 + i).split())) for i in range(20)] + [(2000 + i, "!! ".join(prose(60, 6000 + i).upper().split())) for i in range(20)]
    rows = [*good, *bad, (None, bad[0][1]), (None, good[0][1]), (3, bad[1][1]), (None, None)]
    df = frame(spark, rows)
    left = pairs_of(quality.keep_good(df))
    assert (None, bad[0][1]) not in left and (3, bad[1][1]) not in left and (None, good[0][1]) in left and good[3] in left
    assert quality.keep_good(df).columns == df.columns

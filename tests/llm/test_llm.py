"""Training-data operators on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import io
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tomelake.llm import chat_format, exact_dedup, fingerprints, near_dedup, packing, quality, range_coder, source_mix, token_files, tokens, toxicity, url_filter
from tomelake.llm import shingles as shingles_module

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, component string, may_repeat string"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def texts() -> list:
    base = prose(120, 1)
    words = base.split()
    near = [" ".join([*words[:k], "zzz", *words[k + 1 :]]) for k in (10, 60, 119)]
    odd = [None, "", "   \t\n", "one", "ONE", "a b c d", "a b c d e", "é ß “x” 漢字", "x" * 5000, "word " * 3000, base, base.upper(), base.replace(" ", "  "), *near]
    return odd + [prose(RNG.randint(1, 200), 100 + i) for i in range(40)] + [base] * 5


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "src1", "src2", "zz"][i % 4], None, 1, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[20], (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def collected(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_exact_dedup(docs, none):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = defaultdict(list)
    for i, t in collected(docs):
        groups[norm(t)].append((-len(t), float("inf") if i is None else i, i))
    got = rows(exact_dedup.duplicate_groups(docs))
    for text, members in groups.items():
        keep = min(members)[2]
        for *_, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.duplicate_groups(none).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_bloom_filter_lets_no_repeated_row_pass(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(str(rng.randint(0, 3000)),) for _ in range(4000)], "k string")
    bits = 1 << 14
    marked = exact_dedup.may_hit(df, "k", exact_dedup.repeated_cells(df, "k", bits, 2), bits, 2).collect()
    count = Counter(r["k"] for r in marked)
    assert all(r["_may"] for r in marked if count[r["k"]] > 1)
    assert sum(not r["_may"] for r in marked) > 100


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(pairs):
    sets = {i: shingles(t) for i, t in pairs}
    part = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[i] and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = {k: low if v == high else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def test_near_dedup(docs, none):
    expected = components([(i, t) for i, t in collected(docs) if i is not None])
    got = rows(near_dedup.near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items() if i is not None} == expected
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items() if i is not None) and got[None]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_near_dedup_splits_large_buckets_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_IN_BUCKET", 6)
    monkeypatch.setattr(near_dedup, "MOST_SHINGLES", 900)
    words = prose(100, 5).split()
    pairs = [(i, " ".join([*words[: i * 2], f"w{i}", *words[i * 2 + 1 :]])) for i in range(30)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = rows(near_dedup.near_duplicates(df))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == components(pairs)


def test_fingerprints(docs, none, spark):
    ordered = sorted(collected(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    ordered = [r for k, r in enumerate(ordered) if k == 0 or r[0] != ordered[k - 1][0]]
    got = rows(fingerprints.edit_likeness(docs.dropDuplicates(["doc_id"])))
    for k, (i, t) in enumerate(ordered):
        half, following = len(t) // 2, ordered[k - 1][1]
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest()
        assert got[i]["n_chars"] == len(t)
    assert len({r["fingerprint"] for i, r in got.items() if i in (10, 11, 12)}) == 1
    assert fingerprints.edit_likeness(none).count() == 0
    one = fingerprints.edit_likeness(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0


def test_fingerprint_neighbours(spark):
    rng = random.Random(4)
    prints = [rng.getrandbits(128) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for p in prints[:20]] + prints[:5]
    distinct = sorted(set(prints))
    expected = {(a, b, (a ^ b).bit_count()) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= 6}
    found = fingerprints.neighbours(spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")).collect()
    assert {(int(r["a"], 16), int(r["b"], 16), r["distance"]) for r in found} == expected and len(found) == len(expected)


def encoded(docs):
    t = Tokenizer.from_file(tokens.default_path())
    return {i: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in collected(docs)}


def test_packing(docs, none):
    ids, pieces, sequences = encoded(docs), defaultdict(list), defaultdict(list)
    for r in packing.pack(docs.dropDuplicates(["doc_id"])).collect():
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(none).count() == 0


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert_keys(grid, bits=3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("lengths", [[], [0], [1], [5, 3], [300, 300, 40, 1, 0]])
def test_range_coder_round_trip(lengths):
    rng = np.random.default_rng(len(lengths))
    blocks = [rng.integers(0, 9 if k % 2 else 1 << 16, n) for k, n in enumerate(lengths)]
    coded = range_coder.encode_blocks(blocks)
    for a, b in zip(blocks, range_coder.decode_blocks(coded, lengths), strict=True):
        assert (a == b).all()


def test_range_coder_learns():
    block = np.tile(np.arange(100, 150), 60)
    assert len(range_coder.encode_blocks([block])[0]) * 8 / len(block) < 3


def test_token_files(docs, none, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    monkeypatch.setattr(token_files, "GROUP_BLOCKS", 4)
    small = docs.dropDuplicates(["doc_id"])
    ids, at = encoded(small), 0
    got = rows(token_files.read_files(spark.createDataFrame(token_files.write_files(small, f"file://{tmp_path}/a").collect())))
    for i in sorted(ids, key=lambda k: (k is not None, k or 0)):
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])
    written = token_files.write_files(none, f"file://{tmp_path}/b").collect()
    assert sum(r["n_docs"] for r in written) == 0


def test_damage_is_found():
    out = io.BytesIO()
    writer = token_files.FileWriter(out)
    for i in range(20):
        writer.add(i, np.arange(i * 10, dtype="<u4").tobytes())
    writer.finish()
    data = out.getvalue()
    assert [d for d, _ in token_files.read_documents(io.BytesIO(data))] == list(range(20))
    for at in (3, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises((token_files.DamagedFile, zlib.error)):
            list(token_files.read_documents(io.BytesIO(bytes(bad))))
    with pytest.raises(token_files.DamagedFile):
        list(token_files.read_documents(io.BytesIO(data[:-5])))


def test_runs_encode_like_whole_texts(monkeypatch):
    rng = random.Random(1)
    alphabet = ["a", "É", ".", ",", " ", "\t", "\u00a0", "\u0301", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "漢", "\x1c", "é.", "×.", "\x85", "ª", "µ", "-", "“", "<", "\u0338", "ß", "İ", "ll", "B", "Ω", "\u2028"]
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", "x" * 5000, "don't stop, I'll 've 'RE'save.'s"]
    monkeypatch.setattr(tokens, "MOST_RUNS", 500)
    monkeypatch.setattr(shingles_module, "SLICE_BYTES", 400)
    own = tokens.encoder(tokens.default_path())
    whole = own.tokenizer.encode_batch(samples, add_special_tokens=False)
    for _ in range(2):
        found = [ids for _, coded in tokens.encoded(tokens.default_path(), pa.array(samples)) for ids in coded]
        assert len(found) == len(samples)
        for text, a, b in zip(samples, found, whole, strict=True):
            assert np.frombuffer(a, "<u4").tolist() == b.ids, text


def test_other_tokenizers_encode_whole_texts(tmp_path):
    settings = json.load(open(tokens.default_path(), encoding="utf-8"))
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(settings))
    texts_ = ["Some Text", "ABC abc.", ""]
    found = [ids for _, coded in tokens.encoded(str(path), pa.array(texts_)) for ids in coded]
    whole = Tokenizer.from_file(str(path)).encode_batch(texts_, add_special_tokens=False)
    assert not tokens.encoder(str(path)).by_runs
    assert [np.frombuffer(a, "<u4").tolist() for a in found] == [b.ids for b in whole]


def test_source_mix(docs, none):
    weights = {"src1": 3, "src2": 2, "other": 1}
    slots = source_mix.period(weights)
    done = Counter()
    for t, s in enumerate(slots * 3, 1):
        done[s] += 1
        assert all(abs(done[k] - t * w / 6) < 1 for k, w in weights.items())
    many = source_mix.period({f"s{i}": 1 for i in range(50)} | {"big": 50})
    done = Counter()
    for t, s in enumerate(many, 1):
        done[s] += 1
        assert abs(done["big"] - t / 2) < 1
    mixed = source_mix.mix(docs, weights, block=2).collect()
    assert len(mixed) == docs.count() and len({r["position"] for r in mixed}) == len(mixed)
    assert source_mix.mix(none, weights).count() == 0
    ordered = source_mix.in_mix_order(docs, weights)
    assert ordered.count() == docs.count() and ordered.columns == docs.columns
    with pytest.raises(ValueError):
        source_mix.period({"a": 0, "b": 1})


def test_chat_events_fold(spark):
    log = [
        ("c", 1, 1, "message", "user", "hi"), ("c", 2, 2, "message", "assistant", ""), ("c", 3, 2, "delta", None, "Hel"), ("c", 4, 2, "delta", None, "lo"), ("c", 5, 1, "edit", "user", "hey"),
        ("c", 6, 3, "message", "user", "again?"), ("c", 7, 4, "message", "assistant", "bad"), ("c", 8, 4, "regenerate", None, None), ("c", 9, 4, "delta", None, "good"), ("c", 10, 5, "message", "user", "x"), ("c", 11, 5, "delete", None, None),
    ]
    events = spark.createDataFrame(log, "conv_id string, seq long, message_id long, kind string, role string, text string")
    got = [(r["role"], r["text"]) for r in chat_format.fold_events(events).orderBy("position").collect()]
    assert got == [("user", "hey"), ("assistant", "Hello"), ("user", "again?"), ("assistant", "good")]


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", None, "", "a\nb", "\\", "\\\\h", "</turn>\n", "<", "### x: y", "\\l/turn>", "é漢🙂", "n\\n"]
    turns = [(1, i, ["user", "assistant", None, "we:ird\nrole\\"][i % 4], t) for i, t in enumerate(nasty)] + [(2, 0, "user", "x"), (2, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(df)
    out = rows(out.withColumn("turns", chat_format.parse(F.col("formatted"))).withColumn("learnt", chat_format.masked_text(F.col("formatted"), F.col("loss_spans"))), "conv_id")
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r or "", t or "") for _, _, r, t in turns[:12]]
    assert out[1]["learnt"] == "".join(t or "" for _, _, r, t in turns[:12] if r == "assistant")
    assert len(out[2]["turns"]) == 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://Sub.Example.com/en/x?q#f", "https://www.example.com/en/", "http://a.net/fr/1", "http://a.net/de/", None, "no scheme", "x://example.com", "http://example.com/en/?a://b/", "http://notexample.com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, labels).collect()}
    assert got[0] == ("sub.example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow")
    assert got[2][2:] == ("net/fr/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("example.com", "", None, "allow")
    assert got[8][2:] == ("com/", "allow")


def test_url_rules_are_mined(spark, monkeypatch):
    spam = [(i, f"http://h{i}.org/casino/win/{i}", True) for i in range(20)]
    fine = [(100 + i, f"http://h{i}.org/news/win/{i}", False) for i in range(40)]
    df = spark.createDataFrame(spam + fine + [(999, "http://new.org/casino/x", None)], "page_id long, url string, blocked boolean")
    judge = lambda: {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df.select("page_id", "url"), df.filter("blocked is not null").select("page_id", "blocked")).collect()}
    first = judge()
    assert first[999] == "block" and first[3] == "block" and first[103] == "allow"
    monkeypatch.setattr(url_filter, "LITERAL_RULES", -1)
    assert judge() == first


def test_url_rules_of_small_hosts_and_many_tokens(spark):
    # Six pages of one host are under 1% of the labels; of the four words, any three occur on as many fine pages as blocked ones.
    spam = [(i, f"http://spam.org/{i}", True) for i in range(6)]
    fine = [(100 + i, f"http://fine.org/{i}", False) for i in range(900)]
    words = ["aa", "bb", "cc", "dd"]
    long = [(2000 + i, "http://mixed.org/" + "/".join(words), True) for i in range(6)]
    parts = [(3000 + 10 * k + i, "http://mixed.org/" + "/".join(w for w in words if w != words[k]), False) for k in range(4) for i in range(6)]
    df = spark.createDataFrame([*spam, *fine, *long, *parts], "page_id long, url string, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(df.select("page_id", "url"), df.select("page_id", "blocked")).collect()}
    assert got == {i: "block" if blocked else "allow" for i, _, blocked in [*spam, *fine, *long, *parts]}


def test_toxicity(spark, none):
    rng = random.Random(9)
    bad = ["grimbol", "snarkfu"]
    made = []
    for i in range(400):
        toxic = i % 4 == 0
        w = prose(30, 1000 + i).split()
        if toxic:
            w.insert(rng.randrange(30), rng.choice(bad))
        made.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df.select("doc_id", "toxic"))
    assert set(model[0]) == set(bad)
    probes = ["a gr1mb0l here", "g r i m b o l now", "grrrimbol", "s.n.a.r.k.f.u", "gr!mbol!!", "plain words only", None, "", "grim bolder " * 2000]
    got = rows(toxicity.score_texts(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model))
    assert [got[i]["score"] >= toxicity.THRESHOLD for i in range(len(probes))] == [True] * 5 + [False] * 4
    assert toxicity.score_texts(none, toxicity.learn(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


@pytest.fixture
def finder():
    """A finder of four words, whose characters are counted in them."""
    lexicon = {w: 1.0 for w in ("worthless", "scum", "idiot", "loser")}
    counts = np.full((toxicity.N,) * 3, 0.01)
    for word in lexicon:
        c = [0, 0, *(ord(x) - 96 for x in word), 0]
        for i in range(2, len(c)):
            counts[c[i - 2], c[i - 1], c[i]] += 1
    return toxicity.Finder(lexicon, np.log(counts / counts.sum(axis=2, keepdims=True)))


def test_signs_at_the_ends_are_letters_or_decoration(finder):
    probes = {"worthless": ["worthle$$", "w0rthle$$", "$$worthle$$", "worthle$$!!", "**worthle$$**"], "scum": ["$$cum", "!!$$cum!!", "$$scum$$", "--$$cum--"], "idiot": ["!!diot", "!!diot!!", "$$!!diot", "$$idiot!!"]}
    for word, chunks in probes.items():
        for chunk in chunks:
            assert finder.restored(chunk) == {word}, chunk
    assert not any(finder.restored(chunk) for chunk in ("!!", "$$$", "$$!!", "cumulate$$", "!!diots", "***", "worth$$"))


def test_disguises_of_any_length_are_undone(finder):
    long = {"l" + "o" * 200 + "ser": "loser", "i" + "*" * 200 + "d1ot": "idiot", "$" * 150 + "cum": "scum", "w0rthle" + "$" * 100: "worthless", ".-" * 5000 + "s.c.u.m" + "~=" * 5000: "scum"}
    for chunk, word in long.items():
        assert finder.restored(chunk) == {word}, chunk[:20]
    assert not any(finder.restored(chunk) for chunk in ("l" + "o" * 200, "0123456789" * 20_000, "x1" * 100_000, "ab" * 100_000))
    assert toxicity.decode("l0" * 50_000, finder.model) == "lo" * 50_000


def test_quality(spark, none):
    good = [(i, ". ".join(prose(12, 2000 + 9 * i + k).capitalize() for k in range(8)) + ".") for i in range(150)]
    bad = [(1000 + i, " | ".join(prose(80, 5000 + i).split())) for i in range(20)] + [(2000 + i, " ".join([WORDS[i]] * 90)) for i in range(20)] + [(3000 + i, "!! ".join(prose(60, 6000 + i).upper().split())) for i in range(20)]
    df = spark.createDataFrame([*good, *bad, (9000, None), (9001, "")], "doc_id long, text string")
    got = rows(quality.score_quality(df, quality.learn(df)))
    assert sum(got[i]["kept"] for i, _ in good) >= 148
    assert sum(got[i]["kept"] for i, _ in bad) <= 3
    assert quality.score_quality(none, quality.learn(none)).count() == 0

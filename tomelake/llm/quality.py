"""Quality classifier from weak labels.

1. Overlapping heuristic labellers vote good, bad or nothing on each text; the corpus is counted by pattern of votes, of
   which there are at most 3**11. Each kind of bad text is known by two labellers at least, and one labeller (length) is no
   judge of quality at all: the estimate has to find that out.
2. Expectation-maximisation over the patterns estimates how often each labeller votes what on good and on bad texts, and
   with that the posterior of each pattern. It starts from the number of bad votes: two are a strong hint, one is open. No
   rate is bounded; a few pseudo-votes keep it off 0 and 1.
3. A logistic model over hashed words and word shapes is fitted to the posteriors of a sample of about TRAINING_ROWS rows,
   and scores every text.

No label is read. Edge cases: null and empty texts have no word, get no vote and the score of the bias alone (about the prior); repeated rows
are scored each; equal scores are treated alike, as the threshold alone decides; a table of equal votes leaves the prior; an empty table gives an empty result; extra columns are ignored
by `score_quality` and kept by `keep_good`, which judges each row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import slices, words

ABSTAIN, GOOD, BAD = 0, 1, 2
LABELLERS = ("symbols", "columns", "capitals", "exclamations", "repeats", "stutter", "punctuation", "word_length", "tails", "wordless", "length")
WORD_FEATURES, SHAPES = 1 << 13, 1024
FEATURES = WORD_FEATURES + SHAPES
#: The model is fitted to about so many texts at most.
TRAINING_ROWS = 8000
THRESHOLD = 0.5
#: P(good) from which the estimate starts, by the number of bad votes: none, one, more.
START = (0.98, 0.7, 0.1)
#: Pseudo-votes of a labeller in each class, good and bad, and the share of them that is bad.
PSEUDO_VOTES, PSEUDO_BAD = (10.0, 2.0), (0.05, 0.25)
WINDOW = 8
_ROWS = 256
_SYMBOL, _UPPER, _LOWER, _DIGIT, _STOP, _BANG, _BAR, _BEYOND = range(8)
_CLASS = np.full(256, _SYMBOL, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _BEYOND
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
_CLASS[ord("!")], _CLASS[ord("|")] = _BANG, _BAR
_SPACES = np.array([9, 10, 11, 12, 13, 32])


@dataclass
class Texts:
    """A run of texts: their words and what labellers and features need of them."""

    counts: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    shapes: np.ndarray
    again: np.ndarray
    stutter: np.ndarray
    classes: np.ndarray
    letters: np.ndarray


def _texts(raw: np.ndarray, at: np.ndarray) -> Texts:
    h, counts, first, last = words(raw, at)
    n = len(counts)
    rows = np.repeat(np.arange(n), counts)
    again, stutter = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    for k in range(1, min(WINDOW, len(h) - 1) + 1 if len(h) else 1):
        same = (h[k:] == h[:-k]) & (rows[k:] == rows[:-k])
        again[k:] |= same
        if k == 1:
            stutter[k:] = same
    cls = _CLASS[raw]
    shapes = cls[first] * 128 + cls[np.maximum(last - 1, first)] * 16 + cls[last] * 2 + again if len(h) else np.zeros(0, dtype=np.int64)
    cls[np.isin(raw, _SPACES)] = 8
    classes = np.zeros((n, 9))
    full = np.flatnonzero(np.diff(at) > 0)
    for c in range(8):
        if len(full):
            classes[full, c] = np.add.reduceat((cls == c).astype(np.int32), at[full])
    return Texts(counts, h, rows, shapes, again, stutter, classes, np.bincount(rows, weights=last - first + 1, minlength=n))


def votes(t: Texts) -> np.ndarray:
    """(n, labellers) of ABSTAIN, GOOD, BAD."""
    n = np.maximum(t.counts, 1)
    solid = np.maximum(t.classes[:, :8].sum(axis=1), 1)
    of = lambda flag: np.bincount(t.rows, weights=flag, minlength=len(n)) / n
    cased = t.classes[:, _UPPER] + t.classes[:, _LOWER]
    first, last = t.shapes // 128, t.shapes // 2 % 8
    ends_in_sign = (last == _SYMBOL) | (last == _BAR)

    def judge(value, good, bad, when=None):
        out = np.where(bad(value), BAD, np.where(good(value), GOOD, ABSTAIN))
        return np.where(t.counts < 5 if when is None else (t.counts < 5) | ~when, ABSTAIN, out)

    columns = (
        judge(t.classes[:, _SYMBOL] / solid, lambda v: v < 0.02, lambda v: v > 0.10),
        judge(t.classes[:, _BAR] / n, lambda v: v < 0.03, lambda v: v > 0.15),
        judge(t.classes[:, _UPPER] / np.maximum(cased, 1), lambda v: v < 0.2, lambda v: v > 0.5, cased >= 20),
        judge(t.classes[:, _BANG] / n, lambda v: v < 0.1, lambda v: v > 0.3),
        judge(of(t.again), lambda v: v < 0.35, lambda v: v > 0.6),
        judge(of(t.stutter), lambda v: v < 0.05, lambda v: v > 0.2),
        judge(t.classes[:, _STOP] / n, lambda v: (v > 0.03) & (v < 0.5), lambda v: v < 0.005, t.counts >= 20),
        judge(t.letters / n, lambda v: (v > 2.5) & (v < 9), lambda v: v > 12),
        judge(of(ends_in_sign), lambda v: v < 0.05, lambda v: v > 0.2),
        judge(of(ends_in_sign & ((first == _SYMBOL) | (first == _BAR))), lambda v: v < 0.03, lambda v: v > 0.1),
        judge(t.counts, lambda v: v > 60, lambda v: v < 20),
    )
    return np.stack(columns, axis=1)


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def _count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
    for batch in batches:
        for _, _, raw, at in slices(batch.column("text")):
            total += np.bincount(patterns(votes(_texts(raw, at))), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pattern", "n"])


def posteriors(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """pattern -> P(good), and P(bad vote | class, a vote) of each labeller (labellers, 2): class 0 is good.

    An abstention says nothing.
    """
    keys = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = keys[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad, good = (v == BAD).astype(float), (v == GOOD).astype(float)
    post = np.array(START)[np.minimum(bad.sum(axis=1).astype(int), 2)]
    pseudo, share = np.array(PSEUDO_VOTES)[:, None], np.array(PSEUDO_BAD)[:, None]
    for _ in range(rounds):
        weight = np.stack([n * post, n * (1 - post)])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        rate = ((weight @ bad + pseudo * share) / (weight @ (bad + good) + pseudo)).T
        log = np.log(prior)[:, None] + (bad @ np.log(rate) + good @ np.log(1 - rate)).T
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), rate


def features(t: Texts) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, dense rows) for runs of texts: square roots of shares of hashed words and of shapes."""
    n = len(t.counts)
    index = np.concatenate(((t.hashes >> np.uint64(20)).astype(np.int64) % WORD_FEATURES, WORD_FEATURES + t.shapes))
    rows = np.concatenate((t.rows, t.rows))
    ends = np.concatenate(([0], np.cumsum(t.counts)))
    half = len(t.rows)
    for first in range(0, n, _ROWS):
        end = min(n, first + _ROWS)
        own = np.r_[ends[first] : ends[end], half + ends[first] : half + ends[end]]
        x = np.bincount((rows[own] - first) * FEATURES + index[own], minlength=(end - first) * FEATURES).reshape(end - first, FEATURES)
        yield first, np.sqrt(x / np.maximum(t.counts[first:end, None], 1))


def fit(rows: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Logistic regression on soft targets by Adam over all rows; the last weight is the bias."""
    n = len(target)
    w, m, s = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[index] * value, minlength=n) + w[-1], -30, 30)))
        error = (p - target) / max(n, 1)
        g = np.append(np.bincount(index, weights=error[rows] * value, minlength=FEATURES), error.sum()) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, raw, at in slices(batch.column("text")):
            t = _texts(raw, at)
            pattern = patterns(votes(t))
            for first, x in features(t):
                index = [np.flatnonzero(row) for row in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pattern[first : first + len(x)]), pa.array([i.astype("<i4").tobytes() for i in index]), pa.array([x[k, i].astype("<f4").tobytes() for k, i in enumerate(index)])],
                    ["pattern", "index", "value"],
                )


def learn(docs: DataFrame) -> np.ndarray:
    """Weights of the scorer."""
    counts = {r["pattern"]: r["n"] for r in docs.select("text").mapInArrow(_count_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return np.zeros(FEATURES + 1)
    post, _ = posteriors(counts)
    share = TRAINING_ROWS / total
    sample = docs.sample(fraction=share, seed=7) if share < 1 else docs
    rows = sample.select("text").mapInArrow(_training, "pattern long, index binary, value binary").collect()
    index = [np.frombuffer(r["index"], "<i4") for r in rows]
    at = np.repeat(np.arange(len(rows)), [len(i) for i in index])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    value = join([np.frombuffer(r["value"], "<f4") for r in rows], "<f4").astype(float)
    return fit(at, join(index, "<i4").astype(np.int64), value, np.array([post[r["pattern"]] for r in rows]))


def _quality(t: Texts, weights: np.ndarray) -> np.ndarray:
    found = [1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) for _, x in features(t)]
    return np.concatenate(found) if found else np.zeros(0)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, quality (0 to 1), kept."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_quality(_texts(raw, at), weights) for _, _, raw, at in slices(batch.column("text"))]
            quality = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(quality), pa.array(quality >= THRESHOLD)], ["doc_id", "quality", "kept"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, quality double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text is of low quality; all columns as they were."""
    weights = learn(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_quality(t, weights) >= THRESHOLD for _, _, raw, at in slices(batch.column("text")) for t in [_texts(raw, at)]]
            yield batch.filter(pa.array(np.concatenate(kept) if kept else np.zeros(0, dtype=bool)))

    return docs.mapInArrow(keep, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, learn(docs))

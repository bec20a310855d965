"""Toxicity by noisy-channel deobfuscation.

Training, from labelled rows outside the held-out part:
1. Words of plain letters that occur in many toxic and few clean training texts are the lexicon. Copies must not make a
   text's rare words look like that, so texts that share the least hash of their other words count once.
2. A character trigram model is counted over every text of the corpus, and interpolated with the lexicon's own trigrams.
3. A logistic model weighs the lexicon's words.

Scoring: a chunk that isn't plain letters, and each run of single characters set apart by spaces, spans a lattice: leetspeak signs may be the letters they stand for, separators may be dropped, and
repeated characters may stand once or twice. Viterbi picks the likeliest letters under the character model and the
channel's costs; the restored words are looked up in the lexicon (without repetitions), and the logistic model scores what
was found. Runs of `!` and `$` at a chunk's ends are read as letters and as decoration. A chunk whose plain letters no word
of the lexicon holds in their order isn't decoded, as no decoding drops a plain letter, nor one that has more letters in any
decoding than the longest word; else its length is of no matter, as a run of one sign is one step.

A text's score uses nothing but the text. Edge cases: null and empty texts get the score of a text without findings;
without toxic training rows the lexicon is empty and scores are the base rate, 0 without any training row; repeated rows
are scored each; labels that are null or without a document are ignored, and of contradicting labels of one doc_id the toxic one
counts; extra columns are ignored by `score_texts` and
kept by `drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, ship, table
from .known import Known
from .shingles import slices, words
from .tokens import in_slices

#: At most so many labelled rows are learnt from: those with the least hash of doc_id.
TRAINING_ROWS = 40_000
#: Chunks that a task remembers; beyond, it learns them anew.
MOST_CHUNKS = 3_000_000
#: A word of the lexicon occurs in so many toxic training texts at least, in this share of them, and in so many times fewer clean ones.
LEAST_TEXTS, LEAST_SHARE, ODDS = 3, 0.002, 5
THRESHOLD = 0.3
HELD_OUT = 2
#: The letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs that may stand between letters for nothing.
SEPARATORS = "*.-_~'`^,:;/\\#%&=\"?)]}[{<>|!+("
#: Log costs of the channel: a sign for a letter, a dropped separator, a dropped sign that could be a letter, one repetition dropped.
SIGN_COST, DROP_COST, UNREAD_COST, REPEAT_COST = -0.7, -0.3, -3.0, -0.2
#: A masked letter: any vowel, at this cost.
MASK, MASKED, MASK_COST = "*", "aeiou", -2.0
N = 28  # a-z are 1 to 26, other letters 27, edges of words 0
_CODE = np.zeros(256, dtype=np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27

Model = tuple[dict[str, float], float, np.ndarray]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def plain_words(raw: bytes) -> set[str]:
    """Distinct lower-case words of letters alone; signs at a chunk's ends don't count."""
    found = set()
    for chunk in set(raw.decode("utf-8", "replace").lower().split()):
        word = chunk.strip(".,;:!?\"'()[]")
        if word.isalpha():
            found.add(word)
    return found


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, group): group is the least hash of the text's other words."""
    for batch in batches:
        marks = batch.column("toxic").to_pylist()
        for first, texts in in_slices(batch.column("text")):
            words, toxic, groups = [], [], []
            for mark, raw in zip(marks[first:], texts, strict=False):
                own = sorted(plain_words(raw))
                words += own
                toxic += [bool(mark)] * len(own)
                hashes = [_hash(w) for w in own]
                least, second = (sorted(hashes)[:2] + [0, 0])[:2]
                groups += [second if h == least else least for h in hashes]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(toxic, pa.bool_()), pa.array(groups, pa.int64())], ["word", "toxic", "group"])


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def _weights(rows: np.ndarray, words_: np.ndarray, toxic: np.ndarray, times: np.ndarray, n_words: int) -> tuple[list[float], float]:
    """Logistic regression with a small ridge, by Newton's method; conjugate gradients solve each step, so the matrix of
    words by words is never made. Text rows[k] holds word words_[k]; texts count `times` each."""
    n = len(toxic)
    ridge = np.full(n_words + 1, 0.3)
    ridge[-1] = 1e-3

    def total(beta):
        return np.bincount(rows, weights=beta[words_], minlength=n) + beta[-1]

    def by_word(v):
        return np.append(np.bincount(words_, weights=v[rows], minlength=n_words), v.sum())

    beta = np.zeros(n_words + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(total(beta), -30, 30)))
        w = times * p * (1 - p)
        left = by_word(times * (toxic - p)) - ridge * beta
        step, side, size = np.zeros_like(beta), left.copy(), left @ left
        least = 1e-20 * size
        for _ in range(4 * len(beta)):
            if size <= least:
                break
            turned = by_word(w * total(side)) + (ridge + 1e-9) * side
            far = size / (side @ turned)
            step += far * side
            left = left - far * turned
            before, size = size, left @ left
            side = left + size / before * side
        beta += np.clip(step, -3, 3)
    return beta[:-1].tolist(), float(beta[-1])


def learn_lexicon(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Word -> weight, and the bias. docs(doc_id, text), labels(doc_id, toxic)."""
    rows = labels.filter("toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = saved(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS))
    training = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")
    rows = training.mapInArrow(_word_rows, "word string, toxic boolean, group long").distinct()
    counts = rows.groupBy("word").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * sample.filter("toxic = 1").count()))
    top = counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= ODDS * F.col("clean"))).select("word")
    words_ = sorted(r["word"] for r in top.collect())
    index = {w: i for i, w in enumerate(words_)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[w] for w in plain_words(raw) & index.keys()) for _, texts in in_slices(batch.column("text")) for raw in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "found"])

    # Texts with the same words of the lexicon and the same label are one row with their number.
    texts = training.mapInArrow(incidence, "toxic int, found array<int>").groupBy("toxic", "found").agg(F.count(F.lit(1)).alias("times")).orderBy("toxic", "found").collect()
    if not texts:
        return {}, -30.0
    sizes = [len(r["found"]) for r in texts]
    weights, bias = _weights(
        np.repeat(np.arange(len(texts)), sizes),
        np.array([i for r in texts for i in r["found"]], dtype=np.int64),
        np.array([r["toxic"] for r in texts], dtype=float),
        np.array([r["times"] for r in texts], dtype=float),
        len(words_),
    )
    return dict(zip(words_, weights, strict=True)), bias


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N**3, dtype=np.int64)
    for batch in batches:
        for _, _, raw, _ in slices(batch.column("text")):
            c = _CODE[np.concatenate((np.zeros(2, dtype=np.uint8), raw, np.zeros(1, dtype=np.uint8)))]
            total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def character_model(docs: DataFrame, lexicon: dict[str, float]) -> np.ndarray:
    """log P(c | a, b) of letters and word ends: all texts' trigrams and the lexicon's, half and half, smoothed by bigrams."""
    rows = docs.select("text").mapInArrow(_count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    corpus, own = np.zeros((N, N, N)), np.zeros((N, N, N))
    for r in rows:
        corpus.flat[r["cell"]] = r["n"]
    for word in lexicon:
        c = [0, 0, *(_CODE[b] for b in word.encode()), 0]
        for i in range(2, len(c)):
            own[c[i - 2], c[i - 1], c[i]] += 1

    def conditional(counts: np.ndarray) -> np.ndarray:
        low = counts.sum(axis=0) + 0.1
        low /= low.sum(axis=1, keepdims=True)
        return (counts + 0.5 * low[None]) / (counts.sum(axis=2, keepdims=True) + 0.5)

    return np.log(0.5 * conditional(corpus) + 0.5 * conditional(own)) if lexicon else np.log(conditional(corpus))


def lattice(chunk: str) -> list[list[tuple[str, float]]]:
    """For each run of one character: the strings it may stand for, with log costs."""
    out = []
    for m in _RUN.finditer(chunk):
        sign, times = m[1], len(m[0])
        options = []
        letters = sign if sign.isalpha() else LEET.get(sign, "")
        cost = 0.0 if sign.isalpha() else SIGN_COST
        for letter in letters:
            options.append((letter, cost + REPEAT_COST * (times - 1)))
            if times > 1:
                options.append((letter * 2, 2 * cost + REPEAT_COST * (times - 2)))
        if sign == MASK and times == 1:
            options += [(letter, MASK_COST) for letter in MASKED]
        if sign in SEPARATORS or not letters:
            options.append(("", (UNREAD_COST if letters else DROP_COST) * times))
        out.append(options)
    return out


def decode(chunk: str, model: np.ndarray) -> str:
    """The likeliest letters of a chunk: Viterbi over pairs of last letters, each with a link to the letters before."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(chunk):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, before) in best.items():
            for letters, cost in options:
                s, x, y = score + cost, a, b
                for ch in letters:
                    code = ord(ch) - 96 if "a" <= ch <= "z" else 27
                    s += model[x, y, code]
                    x, y = y, code
                old = after.get((x, y))
                if old is None or s > old[0]:
                    after[x, y] = (s, (before, letters) if letters else before)
        best = after
    _, link = max(((s + model[a, b, 0], link) for (a, b), (s, link) in best.items()), key=lambda x: x[0], default=(0.0, None))
    out = []
    while link:
        link, letters = link
        out.append(letters)
    return "".join(reversed(out))


def least_letters(chunk: str) -> int:
    """So many letters, without repetitions, any decoding of a chunk has at least: of runs that can't be dropped, those with no letter in common are different ones."""
    n, common = 0, set()
    for sign in (m[1] for m in _RUN.finditer(chunk)):
        letters = {sign} if sign.isalpha() else set() if sign in SEPARATORS else set(LEET.get(sign, ""))
        if letters:
            common &= letters
            if not common:
                n, common = n + 1, letters
    return n


_RUN = re.compile(r"(.)\1*", re.DOTALL)
_TRIM = ".,;:?\"')]}([{"
#: Single characters set apart: four at least, each a letter, digit or sign.
_SPACED = re.compile(rb"(?<![^ \t\r\n])[a-zA-Z0-9@$!|+*](?:[ \t]+[a-zA-Z0-9@$!|+*]){3,}(?![^ \t\r\n])")


def skeleton(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


#: Signs that stand for no letter.
_DROPPED = "#%&=~^_<>{}\\/`,.:;?\"')[]-"


def _ends(runs: list[str]) -> tuple[int, list[int]]:
    """How many runs at the beginning are no letters or may be none (runs of `!` and `$`), and where the rest may begin: after them, or at the first or last that may be letters."""
    n = 0
    while n < len(runs) and (not (runs[n][0].isalpha() or runs[n][0] in LEET or runs[n] == MASK) or (runs[n][0] in "!$" and len(runs[n]) > 1)):
        n += 1
    signs = [i for i in range(n) if runs[i][0] in "!$"]
    return n, [n, *signs[:1], *signs[-1:]]


def readings(part: str) -> set[str]:
    """A part without the signs at its ends that any decoding drops; runs of `!` and `$` there are letters in some readings and dropped in others."""
    part = part.strip(_DROPPED)
    if not part or (part[0] not in "!$*" and part[-1] not in "!$*"):
        return {part}
    runs = [m[0] for m in _RUN.finditer(part)]
    n, first = _ends(runs)
    _, last = _ends(runs[:n - 1 if n else None:-1])
    return {"".join(runs[i : len(runs) - j]) for i in first for j in last}


class Finder:
    """Finds the lexicon's words in a text, restored where they are disguised."""

    def __init__(self, lexicon: dict[str, float], model: np.ndarray):
        self.lexicon, self.model = lexicon, model
        self.skeletons = {skeleton(w): w for w in lexicon}
        self.longest = max(map(len, self.skeletons), default=0)
        self.having: dict[str, set[str]] = {}
        for s in self.skeletons:
            for letter in s:
                self.having.setdefault(letter, set()).add(s)
        self.shortest = min(map(len, lexicon), default=1)
        self.known = Known(1)  # of a chunk: the place of its set in `sets`
        self.sets: list[frozenset[str]] = [frozenset()]

    def word(self, x: str) -> str | None:
        """The word of the lexicon that x is a disguise of. Decoding keeps letters, and only drops or doubles repeated ones."""
        if x.isalpha():
            return self.skeletons.get(skeleton(x))
        letters = skeleton("".join(c for c in x if c.isalpha()))
        if letters:
            fit = set.intersection(*(self.having.get(c, set()) for c in set(letters)))
            if not any(all(c in rest for c in letters) for rest in map(iter, fit)):
                return None
        return self.skeletons.get(skeleton(decode(x, self.model))) if least_letters(x) <= self.longest else None

    def restored(self, chunk: str) -> set[str]:
        """Words of the lexicon that a chunk (lower case, without spaces) holds."""
        if chunk.isalpha():
            w = chunk if chunk in self.lexicon else self.word(chunk) if self.shortest <= len(chunk) else None
            return {w} if w else set()
        found = set()
        for part in {chunk, chunk.strip(_TRIM)} | set(re.split(r"[-/_.,;:&]+", chunk)):
            word = part.strip("!.,;:?\"'()[]")
            if word in self.lexicon:
                found.add(word)
            elif self.shortest <= len(part) and sum(c.isalnum() or c in LEET or c == MASK for c in part) >= self.shortest:
                found.update(w for x in readings(part) | {word} if (w := self.word(x)))
        return found

    def _learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.known) > MOST_CHUNKS:
            self.known.clear()
            self.sets = [frozenset()]
        at = np.zeros(len(chunks), dtype=np.int32)
        for i, chunk in enumerate(chunks):
            found = self.restored(chunk.decode("utf-8", "replace").lower())
            if found:
                at[i] = len(self.sets)
                self.sets.append(frozenset(found))
        self.known.add(hashes, at[None])

    def texts(self, raw: np.ndarray, at: np.ndarray) -> list[set[str]]:
        """The words found in each of the texts raw[at[i] : at[i + 1]]. Chunks are hashed for the whole slice, and only those not seen yet are decoded."""
        out: list[set[str]] = [set() for _ in range(len(at) - 1)]
        h, counts, first, last = words(raw, at)
        if not self.lexicon or not len(h):
            return out
        hashes, one, which = np.unique(h, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(self.known.find(hashes)[0] < 0)
        data = raw.tobytes()
        if len(fresh):
            if len(self.known) + len(fresh) > MOST_CHUNKS:
                fresh = np.arange(len(hashes))
            self._learn(hashes[fresh], [data[a : b + 1] for a, b in zip(first[one[fresh]].tolist(), last[one[fresh]].tolist(), strict=True)])
        places = self.known.find(hashes)[0][which]
        text = np.repeat(np.arange(len(counts)), counts)
        for i in np.flatnonzero(places > 0):
            out[text[i]] |= self.sets[places[i]]
        # Four single characters in a row, all of one text.
        single = first == last
        four = single[:-3] & single[1:-2] & single[2:-1] & single[3:] & (text[:-3] == text[3:])
        for i in np.unique(text[:-3][four]) if len(four) else ():
            for m in _SPACED.finditer(data[at[i] : at[i + 1]]):
                letters = skeleton(decode(b"".join(m[0].split()).decode().lower(), self.model))
                out[i].update(w for s, w in self.skeletons.items() if len(s) >= 4 and s in letters)
        return out

    def text(self, raw: bytes) -> set[str]:
        return self.texts(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0]


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, list[set[str]], list[float]]]:
    """Batches with the words found in each text, and the texts' scores."""
    lexicon, bias, characters = model
    finder = Finder(lexicon, characters)
    for batch in batches:
        found = [f for _, _, raw, at in slices(batch.column("text")) for f in finder.texts(raw, at)]
        yield batch, found, [1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(lexicon[w] for w in sorted(f)))))) for f in found]


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, found (the lexicon's words, sorted)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found, scores in _scored(batches, model):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["doc_id", "score", "found"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, found array<string>")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    lexicon, bias = learn_lexicon(docs, labels)
    return lexicon, bias, character_model(docs, lexicon)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text scores THRESHOLD or more; all columns as they were. Each row is judged by its own text, whatever its doc_id, in the pass that scores it."""
    model = learn(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, scores in _scored(batches, model):
            yield batch.filter(pa.array([s < THRESHOLD for s in scores], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.array_join("found", " ").alias("found"))

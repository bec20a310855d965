"""Token ids of whole texts with the tokenizers library, each distinct run of characters encoded once.

The vocabulary used here (word_bpe) drops white space and never joins across it: its normaliser is NFC, white space to one
space, lower case, and its splitter takes a contraction, a run of letters, one digit, or a run of anything else. So the ids
of a text are those of its runs, one after the other, where a run ends at ASCII white space and between a letter or digit
and an ASCII sign other than the apostrophe (which may begin a contraction). Runs are found and hashed with numpy for a
whole slice of texts; a run's ids are looked up by its 64-bit hash, and only runs not seen yet go to the library. Two of
10**6 different runs share a hash with probability 3e-8.

A tokenizer with another normaliser, splitter or special tokens than these encodes whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .known import Known
from .shingles import run_hashes, slices

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Remembered runs, and their ids: beyond either all are forgotten and learnt anew, so memory is bounded.
MOST_RUNS, MOST_IDS = 3_000_000, 16_000_000
#: The normaliser and the splitter for which runs may be encoded one by one.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_SPACE, _LETTER, _SIGN = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
for _b in range(33, 127):
    (_LETTER if chr(_b).isalnum() else _SIGN)[_b] = True
_SIGN[ord("'")] = False
#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on.
_KEPT = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_ALPHABET = {b: b for b in _KEPT} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_KEPT))}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _splits_into_runs(settings: dict) -> bool:
    """Whether a tokenizer's ids are those of its runs."""
    normal, parts = settings.get("normalizer") or {}, (settings.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    model = settings.get("model") or {}
    return (
        normal.get("normalizers") == _NORMALIZERS
        and len(parts) == 2
        and parts[0] == {"type": "Split", "pattern": {"Regex": _SPLITTER}, "behavior": "Removed", "invert": True}
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("add_prefix_space")
        and not parts[1].get("use_regex")
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and all("<|" in t["content"] for t in settings.get("added_tokens", []))
    )


class TextEncoder:
    """Texts -> their ids as little-endian unsigned 32-bit integers, without the end id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_runs = _splits_into_runs(json.load(f))
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.pool, self.filled = np.zeros(1 << 16, dtype="<u4"), 0
        self.known = Known(2)  # start in the pool, number of ids

    def _plain(self, run: bytes) -> str | None:
        """A run of letters of one pre-token in the byte-level alphabet, or None."""
        if run.isalpha():
            return run.lower().decode()
        text = run.decode("utf-8", "replace")
        if text.isalpha() and max(text) <= "ÿ" and not set(text) & {"ª", "µ", "º"}:
            return text.lower().encode().decode("latin-1").translate(_ALPHABET)
        return None

    def ids_of(self, runs: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(runs)
        rest = []
        tokenize = self.model.tokenize
        for i, run in enumerate(runs):
            text = self._plain(run)
            if text is None:
                rest.append(i)
            else:
                out[i] = [t.id for t in tokenize(text)]
        if rest:
            found = self.tokenizer.encode_batch_fast([runs[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False)
            for i, e in zip(rest, found, strict=True):
                out[i] = e.ids
        return out

    def _learn(self, hashes: np.ndarray, runs: list[bytes]) -> None:
        """hashes ascend."""
        ids = self.ids_of(runs)
        size = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        total = int(size.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.filled], np.zeros(max(self.filled, total) + total, dtype="<u4")))
        self.pool[self.filled : self.filled + total] = np.fromiter((x for i in ids for x in i), dtype="<u4", count=total)
        self.known.add(hashes, np.stack((self.filled + np.cumsum(size) - size, size)))
        self.filled += total

    def encode_slice(self, raw: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of the texts raw[at[i] : at[i + 1]]."""
        if not self.by_runs or b"<|" in raw.tobytes():  # a special token isn't split, and keeps its case
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        first, last = runs(raw, at)
        if not len(first):
            return [b""] * (len(at) - 1)
        hashes, one, which = np.unique(run_hashes(raw, first, last), return_index=True, return_inverse=True)
        if len(self.known) > MOST_RUNS or self.filled > MOST_IDS:
            self._forget()
        start, size = self.known.find(hashes)
        fresh = np.flatnonzero(start < 0)
        if len(fresh):
            data = raw.tobytes()
            self._learn(hashes[fresh], [data[a : b + 1] for a, b in zip(first[one[fresh]].tolist(), last[one[fresh]].tolist(), strict=True)])
            start, size = self.known.find(hashes)
        n = size[which].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(start[which] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[np.searchsorted(first, at)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def runs(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each run of the texts raw[at[i] : at[i + 1]]."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid, sign, letter = ~_SPACE[raw], _SIGN[raw], _LETTER[raw]
    # Two-byte letters of Latin-1 (U+00C0 to U+00FF but the signs × and ÷).
    lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
    letter[lead] = letter[lead + 1] = True
    cut = np.zeros(n + 1, dtype=bool)
    cut[at] = True
    cut[1:n] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:n]
    ends[:-1] &= ~solid[1:] | cut[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encoded(path: str, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, ids of each text) for runs of texts of about a megabyte."""
    own = encoder(path)
    for first, _, raw, at in slices(texts):
        yield first, own.encode_slice(raw, at)


def in_slices(texts: Iterable, size: int = 1 << 20):
    """(first, texts) for runs of texts (Arrow strings, null empty) of about `size` bytes."""
    first, run, total = 0, [], 0
    for i, t in enumerate(texts):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        run.append(raw)
        total += len(raw)
        if total >= size:
            yield first, run
            first, run, total = i + 1, [], 0
    if run:
        yield first, run

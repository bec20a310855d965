"""Adaptive context-mixing range coder for token ids, run over many independent blocks in step.

Each block is coded from a fresh state. An order-2 and an order-1 context propose the id that followed them last; the
order-0 prediction is a table of shares that all blocks of a call have in common (`shares`). An id is one symbol of the
mixture of the three: its share times the weight of order 0, plus the weight of each context that proposes it. How sure the
contexts are and whether they agree selects a block's weights, which move towards each prediction's part in what came.

Shares add up to 2**20 and weights to 2**10. The range coder keeps 48 bits, puts out 16 bits at a time, and carries into
what it has put out. One numpy step codes the same position of all blocks, so the cost per id falls with the number of blocks.
"""

from __future__ import annotations

import numpy as np

SHARE_BITS, WEIGHT_BITS = 20, 10
SHARES, WEIGHTS = 1 << SHARE_BITS, 1 << WEIGHT_BITS
TOTAL_BITS = SHARE_BITS + WEIGHT_BITS
RATE = 5
SLOTS1, SLOTS2 = 1 << 10, 1 << 11
#: How sure a context is takes two bits.
SURE = 3
_48, _LOW, _WORD = (1 << 48) - 1, 1 << 32, (1 << 16) - 1


def shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, the most frequent first, and the share of each, at least 1."""
    count = np.bincount(ids)
    found = np.flatnonzero(count)
    found = found[np.argsort(-count[found], kind="stable")]
    if not len(found):
        return found, count
    if len(found) > 1 << 16:
        raise ValueError("a table holds 65536 different ids")
    share = 1 + count[found] * (SHARES - len(found)) // count.sum()
    share[0] += SHARES - share.sum()
    return found, share


def _even() -> tuple[np.ndarray, np.ndarray]:
    return np.arange(1 << 16), np.full(1 << 16, SHARES >> 16)


class _Models:
    """State of the predictions of all blocks. Ids are places in the table of shares."""

    def __init__(self, lanes: int):
        self.next1, self.next2 = np.zeros(lanes * SLOTS1, np.uint32), np.zeros(lanes * SLOTS2, np.uint32)
        self.part1, self.part2 = (np.full(lanes * (SURE + 1) ** 2 * 2, WEIGHTS, np.int32) for _ in range(2))
        self.hash, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        lane = np.arange(lanes)
        self.base1, self.base2, self.base = lane * SLOTS1, lane * SLOTS2, lane * ((SURE + 1) ** 2 * 2)

    def propose(self, n: int):
        """Of the first n blocks: proposals of order 1 and 2, and weights of order 1, 2 and 0."""
        h = self.last[:n] * 0x9E3779B1
        self.i1 = self.base1[:n] + ((h >> 12) & (SLOTS1 - 1))
        self.i2 = self.base2[:n] + (((h ^ self.hash[:n]) >> 13) & (SLOTS2 - 1))
        self.hash[:n] = self.last[:n] * 0x85EBCA6B
        self.s1, self.s2 = self.next1[self.i1].astype(np.int64), self.next2[self.i2].astype(np.int64)
        a1, a2 = self.s1 >> 2, self.s2 >> 2
        self.row = self.base[:n] + (((self.s2 & 3) << 3) | ((self.s1 & 3) << 1) | (a1 == a2))
        self.p1, self.p2 = self.part1[self.row].astype(np.int64), self.part2[self.row].astype(np.int64)
        # At most 994 of 1024 together, as the parts are at most 2**16.
        w1, w2 = (self.p1 * 62 >> 12) + 1, (self.p2 * 62 >> 12) + 1
        return a1, a2, w1, w2, WEIGHTS - w1 - w2

    def learn(self, n: int, ids, hit1, hit2, w1, w2, size) -> None:
        """size: of the ids in the mixture. Each prediction's part in it is a share of 2**16."""
        g, fresh = (1 << 46) // size, ids << 2
        for part, was, hit, w in ((self.part1, self.p1, hit1, w1), (self.part2, self.p2, hit2, w2)):
            part[self.row] = (was + (((w * hit * g >> 10) - was) >> RATE)).astype(np.int32)
        for follow, i, s, hit in ((self.next1, self.i1, self.s1, hit1), (self.next2, self.i2, self.s2, hit2)):
            sure = s & 3
            follow[i] = np.where(hit, s + (sure < SURE), np.where(sure > 0, s - 1, fresh)).astype(np.uint32)
        self.last[:n] = ids


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.out, self.at = np.zeros((lanes, words), np.uint16), np.zeros(lanes, np.int64)

    def put(self, n: int, lo: np.ndarray, size: np.ndarray) -> None:
        """Of the first n blocks: where a symbol begins, and its size."""
        r = self.range[:n] >> TOTAL_BITS
        low, size = self.low[:n], r * size
        low += r * lo
        over = low > _48
        if over.any():
            self._carry(np.flatnonzero(over))
            low &= _48
        who = np.flatnonzero(size < _LOW)
        while len(who):
            own = low[who]
            at = self.at[who]
            self.out[who, at] = own >> 32
            self.at[who] = at + 1
            low[who] = (own << 16) & _48
            size[who] <<= 16
            who = who[size[who] < _LOW]
        self.range[:n] = size

    def _carry(self, who: np.ndarray) -> None:
        at = self.at[who] - 1
        while len(who):
            self.out[who, at] += np.uint16(1)
            more = self.out[who, at] == 0
            who, at = who[more], at[more] - 1

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[np.arange(len(self.at)), self.at] = (self.low >> shift) & _WORD
            self.at += 1
        return [self.out[i, : self.at[i]].astype("<u2").tobytes() for i in range(len(self.at))]


class _Reader:
    def __init__(self, blocks: list[bytes]):
        longest = max(map(len, blocks), default=0) // 2
        self.words = np.zeros((len(blocks), longest + 4), np.uint16)
        for i, b in enumerate(blocks):
            self.words[i, : len(b) // 2] = np.frombuffer(b, "<u2")
        first = self.words[:, :3].astype(np.int64)
        self.code = (first[:, 0] << 32) | (first[:, 1] << 16) | first[:, 2]
        self.range, self.at = np.full(len(blocks), 1 << 48, np.int64), np.full(len(blocks), 3)

    def value(self, n: int) -> np.ndarray:
        """Of the first n blocks: a place within the symbol that comes."""
        self.r = self.range[:n] >> TOTAL_BITS
        return np.minimum(self.code[:n] // self.r, (1 << TOTAL_BITS) - 1)

    def skip(self, n: int, lo: np.ndarray, size: np.ndarray) -> None:
        code, size = self.code[:n], self.r * size
        code -= self.r * lo
        who = np.flatnonzero(size < _LOW)
        while len(who):
            at = self.at[who]
            code[who] = (code[who] << 16) | self.words[who, at]
            self.at[who] = at + 1
            size[who] <<= 16
            who = who[size[who] < _LOW]
        self.range[:n] = size


def _lanes_at(lengths: list[int]):
    """(step, number of blocks that have an id there); lengths fall."""
    if any(a < b for a, b in zip(lengths, lengths[1:], strict=False)):
        raise ValueError("blocks must be in order of falling length")
    n = len(lengths)
    for t in range(lengths[0] if lengths else 0):
        while lengths[n - 1] <= t:
            n -= 1
        yield t, n


def _symbol(ids, a1, a2, w1, w2, w0, begin, share):
    """Which contexts propose the ids; where they begin in the mixture, and their size there."""
    hit1, hit2 = a1 == ids, a2 == ids
    lo = w0 * begin[ids] + ((w1 * (a1 < ids) + w2 * (a2 < ids)) << SHARE_BITS)
    return hit1, hit2, lo, w0 * share[ids] + ((w1 * hit1 + w2 * hit2) << SHARE_BITS)


def encode_blocks(blocks: list[np.ndarray], table: tuple[np.ndarray, np.ndarray] | None = None) -> list[bytes]:
    """Blocks in order of falling length, of ids in a table of shares (without one: of ids below 2**16)."""
    known, share = table or _even()
    lengths = [len(b) for b in blocks]
    place = np.zeros(int(known.max(initial=0)) + 1, np.uint16)
    place[known] = np.arange(len(known))
    ids_at = np.zeros((max(lengths, default=0), len(blocks)), np.uint16)
    for i, b in enumerate(blocks):
        ids_at[: len(b), i] = place[b]
    begin = np.cumsum(share) - share
    models, out = _Models(len(blocks)), _Writer(len(blocks), 2 * max(lengths, default=0) + 8)
    for t, n in _lanes_at(lengths):
        ids = ids_at[t, :n].astype(np.int64)
        a1, a2, w1, w2, w0 = models.propose(n)
        hit1, hit2, lo, size = _symbol(ids, a1, a2, w1, w2, w0, begin, share)
        out.put(n, lo, size)
        models.learn(n, ids, hit1, hit2, w1, w2, size)
    return out.finish()


def decode_blocks(blocks: list[bytes], lengths: list[int], table: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    known, share = table or _even()
    begin, owner = np.cumsum(share) - share, np.repeat(np.arange(len(known), dtype=np.uint16), share)
    models, source = _Models(len(blocks)), _Reader(blocks)
    ids_at = np.zeros((max(lengths, default=0), len(blocks)), np.uint16)
    for t, n in _lanes_at(lengths):
        a1, a2, w1, w2, w0 = models.propose(n)
        # A context's weight lies where its id begins; without both weights, the value is one of order 0.
        value = source.value(n)
        first, m1, m2 = a1 <= a2, w1 << SHARE_BITS, w2 << SHARE_BITS
        at1, at2 = w0 * begin[a1] + m2 * ~first, w0 * begin[a2] + m1 * first
        rest = value - np.minimum(np.maximum(value - at1, 0), m1) - np.minimum(np.maximum(value - at2, 0), m2)
        ids = owner[rest // w0].astype(np.int64)
        hit1, hit2, lo, size = _symbol(ids, a1, a2, w1, w2, w0, begin, share)
        source.skip(n, lo, size)
        models.learn(n, ids, hit1, hit2, w1, w2, size)
        ids_at[t, :n] = ids
    return [known[ids_at[:length, i]] for i, length in enumerate(lengths)]

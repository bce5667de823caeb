"""Texts that are at least so alike: which of many pairs ``SequenceMatcher`` has to align.

The ratio of two texts is twice what their matching blocks hold over both lengths, and these blocks are a common subsequence. So a pair
whose longest common subsequence is too short can't reach the ratio. That is asked in three steps, each an upper bound of the next one's
figure: lengths, common letters, the common subsequence itself, for many pairs at once. Only what passes all three is aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np

#: Characters are taken modulo so many: unequal ones may count as equal, so bounds get no smaller.
CLASSES = 64
#: So many classes of two neighbouring characters.
TWOS = 256
#: Bits of a word in use; the next one takes the carry.
BITS = 63
#: Pairs gone through at once, bytes of their tables at most, and characters between two looks at what can still be reached.
PAIRS, TABLE_BYTES, LOOK = 4_096, 1 << 25, 8


class Texts:
    """Texts as classes of characters, one after the other, with the letters of each."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.codes = (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES).astype(np.uint8)
        of = np.repeat(np.arange(len(texts)), self.sizes)
        letters = np.bincount(of * CLASSES + self.codes, minlength=len(texts) * CLASSES)
        small = np.uint16 if self.sizes.max(initial=0) < 1 << 16 else np.int64
        self.letters = letters.reshape(-1, CLASSES).astype(small)
        inner = of[1:] == of[:-1]
        two = (self.codes[:-1].astype(np.int64) * 37 + self.codes[1:])[inner] % TWOS
        self.twos = np.bincount(of[1:][inner] * TWOS + two, minlength=len(texts) * TWOS).reshape(-1, TWOS).astype(small)
        self.grid = self.padded(np.arange(len(texts))) if len(texts) * self.sizes.max(initial=0) <= TABLE_BYTES else None

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """(position, text): the classes of some texts, CLASSES beyond their end."""
        sizes = self.sizes[rows]
        out = np.full((len(rows), int(sizes.max(initial=0))), CLASSES, np.uint8)
        out[np.arange(out.shape[1]) < sizes[:, None]] = self.codes[ranges(self.start[rows], sizes)]
        return np.ascontiguousarray(out.T)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after the other."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - count), count)


def subsequences(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs (i, j), -1 for those below ``least``. Bit-parallel: bits are the characters
    of a text of ``a``, and the bits that are 0 in the end are as many as the subsequence is long."""
    own, at = np.unique(i, return_inverse=True)
    words = max(1, -(-int(a.sizes[own].max(initial=0)) // BITS))
    place = ranges(np.zeros(len(own), np.int64), a.sizes[own])
    row = np.repeat(np.arange(len(own)), a.sizes[own])
    masks = np.zeros((words, len(own) * (CLASSES + 1)), np.uint64)
    np.bitwise_or.at(masks, (place // BITS, row * (CLASSES + 1) + a.codes[ranges(a.start[own], a.sizes[own])]), np.uint64(1) << (place % BITS).astype(np.uint64))
    full, top = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    sizes, at = b.sizes[j], at * (CLASSES + 1)
    codes, column = (b.padded(j), np.arange(len(j))) if b.grid is None else (b.grid[: sizes.max(initial=0)], j)
    found, live = np.full(len(i), -1, np.int64), np.arange(len(i))
    state = np.full((words, len(i)), full)
    for t in range(len(codes) + 1):
        if t % LOOK == 0 or t == len(codes):
            common = BITS * words - np.bitwise_count(state).sum(0, dtype=np.int64)
            can = common + np.maximum(sizes[live] - t, 0) >= least[live]
            if not can.all():
                live, at, column, state, common = live[can], at[can], column[can], state[:, can], common[can]
            if not len(live):
                break
            if t == len(codes):
                found[live] = common
                break
        where = at + codes[t].take(column)
        carry = np.uint64(0)
        for w in range(words):
            v = state[w]
            u = v & masks[w].take(where)
            s = v + u
            s += carry
            carry = s >> top
            v ^= u
            v |= s
            v &= full
    return found


def _maybe(a: Texts, b: Texts, lo: np.ndarray, hi: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with lo[i] <= j < hi[i] that have letters enough in common; all of one i come together."""
    by_class = np.ascontiguousarray(b.letters.T)
    many = hi - lo >= CLASSES
    some = np.flatnonzero((hi > lo) & ~many)
    for rows in np.array_split(some, max(1, int((hi - lo)[some].sum()) // 20_000)):
        i, j = np.repeat(rows, hi[rows] - lo[rows]), ranges(lo[rows], hi[rows] - lo[rows])
        ok = 2 * np.minimum(a.letters[i], b.letters[j]).sum(1, dtype=np.int64) >= least * (a.sizes[i] + b.sizes[j]) - 1e-6
        yield i[ok], j[ok]
    for i in np.flatnonzero(many):
        own, at = a.letters[i], slice(int(lo[i]), int(hi[i]))
        common = np.zeros(at.stop - at.start, by_class.dtype)
        for k in np.flatnonzero(own):
            common += np.minimum(by_class[k, at], own[k])
        j = np.flatnonzero(2 * common.astype(np.int64) >= least * (a.sizes[i] + b.sizes[at]) - 1e-6) + at.start
        yield np.full(len(j), i), j


def best_alike(x: list[str], x_group: np.ndarray, y: list[str], y_group: np.ndarray, y_ord: list, least: float) -> list[tuple[int, int, float]]:
    """(row of x, row of y, ratio): for each text of x the most alike text of y of its group, of equals the one of the smallest
    ``y_ord``, where the ratio is at least ``least``."""
    # texts of one length together: what is gone through at once has about as many words
    turn = np.argsort([len(t) for t in x], kind="stable")
    order = np.lexsort(([len(t) for t in y], y_group))
    a, b = Texts([x[k] for k in turn]), Texts([y[k] for k in order])
    x_group = x_group[turn]
    # partners by length: a range of the texts of a group
    span = max(int(a.sizes.max(initial=0)), int(b.sizes.max(initial=0))) + 3
    key = y_group[order] * span + b.sizes
    shortest = np.floor(a.sizes * least / (2 - least) - 1e-6)
    longest = np.minimum(np.ceil(a.sizes * (2 - least) / least + 1e-6) if least > 0 else span, span - 1)
    lo = np.searchsorted(key, x_group * span + np.maximum(shortest, 0).astype(np.int64))
    hi = np.searchsorted(key, x_group * span + longest.astype(np.int64), "right")
    out = []

    def align(i: np.ndarray, j: np.ndarray) -> None:
        need = np.ceil(least * (a.sizes[i] + b.sizes[j]) / 2 - 1e-6).astype(np.int64)
        # of m common characters in n, at most n - 2 m + 1 begin a block; all others follow the one they follow in both
        follow = 3 * need - a.sizes[i] - b.sizes[j] - 1
        cut = np.array_split(np.arange(len(i)), len(i) // PAIRS + 1)
        ok = np.concatenate([np.minimum(a.twos[i[k]], b.twos[j[k]]).sum(1, dtype=np.int64) >= follow[k] for k in cut])
        i, j, need = i[ok], j[ok], need[ok]
        if not len(i):
            return
        bytes_ = 8 * (CLASSES + 1) * (a.sizes[i].max(initial=0) // BITS + 1) + b.sizes[j].max(initial=0)
        step = int(max(1, min(PAIRS, TABLE_BYTES // max(1, bytes_))))
        common = np.concatenate([subsequences(a, b, i[k : k + step], j[k : k + step], need[k : k + step]) for k in range(0, len(i), step)])
        i, j, common = i[common >= 0], j[common >= 0], common[common >= 0]
        bound = np.where(a.sizes[i] + b.sizes[j] > 0, 2.0 * common / np.maximum(a.sizes[i] + b.sizes[j], 1), 1.0)
        best: tuple | None = None
        for k in np.lexsort((-bound, i)):
            r, c = int(turn[i[k]]), int(order[j[k]])
            if best and best[0] != r:
                out.append(best[:3])
                best = None
            if best and bound[k] < best[2]:
                continue
            ratio = 1.0 if x[r] == y[c] else SequenceMatcher(None, x[r], y[c]).ratio()
            if ratio >= least and (best is None or (ratio, -y_ord[c]) > (best[2], -y_ord[best[1]])):
                best = (r, c, ratio)
        if best:
            out.append(best[:3])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pairs in _maybe(a, b, lo, hi, least):
        held.append(pairs)
        if sum(len(i) for i, _ in held) >= 4 * PAIRS:
            align(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if sum(len(i) for i, _ in held):
        align(*map(np.concatenate, zip(*held, strict=True)))
    return out

"""A linear-chain conditional random field with two states over characters, trained and applied on arrays.

Texts become segments (about sentences) of normalised characters. A character's score for the state "offending" is the
sum of the weights of the n-grams around it and of its segment's bigrams within ``REACH``; the chain adds transition weights.
Forward-backward runs over all segments of a batch at once, a position of every chain at a time. A long segment is
several chains: the product of a chain's transfer matrices says what enters the next, so the result is that of the whole
segment, however long.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from inkstream.functions.hanzi import FREQUENT, FREQUENT_SIMPLIFIED
from inkstream.llm.codepoints import CharMap, decode

BITS = 18
QUOTE, COMMA, END, DOT = ord('"'), ord(","), ord("\n"), ord(".")
#: Characters on either side whose bigrams count for a character besides its n-grams.
REACH = 100
#: Characters that forward-backward goes through one by one.
CHAIN = 256


SIMPLE = dict(zip(FREQUENT, FREQUENT_SIMPLIFIED))


def _token(c: str) -> str:
    c = SIMPLE.get(c, c)
    if c in "“”\"「」『』«»‘’《》":
        return '"'
    if c in "。！？!?…\n\r；;":
        return "\n"
    if c in "，,：:":
        return ","
    if c in ".．":
        return "."
    kind = unicodedata.category(c)
    if kind in ("So", "Sk") or c in "<>":
        return "\n"
    return "".join(x for x in unicodedata.normalize("NFKC", c).lower() if unicodedata.category(x)[0] in "LN") if kind != "Mn" else ""


@lru_cache(maxsize=1)
def token_map() -> CharMap:
    return CharMap(_token)


@dataclass
class Segments:
    """Characters of all segments in order; ``start`` and ``size`` by segment, ``row`` the text it is from, ``place`` each character's place in its text."""

    tokens: np.ndarray
    place: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray

    def take(self, which: np.ndarray) -> Segments:
        size = self.size[which]
        start = np.cumsum(size) - size
        at = np.repeat(self.start[which] - start, size) + np.arange(size.sum())
        return Segments(self.tokens[at], self.place[at], start, size, self.row[which])


def segments(column: pa.Array) -> Segments:
    points, offsets = decode(column)
    raw, at = token_map().apply(points, np.arange(len(points) + 1))
    source = np.repeat(np.arange(len(points)), np.diff(at))
    row = np.searchsorted(offsets, source, "right") - 1
    place = source - offsets[row]
    # a dot ends a segment before white space or the text's end, elsewhere it's left out
    dots = np.flatnonzero(raw == DOT)
    after = np.minimum(source[dots] + 1, len(points) - 1)
    ends = (source[dots] + 1 >= offsets[row[dots] + 1]) | np.isin(points[after], (0x20, 0x0A, 0x0D, 0x09, 0xA0, 0x3000))
    raw = raw.copy()
    raw[dots[ends]] = END
    stay = raw != DOT
    raw, row, place = raw[stay], row[stay], place[stay]
    stop = raw == END
    number = np.cumsum(stop) - stop
    raw, row, place, number = raw[~stop], row[~stop], place[~stop], number[~stop]
    if not len(raw):
        e = np.empty(0, np.int64)
        return Segments(e, e, e, e, e)
    new = np.ones(len(raw), bool)
    new[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return Segments(raw.astype(np.int32), place.astype(np.int32), start, np.diff(np.append(start, len(raw))), row[start])


def _hash(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), (salt * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p.astype(np.uint32)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


#: The windows whose characters are a feature together.
WINDOWS = [(0, 0), (-1, 0), (0, 1), (-1, 1), (-2, 1), (-1, 2), (-2, 2), (-3, 3)]


def features(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """``(characters, windows)`` feature numbers, and the feature number of each character's bigram for its segment."""
    n = len(s.tokens)
    inner = np.arange(n) - np.repeat(s.start, s.size)
    left = np.repeat(s.size, s.size) - inner
    near = {}
    for k in range(-3, 4):
        moved = np.zeros(n, np.int32)
        if k < 0:
            moved[-k:] = s.tokens[:k]
            moved[inner < -k] = 1
        elif k > 0:
            moved[:-k] = s.tokens[k:]
            moved[left <= k] = 2
        else:
            moved = s.tokens
        near[k] = moved
    # a window's features lie together, since they are looked up window by window
    local = np.empty((n, len(WINDOWS)), np.int32, order="F")
    for i, (a, b) in enumerate(WINDOWS):
        local[:, i] = _hash([near[k] for k in range(a, b + 1)], i + 1)
    return local, _hash([near[-1], near[0]], 99)


def _steps(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The order of the chains, longest first, and how many of them have each position."""
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    counts = np.searchsorted(-size[order], -np.arange(longest), "left")
    return order, counts.tolist()


def near(s: Segments) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters within ``REACH`` of each character's segment begin and end."""
    i, start = np.arange(len(s.tokens)), np.repeat(s.start, s.size)
    return np.maximum(start, i - REACH), np.minimum(start + np.repeat(s.size, s.size), i + REACH + 1)


def sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[high] - total[low]


@dataclass
class Model:
    weights: np.ndarray
    overall: np.ndarray
    bias: float
    #: log weights of changing to, from and staying in the offending state
    moves: np.ndarray
    threshold: float = 0.5

    def scores(self, s: Segments, local: np.ndarray, whole: np.ndarray) -> np.ndarray:
        e = np.full(len(s.tokens), self.bias)
        for j in range(local.shape[1]):
            e += self.weights[local[:, j]]
        low, high = near(s)
        e += sums(self.overall[whole], low, high) / np.sqrt(high - low)
        return np.clip(e, -25, 25)

    def marginals(self, s: Segments, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the offending state at each character, and the forward and backward ratios behind it."""
        count = -(-s.size // CHAIN)
        owner = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = s.start[owner] + number * CHAIN
        size = np.minimum(CHAIN, s.size[owner] - number * CHAIN)
        odds = np.exp(e)
        into, out, stay = np.exp(self.moves)
        before, after = self._ends(odds, start, size, count, number)
        order, counts = _steps(start, size)
        start, size, before, after = start[order], size[order], before[order], after[order]
        r, q = np.empty(len(e)), np.empty(len(e))
        for t, n in enumerate(counts):
            at = start[:n] + t
            p = r[at - 1] if t else before
            r[at] = odds[at] * (into + p * stay) / (1 + p * out)
        q[start + size - 1] = after
        for t in range(len(counts) - 2, -1, -1):
            at = start[: counts[t + 1]] + t
            nxt = odds[at + 1] * q[at + 1]
            q[at] = (out + stay * nxt) / (1 + into * nxt)
        return 1 - 1 / (1 + r * q), r, q

    def _ends(self, odds: np.ndarray, start: np.ndarray, size: np.ndarray, count: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio that enters each chain from before, and the one at its last character from after."""
        before, after = np.zeros(len(start)), np.ones(len(start))
        long = np.flatnonzero(np.repeat(count, count) > 1)
        if not len(long):
            return before, after
        into, out, stay = np.exp(self.moves)
        order, counts = _steps(start[long], size[long])
        of = long[order]
        m = np.tile(np.eye(2), (len(of), 1, 1))
        for t, n in enumerate(counts):
            o = odds[start[of[:n]] + t][:, None]
            off, on = m[:n, 0], m[:n, 1]
            m[:n] = np.stack([off + out * on, o * (into * off + stay * on)], axis=1)
            m[:n] /= m[:n].max((1, 2), keepdims=True)
        matrix = np.empty((len(start), 2, 2))
        matrix[of] = m
        last = np.repeat(count, count) - 1
        for k in range(1, int(count.max())):
            here = long[number[long] == k]
            v = np.stack([np.ones(len(here)), before[here - 1]], axis=1)
            v = np.einsum("nij,nj->ni", matrix[here - 1], v)
            before[here] = v[:, 1] / v[:, 0]
            here = long[last[long] - number[long] == k]
            v = np.stack([np.ones(len(here)), after[here + 1]], axis=1)
            v = np.einsum("nji,nj->ni", matrix[here + 1], v)
            after[here] = v[:, 1] / v[:, 0]
        return before, after


def occurring(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur in ``f``, and ``f`` by their places among these."""
    used = np.flatnonzero(np.bincount(f.ravel("K"), minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    return used, place[f]


def train(s: Segments, y: np.ndarray, weight: np.ndarray, rounds: int, model: Model | None = None, rate: float = 0.3, decay: float = 1e-6) -> Model:
    """Weighted maximum likelihood by full-batch adaptive gradient steps on the characters' states ``y``; ``weight`` by segment.

    Features that don't occur in ``s`` keep their weights.
    """
    begin = model or Model(np.zeros(1 << BITS), np.zeros(1 << BITS), -1.0, np.array([-2.0, -2.0, 1.0]))
    heavy = np.repeat(weight, s.size)
    (met, local), (met_whole, whole) = (occurring(f) for f in features(s))
    m = Model(begin.weights[met].astype(np.float64), begin.overall[met_whole].astype(np.float64), begin.bias, begin.moves, begin.threshold)
    low, high = near(s)
    scale = 1 / np.sqrt(high - low)
    first = np.zeros(len(y), bool)
    first[s.start] = True
    inner = np.flatnonzero(~first)
    squares = [np.full(len(met), 1e-3), np.full(len(met_whole), 1e-3), 1e-3, np.full(3, 1e-3)]
    total = max(1.0, float((y * heavy).sum()))
    for _ in range(rounds):
        e = m.scores(s, local, whole)
        p, r, q = m.marginals(s, e)
        g = (p - y) * heavy / total
        own = sum(np.bincount(local[:, j], g, len(met)) for j in range(local.shape[1]))
        grads = [own + decay * m.weights, np.bincount(whole, sums(g * scale, low, high), len(met_whole)) + decay * m.overall, g.sum()]
        into, out, stay = np.exp(m.moves)
        nxt = np.exp(e[inner]) * q[inner]
        w = np.stack([np.ones(len(inner)), into * nxt, r[inner - 1] * out, r[inner - 1] * stay * nxt])
        w *= heavy[inner] / w.sum(0)
        was, now, h = y[inner - 1], y[inner], heavy[inner]
        moves = np.array([(w[1] - h * (1 - was) * now).sum() + ((p[s.start] - y[s.start]) * weight).sum(), (w[2] - h * was * (1 - now)).sum(), (w[3] - h * was * now).sum()]) / total
        grads.append(moves)
        params = [m.weights, m.overall, m.bias, m.moves]
        for k in range(4):
            squares[k] = squares[k] + grads[k] ** 2
            params[k] = params[k] - rate * grads[k] / np.sqrt(squares[k])
        m = Model(params[0], params[1], float(params[2]), params[3], m.threshold)
    weights, overall = begin.weights.astype(np.float64), begin.overall.astype(np.float64)
    weights[met], overall[met_whole] = m.weights, m.overall
    return Model(weights, overall, m.bias, m.moves, m.threshold)


def segment_scores(s: Segments, p: np.ndarray, run: int = 4) -> np.ndarray:
    """Highest mean probability of ``run`` characters in a row, by segment."""
    if not len(s.size):
        return np.empty(0)
    total = np.concatenate([[0], np.cumsum(p)])
    n = len(p)
    stop = np.minimum(np.arange(n) + run, np.repeat(s.start + s.size, s.size))
    mean = (total[stop] - total[np.arange(n)]) / run
    return np.clip(np.maximum.reduceat(mean, s.start), 0, 1)

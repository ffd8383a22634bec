"""Arrow strings as numpy code-point arrays, and the folding that the search operators share.

A column of a batch becomes one array of code points plus row offsets; everything after that is table lookups and
array arithmetic over the whole batch. Null texts count as empty here.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 0x110000
DROP, UNKNOWN = -1, -2


def decode(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """``(code points, offsets)``: row i is ``points[offsets[i]:offsets[i + 1]]``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])] if len(column) else b""
    return np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32), offsets


def encode(points: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings of ``decode()`` back as an Arrow array."""
    data = points.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])[offsets].astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())


def keep(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points under ``mask``."""
    return points[mask], np.concatenate([[0], np.cumsum(mask)])[offsets]


class CharMap:
    """A table from code point to a string of code points, filled as characters are met: ``rule`` is asked once per character, never per occurrence.

    What one character becomes is a code point in ``table``, or the place in ``start`` and ``size`` of several ones in ``flat``.
    """

    def __init__(self, rule: Callable[[str], str]):
        self.rule, self.table = rule, np.full(SIZE, UNKNOWN, np.int32)
        self.flat, self.start, self.size = np.empty(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def learn(self, characters: np.ndarray) -> None:
        flat, sizes = [], []
        for p in characters:
            s = self.rule(chr(p))
            self.table[p] = DROP if not s else ord(s) if len(s) == 1 else -2 - len(self.start) - len(sizes)
            if len(s) > 1:
                flat.append(s)
                sizes.append(len(s))
        if sizes:
            begin = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.flat = np.concatenate([self.flat, np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.int32)])
            self.start, self.size = np.concatenate([self.start, begin]).astype(np.int64), np.concatenate([self.size, sizes]).astype(np.int64)

    def apply(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = self.table[points]
        if (gap := new == UNKNOWN).any():
            self.learn(np.unique(points[gap]))
            new = self.table[points]
        width = (new >= 0).astype(np.int64)
        wide = np.flatnonzero(new < UNKNOWN)
        entry = -2 - new[wide]
        width[wide] = self.size[entry]
        at = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(new, width)
        if len(wide):
            own = self.size[entry]
            inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(at[wide], own) + inner] = self.flat[np.repeat(self.start[entry], own) + inner]
        return out, at[offsets]


class Composer:
    """Canonical order and composition of decomposed characters over whole arrays; rows don't meet."""

    def __init__(self) -> None:
        self.classes, self.second = np.zeros(SIZE, np.uint8), np.zeros(SIZE, bool)
        pairs = {}
        for p in range(0xA0, 0x20000):
            c = chr(p)
            self.classes[p] = unicodedata.combining(c)
            d = unicodedata.decomposition(c)
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = p
                self.second[b] = not unicodedata.combining(chr(b))
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[int(k)] for k in self.keys], np.int32)

    def found(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = first.astype(np.int64) << 21 | second
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[k] == key, self.made[k]

    def __call__(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = jamo(*self.with_marks(points, offsets))
        # a few scripts compose letters of class 0; what they make may take up a mark again
        while len(pair := self.neighbours(points, offsets)):
            points, stay = points.copy(), np.ones(len(points), bool)
            points[pair - 1] = self.found(points[pair - 1], points[pair])[1]
            stay[pair] = False
            points, offsets = self.with_marks(*keep(points, offsets, stay))
        return points, offsets

    def neighbours(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places of letters that compose with the one before; of two that overlap, the first."""
        at = np.flatnonzero(self.second[points])
        at = at[at > 0]
        at = at[~np.isin(at, offsets)]
        at = at[self.found(points[at - 1], points[at])[0]] if len(at) else at
        return at[np.concatenate([[True], np.diff(at) > 1])] if len(at) else at

    def with_marks(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cls = self.classes[points]
        marks = np.flatnonzero(cls)
        if not len(marks):
            return points, offsets
        drop = np.zeros(len(points), bool)
        points = points.copy()
        row_start = np.zeros(len(points) + 1, bool)
        row_start[offsets] = True
        # a run of marks follows a starter, or begins a row
        first = np.ones(len(marks), bool)
        first[1:] = (np.diff(marks) != 1) | row_start[marks[1:]]
        run = np.cumsum(first) - 1
        points[marks] = points[marks][np.lexsort((np.arange(len(marks)), cls[marks], run))]
        cls = self.classes[points]
        begin = marks[first]
        size = np.bincount(run)
        owned = ~row_start[begin]
        begin, size = begin[owned], size[owned]
        last = np.zeros(len(begin), np.uint8)
        j = 0
        while len(begin):
            at, starter = begin + j, begin - 1
            ok, made = self.found(points[starter], points[at])
            ok &= (last == 0) | (last < cls[at])
            points[starter[ok]] = made[ok]
            drop[at[ok]] = True
            last = np.where(ok, last, cls[at])
            j += 1
            more = size > j
            begin, size, last = begin[more], size[more], last[more]
        return keep(points, offsets, ~drop)


@lru_cache(maxsize=1)
def composer() -> Composer:
    return Composer()


def jamo(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hangul letters that follow each other as syllables."""
    for low, high, base in ((0x1161, 0x1175, 0), (0x11A8, 0x11C2, 1)):
        second = np.flatnonzero((points >= low) & (points <= high))
        if not len(second):
            continue
        second = second[second > 0]
        second = second[~np.isin(second, offsets)]
        before = points[second - 1]
        ok = (before >= 0x1100) & (before <= 0x1112) if base == 0 else (before >= 0xAC00) & (before <= 0xD7A3) & ((before - 0xAC00) % 28 == 0)
        second, before = second[ok], before[ok]
        points = points.copy()
        points[second - 1] = 0xAC00 + ((before - 0x1100) * 21 + points[second] - 0x1161) * 28 if base == 0 else before + points[second] - 0x11A7
        stay = np.ones(len(points), bool)
        stay[second] = False
        points, offsets = keep(points, offsets, stay)
    return points, offsets


def _fold_char(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKC", c).lower() if unicodedata.category(x)[0] in "LN")


def fold_text(text: str | None) -> str:
    """Folded text of one string: no tags, no entities, NFKC, lower case, letters and numbers only."""
    text = re.sub(r"&[A-Za-z#0-9]+;", "", re.sub(r"<[^>]*>", "", text or ""))
    return _fold_char(text)


def _needs_context(c: str) -> bool:
    """Whether the folded form of a text with ``c`` may differ from its characters' folded forms side by side."""
    for x in c + unicodedata.normalize("NFKC", c):
        p = ord(x)
        if 0xFE00 <= p <= 0xFE0F or 0xE0100 <= p <= 0xE01EF:
            continue
        if unicodedata.combining(x) or unicodedata.category(x) in ("Mc", "Mn") or 0x1160 <= p <= 0x11FF or x == "Σ":
            return True
    return False


SIGMA, FINAL_SIGMA = 0x3A3, 0x3C2


class Folder:
    """Folds whole batches; of rows with combining marks and the like the marks are composed first, over all these rows at once."""

    def __init__(self) -> None:
        self.map, self.plain = CharMap(_fold_char), CharMap(lambda c: unicodedata.normalize("NFKD", c))
        self.flags = {name: np.full(SIZE, 2, np.uint8) for name in ("context", "cased", "between")}
        # what lower-casing calls cased, and what it looks past, by its own answer about a final sigma
        self.rules = {"context": _needs_context, "cased": lambda c: (c + "Σ").lower()[-1] == "ς", "between": lambda c: (c + "Σ").lower()[-1] == "σ" and ("a" + c + "Σ").lower()[-1] == "ς"}

    def flagged(self, name: str, points: np.ndarray) -> np.ndarray:
        table = self.flags[name]
        if (gap := table[points] == 2).any():
            for p in np.unique(points[gap]):
                table[p] = self.rules[name](chr(p))
        return table[points] == 1

    def final_sigmas(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """``points`` with the sigma that ends a word where lower-casing puts it."""
        at = np.flatnonzero(points == SIGMA)
        if not len(at):
            return points
        seen = np.flatnonzero(~self.flagged("between", points))
        cased = np.append(self.flagged("cased", points[seen]), False)
        row = np.searchsorted(offsets, seen, "right")
        here = np.searchsorted(seen, at)
        own = row[here]
        row = np.append(row, -1)
        final = cased[here - 1] & (row[here - 1] == own) & ~(cased[here + 1] & (row[here + 1] == own))
        points = points.copy()
        points[at[final]] = FINAL_SIGMA
        return points

    def composed(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = composer()(*self.plain.apply(points, offsets))
        return self.map.apply(self.final_sigmas(points, offsets), offsets)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        points, offsets = decode(column)
        hard = np.unique(np.searchsorted(offsets, np.flatnonzero(self.flagged("context", points)), "right") - 1)
        if not len(hard):
            return self.map.apply(points, offsets)
        sizes, which = np.diff(offsets), np.zeros(len(offsets) - 1, bool)
        which[hard] = True
        of = np.repeat(which, sizes)
        parts = []
        for mask, chosen, fold in ((of, which, self.composed), (~of, ~which, self.map.apply)):
            parts.append(fold(points[mask], np.concatenate([[0], np.cumsum(sizes[chosen])])))
        # both kinds of rows back in order
        sizes = np.zeros(len(which), np.int64)
        for (_, at), chosen in zip(parts, (which, ~which)):
            sizes[chosen] = np.diff(at)
        back = np.repeat(which, sizes)
        out = np.empty(len(back), np.int32)
        out[back], out[~back] = parts[0][0], parts[1][0]
        return out, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def grams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of all n-grams that lie within a row, row by row, and the offsets of the rows in them."""
    if len(points) < n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    p, last = points.astype(np.uint64), len(points) - n + 1
    h = p[:last].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += p[k : k + last]
    sizes = np.maximum(np.diff(offsets) - n + 1, 0)
    inside = np.ones(last, bool)
    ends = offsets[1:-1]
    for k in range(1, n):
        cut = ends - k
        inside[cut[(cut >= 0) & (cut < last)]] = False
    # a row shorter than n has its cuts in earlier rows only where those are cut anyway
    return mix(h[inside]), np.concatenate([[0], np.cumsum(sizes)])

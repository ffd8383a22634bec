"""Hamming distances of many signatures at once from vertical bit planes.

Plane p holds bit p of every record, 64 records to a word. The planes' differences are added by carry-save adders, so
one word operation advances 64 distances. Words whose 64 distances all exceed the radius are abandoned between groups
of planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

GROUP = 32
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes_of(signatures: np.ndarray) -> np.ndarray:
    """``(records, words)`` of signature bits as ``(planes, words of records)``."""
    n, words = signatures.shape
    bits = np.unpackbits(np.ascontiguousarray(signatures).view(np.uint8).reshape(n, words * 8), axis=1, bitorder="little").T
    return pack(np.ascontiguousarray(bits))


def pack(bits: np.ndarray) -> np.ndarray:
    """The last axis, one element a bit, as words."""
    short = -bits.shape[-1] % 64
    if short:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), bits.dtype)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """The numbers of the lanes whose bit is set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little", count=n))


def count_planes(diff: np.ndarray) -> list[np.ndarray]:
    """Binary counters of the set bits down the planes: element k has bit k of every lane's count."""
    level, out = [diff[i] for i in range(len(diff))], []
    while level:
        carries = []
        while len(level) > 1:
            a, b = level.pop(), level.pop()
            if level:
                c = level.pop()
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                level.append(ab ^ c)
            else:
                carries.append(a & b)
                level.append(a ^ b)
        out.append(level[0])
        level = carries
    return out


def add(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    out, carry = [], None
    for k in range(max(len(x), len(y))):
        terms = [t for t in (x[k] if k < len(x) else None, y[k] if k < len(y) else None, carry) if t is not None]
        if len(terms) == 3:
            ab = terms[0] ^ terms[1]
            out.append(ab ^ terms[2])
            carry = (terms[0] & terms[1]) | (ab & terms[2])
        elif len(terms) == 2:
            out.append(terms[0] ^ terms[1])
            carry = terms[0] & terms[1]
        else:
            out.append(terms[0])
            carry = None
    return out if carry is None else [*out, carry]


def at_most(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Lanes whose counter is ``limit`` or less."""
    less, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(max(len(counters), limit.bit_length()) - 1, -1, -1):
        bit = counters[k] if k < len(counters) else np.zeros_like(counters[0])
        if limit >> k & 1:
            less |= same & ~bit
            same &= bit
        else:
            same &= ~bit
    return less | same


def within(diff: Callable[[slice, np.ndarray | None], np.ndarray], planes: int, words: int, radius: int) -> np.ndarray:
    """Words with a bit for each lane whose distance is ``radius`` or less. ``diff(group, kept words)`` gives difference planes."""
    out, kept, counters = np.zeros(words, np.uint64), None, []
    for start in range(0, planes, GROUP):
        counters = add(counters, count_planes(diff(slice(start, start + GROUP), kept)))
        near = at_most(counters, radius)
        alive = near != 0
        if not alive.any():
            return out
        if not alive.all():
            kept = np.flatnonzero(alive) if kept is None else kept[alive]
            counters, near = [c[alive] for c in counters], near[alive]
    out[slice(None) if kept is None else kept] = near
    return out


def near_in_buckets(signatures: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers within ``radius`` in the same bucket; buckets of ``sizes`` rows follow each other.

    All buckets are compared together: every row with the row d places on, for each d that lies within a bucket.
    """
    rows, size = np.arange(len(signatures)), np.repeat(sizes, sizes)
    place = rows - np.repeat(np.cumsum(sizes) - sizes, sizes)
    d = 1
    while True:
        held = np.flatnonzero(size > d)
        if not len(held):
            return
        rows, size, place, signatures = rows[held], size[held], place[held], signatures[held]
        p, n = planes_of(signatures), len(rows)
        # the rows stay as they are while buckets that end within the next distances are few
        stop = max(d + 1, min(int(size.max()), d + d // 2 + 2))
        while d < stop:
            word, bit = divmod(d, 64)
            moved = np.zeros_like(p)
            moved[:, : p.shape[1] - word] = p[:, word:] >> np.uint64(bit)
            if bit:
                moved[:, : p.shape[1] - word - 1] |= p[:, word + 1 :] << np.uint64(64 - bit)
            ok = pack((place + d < size).astype(np.uint8)) if n else np.zeros(0, np.uint64)
            near = within(lambda g, k: (p[g] ^ moved[g]) if k is None else (p[g][:, k] ^ moved[g][:, k]), len(p), p.shape[1], radius) & ok
            at = lanes(near, n)
            if len(at):
                yield rows[at], rows[at + d]
            d += 1


def near_across(left: np.ndarray, right: np.ndarray, radius: int, words: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(row of left, row of right)`` within ``radius``: every left signature against all planes of the right."""
    if not len(left) or not len(right):
        return
    p, n = planes_of(right), len(right)
    w = p.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(left).view(np.uint8).reshape(len(left), -1), axis=1, bitorder="little").T
    step = max(1, words // w)
    for start in range(0, len(left), step):
        ask = np.where(bits[:, start : start + step, None] == 1, ALL, np.uint64(0))
        q = ask.shape[1]

        def diff(g: slice, kept: np.ndarray | None) -> np.ndarray:
            if kept is None:
                return (ask[g] ^ p[g][:, None, :]).reshape(-1, q * w)
            i, j = np.divmod(kept, w)
            return ask[g][:, i, 0] ^ p[g][:, j]

        near = within(diff, len(p), q * w, radius).reshape(q, w)
        for i in np.flatnonzero(near.any(1)):
            at = lanes(near[i], n)
            yield np.full(len(at), start + i), at

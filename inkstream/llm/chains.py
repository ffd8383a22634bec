"""Term evidence by sentence, logistic classifier chains, calibration and beam search, on arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from inkstream.llm.crf import BITS, Segments, _hash

#: Evidence of a background sentence: a sentence treats a subject if it has more for it.
BACKGROUND = 2.0


def term_numbers(s: Segments) -> np.ndarray:
    """``(characters, 2)``: the numbers of the bigram and trigram that start at each character of a segment, -1 beyond its end."""
    n = len(s.tokens)
    left = np.repeat(s.size, s.size) - (np.arange(n) - np.repeat(s.start, s.size))
    a, b, c = s.tokens, np.roll(s.tokens, -1), np.roll(s.tokens, -2)
    out = np.stack([_hash([a, b], 201), _hash([a, b, c], 202)], axis=1)
    out[left < 2, 0] = -1
    out[left < 3, 1] = -1
    return out


@dataclass
class Terms:
    """Evidence of each term for each subject."""

    weights: np.ndarray

    @classmethod
    def fit(cls, s: Segments, labels: np.ndarray, turns: int = 4, least: int = 3) -> Terms:
        """``labels[row]`` are an article's subjects. Sentences are shared out among them, again and again by what the terms say."""
        k = labels.shape[1]
        numbers = term_numbers(s)
        sentence = np.repeat(np.arange(len(s.size)), s.size)
        key = np.unique(np.concatenate([sentence[numbers[:, j] >= 0].astype(np.int64) << BITS | numbers[numbers[:, j] >= 0, j] for j in (0, 1)]))
        of, term = key >> BITS, key & (1 << BITS) - 1
        allowed = labels[s.row].astype(float)
        share = allowed / np.maximum(allowed.sum(1, keepdims=True), 1)
        seen = np.bincount(term, minlength=1 << BITS)
        weights = np.zeros((1 << BITS, k), np.float32)
        for _ in range(turns):
            mass, whole = share.sum(0), share.sum(1)
            every = np.bincount(term, whole[of], 1 << BITS)
            for j in range(k):
                got = np.bincount(term, share[of, j], 1 << BITS)
                rest = every - got
                odds = np.log((got + 0.3) / (mass[j] + 3)) - np.log((rest + 0.3) / (mass.sum() - mass[j] + 3))
                weights[:, j] = np.where(seen >= least, np.clip(odds, -4, 4), 0)
            found = cls(weights)
            p = found.posterior(s, numbers)
            share = p * allowed
        return cls(weights)

    def posterior(self, s: Segments, numbers: np.ndarray | None = None) -> np.ndarray:
        """``(sentences, subjects)``: the probability that each sentence treats each subject."""
        numbers = term_numbers(s) if numbers is None else numbers
        total = np.zeros((len(s.size), self.weights.shape[1]))
        step = 200_000
        edges = np.unique(np.concatenate([np.searchsorted(s.start, np.arange(0, len(s.tokens), step)), [len(s.size)]]))
        for a, b in zip(edges[:-1], edges[1:]):
            stop = s.start[b] if b < len(s.size) else len(s.tokens)
            part = numbers[s.start[a] : stop]
            w = self.weights[np.maximum(part[:, 0], 0)] * (part[:, :1] >= 0) + self.weights[np.maximum(part[:, 1], 0)] * (part[:, 1:] >= 0)
            total[a:b] = np.add.reduceat(w.astype(np.float64), s.start[a:b] - s.start[a], axis=0)
        top = np.maximum(total.max(1, keepdims=True), BACKGROUND)
        e = np.exp(total - top)
        return e / (e.sum(1, keepdims=True) + np.exp(BACKGROUND - top))


def article_features(terms: Terms, s: Segments, titles: Segments, n: int) -> np.ndarray:
    """Term features (share of sentences by subject, clear ones and expected ones), source features (what the title says) and structure features."""
    k = terms.weights.shape[1]
    p = terms.posterior(s)
    count = np.bincount(s.row, minlength=n).astype(float)
    some = np.maximum(count, 1)[:, None]
    soft, hard, title = (np.zeros((n, k)) for _ in range(3))
    np.add.at(soft, s.row, p)
    np.add.at(hard, s.row, (p > 0.5).astype(float))
    if len(titles.size):
        np.add.at(title, titles.row, terms.posterior(titles))
    soft, hard = soft / some, hard / some
    best = np.sort(hard, axis=1)[:, ::-1]
    structure = np.stack([np.log1p(count), 1 / some[:, 0], 1 - soft.sum(1), np.bincount(s.row, s.size, n) / some[:, 0] / 20, best[:, 0], best[:, 1] if k > 1 else best[:, 0]], axis=1)
    return np.concatenate([soft, hard, np.clip((hard - 0.2) * 10, -1, 1), title, structure], axis=1)


def own_features(x: np.ndarray, j: int, k: int) -> np.ndarray:
    """What a chain's link for subject j looks at: that subject's features and the structure."""
    return np.concatenate([x[:, [j, k + j, 2 * k + j, 3 * k + j]], x[:, 4 * k :]], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the last one being the constant; Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, keep = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    keep[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Chain:
    """One classifier per subject in ``order``; each sees the subjects decided before it. ``scale`` calibrates its log odds."""

    order: list[int]
    links: list[np.ndarray]
    scale: list[np.ndarray]
    k: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> Chain:
        """Frequent subjects come first. Calibration uses rows that the link was not trained on."""
        k = labels.shape[1]
        order = list(np.argsort(-labels.sum(0), kind="stable"))
        links, scale = [], []
        for at, j in enumerate(order):
            z = np.concatenate([own_features(x, j, k), labels[:, order[:at]]], axis=1)
            out = np.zeros(len(z))
            for f in (0, 1):
                out[fold == f] = linear(z[fold == f], logistic(z[fold != f], labels[fold != f, j]))
            links.append(logistic(z, labels[:, j]))
            scale.append(logistic(out[:, None], labels[:, j], 0.01))
        return cls(order, links, scale, k, x.min(0), x.max(0))

    def decode(self, x: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label combination of each row and its probability, by beam search along the chain."""
        # features beyond those that were learned from count as the outermost of them
        n, x = len(x), np.clip(x, self.low, self.high)
        beams, score = np.zeros((n, 1, self.k)), np.zeros((n, 1))
        for at, j in enumerate(self.order):
            b = beams.shape[1]
            own = own_features(x, j, self.k)
            z = np.concatenate([np.repeat(own[:, None, :], b, axis=1), beams[:, :, self.order[:at]]], axis=2)
            odds = linear(linear(z.reshape(n * b, -1), self.links[at])[:, None], self.scale[at]).reshape(n, b)
            yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
            with_j = beams.copy()
            with_j[:, :, j] = 1
            beams, score = np.concatenate([beams, with_j], axis=1), np.concatenate([score + no, score + yes], axis=1)
            if beams.shape[1] > width:
                top = np.argsort(-score, axis=1, kind="stable")[:, :width]
                beams, score = np.take_along_axis(beams, top[:, :, None], axis=1), np.take_along_axis(score, top, axis=1)
        best = score.argmax(1)
        return beams[np.arange(n), best] > 0.5, np.exp(score[np.arange(n), best])

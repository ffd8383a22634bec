"""Abusive, hateful or sexual content: a conditional random field tags offending characters; documents get a score.

The labels say which documents offend, not where. Offending segments are found in turns: first the segments of offending
documents whose n-grams occur in offending documents far more often than in others, then those that the field trained
on these tags itself. Segments of clean documents that it tags are trained with more weight. A document's score is the
highest mean probability of some characters in a row.

The field is fitted on a bounded sample of the labels: the first ``OFFENDING`` and ``CLEAN`` labelled documents by hash,
those of more than ``EXAMPLE_CHARS`` characters left out. The sample is dealt out to tasks; in every turn each task trains
on its share from the field that all have, and a feature's new weight is the mean of those of the tasks that met it.
Every tagged or doubtful segment is trained on, of the plain ones ``PLAIN_CLEAN`` of clean and ``PLAIN_OFFENDING`` of
offending documents. All documents are scored, whole.

Result cases
    null, empty texts      score 0
    no labels of one kind  nothing to learn from: every score is 0
    label without document ignored; a document labelled twice counts as offending if half of its labels say so
    repeated doc_id        one result per row
    very long texts        no limit; a chain is as long as its sentence
    clashing names         only the named columns are read
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.crf import BITS, Model, Segments, features, segment_scores, segments, train
from inkstream.session import cut

OFFENDING, CLEAN, EXAMPLE_CHARS = 3000, 5000, 20_000
PLAIN_CLEAN, PLAIN_OFFENDING = 12_000, 8000
#: Labelled documents of a task's share, and the most tasks.
SHARE, MOST_SHARES = 1200, 8
TURNS, ROUNDS = 5, 30
THRESHOLD = 0.4
#: Weights of both kinds, of the moves and the bias; their sums are kept in units of 1 / UNIT.
SUMS, UNIT = (2 << BITS) + 4, 1 << 24


def sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``(doc_id, text, y)``, at most ``OFFENDING + CLEAN`` rows of at most ``EXAMPLE_CHARS`` characters."""
    each = labels.where(f"`{doc_id}` is not null and `{label}` is not null").groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    chosen = each.where("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(OFFENDING).unionByName(each.where("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CLEAN))
    # one document per label, so a repeated id can't make the sample larger
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") <= EXAMPLE_CHARS)
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))


def gram_counts(s: Segments, local: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many clean and how many offending documents have each 4-gram."""
    key = np.unique(np.repeat(s.row, s.size).astype(np.int64) << BITS | local[:, 4])
    gram, of = key & (1 << BITS) - 1, y[key >> BITS]
    return np.stack([np.bincount(gram, 1 - of, 1 << BITS), np.bincount(gram, of, 1 << BITS)]).astype(np.int32)


def first_guess(s: Segments, local: np.ndarray, y: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Evidence of each segment: how much more often its 4-grams occur in other offending documents than in others."""
    f, own = local[:, 4], y[np.repeat(s.row, s.size)]
    # without the document itself, so that nothing speaks for itself
    good, bad = counts[0][f] - (1 - own), counts[1][f] - own
    odds = np.log((bad + 2 * share) / (good + 2 * (1 - share)) * (1 - share) / share)
    odds[bad + good < 2] = 0
    return np.add.reduceat(np.clip(odds, -3, 3), s.start) / np.sqrt(s.size)


def best_of_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    best = np.full(n, -np.inf)
    np.maximum.at(best, row, values)
    return best[row]


def turn(s: Segments, y: np.ndarray, counts: np.ndarray, share: float, models: list[Model], shares: int, seed: int = 7) -> tuple[Model, np.ndarray] | None:
    """The field after one turn on a task's documents, from the last of ``models``, and how often it met each feature."""
    local, whole = features(s)
    offending = y[s.row] == 1
    evidence = first_guess(s, local, y, counts, share)
    tagged = offending & ((evidence > 5) | (evidence >= best_of_row(evidence, s.row, len(y))) & (evidence > 2.5))
    clean = np.flatnonzero(~offending)
    hard = clean[evidence[clean] > 1]
    rng = np.random.default_rng(seed)
    plain = [rng.choice(some, min(len(some), n // shares), replace=False) for some, n in ((clean, PLAIN_CLEAN), (np.flatnonzero(offending & (evidence < 1)), PLAIN_OFFENDING))]
    for model in models:
        score = segment_scores(s, model.marginals(s, model.scores(s, local, whole))[0])
        tagged = offending & ((score > 0.5) | (score >= best_of_row(score, s.row, len(y))) & (score > 0.2))
        hard = np.union1d(hard, np.flatnonzero(~offending & (score > 0.15)))
    use = np.unique(np.concatenate([np.flatnonzero(tagged), hard, *plain]))
    if not len(use):
        return None
    part = s.take(use)
    model = train(part, np.repeat(tagged[use].astype(float), part.size), np.where(np.isin(use, hard), 4.0, 1.0), ROUNDS, models[-1] if models else None)
    f, w = features(part)
    return model, np.stack([np.bincount(f.ravel(), minlength=1 << BITS), np.bincount(w, minlength=1 << BITS)])


def told(model: Model, met: np.ndarray) -> pa.RecordBatch:
    """``(slot, n, total)`` of a task's field: of each weight that it trained how often its feature was met, and the weight as often. Whole numbers, so their sums are the same in any order."""
    n = np.append(met.ravel(), np.ones(4, np.int64))
    slot = np.flatnonzero(n)
    values = np.concatenate([model.weights, model.overall, model.moves, [model.bias]])[slot]
    return sums_of(slot, n[slot], np.rint(values * n[slot] * UNIT))


def sums_of(slot: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(total.astype(np.int64))], names=["slot", "n", "total"])


def mixed(n: np.ndarray, total: np.ndarray, before: Model | None) -> Model:
    """The mean field; a feature's weight is that of the tasks that met it, as often as they did, and stays as it was if none did."""
    size = 1 << BITS
    old = np.zeros(SUMS) if before is None else np.concatenate([before.weights, before.overall, before.moves, [before.bias]])
    new = np.where(n > 0, total / np.maximum(n, 1) / UNIT, old)
    return Model(new[:size].astype(np.float32), new[size : 2 * size].astype(np.float32), float(new[-1]), new[2 * size : -1])


def fitted(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The field of the labels, for ``scored``; None if there is nothing to learn from.

    Spark adds up what the tasks learn. One field comes to the driver in a turn, whatever the number of tasks, and no text.
    """
    rows = cut(sample(documents, labels, doc_id, text, label))
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return None
    total, share = sum(size.values()), size[1] / sum(size.values())
    shares = min(MOST_SHARES, max(1, total // SHARE))
    dealt = cut(rows.repartition(shares, "doc_id"))

    def of_tasks(work: Callable[[Segments, np.ndarray], pa.RecordBatch | None]) -> np.ndarray:
        """``n`` and ``total`` of every slot, summed over the rows ``work(segments, y)`` of each task's documents."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in range(3)))), key=lambda r: str(r[0]))
            y = np.array([r[2] for r in held], np.int64)
            s = segments(pa.array([r[1] for r in held], pa.string()))
            out = work(s, y) if len(s.size) else None
            if out is not None:
                yield out

        sums = dealt.mapInArrow(run, "slot int, n bigint, total bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        out = np.zeros((2, SUMS), np.int64)
        out[:, sums.column("slot").to_numpy()] = [sums.column(c).to_numpy() for c in ("n", "total")]
        return out

    def in_documents(s: Segments, y: np.ndarray) -> pa.RecordBatch:
        n = gram_counts(s, features(s)[0], y).ravel()
        slot = np.flatnonzero(n)
        return sums_of(slot, n[slot], 0 * slot)

    counts = of_tasks(in_documents)[0, : 2 << BITS].reshape(2, -1).astype(np.int32)
    models: list[Model] = []
    for _ in range(TURNS):

        def one(s: Segments, y: np.ndarray, models: list[Model] = models) -> pa.RecordBatch | None:
            out = turn(s, y, counts, share, models, shares)
            return None if out is None else told(*out)

        n, learned = of_tasks(one)
        if not n[-1]:
            return None
        models.append(mixed(n, learned, models[-1] if models else None))
    return models[-1]


def tag(column: pa.Array, model: Model | None, least: float) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its offending spans: runs of characters of probability ``least`` or more in segments of that score."""
    n = len(column)
    s = segments(column)
    scores, spans = np.zeros(n), [[] for _ in range(n)]
    if model is None or not len(s.size):
        return scores, spans
    p = model.marginals(s, model.scores(s, *features(s)))[0]
    by_segment = segment_scores(s, p)
    np.maximum.at(scores, s.row, by_segment)
    for i in np.flatnonzero(by_segment >= least):
        own = slice(s.start[i], s.start[i] + s.size[i])
        on = np.flatnonzero(p[own] >= least)
        for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
            if len(run):
                at = s.place[own][run]
                spans[s.row[i]].append({"start": int(at[0]), "stop": int(at[-1]) + 1, "score": float(p[own][run].mean())})
    return scores, spans


def scored(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, *carry, score, spans)`` of every document; spans are places in the text."""
    return tagged(documents, fitted(documents, labels, doc_id, text, label), doc_id, text, carry, threshold)


def tagged(documents: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``scored`` by a field that was fitted before."""
    kept = documents.select(F.col(doc_id).alias("doc_id"), *(F.col(c) for c in carry), F.col(text).alias("_text"))
    names = kept.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                score, spans = tag(part.column(len(names)), model, threshold)
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(score), pa.array(spans, kind)], names=[*names, "score", "spans"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{head}, score double, spans array<struct<start:int,stop:int,score:double>>")


def rates(scores: DataFrame, source: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``(source, n_docs, n_offending, rate)``; documents without a source are a group of their own."""
    return scores.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("n_offending")).withColumn("rate", F.round(F.col("n_offending") / F.col("n_docs"), 6))

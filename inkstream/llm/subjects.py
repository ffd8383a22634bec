"""Subject areas of articles: classifier chains over term, source and structure features, decoded by beam search.

Terms (character bigrams and trigrams) get their evidence for each subject from labelled articles, whose sentences are
shared out among the article's subjects in turns. An article's features are the shares of its sentences that treat each
subject, what its title says, and its structure. Each link of the chain decides one subject, knowing the subjects
decided before it; links are calibrated on articles that they were not trained on; the likeliest combination is found by
beam search.

The models are fitted on a bounded sample, the first ``SAMPLE`` labelled articles by hash, those of more than
``EXAMPLE_CHARS`` characters left out. All articles are decoded, whole. The tables have no source beyond the title, so
the source features are what the title says. There is one chain, the most frequent subject first.

Result cases
    null, empty texts      no subject
    no or one-sided labels nothing to learn from: no article has a subject
    label without article  ignored; repeated labels count once; a null id or subject is no label
    repeated article rows  one result per row, one row per id and subject in ``subjects_of``
    very long texts        all sentences count
    clashing names         only the named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.chains import Chain, Terms, article_features
from inkstream.llm.crf import Segments, segments

SAMPLE, EXAMPLE_CHARS = 3000, 20_000


@dataclass
class Classifier:
    subjects: list[str]
    terms: Terms
    chain: Chain

    def __call__(self, texts: pa.Array, titles: pa.Array) -> tuple[list[list[str]], np.ndarray]:
        s = segments(texts)
        x = article_features(self.terms, s, segments(titles), len(texts))
        chosen, p = self.chain.decode(x)
        chosen[np.bincount(s.row, minlength=len(texts)) == 0] = False
        return [[self.subjects[j] for j in np.flatnonzero(row)] for row in chosen], p


def _rows(s: Segments, mask: np.ndarray) -> Segments:
    return s.take(np.flatnonzero(mask[s.row])) if len(s.size) else s


def fit(texts: list[str | None], titles: list[str | None], labels: list[list[str]]) -> Classifier | None:
    subjects = sorted({x for row in labels for x in row})
    y = np.array([[float(x in row) for x in subjects] for row in labels]).reshape(len(labels), len(subjects))
    if len(subjects) < 2 or len(labels) < 4:
        return None
    s, t = segments(pa.array(texts, pa.string())), segments(pa.array(titles, pa.string()))
    fold = np.arange(len(labels)) % 2
    x = None
    for f in (0, 1):
        # features of articles that the terms were not learned from
        part = article_features(Terms.fit(_rows(s, fold != f), y), _rows(s, fold == f), _rows(t, fold == f), len(labels))
        x = part if x is None else np.where((fold == f)[:, None], part, x)
    return Classifier(subjects, Terms.fit(s, y), Chain.fit(x, y, np.arange(len(labels)) // 2 % 2))


def sample(articles: DataFrame, labels: DataFrame, article_id: str, text: str, title: str, subject: str) -> tuple[list, list, list]:
    of = labels.where(f"`{article_id}` is not null and `{subject}` is not null").groupBy(F.col(article_id).alias("id")).agg(F.sort_array(F.collect_set(F.col(subject))).alias("labels"))
    chosen = of.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    named = articles.select(F.col(article_id).alias("id"), F.col(text).alias("text"), F.col(title).alias("title"))
    rows = named.join(F.broadcast(chosen), "id").where("text <> ''").where(F.length("text") <= EXAMPLE_CHARS).groupBy("id").agg(F.max("text").alias("text"), F.max("title").alias("title"), F.first("labels").alias("labels")).orderBy(F.xxhash64("id"), "id").collect()
    return [r["text"] for r in rows], [r["title"] for r in rows], [r["labels"] for r in rows]


def classified(articles: DataFrame, labels: DataFrame, article_id: str = "id", text: str = "text", title: str = "title", subject: str = "subject") -> DataFrame:
    """``(id, subjects, probability)`` of every article row."""
    return decoded(articles, fitted(articles, labels, article_id, text, title, subject), article_id, text, title)


def fitted(articles: DataFrame, labels: DataFrame, article_id: str = "id", text: str = "text", title: str = "title", subject: str = "subject") -> Classifier | None:
    """The classifier of the labels, for ``decoded``; None if there is nothing to learn from."""
    return fit(*sample(articles, labels, article_id, text, title, subject))


def decoded(articles: DataFrame, model: Classifier | None, article_id: str = "id", text: str = "text", title: str = "title") -> DataFrame:
    """``classified`` by a classifier that was fitted before."""
    kept = articles.select(F.col(article_id).alias("id"), F.col(text).alias("text"), F.col(title).alias("title"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found, p = model(part.column(1), part.column(2)) if model else ([[]] * part.num_rows, np.ones(part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string())), pa.array(p)], names=["id", "subjects", "probability"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, subjects array<string>, probability double")


def subjects_of(classes: DataFrame) -> DataFrame:
    """``(id, subject)``, each once."""
    return classes.select("id", F.explode("subjects").alias("subject")).distinct()


def composition(found: DataFrame) -> DataFrame:
    """``(subject, n_articles)``: the corpus by subject; an article of two subjects counts for both."""
    return found.groupBy("subject").agg(F.count("*").alias("n_articles"))

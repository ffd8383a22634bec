"""Queries of the operators of this package."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.llm import subjects, toxicity
from inkstream.llm.contamination import leaked_items
from inkstream.llm.crf import Model
from inkstream.llm.encoding import Vocabulary, encoded
from inkstream.llm.lookalikes import one_form, same_look_classes, same_look_pairs
from inkstream.llm.neardup import near_duplicates, pairs_of
from inkstream.session import table


@lru_cache(maxsize=4)
def _classifier(spark: SparkSession, sf_dir: str) -> subjects.Classifier | None:
    """The chain of these tables' labels, fitted once in a session."""
    return subjects.fitted(table(spark, sf_dir, "wikipedia_articles"), table(spark, sf_dir, "subject_labels"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(subjects.decoded(table(spark, sf_dir, "wikipedia_articles"), _classifier(spark, sf_dir)))


def p1_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(table(spark, sf_dir, "wikipedia_articles"), "id", ["title", "text"])


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_classes(table(spark, sf_dir, "wikipedia_articles"), "id", ["title", "text"])


def p2_one_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_form(table(spark, sf_dir, "wikipedia_articles").select("id", "title", "text"), ["title", "text"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(p3_classes(spark, sf_dir).withColumnRenamed("pid", "id")).withColumnsRenamed({"id_a": "pid_a", "id_b": "pid_b"})


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "passage_collection"), "pid", "text").withColumnRenamed("id", "pid")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), Vocabulary.read())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_passages(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("shared").alias("most_shared"))


@lru_cache(maxsize=4)
def _field(spark: SparkSession, sf_dir: str) -> Model | None:
    """The field of these tables' labels, fitted once in a session."""
    return toxicity.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.tagged(table(spark, sf_dir, "documents"), _field(spark, sf_dir), carry=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rates(p8_scores(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_composition, p2_found, p2_classes, p2_one_form, p3_found, p3_classes, p6_ids, p7_found, p7_passages, p7_items, p8_found, p8_scores, p8_rates)}
ORACLE: dict[str, str] = {}

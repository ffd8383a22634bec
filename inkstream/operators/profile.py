"""User vectors from interactions, personal search, recent context."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.operators.dense import doubles


def mean_vector(interactions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(user_id, embedding)``: the mean of the vectors ``(id, embedding)`` of each user's ``(user_id, id)``; repeats count again.

    Interactions are counted per user and vector first, and every task has one running mean per user, so a busy user is
    no more than a vector per task.
    """
    counted = interactions.where("user_id is not null and id is not null").groupBy("user_id", "id").agg(F.count("*").cast("double").alias("n"))
    known = vectors.where("embedding is not null").select("id", array_to_vector(doubles(F.col("embedding"))).alias("v"))
    means = counted.join(known, "id").groupBy("user_id").agg(Summarizer.mean(F.col("v"), F.col("n")).alias("v"))
    return means.select("user_id", vector_to_array("v").alias("embedding"))


def recent(interactions: DataFrame, k: int, *newest_first: str) -> DataFrame:
    """The last ``k`` interactions of each user."""
    order = [F.desc(c) for c in newest_first]
    return interactions.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def personal_queries(users: DataFrame, queries: DataFrame, weight: float = 0.7) -> DataFrame:
    """``(qid, user_id, embedding)`` of ``queries (qid, user_id, embedding)``: ``weight`` of the user's vector, the rest the query's."""
    mixed = F.zip_with(F.col("u.embedding"), doubles(F.col("q.embedding")), lambda u, q: F.round(u * weight + q * (1 - weight), 9))
    return queries.alias("q").join(users.alias("u"), "user_id").select("q.qid", "user_id", mixed.alias("embedding"))


def merged_recall(lists: list[DataFrame]) -> DataFrame:
    out = lists[0].select("qid", "id")
    for x in lists[1:]:
        out = out.unionByName(x.select("qid", "id"))
    return out.dropDuplicates()


def recent_context(log: DataFrame, user: str, text: str, turns: int, *newest_first: str) -> DataFrame:
    """``(user_id, context)``: each user's last ``turns`` texts, oldest first, a line each."""
    order = [F.desc(c) for c in newest_first]
    last = log.where(F.col(user).isNotNull() & F.col(text).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("_n") <= turns)
    lines = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(text).alias("t")))), lambda s: s["t"])
    return last.groupBy(F.col(user).alias("user_id")).agg(F.array_join(lines, "\n").alias("context"))


def rerank(candidates: DataFrame, training: DataFrame, features: list[str], label: str, k: int = 5, seed: int = 7) -> DataFrame:
    """The ``k`` best ``candidates (qid, id, features)`` of each query by boosted trees that were trained on ``training``; without training rows all score 0."""
    return _first(_tree_scores(candidates, training, features, label, seed), k)


def rerank_held_out(rows: DataFrame, features: list[str], label: str, k: int = 5, seed: int = 7, folds: int = 2) -> DataFrame:
    """``rerank`` of ``rows (qid, id, features, label)`` where no query is ranked by trees that saw its labels: queries are in ``folds`` by hash, each scored by the others' trees."""
    fold = F.pmod(F.xxhash64("qid"), F.lit(folds))
    scored = [_tree_scores(rows.where(fold == f), rows.where(fold != f), features, label, seed) for f in range(folds)]
    return _first(reduce(DataFrame.unionByName, scored), k)


def _tree_scores(candidates: DataFrame, training: DataFrame, features: list[str], label: str, seed: int) -> DataFrame:
    if training.isEmpty():
        return candidates.withColumn("score", F.lit(0.0))
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="keep")
    model = GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="_p", maxIter=10, maxDepth=3, seed=seed).fit(assembler.transform(training))
    return model.transform(assembler.transform(candidates)).withColumn("score", F.round("_p", 6)).drop("_features", "_p")


def _first(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

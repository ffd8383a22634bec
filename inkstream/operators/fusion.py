"""Ranked lists ``(qid, id, rank[, score])`` put together."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best(scored: DataFrame, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def reciprocal_rank(lists: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (constant + rank)`` over the lists."""
    every = reduce(DataFrame.unionByName, [x.select("qid", "id", "rank") for x in lists])
    return best(every.groupBy("qid", "id").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9).alias("score")), k)


def min_max(scored: DataFrame) -> DataFrame:
    """Scores of each query on 0 to 1; a list of equal scores is all 1."""
    w = Window.partitionBy("qid")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scored.select("qid", "id", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)).alias("score"))


def weighted(first: DataFrame, second: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """``alpha`` of the first list's and ``1 - alpha`` of the second's normalised score; missing scores count 0."""
    a, b = min_max(first).withColumnRenamed("score", "a"), min_max(second).withColumnRenamed("score", "b")
    total = alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))
    return best(a.join(b, ["qid", "id"], "full_outer").select("qid", "id", F.round(total, 6).alias("score")), k)


def pool(lists: list[DataFrame], depth: int = 50) -> DataFrame:
    """The different ``(qid, id)`` within the first ``depth`` of any list."""
    return reduce(DataFrame.unionByName, [x.where(F.col("rank") <= depth).select("qid", "id") for x in lists]).distinct()


def mmr(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, balance: float = 0.5) -> DataFrame:
    """``(qid, id, rank)``: hits reordered by maximal marginal relevance, greedily; of equal values the nearer hit wins.

    A group is one query's hits, as many as the search fetched.
    """
    qtype, itype = (hits.schema[c].dataType.simpleString() for c in ("qid", "id"))
    full = hits.select("qid", "id", F.col("rank").alias("was")).join(vectors.select("id", "embedding"), "id").join(queries.select("qid", F.col("embedding").alias("asked")), "qid")

    def unit(rows: list) -> np.ndarray:
        m = np.array(rows, np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("was")
        v, q = unit([list(x) for x in group["embedding"]]), unit([list(group["asked"].iloc[0])])[0]
        near, like = np.round(v @ q, 9), np.round(v @ v.T, 9)
        chosen: list[int] = []
        while len(chosen) < min(k, len(group)):
            rest = [i for i in range(len(group)) if i not in chosen]
            value = [balance * near[i] - (1 - balance) * (max(like[i][j] for j in chosen) if chosen else 0.0) for i in rest]
            chosen.append(rest[int(np.argmax(np.round(value, 9)))])
        return pd.DataFrame({"qid": group["qid"].iloc[0], "id": group["id"].iloc[chosen].to_numpy(), "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return full.groupBy("qid").applyInPandas(pick, f"qid {qtype}, id {itype}, rank int")

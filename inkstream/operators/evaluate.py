"""Retrieval metrics of ranked lists ``(qid, id, rank)`` against judgements ``(qid, id[, rel])``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def relevant(qrels: DataFrame, at_least: int | None = None) -> DataFrame:
    """Judged pairs once; with ``at_least`` only those of that grade."""
    kept = qrels.where("qid is not null and id is not null")
    return (kept if at_least is None else kept.where(F.col("rel") >= at_least)).select("qid", "id").distinct()


def flagged(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """``ranked`` with whether each hit is relevant."""
    return ranked.join(judged.withColumn("hit", F.lit(True)), ["qid", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def per_query(ranked: DataFrame, judged: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row per query of ``queries (qid)``: hits within each k, first relevant rank within the largest, relevant documents."""
    hits = flagged(ranked, judged)
    within = [F.count_distinct(F.when(F.col("hit") & (F.col("rank") <= k), F.col("id"))).alias(f"hits_{k}") for k in ks]
    found = hits.groupBy("qid").agg(*within, F.min(F.when(F.col("hit") & (F.col("rank") <= max(ks)), F.col("rank"))).alias("first"))
    base = queries.select("qid").distinct().join(judged.groupBy("qid").agg(F.count("*").alias("n_rel")), "qid", "left").join(found, "qid", "left")
    return base.fillna(0, ["n_rel", *[f"hits_{k}" for k in ks]])


def means(ks: tuple[int, ...] = KS) -> list[Column]:
    def mean(c: Column, name: str) -> Column:
        return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)

    out = [F.count("*").alias("n_queries")]
    for k in ks:
        h = F.col(f"hits_{k}")
        out += [mean(F.when(F.col("n_rel") > 0, h / F.col("n_rel")).otherwise(0.0), f"recall_{k}"), mean(h / F.lit(k), f"precision_{k}"), mean((h > 0).cast("double"), f"hit_{k}")]
    return [*out, mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr")]


def metrics(ranked: DataFrame, judged: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS, by: str | None = None) -> DataFrame:
    """Recall, precision and hit rate at each k, and the mean reciprocal rank, over all ``queries``; ``by`` groups by a column of theirs."""
    rows = per_query(ranked, judged, queries, ks)
    if by is None:
        return rows.agg(*means(ks))
    return rows.join(queries.select("qid", by).dropDuplicates(["qid"]), "qid").groupBy(by).agg(*means(ks))


def delta(ours: DataFrame, base: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """``(metric, base, ours, delta)`` of recall at each k and the mean reciprocal rank."""
    names = [*[f"recall_{k}" for k in ks], "mrr"]
    long = [F.struct(F.lit(n).alias("metric"), F.col(f"base.{n}").alias("base"), F.col(f"ours.{n}").alias("ours")) for n in names]
    both = ours.select(F.struct(*names).alias("ours")).join(F.broadcast(base.select(F.struct(*names).alias("base"))))
    return both.select(F.inline(F.array(*long))).withColumn("delta", F.round(F.col("ours") - F.col("base"), 6))


def ndcg(ranked: DataFrame, qrels: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Mean normalised discounted gain at each k with gains ``2^rel - 1``; a pair judged twice has its higher grade, a query without gain scores 0."""
    graded = qrels.where("qid is not null and id is not null").groupBy("qid", "id").agg(F.max("rel").alias("rel"))
    ideal = graded.where("rel > 0").withColumn("best", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id"))).where(F.col("best") <= max(ks))

    def gain(rank: str, k: int) -> Column:
        return F.sum(F.when(F.col(rank) <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col(rank) + 1)))

    got = ranked.join(graded, ["qid", "id"]).groupBy("qid").agg(*[gain("rank", k).alias(f"dcg_{k}") for k in ks])
    most = ideal.groupBy("qid").agg(*[gain("best", k).alias(f"idcg_{k}") for k in ks])
    rows = queries.select("qid").distinct().join(got, "qid", "left").join(most, "qid", "left")
    return rows.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(F.coalesce(F.col(f"dcg_{k}") / F.col(f"idcg_{k}"), F.lit(0.0))), 6).alias(f"ndcg_{k}") for k in ks])


def personalized_gain(personal: DataFrame, standard: DataFrame, k: int = 10) -> DataFrame:
    """Gain of the hit rate in per cent; null where the standard one is 0."""
    p, s = (d.select(F.col(f"hit_{k}").alias(n)) for d, n in ((personal, "personal"), (standard, "standard")))
    return p.join(F.broadcast(s)).select("personal", "standard", F.round(F.when(F.col("standard") != 0, (F.col("personal") - F.col("standard")) / F.col("standard") * 100), 6).alias("gain_pct"))

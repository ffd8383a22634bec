"""BM25 over any tokens: a stored inverted index, and scores for many queries in one plan.

The index is written once, as Parquet in the checkpoint folder or under a path, and asked as often as needed. It is
partitioned by document: a query's terms go to all partitions, each scores its own documents, and only the best leave
it. So neither a frequent term nor a long posting list is ever in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstream.functions.text import tokens
from inkstream.session import bucketed, cut, stored

# The ranking function's usual constants.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Asked terms, a row per query and term, that are sent to all partitions; more are shuffled, with the documents spread by a salt.
MOST_ASKED = 200_000
SALTS = 16


@dataclass(frozen=True)
class LexicalIndex:
    """``postings (doc, dl, term, tf)`` sorted by term in every file, ``docs (doc, dl)``, ``corpus (n_docs, avgdl)`` and ``terms (term, df, idf)``."""

    postings: DataFrame
    docs: DataFrame
    corpus: DataFrame
    terms: DataFrame

    @cached_property
    def average(self) -> float:
        return self.corpus.first()["avgdl"] or 1.0

    def save(self, path: str) -> None:
        for name in ("postings", "docs", "corpus", "terms"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "docs", "corpus", "terms")))


def build_index(docs: DataFrame, tokenize: Callable[[Column], Column] = tokens, doc: str = "doc", text: str = "text", buckets: int | None = None) -> LexicalIndex:
    """The index of ``docs``, a row per document; every text is split once. A term in more than half of the documents gets ``EPSILON`` of the mean idf.

    Documents are dealt out to ``buckets``, one task each in a search; by default as many as the session has shuffle partitions.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = docs.select(F.col(doc).alias("doc"), tokenize(F.col(text)).alias("terms")).repartition(buckets, "doc")
    each = split.select("doc", F.size("terms").alias("dl"), F.explode_outer("terms").alias("term"))
    # terms were split where their document is: counting them moves nothing; a document without terms has one row without a term
    counted = bucketed(each.groupBy("doc", "dl", "term").agg(F.count("*").cast("int").alias("tf")), "doc", buckets, "term")
    lengths = stored(counted.select("doc", "dl").distinct())
    corpus = stored(lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")))
    postings = counted.where("term is not null")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = stored(df.join(F.broadcast(corpus)).select("term", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(postings, lengths, corpus, stored(terms))


def index_stats(index: LexicalIndex) -> DataFrame:
    return index.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.count_if(F.col("idf") < 0).alias("n_negative"), F.round(F.avg("idf"), 6).alias("mean_idf")).join(F.broadcast(index.corpus.select("n_docs", F.round("avgdl", 6).alias("avgdl"))))


def scores(index: LexicalIndex, queries: DataFrame, tokenize: Callable[[Column], Column] = tokens, most_asked: int = MOST_ASKED) -> DataFrame:
    """``(qid, doc, score)`` of ``queries (qid, text)`` for all documents that share a term; a repeated query token counts again."""
    asked = cut(queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    weight = (F.col("qtf") * F.col("idf")).alias("weight")
    if asked.count() <= most_asked:
        met = index.postings.join(F.broadcast(index.terms.join(F.broadcast(asked), "term").select("qid", "term", weight)), "term")
    else:
        salted = asked.join(index.terms, "term").select("qid", "term", weight).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = index.postings.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"])
    tf = F.col("tf")
    part = met.select("qid", "doc", (F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(index.average)))).alias("w"))
    return part.groupBy("qid", "doc").agg(F.round(F.sum("w"), 6).alias("score"))


def top_k(scored: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    """``(qid, doc, score, rank)``; of equal scores the document that was loaded first wins, and documents without a common term score 0.

    Every query gets the first ``k`` documents of ``docs (doc)`` as possible zeros, not all documents.
    """
    first = docs.select("doc").orderBy("doc").limit(k)
    # the first documents are ranked by themselves: all that score stay, and everything is scored once
    apart = scored.select("qid", "doc", "score").join(F.broadcast(first.withColumn("early", F.lit(True))), "doc", "left").withColumn("early", F.col("early").isNotNull())
    best = apart.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "early").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k).select("qid", "doc", "score", F.lit(1).alias("met"))
    zeros = queries.select("qid").distinct().join(F.broadcast(first.agg(F.collect_list("doc").alias("docs")))).select("qid", F.explode("docs").alias("doc"), F.lit(0.0).alias("score"), F.lit(0).alias("met"))
    both = best.unionByName(zeros).groupBy("qid", "doc").agg(F.max_by("score", "met").alias("score"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)

"""A vector index as a table ``(id, document, embedding)``, and exact nearest-neighbour search for many queries at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.operators.documents import numbered
from inkstream.operators.generation import Encoder, embed
from inkstream.session import cut

#: Queries whose vectors are sent to the tasks at once, and rows that meet them at once.
BLOCK, STEP = 2048, 1024


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles; null becomes a row of zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = max((len(x) for x in column if x.is_valid), default=0)
    if not column.null_count:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(column), -1) if len(column) else np.zeros((0, size))
    return np.array([x.as_py() if x.is_valid else [0.0] * size for x in column], np.float64).reshape(len(column), size)


def distances(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """``(queries, rows)``, smaller is nearer, to nine digits so that equal vectors tie; a zero vector is as far as an orthogonal one."""
    product = queries @ rows.T
    if metric == "cosine":
        long = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        d = 1 - np.divide(product, long, out=np.zeros_like(product), where=long > 0)
    elif metric == "l2":
        d = np.stack([np.sqrt(((rows - q) ** 2).sum(1)) for q in queries]) if len(queries) else product
    else:
        d = -product
    # adding 0 makes -0.0 a plain zero
    return np.round(d, 9) + 0.0


ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class Nearest:
    """The ``k`` nearest rows so far of each of some queries; of equal distances the smaller id."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.queries, self.k, self.metric = queries, k, metric
        self.of, self.d, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, object)
        self.worst = np.full(len(queries), np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Rows meet all queries, or those numbered ``asked``."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        for a in range(0, len(rows), STEP):
            d = distances(rows[a : a + STEP], self.queries[asked], self.metric)
            worst = self.worst[asked]
            limit = np.minimum(np.partition(d, self.k - 1, axis=1)[:, self.k - 1], worst) if d.shape[1] >= self.k else worst
            q, row = np.nonzero(d <= limit[:, None])
            self.keep(np.concatenate([self.of, asked[q]]), np.concatenate([self.d, d[q, row]]), np.concatenate([self.ids, ids[a : a + STEP][row]]))

    def keep(self, of: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], d, of)) if len(of) else np.empty(0, np.int64)
        of, d, ids = of[order], d[order], ids[order]
        begin = np.searchsorted(of, np.arange(len(self.queries)))
        place = np.arange(len(of)) - begin[of]
        full = of[place == self.k - 1]
        self.worst[full] = d[place == self.k - 1]
        near = place < self.k
        self.of, self.d, self.ids = of[near], d[near], ids[near]


def _block(index: DataFrame, asked: list, qtype: str, k: int, metric: str, exclude_self: bool) -> DataFrame:
    ids, vectors = [r["qid"] for r in asked], np.array([r["embedding"] for r in asked], np.float64)
    itype = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(vectors, k + exclude_self, metric)
        for batch in batches:
            if batch.num_rows:
                best.add(np.array(batch.column(0).to_pylist(), object), matrix(batch.column(1)))
        if len(best.of):
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.of], ARROW[qtype]), pa.array(best.ids.tolist(), ARROW[itype]), pa.array(best.d)], names=["qid", "id", "distance"])

    near = index.select("id", "embedding").where("embedding is not null and id is not null").mapInArrow(run, f"qid {qtype}, id {itype}, distance double")
    near = near.where("cast(qid as string) <> cast(id as string)") if exclude_self else near
    return ranked(near, k)


def ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``(qid, id, distance, rank)``: the ``k`` nearest rows of ``index (id, embedding)`` for each of ``queries (qid, embedding)``.

    The corpus stays where it is. Query vectors go to it in blocks; each task keeps its best rows of each query and only
    those are shuffled. Of several blocks, each one's result is written before the next is fetched, so the driver never
    has more than one. Of equal distances the smaller id wins. Distances have nine digits. A null id or vector is no row.
    """
    qtype = queries.schema["qid"].dataType.simpleString()
    return in_blocks(index, queries, block, lambda rows: _block(index, rows, qtype, k, metric, exclude_self))


def in_blocks(index: DataFrame, queries: DataFrame, block: int, of_block: Callable[[list], DataFrame]) -> DataFrame:
    """``of_block`` of every ``block`` of ``queries (qid, embedding)``, put together."""
    asked = queries.select("qid", "embedding").where("qid is not null and embedding is not null")
    rows = asked.limit(block + 1).collect()
    if not rows:
        types = (d.schema[c].dataType.simpleString() for d, c in ((queries, "qid"), (index, "id")))
        return index.sparkSession.createDataFrame([], "qid {}, id {}, distance double, rank int".format(*types))
    if len(rows) <= block:
        return of_block(rows)
    placed = cut(asked)
    # by hash, with some room, so that hardly a block is larger
    blocks = -(-placed.count() * 9 // (8 * block))
    parts = []
    for b in range(blocks):
        rows = placed.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        parts += [cut(of_block(rows))] if rows else []
    return reduce(DataFrame.unionByName, parts)


def embedded(docs: DataFrame, encoder: Encoder) -> DataFrame:
    """``(id, embedding)`` of ``docs (doc, text)``, written once."""
    return cut(docs.select(F.col("doc").alias("id"), embed(F.col("text"), encoder).alias("embedding")))


def search_texts(index: DataFrame, queries: DataFrame, encoder: Encoder, k: int = 10) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` rows of ``index (id, embedding)`` nearest to each of ``queries (qid, text)`` by the encoder's vectors; the score is the cosine."""
    asked = cut(queries.select("qid", embed(F.col("text"), encoder).alias("embedding")))
    return search(index, asked, k).select("qid", "id", F.round(1 - F.col("distance"), 9).alias("score"), "rank")


def above(hits: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Hits of at least that cosine similarity."""
    return hits.where(F.round(1 - F.col("distance"), 9) >= threshold)


def add_documents(index: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """``index`` with ``rows`` under new ids ``doc_<n>`` that go on where the index ends."""
    start = index.agg(F.coalesce(F.max(F.regexp_extract("id", r"^doc_(\d+)$", 1).try_cast("bigint")) + 1, F.lit(0)).alias("start"))
    new = numbered(rows, *order).join(F.broadcast(start)).withColumn("id", F.concat(F.lit("doc_"), F.col("id") + F.col("start"))).drop("start")
    return index.unionByName(new.select(index.columns))


def delete_documents(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


def update_documents(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows whose id is in ``changes`` get its columns; unknown ids change nothing."""
    new = changes.dropDuplicates(["id"]).select("id", F.struct(*[c for c in changes.columns if c != "id"]).alias("_new"))
    fields = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in changes.columns and c != "id" else F.col(c) for c in index.columns]
    return index.join(new, "id", "left").select(*fields)


def index_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("document_count"))

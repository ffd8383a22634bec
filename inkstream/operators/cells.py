"""An approximate vector index: every row in the cell of its nearest centre, queries only meet the cells nearest to them.

The centres are fitted on a bounded sample; every row is indexed. The table is stored by cell, so that cells which no
query of a block asks for are not read. Within the cells distances are exact. ``dense.search`` is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.operators.dense import ARROW, BLOCK, Nearest, in_blocks, l2_normalize, matrix, ranked
from inkstream.session import stored

#: Vectors that the centres are fitted on, the first by hash of their id, and the most centres.
SAMPLE, MOST_CELLS = 50_000, 1024
#: Vectors of the sample that tell how many cells a query must look into, as many of them as queries, and the share of the nearest that it must find there.
TRIED, TRIED_QUERIES, FOUND = 4000, 400, 0.98


@dataclass(frozen=True)
class CellIndex:
    """``rows (cell, id, embedding)``, the centres, unit vectors, and how many cells a query looks into."""

    rows: DataFrame
    centers: np.ndarray
    probes: int


def units(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=np.zeros_like(rows), where=n > 0)


def probes_for(sample: np.ndarray, centers: np.ndarray, k: int = 10) -> int:
    """Cells of which a query needs the nearest so many, to meet ``FOUND`` of its ``k`` nearest vectors of the sample."""
    asked = sample[:TRIED_QUERIES]
    like = asked @ sample.T
    like[np.arange(len(asked)), np.arange(len(asked))] = -2
    near = np.argsort(-like, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, (sample @ centers.T).argmax(1)[near], axis=1)
    return int(np.quantile(needed, FOUND, method="higher")) + 1


def build_cells(index: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> CellIndex:
    """The index of ``index (id, embedding)`` by cosine, with about the square root of the sample as number of cells. A null id or vector is no row; zero vectors are in the first cell."""
    known = index.select("id", "embedding").where("id is not null and embedding is not null")
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    some = stored(some)
    n = some.count()
    k = max(1, min(MOST_CELLS, cells or round(n**0.5)))
    centers = units(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(some).clusterCenters())) if n > k else np.zeros((1, 1))
    probes = probes_for(np.array([r[0].toArray() for r in some.limit(TRIED).collect()]), centers) if n > k else 1
    itype, etype = (index.schema[c].dataType.simpleString() for c in ("id", "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1))
            cell = (v @ centers.T).argmax(1) if len(centers) > 1 else np.zeros(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "id", "embedding"])

    placed = known.mapInArrow(run, f"cell int, id {itype}, embedding {etype}")
    return CellIndex(stored(placed, "cell"), centers, probes)


def search_cells(index: CellIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """``(qid, id, distance, rank)``: the ``k`` nearest rows by cosine in the cells nearest to each of ``queries (qid, embedding)``. With ``probes`` as many as there are cells it's exact."""
    qtype, itype = queries.schema["qid"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    cells = len(index.centers)
    probes = min(cells, probes or index.probes)

    def of_block(asked: list) -> DataFrame:
        ids, vectors = [r["qid"] for r in asked], np.array([r["embedding"] for r in asked], np.float64)
        near = np.argsort(-(vectors @ index.centers.T), axis=1, kind="stable")[:, :probes] if cells > 1 else np.zeros((len(ids), 1), np.int64)
        by_cell = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Nearest(vectors, k + exclude_self, "cosine")
            for batch in batches:
                cell, names, v = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object), matrix(batch.column(2))
                for c in np.unique(cell):
                    best.add(names[cell == c], v[cell == c], by_cell[int(c)])
            if len(best.of):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.of], ARROW[qtype]), pa.array(best.ids.tolist(), ARROW[itype]), pa.array(best.d)], names=["qid", "id", "distance"])

        met = index.rows.where(F.col("cell").isin(list(by_cell))).select("cell", "id", "embedding").mapInArrow(run, f"qid {qtype}, id {itype}, distance double")
        return ranked(met.where("cast(qid as string) <> cast(id as string)") if exclude_self else met, k)

    return in_blocks(index.rows, queries, block, of_block)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(n_hits, recall)``: the share of the exact hits ``(qid, id)`` that were found."""
    both = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return both.agg(F.count("*").alias("n_hits"), F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1)), 6).alias("recall"))

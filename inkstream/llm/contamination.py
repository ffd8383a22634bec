"""Evaluation texts that leak into training text: a prefix-filtered set join of item shingles with document shingles.

Shingles are the distinct 12-character sequences of folded text, told apart by 128 bits. A document holds an item when
at least ``share`` of the item's shingles occur in it.

One scan of the documents, whatever the number of items, finds the shingles that an item has too; a bitmap of fixed size
lets most others go. Shingles are ordered by rarity, the number of document rows that have them. Of every item only the
rarest shingles, its prefix, are joined: a document that holds ``need`` of an item's ``n`` shingles holds ``d`` of the
first ``n - need + d``. What is joined must keep three bounds: ``d`` shingles in the prefix, enough shingles in the
document (length), and enough left on both sides behind the place of each of the ``d`` in the order by rarity (position).
The pairs that are left are verified exactly, shingle by shingle, in windows as long as the item.

Result cases
    null, empty or short texts  have no shingle: the document holds nothing, the item is found nowhere
    repeated item rows          rows of one item id make one item; a null item id is no item
    repeated document rows      rows of one doc id make one document; a null doc id is no document
    very long texts             scanned whole
    hot shingle or item         items' shingles are broadcast up to ``MOST_TOKENS`` rows, beyond that joined under a salt
    empty tables                empty result
    clashing names              only the named columns are read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.llm.codepoints import grams
from inkstream.llm.folding import folder, without_markup
from inkstream.session import cut

#: Items' shingles, with one row each, that are sent to all tasks; more are joined by shuffling, a part of the documents at a time.
MOST_TOKENS = 200_000
SALTS = 16
#: The bitmap of shingle values has 2 ** SLOTS bits (2 MB). A fuller one only lets more through to the join.
SLOTS = 24
#: Prefix shingles that a candidate must hold.
DEPTH = 4
TOKEN = ["token", "check"]


def second_hash(points: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """64 bits more of the n-grams that begin at ``starts``."""
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = (h ^ points[starts + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def shingles(rows: DataFrame, n: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """``(id, token, check, pos, size)`` of ``(id, text)``: each shingle of each row at its first place, only those that ``bitmap`` has if given.

    ``size``, the number of the row's shingles, is at its first one; the others have 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, offsets = folder()(batch.column(1))
            values, at = grams(points, offsets, n)
            near = np.arange(len(values))
            if bitmap is not None:
                slot = values >> np.uint64(64 - SLOTS)
                near = np.flatnonzero(bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1))
            row = np.searchsorted(at, near, "right") - 1
            order = np.lexsort((near, values[near], row))
            near, row = near[order], row[order]
            once = np.ones(len(near), bool)
            once[1:] = (row[1:] != row[:-1]) | (values[near[1:]] != values[near[:-1]])
            near, row = near[once], row[once]
            pos = near - at[row]
            first = np.ones(len(row), bool)
            first[1:] = row[1:] != row[:-1]
            check = second_hash(points, offsets[row] + pos, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(values[near].view(np.int64)), pa.array(check.view(np.int64)), pa.array(pos, pa.int32()), pa.array(np.where(first, np.diff(at)[row], 0), pa.int32())],
                names=["id", *TOKEN, "pos", "size"],
            )

    return rows.where("id is not null and text <> ''").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, token bigint, check bigint, pos int, size int")


def bitmap_of(tokens: DataFrame) -> np.ndarray:
    """The bits of the tokens' highest ``SLOTS`` bits, put together by Spark; at most 2 ** (SLOTS - 6) words come to the driver."""
    slot = F.shiftrightunsigned("token", 64 - SLOTS)
    words = tokens.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - SLOTS}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (SLOTS - 6), np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def with_items(documents: DataFrame, items: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Inner join of document rows with rows of the items' shingles: broadcast if these are few, else shuffled with the documents of a hot key spread by a salt."""
    if small:
        return documents.join(F.broadcast(items), on)
    salted = items.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return documents.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*on, "_salt"]).drop("_salt")


def ordered(items: DataFrame, rarity: DataFrame, share: float) -> DataFrame:
    """``(item_id, token, check, df, rank, n, need, depth)``: each item's shingles, the rarest first."""
    of_item = Window.partitionBy("item_id")
    ranked = items.join(rarity, TOKEN, "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = ranked.withColumn("rank", F.row_number().over(of_item.orderBy("df", *TOKEN))).withColumn("n", F.count("*").over(of_item).cast("int"))
    need = F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)).cast("int")
    return ranked.withColumn("need", need).withColumn("depth", F.least("need", F.lit(DEPTH)))


def candidates(documents: DataFrame, order: DataFrame, small: bool) -> DataFrame:
    """``(doc_id, item_id)`` that keep the bounds of ``documents (doc_id, token, check, df, y_rank, y, size)``."""
    prefix = order.where(F.col("rank") <= F.col("n") - F.col("need") + F.col("depth")).drop("df")
    met = with_items(documents, prefix, TOKEN, small).where("y >= need and size >= need")
    places = F.array_sort(F.collect_list(F.struct("rank", "y_rank")))
    pairs = met.groupBy("doc_id", "item_id", "n", "need", "depth", "y").agg(places.alias("places")).where(F.size("places") >= F.col("depth"))
    # behind the k-th shingle in common, n - rank of the item's and y - y_rank of the document's can still be in common
    enough = F.transform(F.slice("places", 1, F.col("depth")), lambda p, k: k + 1 + F.least(F.col("n") - p["rank"], F.col("y") - p["y_rank"]) >= F.col("need"))
    return pairs.where(F.forall(enough, lambda ok: ok)).select("doc_id", "item_id")


def verified(pairs: DataFrame, documents: DataFrame, order: DataFrame, small: bool) -> DataFrame:
    """Exact counts of the pairs: every shingle of the item that the document has, and the item-sized window that has most of them."""
    shared = with_items(pairs, order.select("item_id", *TOKEN, "n", "need"), ["item_id"], small).join(documents.select("doc_id", *TOKEN, "pos"), ["doc_id", *TOKEN])
    # windows of n places: their length is 1 in units of n
    in_window = F.expr("count(*) over (partition by doc_id, item_id order by pos / n range between current row and 0.9999999999D following)")
    windows = shared.withColumn("in_window", in_window)
    counted = windows.groupBy("doc_id", "item_id", "n", "need").agg(F.count("*").alias("shared"), F.max_by("pos", F.struct("in_window", -F.col("pos"))).alias("start"))
    return counted.where("shared >= need").select("doc_id", "item_id", F.col("shared").cast("int").alias("shared"), F.col("n").alias("item_shingles"), "start")


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, share: float = 0.3, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``(doc_id, item_id, shared, item_shingles, start)``: every document with the items it holds.

    ``start`` is the folded position where the densest item-sized window begins; of a doc id with several rows, places
    count from the beginning of the row.
    """
    asked = items.select(F.col(item_id).alias("id"), without_markup(F.col(item_text)).alias("text"))
    tokens = cut(shingles(asked, n).select(F.col("id").alias("item_id"), *TOKEN).distinct())
    corpus = documents.select(F.col(doc_id).alias("id"), without_markup(F.col(text)).alias("text"))
    hits = cut(shingles(corpus, n, bitmap_of(tokens)).withColumnRenamed("id", "doc_id"))
    order = cut(ordered(tokens, hits.groupBy(*TOKEN).agg(F.count("*").alias("df")), share))
    small = order.count() <= most_tokens
    once = hits.groupBy("doc_id", *TOKEN).agg(F.min("pos").alias("pos"), F.sum("size").alias("size"))
    of_doc = Window.partitionBy("doc_id")
    # what the bitmap let through without being an item's shingle falls out of this join
    known = with_items(once.withColumn("size", F.sum("size").over(of_doc)), order.select(*TOKEN, "df").distinct(), TOKEN, small)
    ranked = known.withColumn("y_rank", F.row_number().over(of_doc.orderBy("df", *TOKEN))).withColumn("y", F.count("*").over(of_doc))
    return verified(candidates(ranked, order, small), known, order, small)

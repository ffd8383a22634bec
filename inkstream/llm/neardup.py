"""Near-duplicate texts: bit-sliced comparison of signatures within minhash buckets, then an exact check.

Similarity is that of the sets of distinct ``n``-character sequences of the folded texts (shared / in either).

Each text gets bucket keys of a few minhash values each, and a signature of 128 one-bit minhashes. Texts that share a
bucket are compared by the Hamming distance of their signatures, all of a bucket at once on bit planes; pairs within a
radius are checked on their texts. ``Bands.of`` derives buckets, values and radius from the least similarity, so that a
pair exactly there is missed with a chance of at most ``MISSED`` (1 of 1,000), a more similar one with less. At 0.6 that
is 29 buckets of 3 values and radius 44: 1 of 1,100 pairs is missed at 0.6, 1 of 10,000 at 0.65, 1 of 190,000 at 0.7.

Result cases
    null, empty, short texts   in no group: their class is their own id, without links
    exact copies               one text to the search, told apart by 128 bits, so a hot group of copies costs nothing; all get its class
    hot bucket of unlike texts streamed past memory and compared in blocks of ``BLOCK`` by many tasks
    repeated id, same text     one row
    null id                    left out
    empty table                empty result
    clashing names             only the named columns are read
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.bitslice import near_across, near_in_buckets
from inkstream.llm.codepoints import decode, encode, grams
from inkstream.llm.folding import folder, without_markup
from inkstream.llm.pairs import pairs_within
from inkstream.operators.skew import join_hot
from inkstream.session import cut

SIGNATURE = 128
#: Share of the pairs of exactly the least similarity that may be missed, a tenth of it by the radius.
MISSED = 0.001
#: Buckets of more texts are compared in blocks of so many.
BLOCK = 16_384
#: From this size on a bucket is compared by itself.
LARGE = 128
STEP = 400_000

MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


@dataclass(frozen=True)
class Bands:
    """``count`` buckets of ``rows`` minhash values, and the largest distance of signatures that are looked at."""

    count: int
    rows: int
    radius: int

    @classmethod
    def of(cls, share: float, missed: float = MISSED) -> Bands:
        """The most values a bucket, so the fewest chance meetings, that the signature's values suffice for."""
        if not 0 < share <= 1:
            raise ValueError(f"share is {share}, not above 0 and at most 1")
        for rows in range(8, 0, -1):
            met = share**rows
            count = 1 if met == 1 else math.ceil(math.log(0.9 * missed) / math.log1p(-met))
            if count * rows <= SIGNATURE:
                return cls(count, rows, cls._radius(share, missed))
        raise ValueError(f"share is {share}: {SIGNATURE} minhash values can't find pairs of so little in common")

    @staticmethod
    def _radius(share: float, missed: float) -> int:
        differ, total = (1 - share) / 2, 0.0
        for d in range(SIGNATURE + 1):
            total += math.comb(SIGNATURE, d) * differ**d * (1 - differ) ** (SIGNATURE - d)
            if total >= 1 - 0.1 * missed:
                return d
        return SIGNATURE


#: The radius at the similarity that the operator asks by default.
RADIUS = Bands.of(0.6).radius


def minhashes(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``(rows, SIGNATURE)`` minhash values of non-empty rows of n-gram values."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, SIGNATURE), np.uint32)
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + STEP, "right")) - 1)
        part, where = low[at[start] : at[stop]], at[start:stop] - at[start]
        for k in range(SIGNATURE):
            out[start:stop, k] = np.minimum.reduceat(part * MULTIPLIERS[k], where)
        start = stop
    return out


def text_hash(column: pa.Array) -> np.ndarray:
    """``(rows, 2)``: 128 bits of each text."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s) for s in column.cast(pa.binary()).to_pylist()), np.int64).reshape(-1, 2)


def _folded(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of at least ``least`` folded characters: their numbers, code points and offsets."""
    points, offsets = folder()(batch.column(1))
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes >= least)
    return long, points[np.repeat(sizes >= least, sizes)], np.concatenate([[0], np.cumsum(sizes[long])])


def sign(texts: DataFrame, n: int, least: int, bands: Bands) -> DataFrame:
    """``(id, rid, h1, h2, s0, s1, bands)`` of each text that is long enough; ``h1`` and ``h2`` are the folded text's hash, ``rid`` is ``h1``."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, points, offsets = _folded(batch, least)
            if not len(long):
                continue
            low = minhashes(*grams(points, offsets, n))
            bits = np.packbits((low >> np.uint32(7) & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
            key = np.zeros((len(low), bands.count), np.uint64)
            for k in range(bands.rows):
                key = (key ^ low[:, k * bands.count : (k + 1) * bands.count]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys = (key >> np.uint64(32)).astype(np.uint32)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands.count * 4), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            h1, h2 = (pa.array(h) for h in text_hash(encode(points, offsets)).T)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long)), h1, h1, h2, pa.array(bits[:, 0]), pa.array(bits[:, 1]), packed], names=["id", "rid", "h1", "h2", "s0", "s1", "bands"])

    return texts.mapInArrow(run, f"id {kind}, rid bigint, h1 bigint, h2 bigint, s0 bigint, s1 bigint, bands binary")


def separate(signed: DataFrame) -> DataFrame:
    """``signed`` with another ``rid`` for texts that only have the first 64 bits of their hash in common with another; hardly ever there are any."""
    shared = signed.groupBy("rid").agg(F.min("h2").alias("least"), F.max("h2").alias("most")).where("least <> most").select("rid", "least")
    if shared.isEmpty():
        return signed
    return cut(signed.join(shared, "rid", "left").withColumn("rid", F.when(F.col("h2") > F.col("least"), F.xxhash64("h1", "h2")).otherwise(F.col("rid"))).select(signed.columns))


def spread(signed: DataFrame, bands: Bands) -> DataFrame:
    """``(key, rid, s0, s1)``: a row per text and bucket. Copies within a batch are sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            _, first = np.unique(rid, return_index=True)
            if not len(first):
                continue
            once = batch.take(pa.array(first))
            keys = np.frombuffer(b"".join(once.column(3).to_pylist()), np.uint32).reshape(len(first), bands.count).astype(np.int64) | (np.arange(bands.count, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(once.column(c).to_numpy(), bands.count)) for c in range(3))], names=["key", "rid", "s0", "s1"])

    return signed.select("rid", "s0", "s1", "bands").mapInArrow(run, "key bigint, rid bigint, s0 bigint, s1 bigint")


LINKS = "a bigint, b bigint, key bigint, block int, s0 bigint, s1 bigint"


def _rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None, block: np.ndarray | None = None, s: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b) if b is not None else none, pa.array(key) if key is not None else none, pa.array(block.astype(np.int32)) if block is not None else pa.nulls(n, pa.int32()), *([pa.array(s[:, 0]), pa.array(s[:, 1])] if s is not None else [none, none])],
        names=["a", "b", "key", "block", "s0", "s1"],
    )


def _links(rid: np.ndarray, s: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links within buckets of rows that follow each other."""
    start = np.cumsum(sizes) - sizes
    found = []
    few = (sizes > 1) & (sizes <= LARGE)
    rows = np.flatnonzero(np.repeat(few, sizes))
    for x, y in near_in_buckets(s[rows].view(np.uint64), sizes[few], radius):
        found.append((rid[rows[x]], rid[rows[y]]))
    for i in np.flatnonzero(sizes > LARGE):
        own = slice(start[i], start[i] + sizes[i])
        for x, y in near_across(s[own].view(np.uint64), s[own].view(np.uint64), radius):
            found.append((rid[own][x[x < y]], rid[own][y[x < y]]))
    if found:
        pairs = np.sort(np.stack([np.concatenate(c) for c in zip(*found)]), axis=0)
        pairs = np.unique(pairs, axis=1)
        yield _rows(pairs[0], pairs[1])


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, rid, s0, s1 = (batch.column(c).to_numpy() for c in range(4))
    return key, rid, np.stack([s0, s1], axis=1)


def compare_sorted(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key and rid. A bucket of more than ``BLOCK`` texts isn't held: its rows pass on with a block number."""
    key, rid, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 2), np.int64)
    hot, sent, last = None, 0, None
    for batch in batches:
        k, r, g = _arrays(batch)
        if not len(k):
            continue
        if hot is not None:
            m = int(np.searchsorted(k, hot, "right"))
            fresh = np.concatenate([[r[0] != last], r[1:m] != r[: m - 1]]) if m else np.empty(0, bool)
            if fresh.any():
                yield _rows(r[:m][fresh], None, k[:m][fresh], (sent + np.arange(fresh.sum())) // BLOCK, g[:m][fresh])
                sent, last = sent + int(fresh.sum()), r[m - 1]
            k, r, g = k[m:], r[m:], g[m:]
            if not len(k):
                continue
            hot = None
        key, rid, s = np.concatenate([key, k]), np.concatenate([rid, r]), np.concatenate([s, g])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])])
        key, rid, s = key[new], rid[new], s[new]
        at = int(np.searchsorted(key, key[-1]))
        yield from _links(rid[:at], s[:at], np.unique(key[:at], return_counts=True)[1], radius)
        key, rid, s = key[at:], rid[at:], s[at:]
        if len(key) > BLOCK:
            hot, sent, last = key[0], len(key), rid[-1]
            yield _rows(rid, None, key, np.arange(len(key)) // BLOCK, s)
            key, rid, s = key[:0], rid[:0], s[:0]
    if len(key):
        yield from _links(rid, s, np.array([len(key)]), radius)


def compare_blocks(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of a hot bucket; rows ``(side, rid, s0, s1, key, i, j)`` sorted by key, i, j, side."""
    held: list[tuple] = []
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        side, rid, s = (np.concatenate(c) for c in zip(*held))
        left = side == 0
        same = now[1] == now[2]
        for x, y in near_across(s[left].view(np.uint64), s[left if same else ~left].view(np.uint64), radius):
            a, b = rid[left][x], rid[left if same else ~left][y]
            take = a < b if same else slice(None)
            yield _rows(np.minimum(a, b)[take], np.maximum(a, b)[take])

    for batch in batches:
        side, rid, s = _arrays(batch)
        where = np.stack([batch.column(c).to_numpy() for c in (4, 5, 6)], axis=1)
        cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1), len(where)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if x == y:
                continue
            if now is not None and tuple(where[x]) != now:
                yield from done()
                held = []
            now = tuple(where[x])
            held.append((side[x:y], rid[x:y], s[x:y]))
    if held:
        yield from done()


def candidates(signed: DataFrame, bands: Bands) -> DataFrame:
    """``(a, b)``, a < b: the texts that share a bucket and whose signatures differ in the radius at most."""
    first = cut(spread(signed, bands).repartition("key").sortWithinPartitions("key", "rid").mapInArrow(partial(compare_sorted, radius=bands.radius), LINKS))
    links, hot = first.where("b is not null").select("a", "b"), first.where("b is null").select("key", "block", F.col("a").alias("rid"), "s0", "s1")
    if not hot.isEmpty():
        last = hot.groupBy("key").agg(F.max("block").alias("last"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("last")), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("bigint").alias("side")))
        cells = hot.join(last, "key").withColumn("p", F.explode(pairs)).select("p.side", "rid", "s0", "s1", "key", F.col("p.i").cast("bigint").alias("i"), F.col("p.j").cast("bigint").alias("j"))
        more = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(partial(compare_blocks, radius=bands.radius), LINKS)
        links = links.unionByName(more.select("a", "b"))
    return links.distinct()


def fold_rows(texts: DataFrame, least: int) -> DataFrame:
    """``(rid, folded)`` of rows ``(rid, text, h1, h2)`` whose text has that hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long, points, offsets = _folded(batch, least)
            folded = encode(points, offsets)
            h1, h2 = text_hash(folded).T
            ok = np.flatnonzero((h1 == batch.column(2).to_numpy()[long]) & (h2 == batch.column(3).to_numpy()[long]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(long[ok])), folded.take(pa.array(ok))], names=["rid", "folded"])

    return texts.select("rid", "text", "h1", "h2").mapInArrow(run, "rid bigint, folded string")


def distinct_of_rows(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, and the rows they are in."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


def similar(pairs: DataFrame, n: int, share: float) -> DataFrame:
    """The rows ``(a, b)`` of ``(a, b, folded_a, folded_b)`` that are similar enough, by their exact sets, some hundred pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                (x, i), (y, j) = (distinct_of_rows(*grams(*decode(part.column(c)), n)) for c in (2, 3))
                values, row = np.concatenate([x, y]), np.concatenate([i, j])
                order = np.lexsort((values, row))
                values, row = values[order], row[order]
                twice = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
                total, both = np.bincount(row, minlength=part.num_rows), np.bincount(row[1:][twice], minlength=part.num_rows)
                yield part.select(["a", "b"]).take(pa.array(np.flatnonzero(both >= share * (total - both) - 1e-9)))

    return pairs.select("a", "b", "folded_a", "folded_b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` of all vertices of the edges ``(a, b)``; the root is the component's least vertex. Alternating stars, each round written.

    A vertex may have any number of edges: those of the busiest stay where they are when its least neighbour is joined to them.
    """
    edges, before = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        edges = join_hot(both.where("b > a"), low, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        star = join_hot(edges, low, ["a"], "n").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(star.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        before = now


def near_duplicates(rows: DataFrame, id_col: str, text_col: str, n: int = 4, share: float = 0.6, least: int = 30, missed: float = MISSED) -> DataFrame:
    """``(id, class_id, n_links)``, one row per id and text: the class is named by its least id, ``n_links`` counts the different texts linked to the row's text."""
    texts = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), without_markup(F.col(text_col)).alias("text"))
    bands = Bands.of(share, missed)
    signed = separate(cut(sign(texts.where("text <> ''"), n, least, bands)))
    pairs = cut(candidates(signed, bands))
    of_text, hashes = signed.select("id", "rid").distinct(), signed.select("rid", "h1", "h2").distinct()
    by_text = of_text.groupBy("rid").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    named = by_text.join(asked, "rid", "left_semi").select("rid", F.col("least").alias("id")).join(hashes, "rid")
    folded = cut(fold_rows(texts.join(named, "id"), least).dropDuplicates(["rid"]))
    a, b = (folded.select(F.col("rid").alias(c), F.col("folded").alias(f"folded_{c}")) for c in "ab")
    links = cut(similar(pairs.join(a, "a").join(b, "b"), n, share))
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").cast("int").alias("n_links"))
    # a row per text until its class is known; then the rows of hot texts and of hot classes stay where they are
    linked = components(links).withColumnRenamed("v", "rid").join(degree, "rid")
    of_root = by_text.join(linked, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    roots = of_root.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("members"))
    classes = cut(join_hot(of_root, roots, ["root"], "members").select("rid", "copies", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    grouped = join_hot(of_text, classes, ["rid"], "copies").select("id", "class_id", "n_links")
    alone = texts.select("id").distinct().join(of_text.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(0).alias("n_links"))
    return grouped.unionByName(alone)


def pairs_of(classes: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: the pairs of different ids in the same class; a hot class is split into blocks."""
    return pairs_within(classes.select("class_id", "id").distinct(), "class_id", "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()

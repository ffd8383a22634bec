"""Encoding of a corpus with a public byte-level BPE tokenizer: overlapping chunks, stitched, then encoded in pieces.

Every text is chunks of ``chunk_chars`` characters, each followed by ``overlap`` characters of the next; a text of one
chunk is its own piece. Chunks are pre-tokenised by themselves, each a row that any task may have. Where a chunk and the
next have a pre-token boundary in common, the text can be cut: the pattern looks at nothing before a boundary, so from
there on both agree with the whole text. Neighbours without a common boundary (a run of letters or digits longer than
the overlap) become one wider chunk, which is pre-tokenised again; all others stay as they are. The pieces between the
cuts are encoded in parallel and their ids put together.

Result cases
    null, empty text      the empty list
    special-token strings ordinary text
    repeated rows         one result each; texts are told apart by 128 bits of id and text
    very long texts       every piece is a row of its own until the ids are put together
    empty table           empty result
    clashing names        only the named columns are read
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstream.session import cut

CHUNK_CHARS, OVERLAP = 1000, 100
#: No pre-token is decided by more characters after its boundary.
LOOKAHEAD = 3
KEY = ["k1", "k2"]
#: Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Vocabulary:
    """A file of byte strings (base64) and ranks, read once and sent to the tasks with the job."""

    data: bytes
    pattern: str = PATTERN

    @classmethod
    def read(cls, path: str | Path | None = None, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
        return cls(Path(path or tokenizer_folder() / name).read_bytes())

    @property
    def coder(self) -> tiktoken.Encoding:
        return _coder(self.data, self.pattern)


def tokenizer_folder() -> Path:
    try:
        import public_tokenizers

        return Path(public_tokenizers.__file__).parent
    except ImportError:
        return Path("/opt/tokenizers")


@lru_cache(maxsize=4)
def _coder(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def id_lists(texts: list[str | None], coder: tiktoken.Encoding) -> pa.Array:
    parts = [coder.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.uint32), *parts]).astype(np.int32)))


def encode_rows(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``text`` replaced by ``ids``, row by row."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), id_lists(part.column("text").to_pylist(), coder)], names=[*(f.name for f in kept), "ids"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", ids array<int>")


def chunk_rows(rows: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """``(k1, k2, i, doc_id, text)``: the chunks of rows ``(doc_id, text)``; the key is 128 bits of id and text."""
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (name, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(repr(name).encode() + b"\0" + text.encode()), np.int64)
                starts = range(0, max(1, len(text) - overlap), chunk_chars)
                for a in range(0, len(starts), 4096):
                    part = [text[s : s + chunk_chars + overlap] for s in starts[a : a + 4096]]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k1)), pa.array(np.full(n, k2)), pa.array(np.arange(a, a + n, dtype=np.int32)), batch.column(0).take(pa.array(np.full(n, at))), pa.array(part, pa.string())],
                        names=[*KEY, "i", "doc_id", "text"],
                    )

    return rows.select("doc_id", "text").mapInArrow(run, f"k1 bigint, k2 bigint, i int, doc_id {kind.simpleString()}, text string")


def boundaries(windows: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``(k1, k2, first, last, head, tail)`` of ``(k1, k2, first, last, text)``, the text of chunks ``first`` to ``last``: its pre-token boundaries, as places in the whole text, in the overlaps with the chunks before and after.

    Boundaries after white space are left out: there a cut would change how the white space before it is matched. So are
    those so near the end that what follows might move them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for first, last, text in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                ends = [m.end() for m in scan.finditer(text)]
                start, after = first * chunk_chars, (last - first + 1) * chunk_chars
                ends = [e for e in ends if (e < overlap or after <= e) and e <= len(text) - LOOKAHEAD and not text[e - 1].isspace()]
                heads.append([start + e for e in ends if e < overlap])
                tails.append([start + e for e in ends if e >= after])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*KEY, "first", "last", "head", "tail"])

    return windows.select(*KEY, "first", "last", "text").mapInArrow(run, "k1 bigint, k2 bigint, first int, last int, head array<int>, tail array<int>")


def joints(spans: DataFrame) -> DataFrame:
    """``spans`` with ``start`` and ``stop``, the last boundary in common with the neighbours, and ``open``: there is a next one, but no common boundary."""
    in_order = Window.partitionBy(*KEY).orderBy("first")
    after = F.lead("head").over(in_order)
    cut_at = spans.withColumn("stop", F.array_max(F.array_intersect("tail", after))).withColumn("open", after.isNotNull() & F.col("stop").isNull())
    return cut_at.withColumn("start", F.coalesce(F.lag("stop").over(in_order), F.lit(0)))


def wide_texts(chunks: DataFrame, spans: DataFrame, chunk_chars: int) -> DataFrame:
    """``spans (k1, k2, first, last, ...)`` of several chunks with ``doc_id`` and the ``text`` that the chunks make."""
    each = spans.withColumn("i", F.explode(F.sequence("first", "last")))
    own = F.when(F.col("i") < F.col("last"), F.substring("text", 1, chunk_chars)).otherwise(F.col("text"))
    names = [c for c in spans.columns if c not in ("head", "tail")]
    joined = chunks.join(each, [*KEY, "i"]).groupBy(*names).agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_set(F.struct("i", own.alias("t")))).alias("parts"))
    return joined.withColumn("text", F.array_join(F.transform("parts", lambda p: p["t"]), "")).drop("parts")


def stitched_pieces(rows: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``(k1, k2, start, copies, doc_id, text)``: the pieces of the texts of rows ``(doc_id, text)`` that can be encoded by themselves; ``copies`` rows had this id and text."""
    chunks = chunk_rows(rows, chunk_chars, overlap)
    spread = chunks.repartition(*KEY, "i").select(*KEY, F.col("i").alias("first"), F.col("i").alias("last"), "text")
    known = boundaries(spread, pattern, chunk_chars, overlap).groupBy(*KEY, "first", "last").agg(F.any_value("head").alias("head"), F.any_value("tail").alias("tail"), F.count("*").alias("copies"))
    spans, merged = cut(known), False
    while not joints(spans).where("open").isEmpty():
        # neighbours without a cut between them become one; only these are pre-tokenised again
        in_order = Window.partitionBy(*KEY).orderBy("first")
        begins = F.when(F.lag("open", 1, False).over(in_order), 0).otherwise(1)
        groups = joints(spans).withColumn("begins", begins).withColumn("g", F.sum("begins").over(in_order))
        groups = groups.groupBy(*KEY, "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.any_value("head").alias("head"), F.any_value("tail").alias("tail"), F.max("copies").alias("copies"), F.count("*").alias("m")).drop("g")
        wide = groups.where("m > 1").select(*KEY, "first", "last", "copies")
        again = boundaries(wide_texts(chunks, wide, chunk_chars), pattern, chunk_chars, overlap).join(wide.select(*KEY, "first", "copies"), [*KEY, "first"])
        spans, merged = cut(groups.where("m = 1").drop("m").unionByName(again)), True
    final = joints(spans).select(*KEY, "first", "last", "start", "stop", "copies")
    length = F.coalesce(F.col("stop") - F.col("start"), F.length("text"))
    piece = F.substring(F.col("text"), F.col("start") - F.col("first") * chunk_chars + 1, length).alias("text")
    lone = chunks.join(final.where("first = last").withColumnRenamed("first", "i"), [*KEY, "i"]).withColumnRenamed("i", "first").select(*KEY, "start", "copies", "doc_id", piece)
    if merged:
        lone = lone.unionByName(wide_texts(chunks, final.where("first < last"), chunk_chars).select(*KEY, "start", "copies", "doc_id", piece))
    return lone


def encoded(documents: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every document's text."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must be positive and smaller than a chunk")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    one_chunk = F.length("text") <= chunk_chars + overlap
    whole = encode_rows(rows.where(one_chunk), vocabulary)
    parts = encode_rows(stitched_pieces(rows.where(~one_chunk), vocabulary.pattern, chunk_chars, overlap), vocabulary)
    # equal rows gave equal pieces: the set keeps one of each
    gathered = parts.groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"), F.max("copies").alias("copies"), F.array_sort(F.collect_set(F.struct("start", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return whole.unionByName(gathered.select("doc_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("doc_id", "ids"))


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``: the tokens' bytes side by side."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary.coder
        for batch in batches:
            texts = [b"".join(map(coder.decode_single_token_bytes, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")

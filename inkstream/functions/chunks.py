"""Texts cut into chunks: fixed windows, recursive separators, sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.text import strip

# Separators of the recursive splitter, coarse to fine.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]


def fixed_chunks(text: Column, size: int = 256, overlap: int = 20) -> Column:
    """Windows of ``size`` characters that overlap; stripped, blank ones dropped. Null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must not be negative and must be smaller than the chunk size")
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.filter(windows, lambda x: x != ""))


def chunk_rows(rows: DataFrame, id_col: str, chunks: Column) -> DataFrame:
    """``(document_id, chunk_index, chunk, chunk_size, total_chunks)``: a row per chunk."""
    cut = rows.select(F.col(id_col).cast("string").alias("document_id"), chunks.alias("chunks"))
    each = cut.select("document_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    return each.select("document_id", "chunk_index", "chunk", F.length("chunk").alias("chunk_size"), "total_chunks")


def split_recursive(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of at most ``size`` characters at the first separator that occurs; longer ones at the next, merged with overlap."""
    if not text:
        return []
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        first, *rest = text.split(separator)
        pieces = [p for p in [first, *(separator + r for r in rest)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            held.append(piece)
            continue
        out += merge(held, size, overlap)
        held = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + merge(held, size, overlap)


def merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbours joined up to ``size``; each chunk begins with at most ``overlap`` characters of the one before."""
    out: list[str] = []
    now: list[str] = []
    total = 0
    for piece in pieces:
        if now and total + len(piece) > size:
            out.append("".join(now).strip())
            while now and (total > overlap or total + len(piece) > size):
                total -= len(now.pop(0))
        now.append(piece)
        total += len(piece)
    if now:
        out.append("".join(now).strip())
    return [x for x in out if x]


def recursive_chunks(text: Column, size: int = 500, overlap: int = 50, separators: list[str] | None = None) -> Column:
    """The recursive splitter as an Arrow-batched function; null and empty texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must not be negative and must be smaller than the chunk size")
    order = separators or SEPARATORS

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap, order) if isinstance(t, str) else [])

    return cut(text)


def pack(sentences: list[str], size: int) -> list[str]:
    """Sentences in order, joined while they fit into ``size``; a longer one is cut."""
    parts = [s[i : i + size] for s in sentences for i in range(0, len(s), size)]
    groups: list[list[str]] = []
    room = 0
    for p in parts:
        if groups and len(p) <= room:
            groups[-1].append(p)
        else:
            groups.append([p])
            room = size
        room -= len(p)
    return ["".join(g) for g in groups]


def sentence_chunks(text: Column, size: int = 500) -> Column:
    """Sentences at 。！？ joined in order up to ``size`` characters; a longer sentence is cut."""

    @F.pandas_udf("array<string>")
    def packed(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda s: pack(list(s), size))

    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), "(?<=[。！？])"), lambda s: s != "")
    return F.filter(F.transform(packed(sentences), strip), lambda x: x != "")

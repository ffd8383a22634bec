"""Documents, passages, queries: filtering, deduplication, loading, page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.functions.hanzi import SIMPLIFIED, TRADITIONAL, to_simplified
from inkstream.functions.text import clean_text, normalize_text, once, strip, strip_tags, strip_tags_ws, wiki_clean
from inkstream.session import cut

# The passages' length limits.
MIN_LENGTH, MAX_LENGTH = 10, 2000


def filter_short(rows: DataFrame, min_length: int = MIN_LENGTH, column: str = "content") -> DataFrame:
    return rows.where(F.length(column) >= min_length)


def remove_duplicates(rows: DataFrame) -> DataFrame:
    """Whole rows once; nulls are equal."""
    return rows.dropDuplicates()


def process_documents(rows: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Cleaned, normalised ``content``, short rows and repeats dropped. Without that column the rows pass through."""
    if "content" not in rows.columns:
        return rows
    return remove_duplicates(filter_short(rows.withColumn("content", once(normalize_text(clean_text(F.col("content"))))), min_length))


def process_queries(rows: DataFrame) -> DataFrame:
    """Cleaned, normalised ``Query``, empty rows and repeats dropped. Without that column the rows pass through."""
    if "Query" not in rows.columns:
        return rows
    return remove_duplicates(rows.withColumn("Query", once(normalize_text(clean_text(F.col("Query"))))).where(F.length("Query") > 0))


def load_passages(collection: DataFrame, pos: str = "pid", max_passages: int = 0, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """``(pid, text)`` without tags, long enough, cut at ``max_length``; the first ``max_passages`` by ``pos`` if that is positive."""
    kept = collection.withColumn("text", once(strip_tags(F.col("text")))).where(F.length("text") >= min_length).withColumn("text", F.substring("text", 1, max_length))
    return (kept.orderBy(pos).limit(max_passages) if max_passages > 0 else kept).select("pid", "text")


def passage_batch(collection: DataFrame, pos: str, after: str | int | None, batch_size: int, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """The next ``batch_size`` kept passages after position ``after``, with their position."""
    later = collection if after is None else collection.where(F.col(pos) > F.lit(after))
    kept = later.withColumn("text", once(strip_tags_ws(F.col("text")))).where(F.length("text") >= min_length).withColumn("text", F.substring("text", 1, max_length))
    return kept.orderBy(pos, "text").limit(batch_size)


def passages_to_documents(passages: DataFrame, source: str = "T2Ranking") -> DataFrame:
    """``(page_content, metadata)`` with the passage's id, source and length."""
    return passages.select(F.col("text").alias("page_content"), F.struct(F.col("pid"), F.lit(source).alias("source"), F.length("text").alias("text_length")).alias("metadata"))


def query_sample(queries: DataFrame, n: int, pos: str = "qid") -> DataFrame:
    """The first ``n`` queries in order of ``pos``."""
    return queries.orderBy(pos).limit(n)


def with_judgements(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    return queries.join(qrels.select("qid"), "qid", "left_semi")


def in_pool(queries: DataFrame, qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries with a relevant passage in the pool."""
    return queries.join(qrels.join(passages.select("pid"), "pid", "left_semi").select("qid"), "qid", "left_semi")


def skip_reason(title: Column, text: Column, namespace: Column, min_length: int = 200, cleaned: Column | None = None) -> Column:
    """Why a wiki page is no article; null if it is one. The first reason that holds counts. ``cleaned`` is the text without markup, where it is at hand."""
    low = F.lower(text)
    return (
        F.when(title.isNull() | text.isNull(), "missing")
        .when(F.coalesce(namespace, F.lit("0")) != "0", "namespace")
        .when(low.startswith("#redirect") | low.startswith("#重定向"), "redirect")
        .when(text.contains("{{消歧义") | low.contains("{{disambiguation") | low.contains("{{disambig"), "disambiguation")
        .when(F.length(wiki_clean(text) if cleaned is None else cleaned) < min_length, "short")
    )


def wiki_articles(pages: DataFrame, num_articles: int = 0, min_length: int = 200, pos: str = "pos") -> DataFrame:
    """``(id, title, text, length)`` of pages ``(pos, title, ns, text)`` that are articles; ids count from 0 in page order."""
    cleaned = pages.withColumn("_clean", once(wiki_clean(F.col("text"))))
    kept = cleaned.where(skip_reason(F.col("title"), F.col("text"), F.col("ns").cast("string"), min_length, F.col("_clean")).isNull())
    out = kept.select(F.col(pos).alias("pos"), strip(F.col("title")).alias("title"), to_simplified(F.col("_clean")).alias("text"))
    out = out.orderBy("pos").limit(num_articles) if num_articles > 0 else out
    return numbered(out, "pos").select("id", "title", "text", F.length("text").alias("length"))


def skip_counts(pages: DataFrame, min_length: int = 200) -> DataFrame:
    return pages.groupBy(F.coalesce(skip_reason(F.col("title"), F.col("text"), F.col("ns").cast("string"), min_length), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_pages"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a gapless ``id`` from 0 in the given order, without a task that sees them all.

    Rows are range-partitioned and sorted; only the partitions' counts go to the driver.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33)
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    if not starts:
        return placed.withColumn("id", F.lit(0).cast("bigint")).drop("_n")
    start = F.create_map(*[F.lit(x).cast("bigint") for p in starts.items() for x in p])
    return placed.withColumn("id", start[part] + F.col("_n").bitwiseAND((1 << 33) - 1)).drop("_n")


def simplified_update(rows: DataFrame, traditional: str = TRADITIONAL, simplified: str = SIMPLIFIED) -> DataFrame:
    """Title and text in simplified characters; ``length`` only changes where the text does; ``changed`` tells which rows did."""
    title, text = (to_simplified(F.col(c), traditional, simplified) for c in ("title", "text"))
    differs = F.coalesce(text != F.col("text"), F.lit(False))
    return rows.withColumns({"title": title, "text": text, "length": F.when(differs, F.length(text)).otherwise(F.col("length")), "changed": differs | F.coalesce(title != F.col("title"), F.lit(False))})

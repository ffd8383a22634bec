"""Exploratory figures of documents, queries, users and clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstream.functions.text import has_html


def basic_stats(rows: DataFrame) -> DataFrame:
    """One row: rows, columns, repeated rows (nulls are equal) and nulls by column (``nulls_<column>``)."""
    total = rows.agg(F.count("*").alias("total_records"), F.lit(len(rows.columns)).cast("bigint").alias("n_columns"), *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in rows.columns])
    once = rows.distinct().agg(F.count("*").alias("n_distinct"))
    return total.join(F.broadcast(once)).withColumn("duplicate_count", F.col("total_records") - F.col("n_distinct")).drop("n_distinct")


def six(c: Column) -> Column:
    return F.round(c, 6)


def document_length(rows: DataFrame, column: str = "content") -> DataFrame:
    """One row of length figures; quantiles are interpolated and then truncated. A null counts as the four letters of None."""
    n = F.length(F.coalesce(F.col(column), F.lit("None")))
    whole = rows.select(n.alias("n"))
    quantile = {f"p{q}": F.percentile("n", F.lit(q / 100)).cast("int") for q in (25, 50, 75, 90)}
    return whole.agg(F.min("n").alias("min_length"), F.max("n").alias("max_length"), six(F.avg("n")).alias("mean_length"), six(F.median("n")).alias("median_length"), six(F.stddev_samp("n")).alias("std_length"), *[c.alias(name) for name, c in quantile.items()])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def query_distribution(rows: DataFrame, column: str = "Query") -> DataFrame:
    n = F.col("n")
    return value_counts(rows, column).agg(
        F.count("*").alias("unique_queries"), F.count_if(n == 1).alias("appearing_once"), F.count_if(n.between(2, 5)).alias("appearing_2_5"), F.count_if(n.between(6, 10)).alias("appearing_6_10"), F.count_if(n > 10).alias("appearing_more_than_10")
    )


def most_common(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; of equal ones the smaller value."""
    return value_counts(rows, column).orderBy(F.desc("n"), "value").limit(k)


def user_behavior(rows: DataFrame, column: str = "AnonID") -> DataFrame:
    return value_counts(rows, column).agg(F.count("*").alias("unique_users"), six(F.avg("n")).alias("avg_queries_per_user"), six(F.median("n")).alias("median_queries_per_user"), F.count_if(F.col("n") == 1).alias("users_with_single_query"))


def click_behavior(rows: DataFrame, column: str = "ClickPos") -> DataFrame:
    c = F.col(column)
    return rows.where(c.isNotNull()).agg(F.count("*").alias("total_clicks"), six(F.avg(c)).alias("avg_click_position"), six(F.median(c)).alias("median_click_position"), F.count_if(c == 1).alias("first_position_clicks"))


def at_indexes(lengths: DataFrame, column: str, indexes: dict[str, tuple[int, int]]) -> DataFrame:
    """One row with the elements ``n * a // b`` of the sorted values, from the values' counts.

    The counts are sorted in one task, so ``column`` must take few different values, as lengths do (at most as many as the longest text has characters).
    """
    counts = lengths.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    running = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).join(F.broadcast(total))
    return running.agg(*[F.min(F.when(F.col("upto") > F.floor(F.col("total") * a / b), F.col("v"))).alias(name) for name, (a, b) in indexes.items()])


def collection_stats(collection: DataFrame, column: str = "text") -> DataFrame:
    """One row about the raw passages: counts, tags, lengths without tags, sorted-index percentiles, long ones."""
    lengths = collection.where(F.col(column).isNotNull()).select(F.length(column).alias("n"), has_html(F.col(column)).alias("html"))
    long = [(F.count_if(F.col("n") > k).alias(f"over_{k}"), six(F.coalesce(F.avg((F.col("n") > k).cast("double")), F.lit(0.0)) * 100).alias(f"over_{k}_pct")) for k in (500, 1000, 2000)]
    total = lengths.agg(F.count("*").alias("total"), F.count_if("html").alias("with_html"), six(F.coalesce(F.avg(F.col("html").cast("double")), F.lit(0.0)) * 100).alias("with_html_pct"), F.min("n").alias("min_length"), F.max("n").alias("max_length"), six(F.avg("n")).alias("avg_length"), *[c for pair in long for c in pair])
    return total.join(F.broadcast(at_indexes(lengths, "n", {"median_length": (1, 2), "p25": (1, 4), "p75": (3, 4), "p90": (9, 10)})))


def article_stats(articles: DataFrame, column: str = "length") -> DataFrame:
    known = articles.where(F.col(column).isNotNull())
    total = known.agg(F.count("*").alias("n_articles"), F.min(column).alias("min_length"), F.max(column).alias("max_length"), six(F.avg(column)).alias("mean_length"))
    return total.join(F.broadcast(at_indexes(known, column, {"p25": (1, 4), "p50": (1, 2), "p75": (3, 4)})))


def report(documents: DataFrame, log: DataFrame) -> DataFrame:
    """One JSON string with all five sections."""
    parts = {"basic_stats": basic_stats(documents), "document_length": document_length(documents), "query_distribution": query_distribution(log), "user_behavior": user_behavior(log), "click_behavior": click_behavior(log)}
    out = None
    for name, part in parts.items():
        one = part.select(F.struct("*").alias(name))
        out = one if out is None else out.join(F.broadcast(one))
    return out.select(F.to_json(F.struct(*parts)).alias("report"))

"""A vector index built batch by batch from a folder of passage files; it resumes where it stopped.

New files are taken in micro-batches. Every batch is written to a folder of its own name, so that a batch that is
repeated after a failure replaces itself. Counts of what was stored and skipped are kept per batch.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstream.functions.text import strip_tags_ws
from inkstream.operators.documents import MAX_LENGTH, MIN_LENGTH
from inkstream.operators.generation import Encoder, embed
from inkstream.session import cut


def prepared(passages: DataFrame, encoder: Encoder | None, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH) -> DataFrame:
    """``(id, document, text_length[, embedding], skipped)``; ``skipped`` names the reason."""
    clean = strip_tags_ws(F.col("text"))
    rows = passages.select(F.col("pid").alias("id"), F.substring(clean, 1, max_length).alias("document"), F.when(F.col("text").isNull(), "null").when(F.length(clean) < min_length, "short").alias("skipped"))
    rows = rows.withColumn("text_length", F.length("document"))
    return rows.withColumn("embedding", embed(F.col("document"), encoder)) if encoder else rows


class Enough(Exception):
    """The asked number of batches is done."""


def outcomes(passages: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``(outcome, n)``: how many passages would be stored, and skipped by reason."""
    return prepared(passages, None, min_length).groupBy(F.coalesce("skipped", F.lit("stored")).alias("outcome")).agg(F.count("*").alias("n"))


def build_index(spark: SparkSession, source: str, target: str, schema: str, encoder: Encoder | None = None, files_per_batch: int = 8, min_length: int = MIN_LENGTH, max_batches: int = 0, rebuild: bool = False) -> None:
    """Process all files of ``source`` that earlier calls have not; ``target`` gets ``index``, ``log`` and ``state``.

    With ``max_batches`` it stops after so many, and the next call goes on; ``rebuild`` begins anew.
    """
    if rebuild:
        _delete(spark, target)
    done = 0

    def store(batch: DataFrame, number: int) -> None:
        nonlocal done
        if max_batches and done == max_batches:
            raise Enough
        rows = cut(prepared(batch, encoder, min_length))
        rows.where("skipped is null").drop("skipped").write.mode("overwrite").parquet(f"{target}/index/batch={number}")
        counts = rows.groupBy(F.coalesce("skipped", F.lit("stored")).alias("outcome")).agg(F.count("*").alias("n"))
        counts.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{target}/log/batch={number}")
        done += 1

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        # the batch that was one too many wrote nothing and stays open
        if not max_batches or done < max_batches:
            raise


def build_or_load(spark: SparkSession, source: str, target: str, schema: str, **options) -> DataFrame:
    """The index of ``target``, built from ``source`` first if there is none."""
    if not _path(spark, f"{target}/index")[0].exists(_path(spark, f"{target}/index")[1]):
        build_index(spark, source, target, schema, **options)
    return read_index(spark, target)


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/index")


def build_log(spark: SparkSession, target: str) -> DataFrame:
    """``(batch, outcome, n, at)``."""
    return spark.read.parquet(f"{target}/log")


def index_info(spark: SparkSession, target: str, model: str = "") -> DataFrame:
    """One row: passages stored, batches, the encoder's name."""
    return read_index(spark, target).agg(F.count("*").alias("total_stored"), F.count_distinct("batch").alias("batches"), F.lit(model).alias("embedding_model"))

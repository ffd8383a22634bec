"""Files in and out."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkstream.functions.text import SPACE, strip

T = TypeVar("T")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """With a header line; quoted fields may hold separators and, with ``multi_line``, line breaks. Without it a large file is read by many tasks."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Whole-file JSON: an object or a list of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str = "id long, title string, text string, length int") -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(page_content, metadata)`` of JSON lines of articles; a missing id becomes empty."""
    rows = read_json_lines(spark, path)
    return rows.select(F.col("text").alias("page_content"), F.struct(F.col("title").alias("source"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("article_id")).alias("metadata"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)``: whole files as UTF-8, undecodable bytes left out."""

    @F.pandas_udf("string")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return spark.read.format("binaryFile").load(path).select("path", decode("content").alias("content"))


def missing_is_none(read: Callable[[], T], none: T) -> T:
    """What ``read`` gives; ``none`` if there is no such path. Other errors are raised."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none


def list_files(spark: SparkSession, folder: str, extension: str | None = None) -> DataFrame:
    """``(name)`` of a folder's files, sorted; of a missing folder none. Any file system that Spark reads; only names are read, hidden files are left out."""
    none = spark.createDataFrame([], "path string")
    names = missing_is_none(lambda: spark.read.format("binaryFile").load(folder).select("path"), none).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return (names if extension is None else names.where(F.col("name").endswith(extension))).orderBy("name")


def preview(spark: SparkSession, path: str, lines: int = 10, width: int = 100) -> DataFrame:
    return spark.read.text(path).limit(lines).select(F.substring("value", 1, width).alias("line"))


def read_tsv(spark: SparkSession, path: str, names: tuple[str, str], header: bool = True) -> DataFrame:
    """Two columns, split at the first tab; later tabs and quotes belong to the text. Blank lines and lines without a tab are left out."""
    lines = spark.read.text(path)
    return parse_tsv(lines, names, header)


def parse_tsv(lines: DataFrame, names: tuple[str, str], header: bool = True) -> DataFrame:
    value = strip(F.col("value"))
    parts = F.split(value, "\t", 2)
    rows = lines.where(F.col("value").rlike(rf"[^{SPACE}]") & value.contains("\t")).select(parts[0].alias(names[0]), parts[1].alias(names[1]))
    return rows.where(~((F.col(names[0]) == names[0]) & (F.col(names[1]) == names[1]))) if header else rows


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, pid)`` once each; further columns are left out."""
    pairs = read_tsv(spark, path, ("qid", "pid")).withColumn("pid", F.split("pid", "\t")[0])
    return pairs.where("not (qid = 'qid' and pid = 'pid')").distinct()


def count_data_lines(spark: SparkSession, path: str) -> int:
    """Lines without the header; 0 for an empty or missing file."""
    return max(0, missing_is_none(lambda: spark.read.text(path).count(), 0) - 1)


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, title, ns, text)`` of a MediaWiki export; ``pos`` sorts pages by file, by part of the file and within it, however the parts were dealt out."""
    schema = "title string, ns string, revision struct<text: struct<_VALUE: string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    return pages.select(place.alias("pos"), "title", "ns", F.col("revision.text._VALUE").alias("text"))


def write_csv(rows: DataFrame, path: str) -> bool:
    """Writers return True; what goes wrong is raised."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def write_json(rows: DataFrame, path: str) -> bool:
    rows.write.mode("overwrite").json(path)
    return True


def write_parquet(rows: DataFrame, path: str) -> bool:
    rows.write.mode("overwrite").parquet(path)
    return True


def write_text(rows: DataFrame, path: str) -> bool:
    rows.select("value").write.mode("overwrite").text(path)
    return True


def rewrite_parquet(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``change`` applied to a dataset in place: the new one is written beside it, the old one is kept as ``<path>.bak`` in place of an earlier one, then the new one gets the name.

    Until the last renaming the old data are complete under one of the two names.
    """
    change(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm
    old, new, backup = (jvm.org.apache.hadoop.fs.Path(f"{path}{end}") for end in ("", ".new", ".bak"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(backup, True)
    for source, target in ((old, backup), (new, old)):
        if not fs.rename(source, target):
            raise OSError(f"{source} could not be renamed to {target}")
    return spark.read.parquet(path)

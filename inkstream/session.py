"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's shared folder where one is set, a scratch folder in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there: later plans neither recompute it nor lose it with an executor."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` written as Parquet in the checkpoint folder, in a folder for each value of ``by``, and read from there: for tables that are asked again and again."""
    use_checkpoints(rows.sparkSession)
    path = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bucketed(rows: DataFrame, key: str, buckets: int, *order: str) -> DataFrame:
    """Like ``stored``, in one file for each bucket of ``key``, so that grouping by it and by anything more moves no row. It needs a name in the session's catalog."""
    use_checkpoints(rows.sparkSession)
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{rows.sparkSession.sparkContext.getCheckpointDir()}/{name}"
    rows.write.bucketBy(buckets, key).sortBy(*order).option("path", path).saveAsTable(name, format="parquet")
    return rows.sparkSession.table(name)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores if they come from fewer partitions, as those of a small file do: for steps that cost more than moving the rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows

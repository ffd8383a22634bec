"""Pairs within groups of which some may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.operators.skew import join_hot

#: Members of a group that meet in one cell.
CELL = 1024


def blocks(n: Column) -> Column:
    """Into how many blocks of about ``CELL`` a group of ``n`` is split."""
    return F.ceil(n / F.lit(CELL)).cast("int")


def block_of(member: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(member), count).cast("int")


def pairs_within(members: DataFrame, group: str, member: str) -> DataFrame:
    """``(a, b)``, a < b: all pairs of different members ``(group, member)`` of a group, made in cells of two blocks, so that no task gets a whole hot group."""
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_k", blocks(F.col("_n")))
    placed = join_hot(members, sizes, [group], "_n").withColumn("_i", block_of(F.col(member), F.col("_k")))
    cells = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).select(group, member, F.least("_i", "_o").alias("_lo"), F.greatest("_i", "_o").alias("_hi"), "_i")
    left, right = (cells.where(f"_i = {side}").select(group, "_lo", "_hi", F.col(member).alias(name)) for side, name in (("_lo", "_x"), ("_hi", "_y")))
    met = left.join(right, [group, "_lo", "_hi"]).where("_lo < _hi or _x < _y").where("_x <> _y")
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))

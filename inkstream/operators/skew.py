"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most frequent keys that are broadcast: a key beyond them has less than one part in so many of all rows.
MOST_HOT = 10_000
#: Keys of fewer rows are never hot.
LEAST_HOT = 1000


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with one row per key. The most frequent keys by column ``n``, at most ``MOST_HOT``, are broadcast, so their rows stay where they are."""
    hot = keys.where(F.col(n) > LEAST_HOT).orderBy(F.desc(n), *on).limit(MOST_HOT)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys, on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)

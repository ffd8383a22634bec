"""References to records that do not exist, were deleted, or arrived later.

Result cases
    null or blank key      refers to nothing, never reported
    key that is no integer ``missing``
    null ``judged_at``     only ``missing`` is possible
    repeated reference     reported once
    empty referred table   every reference is ``missing``
    repeated target rows   earliest ``added_at`` and earliest ``deleted_at`` count
    other columns          ignored, whatever they are called
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL_WIDTH, ASCII = "０１２３４５６７８９．－＋", "0123456789.-+"


@dataclass(frozen=True)
class Target:
    """A referred table: its name in the report, its rows, and which columns hold key and life span."""

    name: str
    rows: DataFrame
    key: str
    reference: str
    added_at: str = "added_at"
    deleted_at: str = "deleted_at"


def canonical_key(c: Column) -> Column:
    """One spelling per integer value: signs, blanks, leading zeros, widths and a zero fraction are dropped; other texts stay."""
    s = F.translate(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f\x{200b}\x{feff}]+|[\s\x1c-\x1f\x{200b}\x{feff}]+$", ""), FULL_WIDTH, ASCII)
    digits = F.regexp_replace(s, r"^([+-]?)0*([0-9]+?)(?:\.0*)?$", "$1$2")
    return F.nullif(F.when(digits.rlike(r"^[+-]0$"), F.lit("0")).otherwise(F.ltrim(digits, F.lit("+"))), F.lit(""))


def references(rows: DataFrame, id_col: str, at_col: str, targets: list[Target]) -> DataFrame:
    """One row per row and target: ``(row_id, ref_table, key, judged_at)``, without null keys."""
    each = F.array(*[F.struct(F.lit(t.name).alias("ref_table"), canonical_key(F.col(t.reference).cast("string")).alias("key")) for t in targets])
    return (
        rows.select(F.col(id_col).alias("row_id"), F.col(at_col).alias("judged_at"), F.explode(each).alias("r"))
        .select("row_id", "judged_at", "r.ref_table", "r.key")
        .where(F.col("key").isNotNull())
    )


def life_spans(targets: list[Target]) -> DataFrame:
    """One row per key of each referred table, with its life span."""
    parts = [
        t.rows.select(F.lit(t.name).alias("ref_table"), canonical_key(F.col(t.key).cast("string")).alias("key"), F.col(t.added_at).alias("added_at"), F.col(t.deleted_at).alias("deleted_at")).where(F.col("key").isNotNull())
        for t in targets
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("ref_table", "key").agg(F.min("added_at").alias("added_at"), F.min("deleted_at").alias("deleted_at"), F.lit(True).alias("there"))


def heavy_keys(groups: DataFrame, n_rows: int, most: int) -> DataFrame:
    """Keys with more than their ``1/most`` share of all references: at most ``most`` rows, whatever the data."""
    return groups.groupBy("ref_table", "key").agg(F.sum("n").alias("n")).where(F.col("n") > n_rows / most).select("ref_table", "key")


def join_life_spans(refs: DataFrame, spans: DataFrame, heavy: DataFrame) -> DataFrame:
    """``refs`` with their key's life span. Heavy keys meet a broadcast table of proven size, so no task gets a whole hot key; the others are shuffled."""
    on = ["ref_table", "key"]
    hot = heavy.join(spans, on, "left")
    return refs.join(F.broadcast(hot), on).unionByName(refs.join(F.broadcast(heavy), on, "left_anti").join(spans, on, "left"))


def state_of(first: Column, last: Column) -> Column:
    """State of references judged between two moments; ``mixed`` where the moments differ in state."""

    def one(at: Column) -> Column:
        return F.when(F.col("there").isNull(), "missing").when(F.col("added_at") > at, "late").when(F.col("deleted_at") <= at, "deleted").otherwise("ok")

    return F.when(one(first) == one(last), one(first)).otherwise("mixed")


def _plan(rows: DataFrame, id_col: str, at_col: str, targets: list[Target], most_heavy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    refs, spans = references(rows, id_col, at_col, targets), life_spans(targets)
    groups = refs.groupBy("ref_table", "key", F.date_trunc("month", "judged_at").alias("period")).agg(F.count("*").alias("n"))
    n = max(1, rows.count() * len(targets))
    return refs, spans, heavy_keys(groups, n, most_heavy)


def orphan_references(rows: DataFrame, id_col: str, at_col: str, targets: list[Target], most_heavy: int = 10_000) -> DataFrame:
    """``(row_id, ref_table, state)``: every reference that is ``missing``, ``late`` or ``deleted`` at its ``at_col``."""
    refs, spans, heavy = _plan(rows, id_col, at_col, targets, most_heavy)
    at = F.col("judged_at")
    return join_life_spans(refs, spans, heavy).select("row_id", "ref_table", state_of(at, at).alias("state")).where("state <> 'ok'").distinct()


def orphan_counts(rows: DataFrame, id_col: str, at_col: str, targets: list[Target], most_heavy: int = 10_000) -> DataFrame:
    """``(ref_table, period, state, n_refs)``: orphans by month of ``at_col`` (null where that is null).

    References are counted per key and month before they meet the keys. Only where a key's state changes within
    a month are that month's single references looked at.
    """
    refs, spans, heavy = _plan(rows, id_col, at_col, targets, most_heavy)
    refs = refs.withColumn("period", F.date_trunc("month", "judged_at"))
    groups = refs.groupBy("ref_table", "key", "period").agg(F.count_distinct("row_id").alias("n_refs"), F.min("judged_at").alias("first_at"), F.max("judged_at").alias("last_at"))
    verdict = join_life_spans(groups, spans, heavy).withColumn("state", state_of(F.col("first_at"), F.col("last_at")))
    mixed = verdict.where("state = 'mixed'").select("ref_table", "key", "period", "added_at", "deleted_at", "there")
    on = ["ref_table", "key", "period"]
    # a key's state changes in two months at most: of heavy keys that is a table of proven size, so their references stay where they are
    hot = mixed.join(F.broadcast(heavy), ["ref_table", "key"], "left_semi")
    rest = refs.join(F.broadcast(heavy), ["ref_table", "key"], "left_anti").join(mixed, on)
    single = refs.join(F.broadcast(hot), on).unionByName(rest).withColumn("state", state_of(F.col("judged_at"), F.col("judged_at")))
    per_row = single.groupBy("ref_table", "period", "state").agg(F.count_distinct("row_id").alias("n_refs"))
    decided = verdict.where("state <> 'mixed'").select("ref_table", "period", "state", "n_refs")
    return decided.unionByName(per_row).where("state <> 'ok'").groupBy("ref_table", "period", "state").agg(F.sum("n_refs").alias("n_refs"))

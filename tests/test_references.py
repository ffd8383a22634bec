import datetime as dt

from inkstream.operators.references import Target, canonical_key, orphan_counts, orphan_references
from pyspark.sql import functions as F

AT = dt.datetime(2024, 5, 10)
LATER, BEFORE = dt.datetime(2024, 5, 20), dt.datetime(2024, 5, 1)
TARGET = "key string, added_at timestamp, deleted_at timestamp"
REFS = "id long, ref string, judged_at timestamp, added_at string"


def targets(spark, rows):
    return [Target("t", spark.createDataFrame(rows, TARGET), "key", "ref")]


def test_keys_have_one_spelling(spark):
    spelled = ["12", " 12", "12\t", "0012", "12.0", "+12", "１２", "　12", "-0012", "000", "", " ", None, "1a", "12.5"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in spelled], "s string").select(canonical_key(F.col("s"))).collect()]
    assert got == ["12"] * 8 + ["-12", "0", None, None, None, "1a", "12.5"]


def test_states(spark):
    rows = [("1", BEFORE, None), ("1", LATER, None), ("2", LATER, None), ("3", BEFORE, AT), ("4", BEFORE, LATER)]
    refs = [(1, "1", AT, "x"), (1, "1", AT, "x"), (2, " 02", AT, None), (2, " 02", AT, None), (3, "3.0", AT, None), (4, "4", AT, None), (5, "9", AT, None), (6, None, AT, None), (7, "9", None, None), (8, "2", None, None), (9, "", AT, None)]
    for most in (1, 10_000):
        got = {tuple(r) for r in orphan_references(spark.createDataFrame(refs, REFS), "id", "judged_at", targets(spark, rows), most).collect()}
        assert got == {(2, "t", "late"), (3, "t", "deleted"), (5, "t", "missing"), (7, "t", "missing")}
        counts = {(r["period"].month if r["period"] else None, r["state"]): r["n_refs"] for r in orphan_counts(spark.createDataFrame(refs, REFS), "id", "judged_at", targets(spark, rows), most).collect()}
        assert counts == {(5, "late"): 1, (5, "deleted"): 1, (5, "missing"): 1, (None, "missing"): 1}


def test_counts_look_into_months_where_a_state_changes(spark):
    rows = [("1", BEFORE, AT)]
    refs = [(i, "1", dt.datetime(2024, 5, 1 + i), None) for i in range(20)]
    got = orphan_counts(spark.createDataFrame(refs, REFS), "id", "judged_at", targets(spark, rows)).collect()
    assert [(r["state"], r["n_refs"]) for r in got] == [("deleted", 11)]


def test_hot_key_whose_state_changes_within_a_month(spark):
    refs = spark.createDataFrame([(i, "7" if i % 3 else "8", dt.datetime(2024, 5, 1 + i % 20), None) for i in range(3000)], REFS)
    rows = [("7", BEFORE, AT), ("8", BEFORE, dt.datetime(2024, 5, 15))]
    want = sum((i % 20 >= 9 if i % 3 else i % 20 >= 14) for i in range(3000))
    for most in (1, 2, 10_000):
        got = orphan_counts(refs, "id", "judged_at", targets(spark, rows), most).collect()
        assert [(r["state"], r["n_refs"]) for r in got] == [("deleted", want)]


def test_hot_key_is_heavy_and_right(spark):
    refs = spark.createDataFrame([(i, "7" if i % 3 else str(i), AT, None) for i in range(3000)], REFS)
    got = orphan_references(refs, "id", "judged_at", targets(spark, [("7", LATER, None)]), 10)
    assert got.where("state = 'late'").count() == 2000 and got.where("state = 'missing'").count() == 1000


def test_empty_tables(spark):
    none = spark.createDataFrame([], REFS)
    assert orphan_references(none, "id", "judged_at", targets(spark, [])).count() == 0
    assert orphan_counts(none, "id", "judged_at", targets(spark, [])).count() == 0
    one = spark.createDataFrame([(1, "5", AT, None)], REFS)
    assert [r["state"] for r in orphan_references(one, "id", "judged_at", targets(spark, [])).collect()] == ["missing"]

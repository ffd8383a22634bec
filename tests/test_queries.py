"""Every query with SQL against DuckDB, on the smallest tables where all of them have questions."""

import datetime
import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL, SF = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
#: No question of the smallest tables is asked, or nothing of theirs is found: these are compared on the next larger ones.
LARGER = {
    "bm25_scores", "bm25_topk", "bm25_topk_whitespace", "eval_bm25", "eval_by_type", "eval_delta", "format_context", "hits", "hybrid_rrf", "hybrid_weighted", "ndcg",
    "passage_batch", "passages_md", "pool_union", "rag_prompt", "rewrite_uplift", "rewrite_uplift_delta", "trim_context", "user_prompt",
}
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    def over(folder):
        c = duckdb.connect()
        for f in folder.glob("*.parquet"):
            c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
        return c

    return {folder: over(folder) for folder in (SMALL, SF)}


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    folder = SF if name in LARGER else SMALL
    df = entry.queries()[name](spark, os.fspath(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = sql[folder].execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got, "nothing was compared"
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

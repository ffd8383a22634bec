"""Recall before against after rewriting, on a question whose tag leads the search astray."""

import os

from inkstream.plans.reference_queries import rewrite_uplift_delta


def test_uplift_has_both_sides(spark, tmp_path):
    passages = [("1", "table table table"), ("2", "苹果是水果很好吃很甜的东西"), ("3", "河边的风景真的非常漂亮啊"), ("4", "火车站在城市的北边很远的地方"), ("5", "学生们在图书馆里面看书学习")]
    tables = {
        "passage_collection": (passages, "pid string, text string"),
        "queries_dev": ([("100", "<table>苹果</table>"), ("101", "火车站")], "qid string, text string"),
        "qrels_retrieval_dev": ([("100", "2", 3), ("100", "1", 1)], "qid string, pid string, rel int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(os.fspath(tmp_path / f"{name}.parquet"))
    got = {r["metric"]: (r["base"], r["ours"], r["delta"]) for r in rewrite_uplift_delta(spark, os.fspath(tmp_path)).collect()}
    assert got == {"recall_1": (0.0, 1.0, 1.0), "recall_3": (1.0, 1.0, 0.0), "recall_5": (1.0, 1.0, 0.0), "recall_10": (1.0, 1.0, 0.0), "mrr": (0.5, 1.0, 0.5)}

"""Dense and lexical search, metrics, fusion, profiles on small hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from inkstream.functions.text import tokens
from inkstream.operators import cells, dense, evaluate, fusion, lexical, profile

VECTORS = "id long, embedding array<float>"


def test_dense_ties_zero_and_null(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], VECTORS)
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "qid long, embedding array<float>")
    got = [tuple(r) for r in dense.search(index, asked, 3).orderBy("rank").collect()]
    assert got == [(7, 1, 0.0, 1), (7, 2, 0.0, 2), (7, 3, 1.0, 3)]
    assert dense.search(index, asked, 2, exclude_self=True, block=1).count() == 2
    assert dense.search(index, asked.limit(0), 3).count() == 0
    assert dense.search(index.limit(0), asked, 3).count() == 0
    assert [r["id"] for r in dense.above(dense.search(index, asked, 4), 0.5).collect()] == [1, 2]


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_dense_equals_brute_force(spark, metric):
    import random

    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(7)
    asked = index.where("id % 100 = 0").withColumnRenamed("id", "qid")

    def d(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        if metric == "dot":
            return round(-dot, 9)
        if metric == "l2":
            return round(math.dist(a, b), 9)
        return round(1 - dot / math.hypot(*a) / math.hypot(*b), 9)

    got = {(r["qid"], r["rank"]): r["id"] for r in dense.search(index, asked, 5, metric, block=2).collect()}
    for q, v in rows[::100]:
        for rank, (_, i) in enumerate(sorted((d(v, x), i) for i, x in rows)[:5], 1):
            assert got[q, rank] == i


def clustered(n, seed=3):
    import random

    rng = random.Random(seed)
    at = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, 0.6) for x in at[i % 12]]) for i in range(n)]


def test_cells_find_most_and_all_of_them_exactly(spark):
    index = spark.createDataFrame([*clustered(1500), (9000, None), (9001, [0.0] * 16)], "id long, embedding array<double>").repartition(5)
    asked = index.where("id % 10 = 0").withColumnRenamed("id", "qid")
    built, exact = cells.build_cells(index), dense.search(index, asked, 10)
    assert built.rows.count() == 1501 and len(built.centers) > 20 and built.probes < 20
    got = cells.recall(cells.search_cells(built, asked, 10), exact).first()
    assert got["n_hits"] == 1500 and got["recall"] >= 0.95
    every = cells.search_cells(built, asked, 10, probes=10**6, block=40)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    assert cells.search_cells(built, asked.limit(0)).count() == 0
    tiny = cells.build_cells(index.limit(0))
    assert tiny.rows.count() == 0 and cells.search_cells(tiny, asked).count() == 0


def test_index_maintenance(spark):
    index = spark.createDataFrame([("doc_0", "a"), ("doc_4", "b"), ("other", "c")], "id string, document string")
    more = dense.add_documents(index, spark.createDataFrame([(2, "y"), (1, "x")], "k int, document string"), "k")
    assert {(r["id"], r["document"]) for r in more.collect()} >= {("doc_5", "x"), ("doc_6", "y")}
    assert dense.add_documents(index.limit(0), spark.createDataFrame([(1, "x")], "k int, document string"), "k").first()["id"] == "doc_0"
    gone = spark.createDataFrame([("doc_0",), ("nothing",)], "id string")
    assert dense.delete_documents(index, gone).count() == 2
    new = spark.createDataFrame([("doc_0", None), ("nothing", "z")], "id string, document string")
    assert {tuple(r) for r in dense.update_documents(index, new).collect()} == {("doc_0", None), ("doc_4", "b"), ("other", "c")}


DOCS = ["a b a", "b c", "c d e", "", "b b b b", "b x"]


def py_bm25(docs, query):
    split = [d.split() for d in docs]
    n, avg = len(split), sum(map(len, split)) / len(split)
    df = {t: sum(t in s for s in split) for s in split for t in s}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    return [sum(idf.get(t, 0) * s.count(t) * 2.5 / (s.count(t) + 1.5 * (0.25 + 0.75 * len(s) / avg)) for t in query.split()) for s in split]


def test_bm25(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc long, text string")
    queries = ["a", "b b c", "nothing", "", "e d"]
    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, text string")
    scored = lexical.scores(lexical.build_index(docs, tokens), asked, tokens)
    got = {(r["qid"], r["rank"]): (r["doc"], r["score"]) for r in lexical.top_k(scored, asked, docs, 4).collect()}
    for q, text in enumerate(queries):
        want = sorted(enumerate(py_bm25(DOCS, text)), key=lambda x: (-round(x[1], 6), x[0]))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(d, pytest.approx(s, abs=1e-6)) for d, s in want]


def test_bm25_of_a_saved_index_and_many_queries(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc long, text string")
    asked = spark.createDataFrame(list(enumerate(["a", "b b c", "x b"])), "qid int, text string")
    index = lexical.build_index(docs, tokens)
    index.save(str(tmp_path / "ix"))
    want = {tuple(r) for r in lexical.scores(index, asked, tokens).collect()}
    again = lexical.LexicalIndex.load(spark, str(tmp_path / "ix"))
    assert {tuple(r) for r in lexical.scores(again, asked, tokens, most_asked=0).collect()} == want and len(want) > 5
    assert again.docs.count() == 6


def test_bm25_empty(spark):
    docs = spark.createDataFrame([], "doc long, text string")
    asked = spark.createDataFrame([(1, "a")], "qid int, text string")
    assert lexical.top_k(lexical.scores(lexical.build_index(docs), asked), asked, docs).count() == 0


RANKED = "qid string, id string, rank int"


def test_metrics(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "z", 10), ("c", "w", 1)], RANKED)
    judged = evaluate.relevant(spark.createDataFrame([("a", "y", 2), ("a", "y", 2), ("a", "u", 3), ("b", "z", 2), ("b", "v", 1), ("c", None, 3)], "qid string, id string, rel int"), 2)
    queries = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t"), ("d", "t")], "qid string, kind string")
    m = evaluate.metrics(ranked, judged, queries).first()
    assert (m["n_queries"], m["recall_1"], m["recall_3"], m["recall_10"]) == (4, 0.0, 0.125, 0.375)
    assert (m["precision_3"], m["hit_10"], m["mrr"]) == (0.083333, 0.5, 0.15)
    by = {r["kind"]: r["mrr"] for r in evaluate.metrics(ranked, judged, queries, by="kind").collect()}
    assert by == {"s": 0.3, "t": 0.0}
    assert evaluate.metrics(ranked, judged, queries.limit(0)).first()["mrr"] == 0.0
    d = {r["metric"]: r["delta"] for r in evaluate.delta(evaluate.metrics(ranked, judged, queries), evaluate.metrics(ranked.limit(0), judged, queries)).collect()}
    assert d["mrr"] == 0.15 and len(d) == 5


def test_ndcg(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], RANKED)
    qrels = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "y", 2), ("b", "z", 0)], "qid string, id string, rel int")
    got = evaluate.ndcg(ranked, qrels, spark.createDataFrame([("a",), ("b",)], "qid string")).first()
    want = (1 + 7 / math.log2(3)) / (7 + 1 / math.log2(3)) / 2
    assert got["ndcg_5"] == pytest.approx(want, abs=1e-6)


def test_fusion(spark):
    one = spark.createDataFrame([("q", "a", 1, 9.0), ("q", "b", 2, 5.0)], RANKED + ", score double")
    two = spark.createDataFrame([("q", "b", 1, 3.0), ("q", "c", 2, 3.0)], RANKED + ", score double")
    assert [r["id"] for r in fusion.reciprocal_rank([one, two]).orderBy("rank").collect()] == ["b", "a", "c"]
    assert {r["id"]: r["score"] for r in fusion.weighted(one, two, 0.3).collect()} == {"a": 0.3, "b": 0.7, "c": 0.7}
    assert fusion.pool([one, two], 1).count() == 2


def test_mmr_prefers_other_texts(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.6, 0.8])], VECTORS)
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "qid long, embedding array<float>")
    got = fusion.mmr(dense.search(vectors, asked, 3), vectors, asked, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 3] or [r["id"] for r in got] == [1, 3]


def test_users(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], VECTORS)
    seen = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (7, 2, 3), (7, None, 4), (8, 5, 1)], "user_id long, id long, t int")
    got = {r["user_id"]: r["embedding"] for r in profile.mean_vector(seen, vectors).collect()}
    assert got == {7: [pytest.approx(2 / 3), pytest.approx(1 / 3)]}
    assert profile.recent(seen, 2, "t").where("user_id = 7").agg(F.min("t")).first()[0] == 3
    log = spark.createDataFrame([("u", "一", 1), ("u", "二", 2), ("u", None, 3), ("u", "三", 4), ("u", "四", 5), (None, "x", 1)], "u string, q string, t int")
    assert [tuple(r) for r in profile.recent_context(log, "u", "q", 3, "t").collect()] == [("u", "二\n三\n四")]


def test_rerank(spark):
    rows = spark.createDataFrame([("q", f"d{i}", float(i % 2), float(i)) for i in range(20)], "qid string, id string, a double, rel double").withColumn("rel", F.col("a"))
    got = profile.rerank(rows, rows, ["a"], "rel", 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["d1", "d11", "d13"]
    assert [r["id"] for r in profile.rerank(rows, rows.limit(0), ["a"], "rel", 1).collect()] == ["d0"]
    assert profile.rerank(rows.limit(0), rows.limit(0), ["a"], "rel").count() == 0

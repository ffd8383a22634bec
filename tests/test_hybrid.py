"""Fusion of BM25 with the encoder's nearest passages, against brute force over all passages of small tables."""

import hashlib
import os
from pathlib import Path

import numpy as np
import pytest

from inkstream.operators.generation import HashingEncoder
from inkstream.plans import reference_queries as plans

SF = Path("/root/testdata/sf0.01")


def test_hashing_encoder_by_its_definition():
    texts = ["", "a", "苹果苹果树", "ab" * 300, "𠮷野家"]
    want = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for a in range(len(t) - 1):
            h = int.from_bytes(hashlib.blake2b(t[a : a + 2].encode(), digest_size=8).digest(), "little")
            want[i, h % 64] += 1 if h >> 63 else -1
        want[i] /= np.linalg.norm(want[i]) or 1
    assert np.array_equal(HashingEncoder().encode(texts), want)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_hybrids_fuse_bm25_with_dense(spark):
    sf = os.fspath(SF)
    docs = sorted((r["doc"], r["text"]) for r in plans._passages(spark, sf).collect())
    asked = [(r["qid"], r["text"]) for r in plans._questions(spark, sf).collect()]
    assert docs and asked
    v, q = (HashingEncoder().encode([t for _, t in rows]).astype(np.float32).astype(np.float64) for rows in (docs, asked))
    length = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None]
    near = np.round(1 - np.divide(q @ v.T, length, out=np.zeros_like(length), where=length > 0), 9)
    lists = [{}, {}]
    for r in plans._ranked(spark, sf, k=50).collect():
        lists[0].setdefault(r["qid"], {})[r["id"]] = (r["rank"], r["score"])
    for (qid, _), d in zip(asked, near):
        best = sorted(range(len(docs)), key=lambda i: (d[i], docs[i][0]))[:50]
        lists[1][qid] = {docs[i][0]: (n, 1 - d[i]) for n, i in enumerate(best, 1)}
    pool = {(qid, i) for one in lists for qid, rows in one.items() for i in rows}
    assert {tuple(r) for r in plans.pool_union_dense(spark, sf).select("qid", "id").collect()} == pool

    def norm(rows):
        low, high = min(s for _, s in rows.values()), max(s for _, s in rows.values())
        return {i: 1.0 if high == low else (s - low) / (high - low) for i, (_, s) in rows.items()}

    rrf = {(r["qid"], r["rank"]): r for r in plans.hybrid_rrf_dense(spark, sf).collect()}
    weighted = {(r["qid"], r["rank"]): r for r in plans.hybrid_weighted_dense(spark, sf).collect()}
    assert len(rrf) == len(weighted) == 10 * len(asked)
    for qid, _ in asked:
        one, two = (x[qid] for x in lists)
        a, b = norm(one), norm(two)
        ids = set(one) | set(two)
        by_rank = {i: sum(1 / (60 + x[i][0]) for x in (one, two) if i in x) for i in ids}
        by_score = {i: 0.5 * a.get(i, 0) + 0.5 * b.get(i, 0) for i in ids}
        for got, want in ((rrf, by_rank), (weighted, by_score)):
            top = sorted(want.values(), reverse=True)[:10]
            assert [got[qid, n]["score"] for n in range(1, 11)] == pytest.approx(top, abs=2e-6)
            assert all(want[got[qid, n]["id"]] == pytest.approx(got[qid, n]["score"], abs=2e-6) for n in range(1, 11))

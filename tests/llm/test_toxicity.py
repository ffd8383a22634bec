import itertools
import random

import numpy as np
import pyarrow as pa

from inkstream.llm import crf
from inkstream.llm.crf import Model, features, segments
from inkstream.llm.toxicity import fitted, rates, scored, tagged


def test_marginals_equal_enumeration():
    s = segments(pa.array(["甲乙丙丁。戊己", "庚"]))
    rng = np.random.default_rng(1)
    m = Model(np.zeros(1 << 18), np.zeros(1 << 18), 0.0, np.array([-1.0, -0.5, 0.7]))
    e = rng.normal(size=len(s.tokens))
    got = m.marginals(s, e)[0]
    for start, size in zip(s.start, s.size):
        total, on = 0.0, np.zeros(size)
        for y in itertools.product((0, 1), repeat=int(size)):
            w = np.exp(sum(e[start + i] for i in range(size) if y[i]) + (m.moves[0] if y[0] else 0) + sum({(0, 0): 0, (0, 1): m.moves[0], (1, 0): m.moves[1], (1, 1): m.moves[2]}[y[i], y[i + 1]] for i in range(size - 1)))
            total, on = total + w, on + w * np.array(y)
        assert np.allclose(got[start : start + size], on / total)


def test_long_chains_are_exact(monkeypatch):
    s = segments(pa.array(["甲乙丙丁。" + "好坏" * 700, "庚", "x" * 513, None, "y" * 512, "z" * 256]))
    m, e = Model(np.zeros(1 << 18), np.zeros(1 << 18), 0.0, np.array([-1.0, -0.5, 0.7])), np.random.default_rng(1).normal(size=len(s.tokens)) * 5
    want = m.marginals(s, e)
    for chain in (3, 10**9):
        monkeypatch.setattr(crf, "CHAIN", chain)
        assert all(np.allclose(a, b) for a, b in zip(m.marginals(s, e), want))


def test_gradient_of_the_bigrams_within_reach(monkeypatch):
    monkeypatch.setattr(crf, "REACH", 3)
    s = segments(pa.array(["甲乙丙丁戊己庚辛", "壬癸"]))
    m, (local, whole) = Model(np.zeros(1 << 18), np.zeros(1 << 18), 0.5, np.zeros(3)), features(s)
    m.overall[whole] = np.arange(len(whole)) + 1.0
    got = m.scores(s, local, whole)
    for i, (a, b) in enumerate([(max(0, i - 3), min(8, i + 4)) for i in range(8)] + [(8, 10)] * 2):
        assert np.isclose(got[i], 0.5 + m.overall[whole[a:b]].sum() / np.sqrt(b - a))


def test_segments_keep_places():
    texts = ["寄 生_虫，走3.5米。好Ａ！\n", None, "a.b c. d", "，" * 3, "字" * 450]
    s = segments(pa.array(texts))
    for i in range(len(s.size)):
        at = s.place[s.start[i] : s.start[i] + s.size[i]]
        assert list(at) == sorted(at) and all(0 <= p < len(texts[s.row[i]]) for p in at)
    assert [int(n) for n in s.size[s.row == 4]] == [450]
    local, whole = features(s)
    assert local.shape[0] == whole.shape[0] == len(s.tokens)


PLAIN = ["河边的树很高", "今天讨论数据的方法", "老师说明了结果", "队伍赢得了比赛", "程序处理了文件"]
BAD = ["你这个{}赶紧滚开", "写这个的{}不配活着", "又是你这个{}真恶心"]
QUOTED = ["“{}”一词出自古书", "请不要说“你这个{}”这种话"]
WORDS = ["坏蛋", "蠢货", "垃圾", "败类", "废物"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = rng.random() < 0.35
        parts = [rng.choice(PLAIN) + str(rng.randrange(99)) for _ in range(rng.randint(3, 8))]
        if toxic:
            parts.insert(rng.randrange(len(parts)), rng.choice(BAD).format(rng.choice(WORDS)))
        elif rng.random() < 0.4:
            parts.append(rng.choice(QUOTED).format(rng.choice(WORDS)))
        out.append((i, "。".join(parts) + "。", int(toxic)))
    return out


def test_held_out(spark):
    rows = corpus(900, 3)
    noisy = [(i, y if i % 50 else 1 - y) for i, _, y in rows[:600]]
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1.0) for i, t, _ in rows] + [(5000, None, "s", 0.0), (5001, "", "s", 0.0), (5002, "你这个坏蛋赶紧滚开" + "好" * 50000, "s", 0.0)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([*noisy, (99999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in scored(docs, labels, carry=("source",)).collect()}
    assert len(got) == 903 and got[5000]["score"] == got[5001]["score"] == 0.0
    right = sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows[600:])
    assert right >= 0.95 * 300
    spans = [(rows[i][1], x) for i in range(600, 900) for x in got[i]["spans"] if rows[i][2]]
    assert spans and sum("。" not in t[x["start"] : x["stop"]] for t, x in spans) >= 0.9 * len(spans)
    model = fitted(docs, labels)
    by = {r["source"]: r for r in rates(tagged(docs, model, carry=("source",))).collect()}
    assert by[None]["n_docs"] == 450 and 0 < by[None]["rate"] < 1


def test_shares_are_mixed(spark, monkeypatch):
    from inkstream.llm import toxicity

    monkeypatch.setattr(toxicity, "SHARE", 200)
    rows = corpus(900, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in scored(docs, spark.createDataFrame([(i, y) for i, _, y in rows[:600]], "doc_id long, toxic int")).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in rows[600:]) >= 0.95 * 300


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "你好")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert scored(docs, none).first()["score"] == 0.0
    assert scored(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).first()["score"] == 0.0
    assert scored(docs.limit(0), none).count() == 0

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from inkstream.llm import neardup
from inkstream.llm.bitslice import near_across, near_in_buckets
from inkstream.llm.codepoints import fold_text
from inkstream.llm.neardup import components, near_duplicates, pairs_of
from inkstream.operators import skew


def distance(a, b):
    return int(np.unpackbits((a ^ b).view(np.uint8)).sum())


@pytest.mark.parametrize("sizes", [[1, 2, 3, 2], [70, 1, 65], [130], [300, 4], []])
def test_bit_planes_equal_counting(sizes):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 2**63, (sum(sizes), 2), dtype=np.int64).view(np.uint64)
    for i in range(1, len(s), 2):
        s[i] = s[i - 1] ^ np.uint64(0b1011)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    want = {(i, j) for i, j in itertools.combinations(range(len(s)), 2) if bucket[i] == bucket[j] and distance(s[i], s[j]) <= 50}
    assert {(int(i), int(j)) for x, y in near_in_buckets(s, np.array(sizes, np.int64), 50) for i, j in zip(x, y)} == want
    half = len(s) // 2
    want = {(i, j) for i in range(half) for j in range(half, len(s)) if distance(s[i], s[j]) <= 50}
    assert {(int(i), int(j) + half) for x, y in near_across(s[:half], s[half:], 50) for i, j in zip(x, y)} == want


def texts(n=160, seed=1):
    """Random texts, some with copies that have small edits."""
    rng = random.Random(seed)
    word = lambda: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(2, 4)))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.randint(15, 60))]
        out.append("，".join(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            other = list(base)
            other[rng.randrange(len(other))] = word()
            out.append("<p>" + "&nbsp;".join(other) + "</p>")
    return out[:n]


def brute(rows):
    """Pairs within the groups that similar pairs make."""
    sets = {i: {f[k : k + 4] for k in range(len(f) - 3)} for i, t in rows if i is not None and len(f := fold_text(t)) >= 30}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if find(a) == find(b)}


def test_equals_brute_force(spark):
    rows = [(f"{i:08d}", t) for i, t in enumerate(texts())]
    rows += [("90000001", rows[0][1]), ("90000002", rows[0][1]), ("90000003", None), ("90000004", ""), ("90000005", "短"), (None, rows[0][1]), rows[3], ("90000006", rows[5][1] * 400), ("90000007", rows[5][1] * 400 + "。")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "pid string, text string, folded string, rid long")
    classes = near_duplicates(df, "pid", "text")
    assert {tuple(r) for r in pairs_of(classes).collect()} == brute(dict(rows).items())
    by = {r["id"]: r for r in classes.collect()}
    assert len(by) == classes.count() == len({i for i, _ in rows if i}) and by["90000003"]["class_id"] == "90000003" and by["90000003"]["n_links"] == 0
    assert by["90000001"]["class_id"] == by["90000002"]["class_id"] == by[rows[0][0]]["class_id"]


def test_empty(spark):
    df = spark.createDataFrame([], "pid string, text string")
    assert near_duplicates(df, "pid", "text").count() == 0 and pairs_of(near_duplicates(df, "pid", "text")).count() == 0


def test_hot_bucket_goes_through_blocks(monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    n = 75
    sig = rng.integers(0, 2**62, (n, 2), dtype=np.int64)
    for i in range(0, n - 3, 5):
        sig[i + 3] = sig[i] ^ 5
    rid = np.sort(rng.choice(10**6, n, replace=False)).astype(np.int64)
    key = np.full(n, 9, np.int64)
    key[:4] = 1
    batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + 10]), pa.array(rid[a : a + 10]), pa.array(sig[a : a + 10, 0]), pa.array(sig[a : a + 10, 1])], names=["key", "rid", "s0", "s1"]) for a in range(0, n, 10)]
    out = pa.Table.from_batches(neardup.compare_sorted(iter(batches))).to_pylist()
    links = {(r["a"], r["b"]) for r in out if r["b"] is not None}
    hot = [r for r in out if r["b"] is None]
    assert len(hot) == n - 4 and max(r["block"] for r in hot) == (n - 5) // 16
    cells = [(int(r["block"] > o), r["a"], r["s0"], r["s1"], r["key"], min(r["block"], o), max(r["block"], o)) for r in hot for o in range(max(x["block"] for x in hot) + 1)]
    cells.sort(key=lambda c: (c[4:], c[0]))
    names = ["side", "rid", "s0", "s1", "key", "i", "j"]
    parts = [pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells[a : a + 13]], pa.int64()) for k in range(7)], names=names) for a in range(0, len(cells), 13)]
    links |= {(r["a"], r["b"]) for b in neardup.compare_blocks(iter(parts)) for r in b.to_pylist()}
    u = sig.view(np.uint64)
    want = {(int(rid[i]), int(rid[j])) for i, j in itertools.combinations(range(n), 2) if key[i] == key[j] and distance(u[i], u[j]) <= neardup.RADIUS}
    assert links == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}


@pytest.mark.parametrize("hub", [-1, 1000])
def test_components_of_hot_vertices(spark, monkeypatch, hub):
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    edges = [(hub, i) for i in range(20)] + [(30, 31), (31, 32)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(hub, 0) for i in [hub, *range(20)]} | {30: 30, 31: 30, 32: 30}


def test_hot_copies_and_hot_class(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST_HOT", 3)
    rows = [(f"{i:03}", t) for i, t in enumerate(texts(60, 8))]
    rows += [(f"c{i:03}", rows[0][1]) for i in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()
    assert len(got) == len(rows)
    of = {r["id"]: (r["class_id"], r["n_links"]) for r in got}
    assert all(of[f"c{i:03}"] == of["000"] for i in range(30))
    assert {(a, b) for a, b in itertools.combinations(sorted(of), 2) if of[a][0] == of[b][0]} == brute(rows)


def at_similarity(share, n, grams=200, seed=11):
    """``n`` pairs of random texts that have in common just the share of their four-character sequences, at least."""
    rng = random.Random(seed)
    some = lambda k: "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(k))
    same = -(-2 * grams * share // (1 + share))
    for i in range(n):
        start = some(int(same) + 3)
        yield from ((f"{2 * i:08d}", start + some(grams - int(same))), (f"{2 * i + 1:08d}", start + some(grams - int(same))))


@pytest.mark.parametrize(("share", "of_pairs"), [(0.6, 0.6), (0.6, 0.65), (0.6, 0.7), (0.3, 0.3), (0.8, 0.8)])
def test_recall_at_the_threshold(spark, share, of_pairs):
    n = 2000
    df = spark.createDataFrame(list(at_similarity(of_pairs, n)), "pid string, text string")
    found = pairs_of(near_duplicates(df, "pid", "text", share=share)).collect()
    assert all(int(a) // 2 == int(b) // 2 for a, b in found)
    assert len(found) >= 0.996 * n


def test_share_without_a_plan():
    assert neardup.Bands.of(1.0).count == 1
    for share in (0.0, -0.5, 1.5, 0.01):
        with pytest.raises(ValueError):
            neardup.Bands.of(share)


def test_pairs_of_a_hot_class(spark, monkeypatch):
    from inkstream.llm import pairs

    monkeypatch.setattr(pairs, "CELL", 4)
    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    rows = [(f"{i:04d}", "0000") for i in range(60)] + [("0100", "0100"), ("0101", "0101"), ("0102", "0101"), (None, None)]
    got = pairs_of(spark.createDataFrame(rows, "id string, class_id string")).collect()
    assert sorted(map(tuple, got)) == [*itertools.combinations([f"{i:04d}" for i in range(60)], 2), ("0101", "0102")]


def test_texts_of_one_64_bit_hash_stay_apart(spark):
    rows = [("a", 7, 1), ("b", 7, 2), ("c", 7, 2), ("d", 8, 5)]
    signed = spark.createDataFrame([(i, h1, h1, h2, 0, 0, b"") for i, h1, h2 in rows], "id string, rid long, h1 long, h2 long, s0 long, s1 long, bands binary")
    got = {r["id"]: r["rid"] for r in neardup.separate(signed).collect()}
    assert got["a"] == 7 and got["d"] == 8 and got["b"] == got["c"] not in (7, 8)
    assert neardup.separate(signed.where("id <> 'a'")).where("rid <> h1").count() == 0


def test_similar_equals_sets(spark):
    rng = random.Random(9)
    rows = []
    for i in range(700):
        base = "".join(rng.choice("abcd") for _ in range(rng.randint(4, 60)))
        rows.append((i, i + 1, base, "".join(c if rng.random() < 0.93 else "z" for c in base)))
    sets = lambda t: {t[k : k + 4] for k in range(len(t) - 3)}
    want = {r[0] for r in rows if len(sets(r[2]) & sets(r[3])) >= 0.6 * len(sets(r[2]) | sets(r[3]))}
    got = neardup.similar(spark.createDataFrame(rows, "a long, b long, folded_a string, folded_b string"), 4, 0.6)
    assert {r["a"] for r in got.collect()} == want and 50 < len(want) < 650

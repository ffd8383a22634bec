import itertools

import pytest

from inkstream.llm import pairs
from inkstream.llm.lookalikes import one_form, same_look_classes, same_look_pairs
from inkstream.operators import skew

ROWS = "id long, title string, text string, look string"
SAME = [("A-1", "Ａ‑１"), ("é", "é"), ("a b", "a　b"), ("II世", "Ⅱ世"), ("Corsa", "Соrѕа"), ("人", "⼈"), ("冷", "冷"), ("a·b", "a・b"), ("ab", "a​﻿b️"), ("가", "가")]
DIFFERENT = [("a", "A"), ("e", "\u00e9"), ("来", "來"), ("2", "\u00b2"), ("3", "③"), ("a-b", "a—b"), ("a b", "a  b"), ("a", "ab"), ("a\nb", "a b"), ("（a", "〈a")]


def test_pairs(spark):
    values = [v for p in SAME + DIFFERENT for v in p]
    rows = [(i, v, None, "x") for i, v in enumerate(values)]
    got = {(r["id_a"], r["id_b"]) for r in same_look_pairs(spark.createDataFrame(rows, ROWS), "id", ["title", "text"]).collect()}
    by = {frozenset(p) for p in SAME}
    want = {(i, j) for i, j in itertools.combinations(range(len(values)), 2) if frozenset((values[i], values[j])) in by}
    assert got == want


def test_edge_cases(spark):
    rows = [(1, None, "", "c"), (1, None, "", "c"), (2, "​", "a", None), (3, "", "ａ", "d"), (3, "", "ａ", "d"), (4, "x" * 100000 + "Ａ", "a", ""), (5, "x" * 100000 + "A", None, ""), (None, "a", "А", None)]
    df = spark.createDataFrame(rows, ROWS)
    assert {tuple(r) for r in same_look_pairs(df, "id", ["title", "text"]).collect()} == {(2, 3, "text"), (3, 4, "text"), (4, 5, "title")}
    formed = one_form(df, ["title"]).collect()
    assert [r["title"] for r in formed][:4] == [None, None, "", ""] and formed[3]["text"] == "ａ" and formed[0]["look"] == "c"
    assert same_look_pairs(df.limit(0), "id", ["title"]).count() == 0


@pytest.mark.parametrize("pair", ["⺝月", "⺜日", "⺊卜", "⻗雨", "⻝食", "〸十", "µμ", "ﾡㄱ", "ꓐB", "⽉月"])
def test_same_shape_in_other_blocks(pair):
    import pyarrow as pa

    from inkstream.llm.lookalikes import plain_column

    a, b = plain_column(pa.array(list(pair))).to_pylist()
    assert a == b


def test_hot_look_is_split_into_cells(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL", 8)
    monkeypatch.setattr(skew, "LEAST_HOT", 5)
    rows = [(i, "Ａ" if i % 40 == 0 else "А" if i % 50 == 0 else "A", f"{i}", "x") for i in range(1, 301)] + [(1000, "B", "t", "x"), (1001, "B", "t", "x")]
    df = spark.createDataFrame(rows, ROWS)
    want = {(a, b, "title") for (a, x, *_), (b, y, *_) in itertools.combinations(rows, 2) if x != y and x in "ＡАA" and y in "ＡАA"}
    assert {tuple(r) for r in same_look_pairs(df, "id", ["title", "text"]).collect()} == want
    classes = same_look_classes(df, "id", ["title", "text"]).collect()
    assert {tuple(r) for r in classes} == {(i, "title", 1, 3) for i in range(1, 301)} and len(classes) == 300

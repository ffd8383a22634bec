import random

import pytest

from inkstream.llm import contamination
from inkstream.llm.codepoints import fold_text
from inkstream.llm.contamination import leaked_items


def shingles(t):
    f = fold_text(t)
    return {f[i : i + 12] for i in range(len(f) - 11)}


def tables(spark):
    rng = random.Random(8)
    word = lambda n: "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n))
    items = [(i, word(rng.randint(30, 120))) for i in range(25)] + [(90, None), (91, ""), (92, "短文"), (None, word(50)), (93, word(40) * 3)]
    docs = []
    for d in range(120):
        t = word(rng.randint(0, 200))
        for _ in range(rng.choice([0, 1, 2])):
            src = rng.choice(items)[1] or ""
            a, b = sorted((rng.randrange(len(src) + 1), rng.randrange(len(src) + 1)))
            t += "<b>" + "&nbsp;".join([src[a:b][:5], src[a:b][5:]]) + "</b>" + word(3)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "x"), (503, items[0][1] + "，" * 9), (503, items[1][1]), (None, items[2][1]), (504, word(9000) + items[3][1] + word(9000))]
    return docs, items


@pytest.mark.parametrize("slots", [24, 8])
def test_equals_brute_force(spark, monkeypatch, slots):
    monkeypatch.setattr(contamination, "SLOTS", slots)
    docs, items = tables(spark)
    want, sets = set(), {}
    for i, t in items:
        if i is not None:
            sets.setdefault(i, set()).update(shingles(t))
    of = {}
    for d, t in docs:
        of.setdefault(d, set()).update(shingles(t))
    for d, s in of.items():
        want |= {(d, i) for i, x in sets.items() if x and len(s & x) >= 0.3 * len(x)}
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, shingle int").repartition(5)
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, rank string")
    for most in (200_000, 0):
        got = leaked_items(d, i, most_tokens=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {w for w in want if w[0] is not None}
        for r in got:
            assert r["shared"] == len(of[r["doc_id"]] & sets[r["item_id"]])


def test_item_split_over_rows_of_one_document(spark):
    rng = random.Random(2)
    item = "".join(chr(0x4E00 + k) for k in rng.sample(range(5000), 111))
    docs = [(1, item[:31]), (1, item[40:71]), (2, item[:31]), (3, item[:31] + "。" + item[40:71])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["shared"]) for r in leaked_items(d, i, share=0.4).collect()}
    assert got == {(1, 40), (3, 40)}


def test_densest_window(spark):
    rng = random.Random(3)
    item, other = ("".join(chr(0x4E00 + k) for k in rng.sample(range(a, a + 3000), 60)) for a in (0, 4000))
    d = spark.createDataFrame([(1, item[:25] + other * 3 + item[20:])], "doc_id long, text string")
    r = leaked_items(d, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (r["shared"], r["item_shingles"], r["start"]) == (43, 49, 25 + 180)


def test_empty(spark):
    d, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "一" * 5 + "二三四五六七八九十")], "item_id int, text string")
    assert leaked_items(d, i).count() == 0
    assert leaked_items(d, i.limit(0)).columns == ["doc_id", "item_id", "shared", "item_shingles", "start"]

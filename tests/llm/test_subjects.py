import random

import numpy as np

from inkstream.llm.chains import Chain
from inkstream.llm.subjects import classified, composition, subjects_of

TERMS = {"sport": ["守门员", "联赛", "冠军", "射门", "教练"], "law": ["合同", "法院", "被告", "条款", "仲裁"], "food": ["面团", "酱油", "火锅", "蘑菇", "烤箱"], "music": ["吉他", "乐谱", "和弦", "唱片", "歌词"]}
NEUTRAL = ["结果逐渐改变", "这一时期比较平稳", "材料说明了细节"]


def article(rng):
    chosen = rng.sample(sorted(TERMS), rng.choice([1, 1, 2]))
    out = [f"{rng.choice(['早期', '后来', '当时'])}的{rng.choice(TERMS[s])}影响了{rng.choice(TERMS[s])}" for s in chosen for _ in range(rng.randint(4, 6))] + [rng.choice(NEUTRAL) for _ in range(3)]
    other = rng.choice([s for s in TERMS if s not in chosen])
    if rng.random() < 0.5:
        out.append(f"曾经的{rng.choice(TERMS[other])}很少")
    rng.shuffle(out)
    return "。".join(out) + "。", set(chosen)


def test_held_out(spark):
    rng = random.Random(6)
    rows = [(i, *article(rng)) for i in range(700)]
    labels = [(i, s if rng.random() > 0.02 else "law") for i, _, chosen in rows[:450] for s in chosen] + [(1, "law"), (None, "law"), (5, None), (10**6, "law")]
    articles = spark.createDataFrame([(i, t, "题", "x") for i, t, _ in rows] + [(rows[0][0], rows[0][1], "题", "x"), (800, None, None, None), (801, "", "联赛", None), (802, "联赛的冠军。" * 9000, None, None)], "id long, text string, title string, subject string")
    found = subjects_of(classified(articles, spark.createDataFrame(labels, "id long, subject string")))
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], set()).add(r["subject"])
    assert sum(got.get(i) == chosen for i, _, chosen in rows[450:]) >= 0.95 * 250
    assert 800 not in got and 801 not in got and got[802] == {"sport"}
    assert sum(r["n_articles"] for r in composition(found).collect()) == sum(map(len, got.values()))


def test_nothing_to_learn_from(spark):
    articles = spark.createDataFrame([(1, "联赛", "t")], "id long, text string, title string")
    none = spark.createDataFrame([], "id long, subject string")
    assert subjects_of(classified(articles, none)).count() == 0
    assert classified(articles.limit(0), none).count() == 0


def test_wide_beam_is_exact():
    rng = np.random.default_rng(0)
    k = 4
    x, y = rng.normal(size=(200, 4 * k + 6)), (rng.random((200, k)) < 0.4).astype(float)
    chain = Chain.fit(x, y, np.arange(200) % 2)
    best, p = chain.decode(x, 2**k)
    narrow, q = chain.decode(x, 1)
    assert (p >= q - 1e-12).all() and best.shape == narrow.shape

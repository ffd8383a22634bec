import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm.codepoints import decode, encode, fold_text, grams
from inkstream.llm.folding import folder, without_markup
from inkstream.llm.lookalikes import plain_char, plain_column

TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("éÅΣσıİﾊﾞ각한②ⅣＡ'゙̧́̂")), max_size=30)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_round_trip(rows):
    assert encode(*decode(pa.array(rows, pa.string()))).to_pylist() == [r or "" for r in rows]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_folding_is_that_of_whole_strings(rows):
    want = ["".join(c for c in unicodedata.normalize("NFKC", r).lower() if unicodedata.category(c)[0] in "LN") for r in rows]
    assert encode(*folder()(pa.array(rows, pa.string()))).to_pylist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_one_form_is_that_of_whole_strings(rows):
    want = [None if r is None else unicodedata.normalize("NFC", "".join(map(plain_char, r))) for r in rows]
    assert plain_column(pa.array(rows, pa.string())).to_pylist() == want


def test_grams_stay_within_rows():
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 4, 9]))) for _ in range(300)]
    for n in (1, 3, 4):
        values, at = grams(*decode(pa.array(rows)), n)
        known = {}
        for i, r in enumerate(rows):
            assert at[i + 1] - at[i] == max(0, len(r) - n + 1)
            for k in range(len(r) - n + 1):
                assert known.setdefault(r[k : k + n], values[at[i] + k]) == values[at[i] + k]
        assert len(set(known.values())) == len(known)


def test_markup(spark):
    raw = ["<b\nx>Ａ&nbsp;b&#12;</b>", "a < b &amp c", None, "&;x"]
    got = spark.createDataFrame([(r,) for r in raw], "t string").select(without_markup(__import__("pyspark").sql.functions.col("t")).alias("t")).toPandas()["t"]
    assert encode(*folder()(pa.array(list(got), pa.string()))).to_pylist() == [fold_text(r) for r in raw]

import pytest
from pyspark.sql import functions as F

from inkstream.functions.chunks import SEPARATORS, chunk_rows, fixed_chunks, recursive_chunks, sentence_chunks, split_recursive


def windows(text, size, overlap):
    text = text or ""
    starts = range(0, max(len(text) - overlap, 1), size - overlap)
    return [w for w in (text[s : s + size].strip() for s in starts) if w]


@pytest.mark.parametrize("size,overlap", [(10, 3), (5, 0), (1, 0), (256, 20)])
def test_fixed(spark, size, overlap):
    texts = [None, "", "a", "a" * size, "b" * (size + 1), " " * 40, "你好，世界。" * 9, "x" + " " * 30 + "y", "😀" * 33]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fixed_chunks(F.col("t"), size, overlap).alias("c")).collect()
    for r in rows:
        assert r["c"] == windows(texts[r["i"]], size, overlap)


def test_bad_overlap():
    for cut in (fixed_chunks, recursive_chunks):
        with pytest.raises(ValueError):
            cut(F.lit("a"), 5, 5)


def test_rows_number_chunks(spark):
    rows = chunk_rows(spark.createDataFrame([(1, "abcdef"), (2, "")], "id int, t string"), "id", fixed_chunks(F.col("t"), 4, 1)).collect()
    assert [tuple(r) for r in rows] == [("1", 0, "abcd", 4, 2), ("1", 1, "def", 3, 2)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("一二三\n\n四五六\n\n七八九", ["一二三", "四五六", "七八九"]),
        ("一二三。四五六。七八", ["一二三", "。四五六", "。七八"]),
        ("abcdefghijkl", ["abcde", "efghi", "ijkl"]),
        ("a b c d e", ["a b c", "c d", "d e"]),
        ("", []),
        ("   ", []),
    ],
)
def test_recursive(text, want):
    assert split_recursive(text, 5, 1 if text.startswith("abc") else 2 if " " in text else 0, SEPARATORS) == want


def test_recursive_column(spark):
    got = spark.createDataFrame([("一二三。四五六",), (None,)], "t string").select(recursive_chunks(F.col("t"), 5, 0)).collect()
    assert [r[0] for r in got] == [["一二三", "。四五六"], []]


def test_sentences(spark):
    got = [r[0] for r in spark.createDataFrame([("一二。三四！五",), ("一二三四五六七",), (None,)], "t string").select(sentence_chunks(F.col("t"), 6)).collect()]
    assert got == [["一二。三四！", "五"], ["一二三四五六", "七"], []]

import pytest
from tokenizers import Tokenizer

from inkstream.llm.encoding import Vocabulary, decoded, encoded, stitched_pieces, tokenizer_folder
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(not (tokenizer_folder() / "byte_bpe_50k.tiktoken").exists(), reason="no vocabulary here")

TEXTS = [None, "", " ", "你好，世界！Hello's don't", "<|endoftext|>" * 20, "好" * 700, "a b\n\n  c" * 80, " \n\t　" * 100 + "x", "'ve'll" * 100, "😀" * 90, "x" + " " * 300 + "y" * 300, "12 345" * 60, "é\xa0" * 99]


@pytest.mark.parametrize("chunk,overlap", [(16384, 512), (64, 16), (40, 39), (16, 3)])
def test_ids(spark, chunk, overlap):
    t = Tokenizer.from_file(str(tokenizer_folder() / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, x, 1) for i, x in enumerate([*TEXTS, TEXTS[3]])]
    got = encoded(spark.createDataFrame(rows, "doc_id long, text string, ids int"), Vocabulary.read(), chunk_chars=chunk, overlap=overlap)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}


def test_repeated_rows_and_round_trip(spark):
    v = Vocabulary.read()
    df = spark.createDataFrame([(1, TEXTS[6]), (1, TEXTS[6]), (1, "y" * 100), (2, None)], "doc_id long, text string")
    got = encoded(df, v, chunk_chars=32, overlap=8)
    assert got.count() == 4
    assert sorted(r["text"] for r in decoded(got, v).collect()) == sorted([TEXTS[6], TEXTS[6], "y" * 100, ""])
    assert encoded(df.limit(0), v).count() == 0
    with pytest.raises(ValueError):
        encoded(df, v, chunk_chars=5, overlap=5)


def test_long_text_is_cut(spark):
    df = spark.createDataFrame([(1, "ab cd, " * 500), (2, "z" * 3000), (3, "z" * 300 + " ab, cd" * 200 + "z" * 300)], "doc_id long, text string")
    pieces = stitched_pieces(df, Vocabulary.read().pattern, 64, 16)
    by = {r["doc_id"]: r for r in pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).collect()}
    assert by[1]["n"] > 40 and by[1]["most"] < 160 and by[2]["n"] == 1
    # a joint without a boundary only joins its neighbours
    assert by[3]["n"] > 15 and by[3]["most"] < 420


def test_random_texts_and_chunk_sizes(spark):
    import random

    rng, t = random.Random(4), Tokenizer.from_file(str(tokenizer_folder() / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    bits = ["'re", "'", "r", "e", " ", "  ", "\n", "好", "12", "!", "\u00a0", "\x1c", "é", "ab", "\u3000", "'s", "😀", "-" * 9, "z" * 9]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 300)))) for i in range(150)]
    df = spark.createDataFrame([*rows, (None, rows[3][1] * 9)], "doc_id long, text string")
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in [*rows, (None, rows[3][1] * 9)]}
    for chunk, overlap in ((20, 6), (50, 20), (9, 8)):
        assert {r["doc_id"]: r["ids"] for r in encoded(df, Vocabulary.read(), chunk_chars=chunk, overlap=overlap).collect()} == want

"""Text columns on adversarial strings, against expected results that were worked out apart."""

import pytest
from pyspark.sql import functions as F

from inkstream.functions import hanzi, text

# (raw text, cleaned, as wiki text)
CASES = [
    (None, "", ""),
    ("", "", ""),
    (' ', '', ''),
    ('<p>你好</p>', '你好', '你好'),
    ('<>a', 'a', '<>a'),
    ('a<b\nc>d', 'ad', 'ad'),
    ('&nbsp;x&#12;', 'x 12', 'x'),
    ('\u3000全角\u3000空格\u2028行\x1c尾\x85', '全角 空格 行 尾', '全角\u3000空格\u2028行\x1c尾'),
    ('É é 1² ③ _-.,!?@#￥', 'É é 1² ③ _-.,!?', 'É é 1² ③ _-.,!?@#￥'),
    ('a\r\nb\rc\n\n\n d', 'a b c d', 'a\nb\rc\nd'),
    ('\U0001f600 emoji \U0001f44d\U0001f3fd', 'emoji', '\U0001f600 emoji \U0001f44d\U0001f3fd'),
    ('{{a{{b{{c}}}}}} [[A|b]] [[c]] [[File:x.jpg|thumb]] [[图像:y]] [http://e.cn 名字] http://e.cn/a。', 'a b c A b c File x.jpg thumb 图像 y http e.cn 名字 http e.cn a', 'b c 名字'),
    ('<ref name=x />a<ref>b\nc</ref>d<!-- e\nf -->g', 'ab cdg', 'adg'),
    ("== 标题 ==\n* 项\n#: 目\n| cell\n! head\n{| t\n|}\n'''粗'''  '''斜''", '标题 项 目 cell ! head t 粗 斜', '标题\n项\n目\n粗 斜'),
    ('{{1{{2{{3{{4{{5{{6{{7}}}}}}}}}}}}}}', '1 2 3 4 5 6 7', '{{1{{2}}}}'),
    ('a\u2028| b\n| c\nd', 'a b c d', 'a\u2028| b\nd'),
    ('\xa0\u3000x\xa0', 'x', 'x'),
    ('e\u0301 combining', 'e combining', 'e\u0301 combining'),
    ('#:*;list', 'list', 'list'),
    ('====', '', ''),
    ('a\x0bb\x0cc', 'a b c', 'a\x0bb\x0cc'),
]
RAW = [c[0] for c in CASES]


def results(spark, column):
    rows = spark.createDataFrame(list(enumerate(RAW)), "i int, t string").select("i", column(F.col("t")).alias("got")).collect()
    return [r["got"] for r in sorted(rows)]


@pytest.mark.parametrize("column,at", [(text.clean_text, 1), (text.wiki_clean, 2)])
def test_cleaners(spark, column, at):
    assert results(spark, column) == [c[at] for c in CASES]


def test_long_text_is_cleaned(spark):
    raw = "<b>好</b> " * 60_000
    got = spark.createDataFrame([(raw,)], "t string").select(text.clean_text(F.col("t")), text.wiki_clean(F.col("t"))).first()
    assert tuple(got) == ("好 " * 59_999 + "好",) * 2


def test_blanks_at_the_ends_and_tokens(spark):
    assert results(spark, text.normalize_text) == [(r or "").lower().strip() for r in RAW]
    assert results(spark, text.tokens) == [(r or "").split() for r in RAW]


def test_snippet(spark):
    got = spark.createDataFrame([("一\n二三",), ("一",), (None,)], "t string").select(text.snippet(F.col("t"), 3)).collect()
    assert [r[0] for r in got] == ["一 二...", "一...", None]


def test_tags(spark):
    raw = ["<>a< b\n>  c\t<b>d", " <x> ", "a > b < c", None]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    assert [r[0] for r in df.select(text.strip_tags(F.col("t"))).collect()] == ["a  c\td", "", "a > b < c", None]
    assert [r[0] for r in df.select(text.strip_tags_ws(F.col("t"))).collect()] == ["a c d", "", "a > b < c", None]


def test_bigrams(spark):
    rows = [("",), (None,), ("好",), ("你好 吗",), ("Ab, c",), ("😀x𠀀y",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.bigrams(F.col("t"))).collect()]
    assert got == [[], [], ["好"], ["你好", "好吗"], ["ab", "bc"], ["x𠀀", "𠀀y"]]


def test_format_size(spark):
    sizes = [0, 1023, 1024, 24832, 1048575, 1048576, 10**10, None]
    want = [None if n is None else f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 1024**2 else f"{n / 1024**2:.1f} MB" for n in sizes]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(text.format_size(F.col("n"))).collect()] == want


@pytest.mark.parametrize(
    ("traditional", "simplified"),
    [
        ("溫度計顯示氣溫繼續上升，證據與圖表標明強度恢復。", "温度计显示气温继续上升，证据与图表标明强度恢复。"),
        ("節目報導：參觀鐵橋的機會單純難得，夠寬闊。", "节目报导：参观铁桥的机会单纯难得，够宽阔。"),
        ("臺灣歷史學會擬於龜山鎮舉辦藝術展覽，鄉親踴躍參與。", "台湾历史学会拟于龟山镇举办艺术展览，乡亲踊跃参与。"),
        ("衹擡峯麪", "只抬峰面"),
        ("著名的俱乐部、大阪、慰藉、姊妹、摔跤、哪吒、苎麻", "著名的俱乐部、大阪、慰藉、姊妹、摔跤、哪吒、苎麻"),
        ("简体中文没有变化，English 123", "简体中文没有变化，English 123"),
        (None, None),
        ("", ""),
    ],
)
def test_simplified_sentences(spark, traditional, simplified):
    df = spark.createDataFrame([(traditional,)], "t string").select(hanzi.to_simplified(F.col("t")).alias("s"))
    assert df.first()["s"] == simplified


def test_simplified_frequent_characters():
    """All characters that GB2312 lacks and Big5 lists as frequent, but for rare ones without another form."""

    def has(c, encoding):
        return c.encode(encoding, "ignore")

    known = set(hanzi.TRADITIONAL)
    assert len(known) == len(hanzi.TRADITIONAL) == len(hanzi.SIMPLIFIED) and known & set(hanzi.SIMPLIFIED) <= {"苧"}
    frequent = [c for c in map(chr, range(0x4E00, 0xA000)) if b"" < has(c, "big5") < b"\xc9\x40" and not has(c, "gb2312")]
    assert sum(c in known for c in frequent) >= 0.9 * len(frequent)

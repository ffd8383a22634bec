"""One form for texts that look the same: widths, kinds of space, invisible characters, accents, borrowed letters.

A batch's text becomes one code-point array. A lookup table replaces every character, several code points for one where
needed; combining marks are then sorted and composed over the whole array, a mark of every run at a time. There is no
per-row or per-character string call.

Kept apart, because a reader sees the difference: case, accents, other ideographs (simplified or traditional), raised
and circled characters, dashes longer than a hyphen, line breaks, the number of spaces.

Result cases
    null, empty       stay null, empty; they look like nothing and are never reported as pairs
    text of invisible characters only   the empty text
    repeated rows     one row of an id and value counts
    very long texts   no limit
    hot value         values are compared by hashes; ``same_look_classes`` has a row per id; pairs are formed between spellings, in cells
    clashing names    only the named columns are read or replaced
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.codepoints import CharMap, composer, decode, encode
from inkstream.llm.pairs import block_of, blocks
from inkstream.operators.skew import join_hot
from inkstream.session import cut

# Letters of other alphabets and numerals, each followed by the letter or ideograph of the same shape.
SAME_LETTERS = (
    "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXϹCοoϲcϳj" "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTХXԌGԚQԜWҮYѴVӀI" "аaеeоoрpсcуyхxѕsіiјjһhԁdԛqԝwѵvӏl"
    "ꓐBꓑPꓓDꓔTꓖGꓗKꓙJꓚCꓜZꓝFꓟMꓠNꓡLꓢSꓣRꓦVꓪWꓫXꓬYꓮAꓰEꓲIꓳOꓴU" "օoɡgµμ" "〸十〹卄〺卅"
)
# Radicals of U+2E80-2EF3, each followed by the ideograph of the same shape; forms without one are left out.
SAME_RADICALS = (
    "⺁厂⺅亻⺆冂⺉刂⺊卜⺋㔾⺎兀⺏尣⺐尢⺒巳⺓幺⺔彑⺖忄⺗㣺⺘扌⺙攵⺛旡⺜日⺝月⺞歺⺠民⺡氵⺢氺⺣灬⺤爫⺦丬⺨犭⺫罒⺬示⺭礻⺮𥫗⺯糹⺰纟⺱罓⺲罒⺳㓁⺹耂⺾艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻈讠⻉贝⻊𧾷⻋车"
    "⻌辶⻏阝⻐钅⻑長⻒镸⻓长⻔门⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻟飠⻠饣⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀"
)
SAME_SHAPE = dict(zip(SAME_LETTERS[::2], SAME_LETTERS[1::2])) | dict(zip(SAME_RADICALS[::2], SAME_RADICALS[1::2]))
SAME_SHAPE |= dict.fromkeys("·‧∙⋅・･", "·") | dict.fromkeys("‐‑−﹣－", "-")
# Marks without a glyph that aren't format characters.
NO_GLYPH = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF), (0x180B, 0x180F), (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x3164, 0x3164), (0xFFA0, 0xFFA0)]
SAME_BLOCKS = [(0x2160, 0x217F), (0x2E80, 0x2FDF)]


def plain_char(c: str) -> str:
    """What stands for one character, decomposed."""
    p, kind = ord(c), unicodedata.category(c)
    if kind == "Cf" or (kind == "Cc" and c not in "\t\n\x0b\x0c\r\x85") or any(a <= p <= b for a, b in NO_GLYPH):
        return ""
    if kind == "Zs":
        return " "
    if 0xAC00 <= p <= 0xD7A3:
        return c
    tag, _, other = unicodedata.decomposition(c).partition(" ")
    if tag in ("<wide>", "<narrow>"):
        # one step: what is left is the same character in its usual width
        c = "".join(chr(int(x, 16)) for x in other.split())
    elif any(a <= p <= b for a, b in SAME_BLOCKS):
        c = unicodedata.normalize("NFKC", c)
    return "".join(SAME_SHAPE.get(x, x) for x in unicodedata.normalize("NFD", c))


@lru_cache(maxsize=1)
def char_map() -> CharMap:
    return CharMap(plain_char)


def plain_column(column: pa.Array) -> pa.Array:
    out = encode(*composer()(*char_map().apply(*decode(column))))
    if column.null_count:
        out = pc.if_else(pc.is_valid(column), out, pa.scalar(None, pa.string()))
    return out


def one_form(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the named text columns in one consistent form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [plain_column(batch.column(i)) if name in columns else batch.column(i) for i, name in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


LOOK, RAW = ["field", "look", "look2"], ["raw", "raw2"]


def looks(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(id, field, look, look2, raw, raw2)``, once each: hashes of what each value looks like and of its code points. Nulls and what looks like nothing are left out."""
    values = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("v")).select("id", "v.field", "v.value").where("id is not null and value <> ''")
    formed = one_form(values.withColumn("look", F.col("value")), ["look"]).where("look <> ''")

    def mark(c: str, name: str) -> list:
        return [F.xxhash64(c).alias(name), F.hash(F.length(c), c).alias(f"{name}2")]

    # written once: the texts are read and brought to one form a single time, whatever asks for the hashes
    return cut(formed.select("id", "field", *mark("look", "look"), *mark("value", "raw")).distinct())


def spellings(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the looks that have several spellings: ``(field, look, look2, n, class_id, n_spellings)`` with the number of ids and the least of them, and a row per spelling with its number ``n`` of ids."""
    each = hashed.groupBy(*LOOK, *RAW).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    varied = each.groupBy(*LOOK).agg(F.sum("n").alias("n"), F.min("least").alias("class_id"), F.count("*").cast("int").alias("n_spellings")).where("n_spellings > 1")
    return varied, each.drop("least").join(varied.select(*LOOK), LOOK)


def same_look_classes(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(id, field, class_id, n_spellings)``: every id whose value of a field looks like another that differs in code points; the class is named by its least id."""
    hashed = looks(rows, id_col, columns)
    return join_hot(hashed.select("id", *LOOK), spellings(hashed)[0], LOOK, "n").select("id", "field", "class_id", "n_spellings").distinct()


def same_look_pairs(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """``(id_a, id_b, field)``, id_a < id_b: different ids whose values of a field look the same and differ in code points.

    Spellings are paired first; their members meet in cells of two blocks, so the work follows the pairs that come out
    and no task gets a whole hot look.
    """
    hashed = looks(rows, id_col, columns)
    spelled = spellings(hashed)[1]
    a, b = (spelled.select(*LOOK, *(F.col(c).alias(f"{c}_{s}") for c in (*RAW, "n"))) for s in "ab")
    two = a.join(b, LOOK).where("(raw_a, raw2_a) < (raw_b, raw2_b)").withColumns({"ka": blocks(F.col("n_a")), "kb": blocks(F.col("n_b"))})
    cells = two.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    member = join_hot(hashed, spelled, [*LOOK, *RAW], "n").select("id", *LOOK, *RAW, block_of(F.col("id"), blocks(F.col("n"))).alias("block"))
    cell = [*LOOK, "raw_a", "raw2_a", "raw_b", "raw2_b", "i", "j"]

    def side(s: str, block: str) -> DataFrame:
        mine = member.withColumnsRenamed({"id": f"id_{s}", "raw": f"raw_{s}", "raw2": f"raw2_{s}", "block": block})
        return mine.join(cells.select(*cell), [*LOOK, f"raw_{s}", f"raw2_{s}", block])

    met = side("a", "i").join(side("b", "j"), cell).where("id_a <> id_b")
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "field").distinct()

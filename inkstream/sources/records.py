"""Delimited lines that may be broken: valid records with their fields, bad lines with the reason.

Result cases
    null line            ``columns`` (it holds no field)
    empty line           ``columns`` (one empty field)
    repeated lines       each is judged by itself
    very long lines      no limit; all patterns are possessive, so the regex engine needs no stack
    empty input          empty result
    clashing names       the new columns are named by parameters and replace columns of those names
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED, PLAIN = r'"[^"]*+(?:""[^"]*+)*+"', r'(?!")[^\t]*+'
FIELD = rf"(?:{QUOTED}|{PLAIN})"
ROW, PAIR = rf"^{FIELD}(?:\t{FIELD})*+\z", rf"^({FIELD})\t({FIELD})\z"
KEY = r"^[1-9][0-9]{0,9}\z"
BAD_CHAR = r"[\x{FFFD}\x7F\x00-\x08\x0A-\x1F]"
BLANK = r"(?U)^[\s\x1c-\x1f]*+\z"


def unquoted(field: Column) -> Column:
    return F.when(field.startswith('"'), F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)


def classify_lines(lines: DataFrame, raw: str = "raw_line", key: str = "record_key", text: str = "record_text", reason: str = "reason") -> DataFrame:
    """``lines`` with the two fields of each valid line, or the ``reason`` why it is none.

    Every line is first read permissively with an explicit schema, which keeps the raw text of what the reader calls
    corrupt. Lines that the reader splits and that hold nothing doubtful are taken as they are; corrupt and doubtful
    lines are judged again from their raw text: quoting, then column count, then values.
    """
    schema = "key string, text string, corrupt string"
    options = {"mode": "PERMISSIVE", "sep": "\t", "quote": '"', "escape": '"', "columnNameOfCorruptRecord": "corrupt", "maxCharsPerColumn": "-1"}
    line = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"\r\z", "")
    # explode() of one struct keeps the optimizer from repeating its fields' expressions wherever they are used
    read = lines.withColumn("_read", F.explode(F.array(F.struct(line.alias("line"), F.from_csv(line, F.lit(schema), options).alias("csv")))))
    body, csv = F.col("_read.line"), F.col("_read.csv")
    doubtful = csv.corrupt.isNotNull() | csv.text.isNull() | body.contains('"') | body.rlike(BAD_CHAR) | ~F.coalesce(csv.key.rlike(KEY), F.lit(False))
    shape = F.when(~doubtful, "read").when(~body.rlike(ROW), "quoting").when(~body.rlike(PAIR), "columns").otherwise("pair")
    split = F.when(F.col("_shape") == "read", F.array(csv.key, csv.text)).when(F.col("_shape") == "pair", F.array(unquoted(F.regexp_extract(body, PAIR, 1)), unquoted(F.regexp_extract(body, PAIR, 2))))
    got = read.withColumn("_shape", F.explode(F.array(shape))).withColumn("_got", F.explode(F.array(split)))
    k, t = F.col("_got")[0], F.col("_got")[1]
    why = F.when(F.col("_shape").isin("quoting", "columns"), F.col("_shape")).when(~k.rlike(KEY) | t.rlike(BLANK) | t.rlike(BAD_CHAR), "value")
    done = got.withColumn(reason, F.explode(F.array(why)))
    return done.withColumn(key, F.when(F.col(reason).isNull(), k)).withColumn(text, F.when(F.col(reason).isNull(), t)).drop("_read", "_shape", "_got")


def valid_records(lines: DataFrame, **names: str) -> DataFrame:
    reason = names.get("reason", "reason")
    return classify_lines(lines, **names).where(F.col(reason).isNull()).drop(reason)


def bad_lines(lines: DataFrame, **names: str) -> DataFrame:
    key, text, reason = names.get("key", "record_key"), names.get("text", "record_text"), names.get("reason", "reason")
    return classify_lines(lines, **names).where(F.col(reason).isNotNull()).drop(key, text)

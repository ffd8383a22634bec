from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkstream.sources.records import bad_lines, classify_lines, valid_records


def judge(line):
    """The rules, character by character."""
    line = (line or "").removesuffix("\r")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, value = i + 1, ""
            while True:
                if i >= len(line):
                    return "quoting", None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + line[i], i + 1
            if i < len(line) and line[i] != "\t":
                return "quoting", None
        else:
            end = line.find("\t", i)
            end = len(line) if end < 0 else end
            value, i = line[i:end], end
        fields.append(value)
        if i >= len(line):
            break
        i += 1
    if len(fields) != 2:
        return "columns", None
    key, text = fields
    good = key.isascii() and key.isdigit() and 1 <= len(key) <= 10 and key[0] != "0"
    if not good or not text.strip() or any(c in "�\x7f" or (c < " " and c != "\t") for c in text):
        return "value", None
    return None, (key, text)


def check(spark, lines):
    rows = classify_lines(spark.createDataFrame(list(enumerate(lines)), "line_id long, raw_line string")).collect()
    assert len(rows) == len(lines)
    for r in rows:
        got = r["reason"], None if r["reason"] else (r["record_key"], r["record_text"])
        assert got == judge(lines[r["line_id"]]), repr(lines[r["line_id"]])


CASES = [
    None, "", "\r", "1\ta", "1\ta\r", "1\ta\r\r", '1\t"a\tb"', '1\t"a""b"', '1\t"a', '1\t"a"b', '"1"\ta', '1\ta"b', "1\t", "1\t  　", "1\t\xa0", "1\t​", "01\ta", "12345678901\ta", "１\ta", " 1\ta", "1\ta\tb", "1", "\ta", '1\t""', '1\t""""',
    "1\ta\x00b", "1\ta\x7f", "1\t�", "1\ta\nb", '1\t"a\nb"', '1\t" "', '"\t"', '"1\t2"\tx', "1\t\x85", "1\t\x1c", '1\t"a"\t', "1 a", '1\t"' + 'x""' * 20000 + '"', "1\t" + "y" * 300000, '1\t"' + 'x""' * 20000, "#1\ta", "1\t\\", '1\t\\"a"', '1\t"\\"',
]


def test_cases(spark):
    check(spark, CASES)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='1"\t\r a\n\\', max_size=12), min_size=80, max_size=120))
def test_any_lines(spark, lines):
    check(spark, lines)


def test_valid_and_bad_are_all(spark):
    lines = spark.createDataFrame([(i, x, "keep") for i, x in enumerate(CASES)], "line_id long, raw_line string, record_text string")
    good, bad = valid_records(lines), bad_lines(lines)
    assert good.count() + bad.count() == len(CASES)
    assert good.columns == ["line_id", "raw_line", "record_text", "record_key"]


def test_empty(spark):
    assert classify_lines(spark.createDataFrame([], "line_id long, raw_line string")).count() == 0

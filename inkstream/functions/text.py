"""Text columns: cleaning, normalisation, tokens, snippets.

The patterns spell out their character classes, so that they mean the same to the JVM as the Unicode-aware originals:
``SPACE`` is all Unicode white space, ``WORD`` all letters, numbers and the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\x{0d}\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
EDGES = rf"^[{SPACE}]+|[{SPACE}]+\z"

# The cleaning steps of the three cleaners, in order.
CLEAN_STEPS = [(r"<[^>]+>", ""), (r"&[a-zA-Z]+;", " "), (rf"[^{WORD}{SPACE}.,!?-]", " "), (rf"[{SPACE}]+", " ")]
TAG_STEPS = [(r"<[^>]*>", "")]
TAG_SPACE_STEPS = [(r"<[^>]*>", ""), (rf"[{SPACE}]+", " ")]
# The steps that turn wiki markup into text, in order; the template step is repeated five times.
TEMPLATE_STEP = (r"\{\{[^{}]*\}\}", "")
WIKI_STEPS = [
    (r"(?s)<!--.*?-->", ""),
    *[TEMPLATE_STEP] * 5,
    (r"(?i)\[\[(?:File|Image|文件|图像):[^\]]*?\]\]", ""),
    (r"\[\[([^|\]]+?)\|([^\]]*?)\]\]", "$2"),
    (r"\[\[([^\]]+?)\]\]", "$1"),
    (rf"\[https?://[^{SPACE}\]]+[{SPACE}]+([^\]]*?)\]", "$1"),
    (rf"https?://[^{SPACE}]+", ""),
    (r"(?i)<ref[^>]*?/[^\n]*?>", ""),
    (r"(?is)<ref[^>]*?>.*?</ref>", ""),
    (r"<[^>]+>", ""),
    (r"&[a-zA-Z]+;", " "),
    (r"&#[0-9]+;", " "),
    (r"'''?", ""),
    (r"(?s)\{\|.*?\|\}", ""),
    (rf"(?m)^[{SPACE}]*[|!][^\n]*$", ""),
    (rf"(?m)^[{SPACE}]*[*#:;]+[{SPACE}]*", ""),
    (rf"(?m)^=+[{SPACE}]*([^\n]*?)[{SPACE}]*=+[{SPACE}]*$", "$1"),
    (r"[ \t]+", " "),
]


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, EDGES, "")


def replaced(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        # (?d): only a line feed ends a line
        c = F.regexp_replace(c, f"(?d){pattern}", by)
    return c


def once(c: Column) -> Column:
    """``c`` as a column that is computed once: a later filter on it is neither merged with it nor moved before a step that spreads the rows."""
    return F.explode(F.array(c))


def clean_text(c: Column) -> Column:
    """Tags, entities and special characters removed, white space made single; null becomes empty."""
    return strip(replaced(strip(F.coalesce(c, F.lit(""))), CLEAN_STEPS))


def normalize_text(c: Column) -> Column:
    """Lower case, stripped; null becomes empty."""
    return strip(F.lower(F.coalesce(c, F.lit(""))))


def strip_tags(c: Column) -> Column:
    """Without tags, stripped; inner white space stays."""
    return strip(replaced(c, TAG_STEPS))


def strip_tags_ws(c: Column) -> Column:
    """Without tags, white space made single."""
    return strip(replaced(c, TAG_SPACE_STEPS))


def wiki_clean(c: Column) -> Column:
    """Plain text of wiki markup; blank lines go, templates deeper than five levels stay; null becomes empty."""
    lines = F.split(replaced(F.coalesce(c, F.lit("")), WIKI_STEPS), "\n")
    return strip(F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n"))


def tokens(c: Column) -> Column:
    """Tokens between white space; null has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"[{SPACE}]+"), lambda x: x != "")


def bigrams(c: Column) -> Column:
    """Pairs of neighbouring letters or numbers of the lower-cased text; a text of one gives that one."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"[^{WORD}]+", "")
    # a match consumes one character and captures two; the outer array binds the text, so that it is made once a row
    return F.element_at(F.transform(F.array(plain), lambda s: F.when(s == "", F.array().cast("array<string>")).when(F.length(s) == 1, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit("(?s)(?=(..))."), F.lit(1)))), 1)


def snippet(c: Column, n: int = 300) -> Column:
    """The first ``n`` characters on one line, always with dots."""
    return F.concat(F.replace(F.substring(c, 1, n), F.lit("\n"), F.lit(" ")), F.lit("..."))


def has_html(c: Column) -> Column:
    return c.contains("<br") | c.contains("<img") | c.contains("<div") | c.contains("<p>")


def format_size(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    one = lambda x, unit: F.concat(F.replace(F.format_number(x, 1), F.lit(","), F.lit("")), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, one(n / 1024, " KB")).otherwise(one(n / (1024 * 1024), " MB"))

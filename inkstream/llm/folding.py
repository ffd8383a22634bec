"""The JVM's part of folding, and one folder per Python worker."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.llm.codepoints import Folder


def without_markup(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), "&[A-Za-z#0-9]+;", "")


@lru_cache(maxsize=1)
def folder() -> Folder:
    return Folder()

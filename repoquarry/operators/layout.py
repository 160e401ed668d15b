"""Layout of Markdown lines for a plain page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.text import lines, printable_ascii, rstrip, soft_wrap

# Line heads in order of testing, and the kind of line each one marks.
KIND_BY_HEAD = {"# ": "title", "## ": "section", "### ": "subsection", "- ": "bullet"}
PLAIN = "text"
BLANK = "blank"


def sanitized(texts: DataFrame, column: str = "line") -> DataFrame:
    return texts.withColumn(column, printable_ascii(F.col(column)))


def wrapped(texts: DataFrame, column: str = "line", width: int = 80) -> DataFrame:
    return texts.withColumn(column, soft_wrap(F.col(column), width))


def layout_lines(texts: DataFrame, keys: list[str], column: str = "text", width: int = 80) -> DataFrame:
    """Lines of Markdown texts with their kind and their text without the mark: (*keys, pos, kind, text)."""
    split = texts.select(*keys, F.posexplode(lines(F.col(column))).alias("pos", "line"))
    clean = split.withColumn("line", soft_wrap(printable_ascii(rstrip(F.col("line"))), width))
    return clean.select(*keys, "pos", *[c.alias(n) for n, c in classified(F.col("line")).items()])


def classified(line: Column) -> dict[str, Column]:
    kind, text = F.when(line == "", BLANK), F.when(line == "", "")
    for head, name in KIND_BY_HEAD.items():
        rest = F.trim(F.substring(line, len(head) + 1, 2**31 - 1))
        found = F.startswith(line, F.lit(head))
        kind = kind.when(found, name)
        text = text.when(found, F.concat(F.lit(head), rest) if name == "bullet" else rest)
    return {"kind": kind.otherwise(PLAIN), "text": text.otherwise(line)}


def plain_lines(
    texts: DataFrame, keys: list[str], column: str = "text", max_lines: int = 300, max_chars: int = 100
) -> DataFrame:
    """The plain fallback: the first lines of every text, cut to a width: (*keys, pos, line)."""
    only_feeds = F.regexp_replace(F.col(column), r"[^\n -~]", " ")
    return texts.select(*keys, F.posexplode(lines(only_feeds, max_lines)).alias("pos", "line")).withColumn(
        "line", F.substring("line", 1, max_chars)
    )


def plain_title(title: Column, max_chars: int = 80) -> Column:
    return F.substring(printable_ascii(title), 1, max_chars)

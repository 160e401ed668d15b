"""Text columns: decoding, lines, white space, layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# All white space of Unicode as str.strip() sees it; it lies below U+3001.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# The line boundaries of str.splitlines(): those of Unicode and three information separators.
LINE_END = r"\R|[\x1C-\x1E]"

_REPLACEMENT = "\ufffd"
_ESCAPE = "\uf8ff"


def decode_utf8(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped.

    Only rows holding invalid bytes take the second route. It marks genuine U+FFFD characters
    before Spark turns each invalid byte into one, so that they can be told apart afterwards.
    """
    text = content.cast("string")
    marked = F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "0"))
    marked = F.replace(marked, F.lit(_REPLACEMENT), F.lit(_ESCAPE + "1"))
    valid = F.replace(F.make_valid_utf8(marked), F.lit(_REPLACEMENT), F.lit(""))
    restored = F.replace(valid, F.lit(_ESCAPE + "1"), F.lit(_REPLACEMENT))
    restored = F.replace(restored, F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(_SPACES))


def lines(text: Column, limit: int | None = None) -> Column:
    """Lines of ``text`` without their ends, the first ``limit`` only if given.

    The limit also stops the splitting, so a head of a long text costs only that head.
    """

    def without_empty_end(parts: Column) -> Column:
        count = F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts))
        return F.slice(parts, F.lit(1), count if limit is None else F.least(count, F.lit(limit)))

    return computed_once(F.split(text, LINE_END, -1 if limit is None else limit + 1), without_empty_end)


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is costly and used more than once.

    Generators and conditional branches do not share common parts of an expression; a variable of a
    lambda function is computed once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(lines(text, n), "\n")


def printable_ascii(text: Column) -> Column:
    """Every character outside the printable ASCII range becomes one space."""
    return F.regexp_replace(text, "[^ -~]", " ")


def soft_wrap(text: Column, width: int = 80) -> Column:
    """A space after every ``width`` characters, except at the very end."""
    return F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1 ")


def head_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def universal_newlines(text: Column) -> Column:
    """``\\r\\n`` and ``\\r`` as ``\\n``, as files opened in text mode are read."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def read_text(content: Column) -> Column:
    return universal_newlines(decode_utf8(content))

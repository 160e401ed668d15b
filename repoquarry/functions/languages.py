"""File extensions and the languages they stand for."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import suffix

# Supported extensions and the language each one names.
LANGUAGE_BY_EXTENSION = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".go": "go",
    ".rs": "rust",
    ".cpp": "cpp",
    ".c": "c",
    ".cs": "csharp",
}
PARSEABLE_LANGUAGES = ["python", "javascript", "typescript", "java"]

UNKNOWN = "unknown"

# An extension table travels inside expressions, so its size is checked.
MOST_EXTENSIONS = 2000

Extensions = Mapping[str, str]


def extension_table(table: DataFrame, base: Extensions = LANGUAGE_BY_EXTENSION) -> dict[str, str]:
    """Languages by extension: the rows of ``table`` (extension, language), and ``base`` where it names none.

    Extensions are taken in any case, with or without their dot; repeated rows count once. A row with a
    null or empty value, an extension that no file can have (an inner dot or a slash), an extension
    with two languages, and more than ``MOST_EXTENSIONS`` rows are errors. An empty table gives ``base``.
    """
    named = F.concat(F.lit("."), F.regexp_replace(F.lower(F.trim("extension")), r"^[.]", ""))
    rows = table.select(named.alias("extension"), F.trim("language").alias("language")).distinct()
    found = [tuple(row) for row in rows.limit(MOST_EXTENSIONS + 1).collect()]
    if len(found) > MOST_EXTENSIONS:
        raise ValueError(f"more than {MOST_EXTENSIONS} extensions")
    for extension, language in found:
        if not language or language == UNKNOWN or not re.fullmatch(r"[.][^./]+", extension or ""):
            raise ValueError(f"not an extension and its language: {extension!r}, {language!r}")
    added = dict(found)
    if len(added) < len(found):
        twice = sorted({e for e, language in found if added[e] != language})
        raise ValueError(f"extensions with two languages: {', '.join(twice)}")
    return {**base, **added}


def language_of(path: Column, default: str = UNKNOWN, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> Column:
    """Language named by the extension of ``path``; a literal map, so no join is planned."""
    table = F.create_map(*[F.lit(x) for pair in extensions.items() for x in pair])
    return F.coalesce(table[suffix(path)], F.lit(default))


def is_code(path: Column, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> Column:
    return suffix(path).isin(list(extensions))


def is_parseable(
    path: Column, languages: Iterable[str] = PARSEABLE_LANGUAGES, extensions: Extensions = LANGUAGE_BY_EXTENSION
) -> Column:
    known = set(languages)
    return suffix(path).isin([e for e, name in extensions.items() if name in known])


def ends_like_code(path: Column, extensions: Extensions = LANGUAGE_BY_EXTENSION) -> Column:
    """Case-sensitive extension match on the whole name, so ``X.PY`` fails and ``.py`` passes."""
    endings = "|".join(re.escape(e.removeprefix(".")) for e in extensions)
    return path.rlike(rf"[.](?:{endings})\z")

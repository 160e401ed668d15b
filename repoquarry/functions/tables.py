"""Table functions for SQL text: lines, verdicts and symbols of files, one call per row of a lateral join.

All but ``python_symbols`` are SQL functions, which Catalyst replaces by native generators; a call costs what
the same columns cost in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from repoquarry.functions import symbols
from repoquarry.functions.languages import LANGUAGE_BY_EXTENSION, PARSEABLE_LANGUAGES, UNKNOWN, Extensions
from repoquarry.functions.numbers import OVERSIZE
from repoquarry.functions.symbols import pattern_of, read_python
from repoquarry.functions.text import LINE_END

Patterns = Mapping[str, Mapping[str, list[str]]]

_JAVASCRIPT = {"function": symbols.JS_FUNCTIONS, "class": symbols.JS_CLASSES, "import": symbols.JS_IMPORTS}
_JAVA = {"function": symbols.JAVA_FUNCTIONS, "class": symbols.JAVA_CLASSES, "import": symbols.JAVA_IMPORTS}
PATTERNS: Patterns = {"javascript": _JAVASCRIPT, "typescript": _JAVASCRIPT, "java": _JAVA}


class PythonSymbols:
    """Rows (kind, pos, name) of one Python file; none for null and for text that does not parse."""

    def eval(self, content: bytes) -> Iterator[tuple[str, int, str]]:
        functions, classes, imports, _ = read_python(content)
        for kind, names in (("function", functions), ("class", classes), ("import", imports)):
            for pos, name in enumerate(names):
                yield kind, pos, name


def register(spark: SparkSession, extensions: Extensions = LANGUAGE_BY_EXTENSION, patterns: Patterns = PATTERNS) -> None:
    """Make the table functions known to ``spark``; a second call replaces them.

    - ``head_lines(content STRING, n INT)``: the first ``n`` lines, (pos, line); none of null or empty text.
    - ``file_verdict(path STRING, bytes BIGINT, max_bytes BIGINT)``: always one row, (language, parseable,
      skipped); sizes that are null are not skipped.
    - ``code_symbols(path STRING, content STRING)``: (language, kind, pos, name) by the ``patterns`` of the
      path's language; none for other languages and for null content.
    - ``python_symbols(content BINARY)``: (kind, pos, name) by the grammar.
    """
    suffix = r"lower(regexp_extract(substring_index(path, '/', -1), '(?s)^.+([.][^.]+)\\z', 1))"
    pairs = ", ".join(f"{_text(e)}, {_text(name)}" for e, name in extensions.items())
    language = f"coalesce(element_at(map({pairs}), {suffix}), {_text(UNKNOWN)})"
    parts = f"split(content, {_text(LINE_END)}, n + 1)"
    head = "parts -> slice(parts, 1, least(n, if(element_at(parts, -1) = '', size(parts) - 1, size(parts))))"
    parseable = ", ".join(map(_text, ["python", *patterns] if patterns is not PATTERNS else PARSEABLE_LANGUAGES))
    found = " ".join(f"WHEN {_text(name)} THEN {_rows(name, kinds)}" for name, kinds in patterns.items())
    functions = {
        "head_lines(content STRING, n INT) RETURNS TABLE(pos INT, line STRING)": "SELECT pos, col FROM"
        f" posexplode(get(transform(array({parts}), {head}), 0))",
        "file_verdict(path STRING, bytes BIGINT, max_bytes BIGINT)"
        " RETURNS TABLE(language STRING, parseable BOOLEAN, skipped STRING)": f"SELECT language, language IN ({parseable}),"
        f" CASE WHEN bytes > max_bytes THEN {_text(OVERSIZE)} END FROM (SELECT {language} AS language)",
        "code_symbols(path STRING, content STRING)"
        " RETURNS TABLE(language STRING, kind STRING, pos INT, name STRING)": "SELECT language, kind, pos, name FROM"
        f" inline(CASE {language} {found} END)",
    }
    for head_of, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head_of} RETURN {body}")
    python = udtf(PythonSymbols, returnType="kind string, pos int, name string", useArrow=True)
    spark.udtf.register("python_symbols", python)


def _text(value: str) -> str:
    """A SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _rows(language: str, kinds: Mapping[str, list[str]]) -> str:
    """An array of (language, kind, pos, name) of the distinct names in sorted order."""
    lists = []
    for kind, patterns in kinds.items():
        captures = ", ".join(f"regexp_extract_all(content, {_text(pattern_of(p))}, 1)" for p in patterns)
        row = f"named_struct('language', {_text(language)}, 'kind', {_text(kind)}, 'pos', pos, 'name', name)"
        lists.append(f"transform(array_sort(array_distinct(concat({captures}))), (name, pos) -> {row})")
    return f"concat({', '.join(lists)})"

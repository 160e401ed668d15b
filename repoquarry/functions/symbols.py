"""Symbols of source text: regular expressions for four languages, the grammar for Python."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions.patterns import java_pattern
from repoquarry.schemas import PYTHON_SYMBOLS

# The patterns that define a symbol; each captures one name.
JS_FUNCTIONS = [
    r"function\s+(\w+)\s*\(",
    r"const\s+(\w+)\s*=\s*(?:\([^)]*\)\s*=>|function)",
    r"(\w+)\s*:\s*(?:\([^)]*\)\s*=>|function)",
]
JS_CLASSES = [r"(?:export\s+)?class\s+(\w+)"]
JS_IMPORTS = [
    r"""import\s+.*?\s+from\s+["']([^"']+)["']""",
    r"""require\s*\(["']([^"']+)["']""",
]
JAVA_FUNCTIONS = [r"(?:public|private|protected)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*\{"]
JAVA_CLASSES = [r"(?:public\s+)?class\s+(\w+)"]
JAVA_IMPORTS = [r"import\s+([\w.]+)"]

# A pattern that opens with a word can only match from the head of a word or where the last match
# ended. Saying so keeps the search linear in texts with very long words or blank runs.
_WORD_HEAD = r"(?:\G|(?<!\w)(?=\w))"
_OPENS_WITH_WORD = {JS_FUNCTIONS[2], JAVA_FUNCTIONS[0]}


def pattern_of(pattern: str) -> str:
    """``pattern`` as Spark runs it."""
    return java_pattern(_WORD_HEAD + pattern if pattern in _OPENS_WITH_WORD else pattern)


def _captures(source: Column, patterns: list[str]) -> Column:
    """Distinct captured names in sorted order; a language may have no pattern for a kind."""
    if not patterns:
        return F.array().cast("array<string>")
    found = [F.regexp_extract_all(source, F.lit(pattern_of(p)), F.lit(1)) for p in patterns]
    return F.array_sort(F.array_distinct(reduce(lambda a, b: F.concat(a, b), found)))


Extractor = Callable[[Column], dict[str, Column]]


def regex_extractor(functions: list[str], classes: list[str], imports: list[str]) -> Extractor:
    """An extractor for a language described by patterns with one capture group each."""
    patterns = {"functions": functions, "classes": classes, "imports": imports}
    return lambda source: {kind: _captures(source, p) for kind, p in patterns.items()}


javascript_symbols = regex_extractor(JS_FUNCTIONS, JS_CLASSES, JS_IMPORTS)
java_symbols = regex_extractor(JAVA_FUNCTIONS, JAVA_CLASSES, JAVA_IMPORTS)

# Language -> extractor over the text. TypeScript is read as JavaScript. Python has its own job.
REGEX_EXTRACTORS: dict[str, Extractor] = {
    "javascript": javascript_symbols,
    "typescript": javascript_symbols,
    "java": java_symbols,
}


def read_python(raw: bytes | None, extended: bool = False) -> tuple:
    """(functions, classes, imports, error) of one Python file, in breadth-first order."""
    functions, classes, imports = [], [], []
    if raw is None:
        return functions, classes, imports, None
    try:
        for node in ast.walk(ast.parse(bytes(raw).decode("utf-8", "ignore"))):
            match node:
                case ast.FunctionDef(name=name):
                    functions.append(name)
                case ast.ClassDef(name=name):
                    classes.append(name)
                case ast.Import(names=names):
                    imports += [alias.name for alias in (names if extended else names[:1])]
                case ast.AsyncFunctionDef(name=name) if extended:
                    functions.append(name)
                case ast.ImportFrom(module=module, level=level) if extended:
                    imports.append("." * level + (module or ""))
    except Exception as problem:  # any failure of one file is a value, never a failed job
        return [], [], [], str(problem)
    return functions, classes, imports, None


def python_symbols(content: Column, extended: bool = False) -> Column:
    """Struct of the symbols of Python files; null content yields empty lists.

    Runs as one Arrow-batched job beside the native columns, so the files are read once. It is marked
    as not deterministic to keep Spark from parsing again below a filter on its result.
    """

    @F.pandas_udf(PYTHON_SYMBOLS)
    def parse(files: pd.Series) -> pd.DataFrame:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            rows = [read_python(raw, extended) for raw in files]
        return pd.DataFrame(rows, columns=["functions", "classes", "imports", "error"])

    return parse.asNondeterministic()(content)

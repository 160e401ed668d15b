"""Native columns against plain Python on generated and hand-written values."""

import ast
import random
import re
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry.functions import languages, numbers, paths, symbols, tables, text, urls

RANDOM = random.Random(7)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def evaluated(spark, values, expression, kind="string"):
    found = column(spark, values, kind).select("i", expression(F.col("v")).alias("x")).collect()
    return [r["x"] for r in sorted(found, key=lambda r: r["i"])]


def random_texts(pieces, count=400, size=12):
    return ["".join(RANDOM.choices(pieces, k=RANDOM.randint(0, size))) for _ in range(count)]


def test_decode_drops_only_invalid_bytes(spark):
    pieces = [b"a", b"\xff", b"\xc3", b"\x28", b"\xef\xbf\xbd", b"\xe2\x82", "é€".encode(), b"\xed\xa0\x80", b"\xf4\x90\x80\x80"]
    pieces += [b"\xc0\xaf", chr(0x1F600).encode(), b"0", b"1", chr(0xF8FF).encode(), b"\x00", b"\xf0\x9f"]
    values = [b"".join(RANDOM.choices(pieces, k=RANDOM.randint(0, 10))) for _ in range(600)]
    expected = [v.decode("utf-8", errors="ignore") for v in values]
    assert evaluated(spark, values, text.decode_utf8, "binary") == expected


SPACES = ["a", "b", "é", "\r\n", *map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x3000))]


def test_lines_are_those_of_splitlines(spark):
    values = random_texts(SPACES)
    assert evaluated(spark, values, text.lines) == [v.splitlines() for v in values]
    for n in (1, 2, 5):
        assert evaluated(spark, values, lambda v, n=n: text.lines(v, n)) == [v.splitlines()[:n] for v in values]
        assert evaluated(spark, values, lambda v, n=n: text.head_lines(v, n)) == ["\n".join(v.splitlines()[:n]) for v in values]


def test_strip(spark):
    values = random_texts(SPACES)
    assert evaluated(spark, values, text.strip) == [v.strip() for v in values]
    assert evaluated(spark, values, text.rstrip) == [v.rstrip() for v in values]


def test_universal_newlines(spark):
    values = random_texts(["a", "\r", "\n", "\r\n"])
    expected = [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]
    assert evaluated(spark, values, text.universal_newlines) == expected


def test_layout_of_long_lines(spark):
    values = ["x" * n for n in (0, 1, 79, 80, 81, 159, 160, 161, 240)] + ["é\U0001f600" * 70, "a\n" * 90]

    def wrap(v):
        return " ".join(v[i : i + 80] for i in range(0, len(v), 80))

    assert evaluated(spark, values, text.soft_wrap) == [wrap(v) for v in values]
    expected = ["".join(c if " " <= c <= "~" else " " for c in v) for v in values]
    assert evaluated(spark, values, text.printable_ascii) == expected


def test_sizes_round_half_to_even(spark):
    values = list(range(0, 4000)) + [256, 768, 10_240, 123_456_789, 5 * 2**40 + 256]
    expected = [f"{round(v / 1024, 1):.1f}" for v in values]
    assert evaluated(spark, values, numbers.kib_text, "bigint") == expected
    assert evaluated(spark, values, lambda v: numbers.kib_text(v, 2), "bigint") == [f"{v / 1024:.2f}" for v in values]
    assert evaluated(spark, values, numbers.mib_text, "bigint") == [f"{v / 1048576:.2f}" for v in values]


NAMES = [".py", "a.tar.gz", "a.", "x.PY", "a", "..py", "a..py", "d.x/e", "d/.hidden", "d/a.b.c", "ä.Java", "a b.ts", "x.py\n"]


def test_suffix_and_stem(spark):
    assert evaluated(spark, NAMES, paths.suffix) == [PurePosixPath(n).suffix.lower() for n in NAMES]
    assert evaluated(spark, NAMES, paths.stem) == [PurePosixPath(n).stem for n in NAMES]


def test_language(spark):
    values = ["a.py", "a.PY", "b.tsx", "c.cs", "d.md", "Makefile", ".py", "x/y.rs"]
    expected = ["python", "python", "typescript", "csharp", "unknown", "unknown", "unknown", "rust"]
    assert evaluated(spark, values, languages.language_of) == expected
    assert evaluated(spark, values, lambda v: languages.language_of(v, "text"))[4] == "text"
    listed = evaluated(spark, values, languages.ends_like_code)
    assert listed == [True, False, True, True, False, False, True, True]


GOOD_URLS = {
    "https://github.com/user/repo": "repo",
    "https://github.com/user/repo.git": "repo",
    "git@github.com:user/repo.git": "repo",
    "http://github.com/a-b/c.d_e/": "c.d_e",
    "  HTTPS://GitHub.com/User/Repo \n": "Repo",
    "https://github.com/o/u.github.io": "uhub.io",
}
BAD_URLS = ["https://github.com/us" + chr(0x301) + "er/repo", "https://github.com/user/re po", "github.com/user/repo", "https://gitlab.com/user/repo", "https://github.com/user", "https://github.com/u/r/tree/main", "", "ftp://github.com/u/r", "git@github.com:u/r"]


def test_url_validation(spark):
    values = [*GOOD_URLS, *BAD_URLS]
    assert evaluated(spark, values, urls.is_repository_url) == [v in GOOD_URLS for v in values]
    assert evaluated(spark, values, urls.url_error) == ["" if v in GOOD_URLS else urls.INVALID_URL for v in values]


def expected_name(url):
    bare = "".join(url.strip().rstrip("/").split(".git"))
    path = bare.rpartition(":")[2] if bare[:4] == "git@" else urlparse(bare).path.strip("/")
    _, slash, last = path.rpartition("/")
    return last if slash else "repo"


def test_repository_name(spark):
    pieces = ["https://", "http://", "HTTP://", "git@", "github.com", "/", "a", "b-c", ".git", ":", "?q=1", "#f", ";p", " ", "ftp:", "x:", "é"]
    values = [*GOOD_URLS, *BAD_URLS, *random_texts(pieces, 600, 9)]
    assert evaluated(spark, values, urls.repository_name) == [expected_name(v) for v in values]
    assert [evaluated(spark, [v], urls.repository_name)[0] for v in list(GOOD_URLS)[:3]] == ["repo"] * 3


def test_missing_url(spark):
    assert evaluated(spark, [None, ""], urls.is_repository_url) == [False, False]
    assert evaluated(spark, [None, ""], urls.repository_name) == ["repo", "repo"]


def test_strict_name_keeps_inner_git(spark):
    values = ["https://github.com/o/u.github.io", "https://github.com/o/u.git.git"]
    assert evaluated(spark, values, lambda v: urls.repository_name(v, strict=True)) == ["u.github.io", "u.git"]


SOURCE_PIECES = [
    "function", "const", "class", "import", "from", "export", "require", "public", "private", "static", "if", "else",
    " ", " ", " ", "\n", "\t", "\r", chr(0x2028), chr(0xA0), chr(28), chr(0x301), chr(0xB2), chr(0x2160), "a", "bc", "été", "变量", "_x1", "(", ")", "{", "}", "=>", "=", ":",
    ";", '"', "'", ".", "java.util", "x: function", "f(a) {", "// ", "import ", " from ", "'m'", "from 'lib'", 'require("n"',
    "const z = function", "y: (a) =>",
]


@pytest.mark.parametrize("kind", ["functions", "classes", "imports"])
@pytest.mark.parametrize(
    ("extract", "patterns"),
    [
        (symbols.javascript_symbols, {"functions": symbols.JS_FUNCTIONS, "classes": symbols.JS_CLASSES, "imports": symbols.JS_IMPORTS}),
        (symbols.java_symbols, {"functions": symbols.JAVA_FUNCTIONS, "classes": symbols.JAVA_CLASSES, "imports": symbols.JAVA_IMPORTS}),
    ],
)
def test_patterns_find_what_python_finds(spark, extract, patterns, kind):
    values = random_texts(SOURCE_PIECES, 1500, 40)
    expected = [sorted({name for p in patterns[kind] for name in re.findall(p, v)}, key=lambda s: s.encode()) for v in values]
    assert sum(map(len, expected)) > 20
    assert evaluated(spark, values, lambda v: extract(v)[kind]) == expected


def test_patterns_stay_linear_on_long_runs(spark):
    values = ["x" * 300_000, " " * 300_000, "a " * 150_000, "x" * 100_000 + ": function"]
    found = evaluated(spark, values, lambda v: F.concat(symbols.javascript_symbols(v)["functions"], symbols.java_symbols(v)["functions"]))
    assert [len(x) for x in found] == [0, 0, 0, 1]


JAVASCRIPT = """import React from "react"
import { a,
  b } from 'lib'
import "side-effect"
const fs = require('fs'), again = require("fs")
export class App {}
class App {}
function été(x) {}
const arrow = (a, b) => a
const old = function () {}
const value = 3
o = { method: function () {}, short: (x) => x, plain: 1 }
"""

JAVA = """import java.util.List;
import static org.junit.Assert;
// class Comment
public class Main {
  public int go(int a) { if (a) { return 1; } else if (b) { return 2; } }
  interface I {}
}
"""


def test_javascript_by_hand(spark):
    found = column(spark, [JAVASCRIPT]).select(*[c.alias(k) for k, c in symbols.javascript_symbols(F.col("v")).items()]).first()
    assert found["functions"] == sorted(["été", "arrow", "old", "method", "short"], key=str.encode)
    assert found["classes"] == ["App"]
    assert found["imports"] == ["fs", "react"]


def test_java_by_hand(spark):
    found = column(spark, [JAVA]).select(*[c.alias(k) for k, c in symbols.java_symbols(F.col("v")).items()]).first()
    assert found["functions"] == ["go", "if"]
    assert found["classes"] == ["Comment", "Main"]
    assert found["imports"] == ["java.util.List", "static"]


PYTHON = b"""import os, sys
import a.b as c
from json import loads
from . import sibling
class Outer:
    def method(self):
        def inner(): pass
    class Nested: pass
async def later(): pass
def method(): pass
"""


def test_python_by_hand():
    assert symbols.read_python(PYTHON) == (["method", "method", "inner"], ["Outer", "Nested"], ["os", "a.b"], None)
    functions, _, imports, _ = symbols.read_python(PYTHON, extended=True)
    assert functions == ["later", "method", "method", "inner"]
    assert imports == ["os", "sys", "a.b", "json", "."]


@pytest.mark.parametrize("raw", [b"def f(:", b"x = '\x00'", b"(" * 3000, b"\tx\n  y"])
def test_python_failures_are_values(raw):
    functions, classes, imports, error = symbols.read_python(raw)
    assert (functions, classes, imports) == ([], [], [])
    assert error


def test_python_in_spark_equals_direct_calls(spark):
    values = [PYTHON, b"def f(:", None, b"", b"\xff\xfedef g(): pass", b"\xef\xbf\xbd"]
    found = column(spark, values, "binary").select("i", symbols.python_symbols(F.col("v")).alias("s")).orderBy("i").collect()
    assert [(*r["s"][:3], r["s"]["error"]) for r in found] == [symbols.read_python(v) for v in values]
    assert ast.parse("") is not None


def test_rows_helper(spark):
    assert rows(column(spark, ["b", "a"]), "v") == [("a",), ("b",)]


def called(spark, function, *arguments):
    """Rows of a table function for every argument ``c``, after the argument's number."""
    given = spark.createDataFrame(list(enumerate(arguments)), "i int, c string")
    return sorted(tuple(r) for r in spark.sql(f"SELECT i, t.* FROM {{given}}, LATERAL {function} t", given=given).collect())


def test_table_functions_on_odd_values(spark):
    tables.register(spark)
    heads = called(spark, "head_lines(c, 2)", None, "", "a", "a\r\nb\n", "\n\nx", "a\x1eb c")
    assert heads == [(2, 0, "a"), (3, 0, "a"), (3, 1, "b"), (4, 0, ""), (4, 1, ""), (5, 0, "a"), (5, 1, "b")]
    verdicts = called(spark, "file_verdict(c, length(c), 4)", "a.PY", "b.go", "c", None)
    assert verdicts == [(0, "python", True, None), (1, "go", False, None), (2, "unknown", False, None), (3, "unknown", False, None)]
    assert called(spark, "file_verdict(c, 5, 4)", "a.ts") == [(0, "typescript", True, "file too large (>1MB)")]
    text = "class B {} class A {} class A {} import x from 'it'"
    found = [(0, "javascript", "class", 0, "A"), (0, "javascript", "class", 1, "B"), (0, "javascript", "import", 0, "it")]
    assert called(spark, "code_symbols('a.js', c)", text, None, "") == found
    assert called(spark, "code_symbols('a.py', c)", text) == called(spark, "code_symbols('a', c)", text) == []
    parsed = called(spark, "python_symbols(CAST(c AS BINARY))", "import os\ndef f(): pass", "def (", None, "")
    assert parsed == [(0, "function", 0, "f"), (0, "import", 0, "os")]


def test_table_functions_of_added_languages(spark):
    tables.register(spark, {".it's": "o'hara", ".py": "python"}, {"o'hara": {"word": [r"\b(\w+)'s"]}})
    try:
        words = called(spark, r"code_symbols('x.it\'s', c)", "b's a's b's")
        assert words == [(0, "o'hara", "word", 0, "a"), (0, "o'hara", "word", 1, "b")]
        verdicts = called(spark, "file_verdict(c, 1, 2)", "x.it's", "a.js")
        assert verdicts == [(0, "o'hara", True, None), (1, "unknown", False, None)]
    finally:
        tables.register(spark)
    assert called(spark, "file_verdict(c, 1, 2)", "a.js") == [(0, "javascript", True, None)]

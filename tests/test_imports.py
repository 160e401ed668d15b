"""The import graph: resolved names, cycles and levels in either way against brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry.operators import imports
from repoquarry.operators.imports import import_edges, import_levels, joined_path


def records(spark, found):
    """Records from {(repo, path): (language, [modules])}."""
    data = [(repo, path, language, modules) for (repo, path), (language, modules) in found.items()]
    return spark.createDataFrame(data, "repo_id string, path string, language string, imports array<string>")


def test_names_are_looked_up_as_each_language_does(spark):
    found = {
        ("r", "src/app/main.py"): ("python", ["util", "app.util", "pkg", "os", "deep.x", "util"]),
        ("r", "src/app/util.py"): ("python", None),
        ("r", "util.py"): ("python", []),
        ("r", "src/pkg/__init__.py"): ("python", ["pkg"]),
        ("r", "src/other/deep/x.py"): ("python", []),
        ("r", "web/a/main.js"): ("javascript", ["./b", "../lib", "../lib/", "./c.ts", "react", "../../../out", "./", ".", "./data.json"]),
        ("r", "web/a/b.tsx"): ("typescript", ["../a/./main"]),
        ("r", "web/a/b.ts"): ("typescript", ["./b"]),
        ("r", "web/a/c.ts"): ("typescript", []),
        ("r", "web/a/index.js"): ("javascript", []),
        ("r", "web/lib/index.js"): ("javascript", []),
        ("r", "react.js"): ("javascript", []),
        ("r", "out.js"): ("javascript", []),
        ("r", "src/main/java/com/x/A.java"): ("java", ["com.y.B", "com.y.*", "java.util.List"]),
        ("r", "src/main/java/com/y/B.java"): ("java", ["com.x.A"]),
        ("s", "src/app/main.py"): ("python", ["util"]),
        ("s", "Main.java"): ("java", ["Main"]),
        ("s", "x.go"): ("go", ["Main"]),
    }
    assert rows(import_edges(records(spark, found))) == sorted(
        [
            ("r", "src/app/main.py", "util", "src/app/util.py"),
            ("r", "src/app/main.py", "app.util", "src/app/util.py"),
            ("r", "src/app/main.py", "pkg", "src/pkg/__init__.py"),
            ("r", "src/pkg/__init__.py", "pkg", "src/pkg/__init__.py"),
            ("r", "web/a/main.js", "./b", "web/a/b.ts"),
            ("r", "web/a/main.js", "../lib", "web/lib/index.js"),
            ("r", "web/a/main.js", "../lib/", "web/lib/index.js"),
            ("r", "web/a/main.js", "./c.ts", "web/a/c.ts"),
            ("r", "web/a/main.js", "./", "web/a/index.js"),
            ("r", "web/a/main.js", ".", "web/a/index.js"),
            ("r", "web/a/b.tsx", "../a/./main", "web/a/main.js"),
            ("r", "web/a/b.ts", "./b", "web/a/b.ts"),
            ("r", "src/main/java/com/x/A.java", "com.y.B", "src/main/java/com/y/B.java"),
            ("r", "src/main/java/com/y/B.java", "com.x.A", "src/main/java/com/x/A.java"),
            ("s", "Main.java", "Main", "Main.java"),
        ]
    )
    assert import_edges(records(spark, found).where("false")).count() == 0


def test_paths_seen_from_a_folder(spark):
    cases = [("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "../../c", None), ("", "./c", "c"), ("", "..", None), ("a", "..", ""), ("a", "./.././b//c", "b/c"), ("a", "../../a", None)]
    df = spark.createDataFrame([(f, n) for f, n, _ in cases], "f string, n string")
    assert [r[0] for r in df.select(joined_path(F.col("f"), F.col("n"))).collect()] == [p for _, _, p in cases]


def brute(files, edges):
    after = {f: {t for r, p, t in edges if (r, p) == f and t != p and (r, t) in files} for f in files}

    def reached(start):
        seen, queue = set(), [start]
        while queue:
            here = queue.pop()
            for t in after[here]:
                if (here[0], t) not in seen:
                    seen.add((here[0], t))
                    queue.append((here[0], t))
        return seen

    far = {f: reached(f) for f in files}
    cycle = {f: min([f] + [g for g in far[f] if f in far[g]]) for f in files}
    level = {}

    def level_of(c):
        if c not in level:
            below = {cycle[(f[0], t)] for f in files if cycle[f] == c for t in after[f]} - {c}
            level[c] = max((level_of(b) + 1 for b in below), default=0)
        return level[c]

    return sorted((*f, cycle[f][1], sum(cycle[g] == cycle[f] for g in files), level_of(cycle[f])) for f in files)


GRAPHS = {
    "random": lambda pick: [(r, f"f{pick.randrange(14)}", f"f{pick.randrange(14)}") for r in "ab" for _ in range(18)],
    "chain": lambda pick: [("a", f"f{i}", f"f{i + 1}") for i in range(6)] + [("b", "f3", "f3")],
    "rings": lambda pick: [("a", f"f{4 * k + i}", f"f{4 * k + (i + 1) % 4}") for k in range(3) for i in range(4)] + [("a", "f3", "f4"), ("a", "f7", "f8"), ("b", "f0", "f1"), ("b", "f1", "f0")],
    "none": lambda pick: [],
}


@pytest.mark.parametrize("kind", GRAPHS)
@pytest.mark.parametrize("limit", [10**6, 0, 15])
def test_cycles_and_levels(spark, monkeypatch, kind, limit):
    """Every repository in one task, all in rounds, and some in either way."""
    monkeypatch.setattr(imports, "IN_ONE_TASK", limit)
    found = GRAPHS[kind](random.Random(4))
    files = {(r, f"f{i}") for r in "abc" for i in range(14)}
    edges = [*found, *found[:3], ("a", "f1", "unknown"), ("c", "f2", "f2")]
    table = spark.createDataFrame(sorted(files), "repo_id string, path string")
    links = spark.createDataFrame(edges, "repo_id string, path string, target string")
    assert rows(import_levels(table, links)) == brute(files, edges)


def test_long_chains_need_no_recursion(spark):
    n = 5000
    links = spark.createDataFrame([("a", f"f{i}", f"f{i + 1}") for i in range(n)] + [("a", f"f{n}", "f4990")], "repo_id string, path string, target string")
    table = spark.createDataFrame([("a", f"f{i}") for i in range(n + 1)], "repo_id string, path string")
    found = {r.path: r for r in import_levels(table, links).collect()}
    assert found["f0"].level == 4990 and found["f4995"].cycle_files == 11 and found["f4995"].cycle == "f4990"

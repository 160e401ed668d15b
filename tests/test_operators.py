"""Operators on small literal tables and against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from repoquarry.functions import languages
from repoquarry.functions.symbols import JAVA_CLASSES, REGEX_EXTRACTORS, regex_extractor
from repoquarry.operators import files as fo
from repoquarry.operators import guards, layout, manifests, naming, requests, stats, summaries, tree
from repoquarry.operators.ranking import first_per_key, rank_within, sum_below
from repoquarry.operators.records import (
    file_records,
    manifests_of,
    records_and_manifests,
    records_of,
    symbol_index,
)
from repoquarry.options import ScanOptions

MIB = 1024 * 1024


def files_table(spark, contents):
    """files(repo_id, path, bytes, content) from {(repo, path): bytes}."""
    data = [(repo, path, len(raw), bytearray(raw)) for (repo, path), raw in contents.items()]
    return spark.createDataFrame(data, "repo_id string, path string, bytes bigint, content binary")


def paths_table(spark, repos):
    data = [(repo, path, len(path)) for repo, paths in repos.items() for path in paths]
    return spark.createDataFrame(data, "repo_id string, path string, bytes bigint")


def random_repositories(seed, skewed=True):
    """Three repositories, one of them with most of the files."""
    pick = random.Random(seed)
    names = ["a", "b", "a.b", "a-b", "A", "z", "ä", "_x", ".h"]
    repos = {}
    for repo, size in (("big", 120), ("mid", 15), ("one", 1)):
        paths = set()
        while len(paths) < size:
            path = "/".join(pick.choices(names, k=pick.randint(0, 3))) + "/" + f"f{pick.randint(0, 60)}.py"
            paths.add(path.lstrip("/"))
        repos[repo] = sorted(paths)
    return repos


# Ranking


@pytest.mark.parametrize("n", [4, 150])
def test_first_per_key_equals_plain_sort_when_one_key_is_hot(spark, n):
    pick = random.Random(1)
    data = [("hot" if i % 3 else f"k{i % 7}", pick.randint(0, 40), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, v int, i int").repartition(6)
    found = first_per_key(df, ["k"], [F.desc("v"), F.asc("i")], n, spread=["i"], shares=5)
    groups = defaultdict(list)
    for k, v, i in data:
        groups[k].append((-v, i))
    expected = sorted((k, r + 1, -v, i) for k, g in groups.items() for r, (v, i) in enumerate(sorted(g)[:n]))
    assert rows(found, "k", "rank", "v", "i") == expected


@pytest.mark.parametrize("spread", [0, 1, 50, 10_000])
def test_rank_within_equals_plain_sort(spark, spread):
    pick = random.Random(2)
    data = [("hot" if i % 3 else f"k{i % 5}", pick.randint(0, spread), i) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t int, i int").repartition(5)
    found = rank_within(df, "k", "t", "i", ranges=7)
    groups = defaultdict(list)
    for k, t, i in data:
        groups[k].append((t, i))
    expected = sorted((k, r, t, i) for k, g in groups.items() for r, (t, i) in enumerate(sorted(g)))
    assert rows(found, "k", "rank", "t", "i") == expected


def test_rank_within_keeps_missing_keys_and_times(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, None, 1), ("a", None, 2), (None, 2, 3)], "k string, t int, i int")
    assert sorted((r["i"], r["rank"]) for r in rank_within(df, "k", "t", "i", ranges=3).collect()) == [(0, 1), (1, 0), (2, 0), (3, 2)]


def test_rank_within_splits_a_hot_key(spark):
    hot = spark.range(1000).select(F.lit("hot").alias("k"), F.lit(1).alias("t"), "id")
    ranked = rank_within(hot, "k", "t", "id", ranges=6)
    [folder] = {path.rpartition("/")[0] for path in ranked.inputFiles()}
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy("_range").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 400
    assert rows(ranked, "rank", "id") == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_sum_below_equals_a_running_sum(spark, width):
    pick = random.Random(4)
    data = [("a", p, pick.randint(0, 3)) for p in pick.sample(range(200), 60)] + [("b", 5, 1)]
    df = spark.createDataFrame(data, "k string, p bigint, v int")
    expected = sorted((k, p, sum(v for j, q, v in data if (j, q) < (k, p) and j == k)) for k, p, _ in data)
    assert rows(sum_below(df, "k", "p", F.col("v"), "total", width), "k", "p", "total") == expected


# Unique names


def names_in_turn(names):
    taken, result = set(), []
    for name in names:
        candidate, n = name, 0
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result


def unique(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "req_id int, name string").repartition(3)
    return [r["unique_name"] for r in requests.unique_names(df).orderBy("req_id").collect()]


@pytest.mark.parametrize(
    "names",
    [
        ["x", "x", "x"],
        ["x_1", "x", "x"],
        ["x", "x", "x_1"],
        ["x", "x_1", "x", "x_2", "x", "x", "x_1", "x_1_1", "x"],
        ["x_1", "x_1", "x", "x", "x_1_1", "x_2", "x_2"],
        ["x_01", "x_0", "x", "x", "_1", "_1", "", ""],
    ],
)
def test_unique_names_by_hand(spark, monkeypatch, names):
    assert unique(spark, names) == names_in_turn(names)
    monkeypatch.setattr(requests, "IN_TURN", 0)
    assert unique(spark, names) == names_in_turn(names)


@pytest.mark.parametrize("seed", range(6))
def test_unique_names_equal_taking_turns(spark, monkeypatch, seed):
    """All roots in turn, all in ranges, and some in either way."""
    monkeypatch.setattr(requests, "IN_TURN", [10**6, 0, 10][seed % 3])
    pick = random.Random(seed)
    pool = ["x", "x", "x", "x_1", "x_2", "x_3", "x_1_1", "x_1_2", "x_2_1", "y", "y_1"]
    names = [pick.choice(pool) for _ in range(40)]
    assert unique(spark, names) == names_in_turn(names)


def test_first_request_for_a_repository(spark):
    asked = [
        (5, "https://github.com/Ab/C.d"),
        (3, " HTTP://GitHub.com/ab/c.D.git\n"),
        (4, "git@github.com:AB/c.d.GIT"),
        (9, "https://github.com/ab/c.d/"),
        (1, "https://github.com/ab/c.d/tree/main"),
        (2, None),
        (7, "https://github.com/ab/c"),
        (8, "https://github.com/x/c.d"),
        (8, "https://github.com/x/c.d"),
    ]
    df = spark.createDataFrame([(i, u, "k") for i, u in asked], "req_id int, url string, _key string").repartition(3)
    found = requests.with_first(df.drop("_key"))
    assert rows(found.where("repository IS NOT NULL"), "req_id", "repository", "kept", "is_kept") == [
        (3, "ab/c.d", 3, True),
        (4, "ab/c.d", 3, False),
        (5, "ab/c.d", 3, False),
        (7, "ab/c", 7, True),
        (8, "x/c.d", 8, True),
        (8, "x/c.d", 8, True),
        (9, "ab/c.d", 3, False),
    ]
    assert rows(found.where("repository IS NULL"), "req_id", "kept", "is_kept") == [(1, None, False), (2, None, False)]
    kept = requests.deduplicated(df.drop("_key"))
    assert kept.columns == ["req_id", "url"] and [r[0] for r in rows(kept)] == [3, 7, 8, 8]
    assert requests.with_first(df.where("false").drop("_key")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_names_in_turn_with_state_between_batches(seed):
    """One number a name is all that has to be kept, wherever the requests are cut."""
    pick = random.Random(seed)
    pool = ["x", "x", "x_1", "x_2", "x_3", "x_1_1", "x_1_2", "x_10", "x_2_1", "x_1_1_1"]
    asked = [pick.choice(pool) for _ in range(300)]
    kept, found = {}, []
    for a in range(0, 300, 7):
        names = naming.Names(dict(kept))
        found += [names.take(n) for n in asked[a : a + 7]]
        kept = names.following
    assert found == names_in_turn(asked) and len(kept) <= len(pool)


def test_roots_of_names(spark):
    asked = ["x", "x_1", "x_1_20", "x_0", "x_1_02", "_3", "a_1b_2", "x_1\n", "y" + "_1" * 5000]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, name string").select("i", naming.root_of(F.col("name")))
    assert [r[1] for r in df.orderBy("i").collect()] == ["x", "x", "x", "x_0", "x_1_02", "", "a_1b", "x_1\n", "y"]


def test_requests_without_a_name_or_any_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, None), (4, "x")], "req_id int, name string")
    df = df.withColumn("unique_name", F.lit("old")).withColumn("_n", F.lit(1))
    assert rows(requests.unique_names(df), "req_id", "unique_name", "_n") == [(1, "x", 1), (2, None, 1), (3, None, 1), (4, "x_1", 1)]
    assert requests.unique_names(df.where("false")).count() == 0


def test_rounds_follow_the_depth_of_names_not_their_number(spark, monkeypatch):
    monkeypatch.setattr(requests, "IN_TURN", 0)
    tables = []
    kept = requests.materialize
    monkeypatch.setattr(requests, "materialize", lambda df, label: tables.append(label) or kept(df, label))
    counts = []
    for suffixes in (6, 24):
        names = ["x"] + [n for j in range(1, suffixes, 2) for n in (f"x_{j}", f"x_{j + 1}", "x")]
        tables.clear()
        assert unique(spark, names) == names_in_turn(names)
        counts.append(len(tables))
    assert counts[0] == counts[1]
    tables.clear()
    deep = ["x_1_1", "x", "x_1", "x", "x_1_1_1", "x_1", "x"]
    assert unique(spark, deep) == names_in_turn(deep)
    assert len(tables) == counts[0] + 2


# Files


def walk_entries(paths):
    """All files and the directories above them, each directory right before its contents."""
    entries = {tuple(p.split("/")): False for p in paths}
    for parts in list(entries):
        entries |= {parts[:i]: True for i in range(1, len(parts))}
    return sorted(entries.items(), key=lambda e: [part.encode() for part in e[0]])


@pytest.mark.parametrize("limit", [1, 5, 20, 110, 1000])
def test_scan_cap_counts_directories(spark, limit):
    repos = random_repositories(3)
    found = fo.scan_cap(paths_table(spark, repos), limit)
    expected = sorted(
        (repo, "/".join(parts), is_dir, i + 1)
        for repo, paths in repos.items()
        for i, (parts, is_dir) in enumerate(walk_entries(paths)[:limit])
    )
    assert rows(found, "repo_id", "path", "is_dir", "rank") == expected


def test_scan_cap_counts_empty_directories(spark):
    directories = spark.createDataFrame([("r", "a/empty"), ("r", "a")], "repo_id string, path string")
    found = fo.scan_cap(paths_table(spark, {"r": ["a/f.py", "z.py"]}), 3, directories)
    assert [r[1] for r in rows(found, "rank", "path")] == ["a", "a/empty", "a/f.py"]


def test_capped_keeps_all_without_limit(spark):
    files = paths_table(spark, {"r": ["a.py", "b.py"]})
    assert fo.capped(files, None) is files
    assert rows(fo.capped(files, 1), "path") == [("a.py",)]


def test_filters_differ_in_case(spark):
    files = paths_table(spark, {"r": ["a.py", "X.PY", "b.go", "c.md", ".py", "d"]})
    assert rows(fo.code_files(files), "path") == [("X.PY",), ("a.py",), ("b.go",)]
    assert rows(fo.parseable_files(files), "path") == [("X.PY",), ("a.py",)]
    assert rows(fo.viewer_files(files), "path") == [(".py",), ("a.py",), ("b.go",)]


def extension_rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "extension string, language string")


def test_extension_table_adds_and_renames(spark):
    found = languages.extension_table(extension_rows(spark, ("KT", "kotlin"), (".kt", " kotlin "), ("go", "golang")))
    assert found == {**languages.LANGUAGE_BY_EXTENSION, ".kt": "kotlin", ".go": "golang"}
    assert languages.extension_table(extension_rows(spark), {}) == {}
    files = paths_table(spark, {"r": ["a.KT", "b.kt", "c.go", "d.py", "kt", "e.md"]})
    assert rows(fo.code_files(files, found), "path") == [("a.KT",), ("b.kt",), ("c.go",), ("d.py",)]
    assert rows(fo.viewer_files(files, found), "path") == [("b.kt",), ("c.go",), ("d.py",)]
    assert rows(fo.parseable_files(files, ["golang"], found), "path") == [("c.go",)]
    named = fo.with_language(files, extensions=found)
    assert [r[1] for r in rows(named, "path", "language")] == ["kotlin", "kotlin", "golang", "python", "unknown", "unknown"]
    assert rows(stats.by_language(files, ["python", "kotlin"], found), "language", "n_files") == [("kotlin", 2), ("python", 1)]
    assert stats.file_counts(files, ["kotlin"], found).collect()[0][1:] == (3, 2)


@pytest.mark.parametrize("wrong", [("d.ts", "x"), ("a/b", "x"), ("", "x"), (None, "x"), ("q", None), ("q", " "), ("q", "unknown")])
def test_extension_table_refuses_what_no_file_can_have(spark, wrong):
    with pytest.raises(ValueError, match="not an extension"):
        languages.extension_table(extension_rows(spark, ("kt", "kotlin"), wrong))


def test_extension_table_is_bounded_and_unambiguous(spark, monkeypatch):
    with pytest.raises(ValueError, match="two languages: .kt"):
        languages.extension_table(extension_rows(spark, ("kt", "kotlin"), ("KT", "other"), ("a", "b")))
    monkeypatch.setattr(languages, "MOST_EXTENSIONS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        languages.extension_table(extension_rows(spark, ("a", "x"), ("b", "x"), ("c", "x")))


def test_records_of_an_added_language(spark):
    files = files_table(spark, {("r", "a.kt"): b"fun one() {}", ("r", "package.json"): b"{}", ("r", "b.py"): b"import os"})
    kotlin = {"kotlin": regex_extractor([r"fun\s+(\w+)"], [], [])}
    with pytest.raises(ValueError, match="no extension names kotlin"):
        file_records(files, extractors=kotlin)
    options = ScanOptions(extensions={".kt": "kotlin", ".py": "python", ".json": "json"})
    found = records_and_manifests(files, options, kotlin)
    assert rows(records_of(found), "path", "language", "functions") == [("a.kt", "kotlin", ["one"]), ("b.py", "python", [])]
    assert rows(manifests_of(found), "path") == [("package.json",)]
    assert ScanOptions() == ScanOptions() and hash(ScanOptions())


def test_count_totals_and_repo_counts(spark):
    data = [("r", "java", "scanned"), ("r", "java", "error"), ("r", "c", "skipped"), ("s", "c", "scanned")]
    records = spark.createDataFrame(data, "repo_id string, language string, status string")
    expected = Counter()
    for repo, language, status in data:
        keys = [(repo, language, status, 0), (repo, language, None, 1), (repo, None, None, 3)]
        expected.update([*keys, (None, language, status, 4), (None, None, None, 7)])
    found = {tuple(r)[:4]: r.n_files for r in stats.count_totals(records).collect()}
    assert found == expected
    assert stats.count_totals(records.where("false")).count() == 0
    assert rows(stats.repo_counts(records)) == [
        ("r", 3, 1, 1, 1, [("c", 1), ("java", 2)]),
        ("s", 1, 1, 0, 0, [("c", 1)]),
    ]


def test_file_metrics(spark):
    files = files_table(spark, {("r", "a.tsx"): b"x" * 128, ("r", ".py"): b"", ("r", "X.PY"): b""})
    assert rows(fo.file_metrics(files)) == [("r", ".py", "0.00 KB", "Unknown", 2), ("r", "a.tsx", "0.12 KB", "TSX", 2)]


def test_previews_cut_by_bytes_and_count_characters(spark):
    files = files_table(spark, {("r", "a.py"): "é".encode() * 5, ("r", "b.py"): b"a\r\nb\rc", ("r", "c.PY"): b"x"})
    found = rows(fo.previews(files, 8), "path", "language", "preview")
    assert found == [("a.py", "python", "é" * 5), ("b.py", "python", "a\nb\nc")]
    assert rows(fo.previews(files, 3), "preview") == [("a\nb",), ("ééé",)]


def test_previews_know_other_text(spark):
    assert rows(fo.with_language(paths_table(spark, {"r": ["a.md"]}), "text"), "language") == [("text",)]


# Records


def test_a_language_is_added_by_its_extractor(spark):
    files = files_table(spark, {("r", "m.go"): b'import "fmt"\nfunc main() {}', ("r", "n.rs"): b"fn f() {}"})
    go = regex_extractor([r"func\s+(\w+)"], [r"type\s+(\w+)"], [r'import\s+"([^"]+)"'])
    found = rows(file_records(files, extractors=REGEX_EXTRACTORS | {"go": go}), "path", "language", "functions", "imports")
    assert found == [("m.go", "go", ["main"], ["fmt"])]
    assert rows(file_records(files)) == []


def test_records_of_edge_files(spark):
    contents = {
        ("r", "exact.py"): b"#" * MIB,
        ("r", "over.py"): b"#" * (MIB + 1),
        ("r", "bad.py"): b"def f(:",
        ("r", "nul.py"): b"x = '\x00'",
        ("r", "empty.py"): b"",
        ("r", "dirty.js"): b"function f\xff\xfe(a) {} class K\xc3 {}",
        ("r", "x.ts"): b"class T {}",
        ("r", "J.java"): b"class J { int go() { } }",
        ("r", "m.go"): b"func main() {}",
    }
    found = {r["path"]: r for r in file_records(files_table(spark, contents)).collect()}
    assert found.keys() == {p for _, p in contents} - {"m.go"}
    assert {p: r["status"] for p, r in found.items()} == {
        "exact.py": "scanned",
        "over.py": "skipped",
        "bad.py": "error",
        "nul.py": "error",
        "empty.py": "scanned",
        "dirty.js": "scanned",
        "x.ts": "scanned",
        "J.java": "scanned",
    }
    assert found["over.py"]["skipped"] == "file too large (>1MB)"
    assert found["over.py"]["functions"] == found["bad.py"]["functions"] == []
    assert (found["dirty.js"]["functions"], found["dirty.js"]["classes"]) == (["f"], ["K"])
    assert (found["x.ts"]["language"], found["x.ts"]["classes"]) == ("typescript", ["T"])
    assert (found["J.java"]["functions"], found["J.java"]["classes"]) == (["go"], ["J"])


def test_status_treats_empty_marks_as_none(spark):
    from repoquarry.operators.records import status

    marks = spark.createDataFrame([("", ""), (None, "x"), ("s", "x"), (None, None)], "skipped string, error string")
    assert [r[0] for r in marks.select(status()).collect()] == ["scanned", "error", "skipped", "scanned"]


def test_extended_python_and_own_extractor(spark):
    files = files_table(spark, {("r", "a.py"): b"async def f(): pass\nimport a, b\n", ("r", "B.java"): b"class B {}"})
    own = REGEX_EXTRACTORS | {"java": regex_extractor([r"(never)"], JAVA_CLASSES, [r"class\s+(\w+)"])}
    found = {r["path"]: r for r in file_records(files, ScanOptions(extended_python=True), own).collect()}
    assert (found["a.py"]["functions"], found["a.py"]["imports"]) == (["f"], ["a", "b"])
    assert (found["B.java"]["classes"], found["B.java"]["imports"]) == (["B"], ["B"])


@pytest.mark.parametrize("strip", [False, True])
def test_records_and_manifests_come_from_one_pass(spark, strip):
    contents = {
        ("r", "a.py"): b"def f(): pass",
        ("r", "README"): b"\xfftext",
        ("r", "top/pom.xml"): b"<p/>",
        ("r", "x.go"): b"",
        ("r", "package.json"): b"{" + b" " * 50 + b"}",
    }
    files = files_table(spark, contents)
    options = ScanOptions(max_file_bytes=40, strip_top_level=strip)
    scanned = records_and_manifests(files, options)
    assert rows(records_of(scanned)) == rows(file_records(files, options))
    found = {r["path"]: bytes(r["content"]) for r in manifests_of(scanned).collect()}
    names = {"README", "package.json"} | ({"top/pom.xml"} if strip else set())
    assert found == {path: raw for (_, path), raw in contents.items() if path in names}


def test_symbol_index_keeps_order_and_repeats(spark):
    files = files_table(spark, {("r", "a.py"): b"def g(): pass\ndef g(): pass\nclass C: pass\nimport z\n"})
    found = rows(symbol_index(file_records(files)), "kind", "pos", "name")
    assert found == [("class", 0, "C"), ("function", 0, "g"), ("function", 1, "g"), ("import", 0, "z")]


def test_import_usage_counts_a_file_once(spark):
    contents = {
        ("r", "a.py"): b"import os\nimport os\n",
        ("r", "b.py"): b"import os\n",
        ("s", "c.py"): b"import os\nimport re\n",
    }
    assert rows(stats.import_usage(file_records(files_table(spark, contents)))) == [("os", 3, 2), ("re", 1, 1)]


# Statistics


def test_statistics_by_hand(spark):
    contents = {
        ("r", "a.py"): b"x",
        ("r", "b.py"): b"def f(:",
        ("r", "c.js"): b"y" * 20,
        ("r", "big.go"): b"z" * 40,
        ("r", "notes.md"): b"w" * 99,
        ("q", "only.md"): b"",
    }
    files = files_table(spark, contents)
    records = file_records(files, ScanOptions(max_file_bytes=10))
    assert rows(stats.repo_stats(records)) == [("r", 3, 1, 1, 1)]
    assert rows(stats.by_language(files)) == [("r", "javascript", 1), ("r", "python", 2)]
    assert rows(stats.language_distribution(stats.by_language(files)), "rank", "language") == [(1, "python"), (2, "javascript")]
    assert rows(stats.largest_files(files, 2), "rank", "path", "bytes") == [(1, "big.go", 40), (2, "c.js", 20)]
    assert rows(stats.language_list(files)) == [("r", "javascript, python")]
    assert rows(stats.file_counts(files)) == [("r", 4, 3)]
    assert rows(stats.repo_sizes(files)) == [("q", 0), ("r", 167)]


def test_repository_size_guard_counts_git(spark):
    files = paths_table(spark, {"r": ["a.py", ".git/objects/aaaaaaaaaa"], "s": ["b.py", ".gitignore"]})
    too_large = guards.oversize_repositories(files, 20)
    assert rows(too_large, "repo_id", "error") == [("r", "Repository too large: 0.00 MB. Maximum allowed: 0.00 MB.")]
    assert rows(guards.within_limit(files, too_large), "path") == [(".gitignore",), ("b.py",)]
    assert rows(guards.within_limit(files, too_large.limit(0)), "path") == [(".gitignore",), ("a.py",), ("b.py",)]


# Tree


def listing(paths, limit, directories=()):
    """Directory listing as a recursive walk prints it: files first, then sub-directories."""
    root = {}
    for path, is_dir in [(p, False) for p in paths] + [(d, True) for d in directories]:
        node = root
        *above, name = path.split("/")
        for part in above:
            node = node.setdefault(part, {})
        if is_dir:
            node.setdefault(name, {})
        else:
            node[name] = None

    def walk(node, level):
        for name in sorted((n for n, child in node.items() if child is None), key=str.encode):
            yield "  " * level + name
        for name in sorted((n for n, child in node.items() if child is not None), key=str.encode):
            yield "  " * level + f"- {name}/"
            yield from walk(node[name], level + 1)

    lines = list(walk(root, 0))
    return lines[:limit] + ["... (truncated)"] if len(lines) >= limit else lines


@pytest.mark.parametrize("limit", [1, 7, 30, 105, 500])
def test_tree_equals_a_walk(spark, limit):
    repos = random_repositories(5)
    found = defaultdict(list)
    for repo, _, line in rows(tree.tree_lines(paths_table(spark, repos), limit)):
        found[repo].append(line)
    assert found == {repo: listing(paths, limit) for repo, paths in repos.items()}


def test_tree_marks_a_listing_of_exactly_the_limit(spark):
    files = paths_table(spark, {"r": ["a.py", "d/b.py"]})
    assert [r[2] for r in rows(tree.tree_lines(files, 3))] == ["a.py", "- d/", "  b.py", "... (truncated)"]
    assert [r[2] for r in rows(tree.tree_lines(files, 4))] == ["a.py", "- d/", "  b.py"]


def test_tree_of_empty_repositories_and_directories(spark):
    files = paths_table(spark, {"r": ["d/b.py"]})
    directories = spark.createDataFrame([("r", "e"), ("r", "d")], "repo_id string, path string")
    repositories = spark.createDataFrame([("r",), ("none",)], "repo_id string")
    found = tree.tree_lines(files, 10, directories, repositories)
    assert rows(found) == [("none", 1, "(empty or invalid repository)"), ("r", 1, "- d/"), ("r", 2, "  b.py"), ("r", 3, "- e/")]
    assert rows(tree.tree_text(found))[1] == ("r", "- d/\n  b.py\n- e/")


# Manifests


def manifest_table(spark, contents):
    encoded = {k: v.encode() if isinstance(v, str) else v for k, v in contents.items()}
    return manifests.root_manifests(files_table(spark, encoded))


def test_readme_precedence(spark):
    contents = {("r", "readme.txt"): "low", ("r", "README.txt"): "high", ("r", "docs/README.md"): "inner", ("s", "Readme.md"): "odd"}
    assert rows(manifests.readmes(manifest_table(spark, contents))) == [("r", "README.txt", "high")]


PACKAGES = {
    "invalid": "{bad",
    "list": "[1]",
    "empty": "{}",
    "trailing": '{"name": "x"} tail',
    "single": "{'name': 'x'}",
    "text": '"x"',
    "two": '{"name":"a"},{"name":"b"}',
    "plain": '{"name": "p", "version": 2, "description": null, "dependencies": {"b": "1", "a": "^2"}}',
    "nulls": '{"dependencies": null, "devDependencies": {"d": null}, "engines": {}}',
    "twice": '{"name": "a", "name": "b", "dependencies": {"x": "1", "y": "2", "x": "3"}}',
    "engines": ' {"engines": {"node": ">=18", "npm": "9"}}\n',
    "wrong": '{"name": "w", "dependencies": ["q"]}',
}


def test_package_json(spark):
    found = manifests.packages(manifest_table(spark, {(k, "package.json"): v for k, v in PACKAGES.items()}))
    by_repo = {r["repo_id"]: r for r in found.collect()}
    assert by_repo.keys() == {"plain", "nulls", "twice", "engines", "wrong"}
    plain = by_repo["plain"]
    assert (plain["name"], plain["version"], plain["description"]) == ("p", "2", "None")
    assert [tuple(e) for e in plain["dependencies"]] == [("b", "1"), ("a", "^2")]
    assert by_repo["nulls"]["dependencies"] == []
    assert [tuple(e) for e in by_repo["nulls"]["dev_dependencies"]] == [("d", "None")]
    assert by_repo["nulls"]["name"] == "N/A"
    assert by_repo["nulls"]["engines"] is None
    assert by_repo["twice"]["name"] == "b"
    assert [tuple(e) for e in by_repo["twice"]["dependencies"]] == [("x", "3"), ("y", "2")]
    assert by_repo["engines"]["engines"] == '{"node":">=18","npm":"9"}'
    assert (by_repo["wrong"]["name"], by_repo["wrong"]["dependencies"]) == ("w", [])


def test_dependency_rows_are_capped_with_their_total(spark):
    many = "{" + ",".join(f'"p{i:02}": "{i}"' for i in range(60)) + "}"
    package = manifests.packages(manifest_table(spark, {("r", "package.json"): f'{{"dependencies": {many}, "devDependencies": {many}}}'}))
    found = rows(manifests.dependency_rows(package, "dependencies", 50))
    assert len(found) == 50
    assert found[49] == ("r", 49, "p49", "49", 60)
    assert len(rows(manifests.dependency_rows(package, "dev_dependencies", 30))) == 30


def test_requirements(spark):
    contents = {
        ("both", "requirements.txt"): "# c\r\na==1\r\n\r\n  # kept\r\n b \r\n",
        ("both", "requirements-dev.txt"): "dev",
        ("dev", "requirements-dev.txt"): "x\x0by\n \t\n#z",
        ("none", "sub/requirements.txt"): "q",
    }
    read = manifests.requirements(manifest_table(spark, contents))
    assert rows(read) == [("both", ["a==1", "# kept", "b"]), ("dev", ["x", "y"])]
    assert rows(manifests.requirement_rows(read, 1)) == [("both", 0, "a==1", 3), ("dev", 0, "x", 2)]
    assert len(rows(manifests.requirement_rows(read))) == 5


def test_pom_is_cut_after_newlines_are_joined(spark):
    read = manifests.poms(manifest_table(spark, {("r", "pom.xml"): "é\r\n" * 1500}))
    assert rows(read) == [("r", ("é\n" * 1500)[:2000])]


def test_wrapping_folder_can_be_removed(spark):
    contents = {
        ("wrapped", "top/README.md"): b"w",
        ("wrapped", "top/src/a.py"): b"",
        ("plain", "README.md"): b"p",
        ("plain", "top/README.txt"): b"no",
        ("two", "a/README.md"): b"no",
        ("two", "b/x.py"): b"",
    }
    files = files_table(spark, contents)
    assert rows(manifests.root_manifests(files), "repo_id", "path") == [("plain", "README.md")]
    found = rows(manifests.root_manifests(files, listing=files), "repo_id", "path")
    assert found == [("plain", "README.md"), ("wrapped", "README.md")]


# Summaries and layout


def record_table(spark, n=3):
    data = [("r", f"f{i}.py", "python", ["f"] * 12, [], ["os"], "bad" if i == 1 else None, "large" if i == 2 else None, 1, ["scanned", "error", "skipped"][min(i, 2)]) for i in range(n)]
    schema = "repo_id string, path string, language string, functions array<string>, classes array<string>, imports array<string>, error string, skipped string, bytes bigint, status string"
    return spark.createDataFrame(data, schema)


def test_text_summaries(spark):
    found = [r[2] for r in rows(summaries.text_summaries(record_table(spark)))]
    assert found == [
        "f0.py | Language: python\n  Functions: " + ", ".join(["f"] * 10) + "\n  Imports: os",
        "f1.py | Language: python\n  Error: bad",
        "f2.py | Language: python\n  Skipped: large",
    ]


def test_text_summary_without_symbols_is_one_line(spark):
    bare = record_table(spark, 1).withColumns({c: F.array().cast("array<string>") for c in ("functions", "imports")})
    assert rows(summaries.text_summaries(bare), "summary") == [("f0.py | Language: python",)]


def test_shown_summaries_count_the_rest(spark):
    texts = summaries.text_summaries(record_table(spark))
    assert rows(summaries.shown_summaries(texts, 2), "pos", "summary")[-1] == (3, "... and 1 more files")
    assert len(rows(summaries.shown_summaries(texts, 3))) == 3


def test_bullet_summaries(spark):
    found = rows(summaries.bullet_summaries(record_table(spark), 2))[0][1].split("\n")
    assert found == [
        "- f0.py [python] ",
        "  - functions: f, f, f, f, f, f",
        "  - imports: os",
        "- f1.py [python] (error)",
        "  - functions: f, f, f, f, f, f",
        "  - imports: os",
        "... and 1 more files",
    ]


LINES = {
    "# Title ": ("title", "Title"),
    "##  Section": ("section", "Section"),
    "### Sub": ("subsection", "Sub"),
    "- item  ": ("bullet", "- item"),
    "  - inner": ("text", "  - inner"),
    "   ": ("blank", ""),
    "#Tag": ("text", "#Tag"),
    "- ": ("text", "-"),
    "café": ("text", "caf "),
    "x" * 80: ("text", "x" * 80),
    "x" * 81: ("text", "x" * 80 + " x"),
    "x" * 161: ("text", "x" * 80 + " " + "x" * 80 + " x"),
    "\U0001f600 smile": ("text", "  smile"),
}


def test_line_kinds(spark):
    texts = spark.createDataFrame([("\n".join(LINES),)], "text string").withColumn("id", F.lit(1))
    found = [r[1:] for r in rows(layout.layout_lines(texts, ["id"]), "pos", "kind", "text")]
    assert found == list(LINES.values())


def test_plain_lines(spark):
    texts = spark.createDataFrame([(1, "a\r\nb\x0cc\n" + "y" * 150 + "\n" * 400)], "id int, text string")
    found = [r[2] for r in rows(layout.plain_lines(texts, ["id"]))]
    assert found[:3] == ["a ", "b c", "y" * 100]
    assert len(found) == 300
    title = texts.select(layout.plain_title(F.lit("é" + "t" * 100)).alias("t")).first()["t"]
    assert title == " " + "t" * 79


def test_counts_of_random_repositories(spark):
    repos = random_repositories(9)
    found = dict(rows(stats.total_considered(paths_table(spark, repos))))
    assert found == Counter({repo: len(paths) for repo, paths in repos.items()})

"""Imports between the files of a repository: resolved edges, import cycles and levels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import ancestors
from repoquarry.sources.shared import materialize

# Edges of a repository that one task orders; larger graphs are worked off in rounds over all of them.
IN_ONE_TASK = 100_000

# How languages name files: endings that stand for the name, in order of preference.
_SCRIPT_ENDINGS = ["", ".js", ".jsx", ".ts", ".tsx", "/index.js", "/index.jsx", "/index.ts", "/index.tsx"]
_PYTHON_ENDINGS = [".py", "/__init__.py"]
_JAVA_ENDINGS = [".java"]
_SCRIPTS = ("javascript", "typescript")


def import_edges(records: DataFrame) -> DataFrame:
    """(repo_id, path, module, target) of every import that names a file of its own repository.

    Dotted names of Python and Java are looked up below the folder of the importing file and all folders
    above it, the nearest first; names of scripts that begin with a dot are relative to the file's folder.
    All others, and names that lead out of the repository, are imports of something else. Files of a
    folder that import the same name are resolved once, and candidates meet the files by their whole
    paths, so no name that is common among files joins more than its own rows.
    """
    found = records.where(F.size("imports") > 0).select("repo_id", "path", _folder(F.col("path")).alias("folder"), "language", F.explode(F.array_distinct("imports")).alias("module"))
    asked = found.select("repo_id", "folder", _family(F.col("language")).alias("family"), "module").where("family IS NOT NULL").distinct()
    candidates = asked.withColumn("candidates", _candidates(F.col("family"), F.col("folder"), F.col("module")))
    each = candidates.select("repo_id", "folder", "family", "module", F.posexplode("candidates").alias("rank", "target"))
    files = records.select("repo_id", F.col("path").alias("target"))
    resolved = each.join(files, ["repo_id", "target"]).groupBy("repo_id", "folder", "family", "module").agg(F.min_by("target", "rank").alias("target"))
    keyed = found.withColumn("family", _family(F.col("language")))
    return keyed.join(resolved, ["repo_id", "folder", "family", "module"]).select("repo_id", "path", "module", "target")


def _family(language: Column) -> Column:
    return F.when(language.isin(*_SCRIPTS), F.lit("script")).when(language.isin("python", "java"), language)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*\z", 1)


def _candidates(family: Column, folder: Column, module: Column) -> Column:
    """Paths that an import may mean, the most wanted first."""
    inside = F.concat(folder, F.lit("/x"))
    # The folder itself and those above it, innermost first, and the root.
    above = F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.reverse(ancestors(inside)), F.array(F.lit(""))))
    dotted = F.replace(module, F.lit("."), F.lit("/"))

    def below(endings: list[str]) -> Column:
        named = F.array(*(F.concat(dotted, F.lit(e)) for e in endings))
        prefixed = F.transform(above, lambda a: F.transform(named, lambda n: F.when(a == "", n).otherwise(F.concat(a, F.lit("/"), n))))
        return F.flatten(prefixed)

    relative = joined_path(folder, module)
    scripts = F.when(module.startswith("."), F.transform(F.array(*map(F.lit, _SCRIPT_ENDINGS)), lambda e: F.concat(relative, e)))
    return F.when(family == "python", below(_PYTHON_ENDINGS)).when(family == "java", below(_JAVA_ENDINGS)).otherwise(scripts)


def joined_path(folder: Column, name: Column) -> Column:
    """``name`` as seen from ``folder``, without ``.`` and ``..``; null if it leads out of the root."""
    parts = F.split(F.concat_ws("/", folder, name), "/")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("outside"))

    def step(at: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(part.isin("", "."), at["kept"]).when(up, F.slice(at["kept"], F.lit(1), F.greatest(F.size(at["kept"]) - 1, F.lit(0))))
        return F.struct(
            kept.otherwise(F.concat(at["kept"], F.array(part))).alias("kept"),
            (at["outside"] | (up & (F.size(at["kept"]) == 0))).alias("outside"),
        )

    return F.aggregate(parts, start, step, lambda at: F.when(~at["outside"], F.array_join(at["kept"], "/")))


def import_levels(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, path, cycle, cycle_files, level) of every file (repo_id, path).

    ``cycle`` is the smallest path among the files that import each other in a circle, the file's own if
    there is none but itself. ``level`` is 0 for files that import no file outside of their cycle, and
    otherwise one more than the highest level they import. Repositories of up to ``IN_ONE_TASK`` edges are
    ordered by a task each. Larger ones are worked off in joins over all of them: as many rounds as
    their longest chains of imports have, with every round stored. Repeated edges, edges of a file to
    itself and to unknown files change nothing.
    """
    own = edges.where("path <> target").select("repo_id", "path", "target").distinct()
    own = materialize(own.join(files.select("repo_id", F.col("path").alias("target")), ["repo_id", "target"], "left_semi"), "import-edges")
    # One row for every IN_ONE_TASK edges at most.
    large = materialize(own.groupBy("repo_id").count().where(F.col("count") > IN_ONE_TASK).select("repo_id"), "large-graphs")
    small = own.join(large, "repo_id", "left_anti")
    found = small.groupBy("repo_id").applyInPandas(_ordered, _ORDERED)
    if large.limit(1).count():
        found = found.unionByName(ordered_in_rounds(own.join(large, "repo_id", "left_semi")))
    sizes = found.groupBy("repo_id", "cycle").agg(F.count("*").alias("cycle_files"))
    known = found.join(sizes, ["repo_id", "cycle"])
    every = files.select("repo_id", "path").distinct().join(known, ["repo_id", "path"], "left")
    return every.select(
        "repo_id",
        "path",
        F.coalesce("cycle", "path").alias("cycle"),
        F.coalesce("cycle_files", F.lit(1)).cast("bigint").alias("cycle_files"),
        F.coalesce("level", F.lit(0)).alias("level"),
    )


_ORDERED = "repo_id string, path string, cycle string, level int"


def _ordered(edges: pd.DataFrame) -> pd.DataFrame:
    """Cycles and levels of one repository, by depth-first search without recursion."""
    after: dict[str, list[str]] = {}
    for path, target in zip(edges["path"], edges["target"]):
        after.setdefault(path, []).append(target)
        after.setdefault(target, [])
    number, low, cycle, level, open_ = {}, {}, {}, {}, []

    def close(top: str) -> None:
        """All files above ``top`` on the stack import each other; those they import have levels."""
        members = open_[open_.index(top) :]
        del open_[-len(members) :]
        name = min(members, key=str.encode)
        cycle.update(dict.fromkeys(members, name))
        reached = [level[t] + 1 for m in members for t in after[m] if cycle.get(t) != name]
        level.update(dict.fromkeys(members, max(reached, default=0)))

    for start in after:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_.append(start)
        path: list[tuple[str, Iterator[str]]] = [(start, iter(after[start]))]
        while path:
            here, rest = path[-1]
            for target in rest:
                if target not in number:
                    number[target] = low[target] = len(number)
                    open_.append(target)
                    path.append((target, iter(after[target])))
                    break
                if target not in cycle:
                    low[here] = min(low[here], number[target])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[here])
                if low[here] == number[here]:
                    close(here)
    repo = edges["repo_id"].iloc[0]
    return pd.DataFrame({"repo_id": repo, "path": list(after), "cycle": [cycle[p] for p in after], "level": [level[p] for p in after]})


def ordered_in_rounds(edges: DataFrame) -> DataFrame:
    """``_ordered`` of any number of graphs of any size, by joins alone."""
    nodes = materialize(_nodes(edges), "import-nodes")
    cycles = _cycles(edges)
    named = nodes.join(cycles, ["repo_id", "path"], "left").withColumn("cycle", F.coalesce("cycle", "path"))
    named = materialize(named, "import-cycles")
    start, end = (named.select("repo_id", F.col("path").alias(side), F.col("cycle").alias(name)) for side, name in (("path", "a"), ("target", "b")))
    between = edges.join(start, ["repo_id", "path"]).join(end, ["repo_id", "target"]).where("a <> b").select("repo_id", "a", "b").distinct()
    between = materialize(between, "cycle-edges")
    # A level is final once all levels that it follows from are: one round for every level.
    done = named.select("repo_id", F.col("cycle").alias("a")).distinct().join(between, ["repo_id", "a"], "left_anti").withColumn("level", F.lit(0))
    done, level = materialize(done, "import-levels"), 0
    found = [done]
    while between.limit(1).count():
        level += 1
        reached = done.select("repo_id", F.col("a").alias("b"))
        rest = materialize(between.join(reached, ["repo_id", "b"], "left_anti"), "cycle-edges")
        sources = between.select("repo_id", "a").distinct().join(rest.select("repo_id", "a").distinct(), ["repo_id", "a"], "left_anti")
        done = materialize(sources.withColumn("level", F.lit(level)), "import-levels")
        between = rest
        found.append(done)
    levels = found[0]
    for one in found[1:]:
        levels = levels.unionByName(one)
    return named.join(levels.withColumnRenamed("a", "cycle"), ["repo_id", "cycle"]).select("repo_id", "path", "cycle", "level")


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", "path").union(edges.select("repo_id", "target")).distinct()


def _cycles(edges: DataFrame) -> DataFrame:
    """(repo_id, path, cycle) of all files in cycles, and of some others that stand alone.

    What neither imports nor is imported any more is taken away round by round. Of the rest, every file
    learns the largest path from which it can be reached; the files from which such a path can be reached
    again, among those that have learned it, are its cycle. They are taken away, and so on.
    """
    rest, found = edges, None
    while True:
        rest = _trimmed(rest)
        if not rest.limit(1).count():
            break
        label = _largest_before(rest)
        a = label.select("repo_id", "path", F.col("label").alias("of_path"))
        b = label.select("repo_id", F.col("path").alias("target"), F.col("label").alias("of_target"))
        inside = rest.join(a, ["repo_id", "path"]).join(b, ["repo_id", "target"]).where("of_path = of_target")
        inside = materialize(inside.select("repo_id", "path", "target", F.col("of_path").alias("label")), "import-inside")
        members = _leading_to(inside, label.where("path = label"))
        named = members.groupBy("repo_id", "label").agg(F.min("path").alias("cycle"))
        cycle = materialize(members.join(named, ["repo_id", "label"]).select("repo_id", "path", "cycle"), "import-cycles")
        found = cycle if found is None else found.unionByName(cycle)
        gone = cycle.select("repo_id", "path")
        rest = rest.join(gone, ["repo_id", "path"], "left_anti").join(gone.withColumnRenamed("path", "target"), ["repo_id", "target"], "left_anti")
        rest = materialize(rest, "import-rest")
    if found is None:
        return edges.select("repo_id", "path", F.col("path").alias("cycle")).limit(0)
    return found.groupBy("repo_id", "path").agg(F.min("cycle").alias("cycle"))


def _trimmed(edges: DataFrame) -> DataFrame:
    count = edges.count()
    while True:
        sources = edges.select("repo_id", F.col("path").alias("target")).distinct()
        targets = edges.select("repo_id", F.col("target").alias("path")).distinct()
        edges = materialize(edges.join(sources, ["repo_id", "target"], "left_semi").join(targets, ["repo_id", "path"], "left_semi"), "import-rest")
        left = edges.count()
        if left == count:
            return edges
        count = left


def _largest_before(edges: DataFrame) -> DataFrame:
    """(repo_id, path, label): the largest path that leads to each file, itself included."""
    label = materialize(_nodes(edges).withColumn("label", F.col("path")), "import-labels")
    while True:
        passed = edges.join(label, ["repo_id", "path"]).select("repo_id", F.col("target").alias("path"), "label")
        grown = passed.unionByName(label).groupBy("repo_id", "path").agg(F.max("label").alias("label"))
        grown = materialize(grown, "import-labels")
        changed = grown.join(label.withColumnRenamed("label", "old"), ["repo_id", "path"]).where("label <> old").limit(1).count()
        label = grown
        if not changed:
            return label


def _leading_to(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo_id, path, label) of what leads to a root within its label; roots without an edge are left out."""
    reached = roots.select("repo_id", "path", "label")
    new = reached
    while True:
        before = edges.join(new.select("repo_id", "label", F.col("path").alias("target")), ["repo_id", "label", "target"], "left_semi")
        new = before.select("repo_id", "path", "label").distinct().join(reached, ["repo_id", "path", "label"], "left_anti")
        new = materialize(new, "import-reached")
        if not new.limit(1).count():
            return reached
        reached = materialize(reached.unionByName(new), "import-reached")

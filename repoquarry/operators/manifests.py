"""Dependency manifests and README files at the root of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import basename, depth
from repoquarry.functions.text import head_lines, lines, read_text, strip
from repoquarry.schemas import PACKAGE_JSON

# File names in order of precedence, and the text for a missing field.
README_NAMES = ["README.md", "README.MD", "README.txt", "README", "readme.md", "readme.txt"]
PACKAGE_NAMES = ["package.json"]
REQUIREMENTS_NAMES = ["requirements.txt", "requirements-dev.txt"]
POM_NAMES = ["pom.xml"]
MISSING = "N/A"

MANIFEST_NAMES = README_NAMES + PACKAGE_NAMES + REQUIREMENTS_NAMES + POM_NAMES

_STRICT_JSON = {"allowSingleQuotes": "false"}


def is_manifest(path: Column, strip_top_level: bool = False) -> Column:
    """Whether ``path`` may name a manifest: at the root or, with ``strip_top_level``, one folder below."""
    if not strip_top_level:
        return path.isin(MANIFEST_NAMES)
    return basename(path).isin(MANIFEST_NAMES) & (depth(path) <= 1)


def root_manifests(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Manifest files at the root: (repo_id, path, content).

    Given the whole ``listing``, the one folder that wraps all files of a repository is removed first.
    """
    if listing is None:
        return files.where(is_manifest(F.col("path"))).select("repo_id", "path", "content")
    top = F.substring_index("path", "/", 1)
    wrapped = (
        listing.groupBy("repo_id")
        .agg(F.min(top).alias("top"), F.max(top).alias("last"), F.min(depth(F.col("path"))).alias("above"))
        .where((F.col("top") == F.col("last")) & (F.col("above") > 0))
        .select("repo_id", "top")
    )
    found = files.where(is_manifest(F.col("path"), strip_top_level=True))
    inside = F.coalesce(F.substr("path", F.length("top") + 2), F.col("path"))
    unwrapped = found.join(wrapped, "repo_id", "left").select("repo_id", inside.alias("path"), "content")
    return unwrapped.where(is_manifest(F.col("path")))


def preferred(manifests: DataFrame, names: list[str]) -> DataFrame:
    """The first of ``names`` that each repository has; a repository holds each name at most once.

    The choice is made on names alone; one number per repository then joins the files.
    """
    found = manifests.where(F.col("path").isin(names))
    if len(names) == 1:
        return found
    place = _place(names)
    chosen = found.groupBy("repo_id").agg(F.min(place).alias("_place"))
    return found.withColumn("_place", place).join(chosen, ["repo_id", "_place"], "left_semi").drop("_place")


def readmes(manifests: DataFrame, max_lines: int | None = None) -> DataFrame:
    """README text per repository: (repo_id, path, readme), cut to its first lines where it is read."""
    text = read_text(F.col("content"))
    cut = manifests.withColumn("readme", text if max_lines is None else head_lines(text, max_lines)).drop("content")
    return preferred(cut, README_NAMES).select("repo_id", "path", "readme")


def shown_texts(manifests: DataFrame, readme_lines: int, requirement_lines: int, pom_chars: int) -> DataFrame:
    """What reports show of README, requirements and pom.xml, one row per repository.

    (repo_id, readme, requirements, n_requirements, pom). Texts and lists are cut in the task that reads
    the file, so one aggregate moves only what is shown.
    """
    path, text = F.col("path"), read_text(F.col("content"))
    cut = manifests.where(path.isin(README_NAMES + REQUIREMENTS_NAMES + POM_NAMES)).select(
        "repo_id",
        F.when(
            path.isin(README_NAMES),
            F.struct(_place(README_NAMES).alias("place"), head_lines(text, readme_lines).alias("text")),
        ).alias("readme"),
        F.when(path.isin(REQUIREMENTS_NAMES), _requirement_lines()).alias("listed"),
        F.when(path.isin(REQUIREMENTS_NAMES), _place(REQUIREMENTS_NAMES)).alias("place"),
        F.when(path.isin(POM_NAMES), F.substring(text, 1, pom_chars)).alias("pom"),
    )
    requirement = F.struct(
        "place", F.slice("listed", 1, requirement_lines).alias("lines"), F.size("listed").alias("total")
    )
    parts = cut.select("repo_id", "readme", F.when(F.col("place").isNotNull(), requirement).alias("requirement"), "pom")
    found = parts.groupBy("repo_id").agg(
        F.min("readme").alias("readme"), F.min("requirement").alias("requirement"), F.max("pom").alias("pom")
    )
    return found.select(
        "repo_id",
        F.col("readme.text").alias("readme"),
        F.col("requirement.lines").alias("requirements"),
        F.col("requirement.total").alias("n_requirements"),
        "pom",
    )


def _place(names: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))


def packages(manifests: DataFrame) -> DataFrame:
    """Contents of package.json: identity, dependencies in file order, engines.

    Texts that are not one JSON object, and empty objects, count as no file.
    """
    texts = preferred(manifests, PACKAGE_NAMES).select("repo_id", read_text(F.col("content")).alias("text"))
    # Wrapped in a list, so that text after the object makes it invalid.
    wrapped = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<map<string,string>>", _STRICT_JSON)
    objects = texts.withColumn("objects", wrapped).where(F.size("objects") == 1)
    given = objects.select("repo_id", "text", F.map_keys(F.get("objects", F.lit(0))).alias("keys"))
    read = given.where(F.size("keys") > 0).select(
        "repo_id", "keys", F.from_json("text", PACKAGE_JSON, _STRICT_JSON).alias("p")
    )
    return read.select(
        "repo_id",
        *[_field(name).alias(name) for name in ("name", "version", "description")],
        _entries(F.col("p.dependencies")).alias("dependencies"),
        _entries(F.col("p.devDependencies")).alias("dev_dependencies"),
        F.when(~F.col("p.engines").isin("{}", "[]", "", "0", "false"), F.col("p.engines")).alias("engines"),
    )


def _field(name: str) -> Column:
    given = F.when(F.array_contains("keys", name), F.coalesce(F.col(f"p.{name}"), F.lit("None")))
    return F.coalesce(given, F.lit(MISSING))


def _entries(pairs: Column) -> Column:
    """Entries of a JSON object in file order; a repeated key keeps its first place and last value."""
    entries = F.transform(
        F.map_entries(pairs),
        lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("None")).alias("version")),
    )
    names = F.transform(entries, lambda e: e["name"])
    unique = F.transform(
        F.array_distinct(names), lambda name: F.element_at(F.filter(entries, lambda e: e["name"] == name), -1)
    )
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    nothing = F.array().cast("array<struct<name:string,version:string>>")
    return F.coalesce(F.when(repeated, unique).otherwise(entries), nothing)


def dependency_rows(packages: DataFrame, column: str, n: int) -> DataFrame:
    """First ``n`` dependencies of each package.json with their total: (repo_id, pos, name, version, total)."""
    total = F.size(column).cast("bigint")
    return packages.select(
        "repo_id", total.alias("total"), F.posexplode(F.slice(F.col(column), 1, n)).alias("pos", "entry")
    ).select("repo_id", "pos", "entry.name", "entry.version", "total")


def requirements(manifests: DataFrame) -> DataFrame:
    """Requirement lines per repository: (repo_id, requirements).

    Blank lines and lines that start with ``#`` are dropped; an indented comment is kept.
    """
    return preferred(manifests, REQUIREMENTS_NAMES).select("repo_id", _requirement_lines().alias("requirements"))


def _requirement_lines() -> Column:
    kept = F.filter(
        lines(read_text(F.col("content"))), lambda line: (strip(line) != "") & ~F.startswith(line, F.lit("#"))
    )
    return F.transform(kept, strip)


def requirement_rows(requirements: DataFrame, n: int | None = None) -> DataFrame:
    """Requirements with their total, the first ``n`` if given: (repo_id, pos, requirement, total)."""
    shown = F.col("requirements") if n is None else F.slice(F.col("requirements"), 1, n)
    total = F.size("requirements").cast("bigint")
    return requirements.select("repo_id", total.alias("total"), F.posexplode(shown).alias("pos", "requirement")).select(
        "repo_id", "pos", "requirement", "total"
    )


def poms(manifests: DataFrame, chars: int = 2000) -> DataFrame:
    """Head of pom.xml per repository: (repo_id, pom)."""
    return preferred(manifests, POM_NAMES).select(
        "repo_id", F.substring(read_text(F.col("content")), 1, chars).alias("pom")
    )

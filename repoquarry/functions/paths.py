"""Columns over repository-relative paths written with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# NUL cannot occur in a path, so it sorts a directory right before everything inside it.
_LEVEL = "\0"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension with its dot; empty for ``.py``, ``a.`` and ``a``."""
    return F.lower(raw_suffix(path))


def raw_suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?s)^.+([.][^.]+)\z", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = basename(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(raw_suffix(path)))


def walk_key(path: Column) -> Column:
    """Key whose order lists every directory directly before its contents."""
    return F.replace(path, F.lit("/"), F.lit(_LEVEL))


def tree_key(path: Column, is_dir: Column) -> Column:
    """Key of the tree listing: as ``walk_key``, with a directory's files before its sub-directories."""
    parts = F.split(path, "/")
    leaf = F.size(parts) - 1
    marked = F.transform(
        parts, lambda name, i: F.concat(F.when((i == leaf) & ~is_dir, F.lit("0")).otherwise(F.lit("1")), name)
    )
    return F.array_join(marked, _LEVEL)


def ancestors(path: Column) -> Column:
    """All directories that contain ``path``, outermost first."""
    parts = F.split(path, "/")
    inner = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(inner, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def depth(path: Column) -> Column:
    """Number of directories above ``path``."""
    return F.size(F.split(path, "/")) - 1

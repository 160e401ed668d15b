"""Repository URLs: validation and repository names."""

from __future__ import annotations

from urllib.parse import uses_params

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions.patterns import java_pattern
from repoquarry.functions.text import strip

# Accepted URL forms (matched without regard to case), the message for all others, and
# the name given to URLs with fewer than two path parts.
URL_FORMS = [
    r"^https?://github\.com/[\w-]+/[\w.-]+/?$",
    r"^https?://github\.com/[\w-]+/[\w.-]+\.git$",
    r"^git@github\.com:[\w-]+/[\w.-]+\.git$",
]
INVALID_URL = "Invalid GitHub URL format. Expected: https://github.com/username/repo"
FALLBACK_NAME = "repo"


def is_repository_url(url: Column) -> Column:
    cleaned = strip(url)
    matches = [cleaned.rlike(java_pattern(form, ignore_case=True)) for form in URL_FORMS]
    return F.coalesce(matches[0] | matches[1] | matches[2], F.lit(False))


def url_error(url: Column) -> Column:
    """Empty for a valid URL."""
    return F.when(is_repository_url(url), "").otherwise(INVALID_URL)


def repository_name(url: Column, strict: bool = False) -> Column:
    """Last path part of the URL, or a fallback if there are fewer than two parts.

    Every ``.git`` in the URL is deleted, which also shortens names such as ``u.github.io``;
    ``strict`` deletes only a final one.
    """
    cleaned = F.rtrim(strip(url), F.lit("/"))
    cleaned = F.regexp_replace(cleaned, r"[.]git\z", "") if strict else F.replace(cleaned, F.lit(".git"), F.lit(""))
    over_ssh = F.startswith(cleaned, F.lit("git@"))
    path = F.when(over_ssh, F.substring_index(cleaned, ":", -1)).otherwise(F.trim(_url_path(cleaned), F.lit("/")))
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(FALLBACK_NAME)


def repository_key(url: Column) -> Column:
    """``owner/name`` that all accepted forms of a repository's URL share, in lower case; null for other URLs."""
    cleaned = F.regexp_replace(F.rtrim(strip(url), F.lit("/")), r"(?i)[.]git\z", "")
    key = F.lower(F.regexp_extract(cleaned, r"([^/:]+/[^/:]+)\z", 1))
    return F.when(is_repository_url(url), key)


def _url_path(url: Column) -> Column:
    """Path of a URL: what follows scheme and host, up to query, fragment or parameters."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    path = F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(scheme.isin(uses_params), F.regexp_replace(path, r"(?s);[^/]*\z", "")).otherwise(path)

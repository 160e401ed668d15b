"""Limits and switches, passed to operators as plain parameters."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from repoquarry.functions.languages import LANGUAGE_BY_EXTENSION

MIB = 1024 * 1024


@dataclass(frozen=True)
class ScanOptions:
    """Limits of ingest and scanning.

    ``max_files`` counts every directory entry met in walk order, not only code files; without it
    the whole repository is scanned. ``drop_git`` leaves out what lies in ``.git``, as for clones. ``extended_python`` also reports async functions, ``from`` imports
    and every alias; ``strict_names`` strips ``.git`` only at the end of a URL; ``strip_top_level``
    removes the single wrapping folder many archives have before root-level manifests are looked up.
    ``extensions`` names the language of each file extension; ``extension_table`` reads it from a table.
    """

    max_upload_bytes: int = 100 * MIB
    max_extract_bytes: int = 200 * MIB
    max_file_bytes: int = MIB
    max_files: int | None = None
    drop_git: bool = False
    extended_python: bool = False
    strict_names: bool = False
    strip_top_level: bool = False
    extensions: Mapping[str, str] = field(default_factory=lambda: dict(LANGUAGE_BY_EXTENSION), hash=False)

    @classmethod
    def from_env(cls, **overrides) -> ScanOptions:
        """Defaults overridden by MAX_UPLOAD_BYTES, MAX_EXTRACT_BYTES and MAX_FILE_BYTES."""
        found = {
            name: int(os.environ[name.upper()])
            for name in ("max_upload_bytes", "max_extract_bytes", "max_file_bytes")
            if name.upper() in os.environ
        }
        return cls(**{**found, **overrides})


@dataclass(frozen=True)
class ReportOptions:
    """Sizes of the sections of reports, prompts, listings and previews."""

    tree_entries: int = 300
    preview_chars: int = 500 * 1024
    largest_files: int = 5
    report_readme_lines: int = 50
    report_node_dependencies: int = 20
    report_requirements: int = 30
    report_key_files: int = 30
    report_names: int = 5
    prompt_readme_lines: int = 200
    prompt_dependencies: int = 50
    prompt_dev_dependencies: int = 30
    prompt_requirements: int = 50
    prompt_files: int = 50
    prompt_preview_chars: int = 2000
    summary_names: int = 10
    bullet_names: int = 6
    bullet_files: int = 20
    shown_summaries: int = 15
    pom_chars: int = 2000
    wrap_chars: int = 80
    fallback_lines: int = 300
    fallback_chars: int = 100
    fallback_title_chars: int = 80

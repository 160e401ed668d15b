"""Regular expressions written for Python, in the dialect of Spark."""

from __future__ import annotations

# What Python's \s and \w stand for in text: the four information separators are white space, and
# combining marks are not part of a word.
SPACE = r"[\s\x1C-\x1F]"
WORD = r"[\p{L}\p{N}_]"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` with Python's meaning of its classes, of ``.`` and of ``$``."""
    flags = "(?iUd)" if ignore_case else "(?Ud)"
    return flags + pattern.replace(r"\s", SPACE).replace(r"\w", WORD)

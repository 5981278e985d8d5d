"""Splitting texts into pre-tokens by a Unicode pattern, with a quick path for Latin text."""

from __future__ import annotations

from collections.abc import Callable

# The pattern of the byte-level vocabularies, and the characters for which LATIN splits as it does.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
OTHER = rf"[^\t\n\r -~{LETTERS}]"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of ``pattern``.  Under BYTE_LEVEL, a text of printable ASCII, its white space and Latin letters alone
    is split with explicit classes, which the standard library scans several times as fast."""
    import re

    import regex

    full = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return full
    other, quick = re.compile(OTHER).search, re.compile(LATIN).findall
    return lambda text: full(text) if other(text) else quick(text)

"""Metric expressions: which tokens they hold, and their binding to a frame's columns."""

from __future__ import annotations

import re
from collections.abc import Callable

# Words that an expression may hold besides columns and functions.
SQL_WORDS = frozenset(
    """
    all and as asc between by case cast current desc distinct else end exclude false filter first following group
    groups in interval is last like no not null nulls or order others over partition preceding range row rows then
    ties true unbounded when where within
    """.split()
)

_TOKEN = re.compile(
    r"(?P<text>'(?:[^']|'')*')|(?P<number>(?<![\w.])\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|(?<![\w.])\.\d+)"
    r"|(?P<column>[A-Za-z_]\w*\.[A-Za-z_]\w*)(?!\s*[.(])|(?P<word>[A-Za-z_]\w*)|(?P<other>.)",
    re.S,
)
_TYPES = frozenset("bigint boolean date decimal double float int integer numeric smallint string timestamp varchar char text".split())


def tokens(expression: str) -> list[tuple[str, str, int]]:
    """(kind, text, end) of each token: text, number, column, word or other."""
    return [(m.lastgroup, m.group(), m.end()) for m in _TOKEN.finditer(expression)]


def columns_of(expression: str) -> list[tuple[str, str]]:
    return [tuple(t.split(".")) for kind, t, _ in tokens(expression) if kind == "column"]


def stray_word(expression: str) -> str | None:
    """The first word that is no qualified column, function, type of a cast or SQL word."""
    casts = re.search(r"\bcast\s*\(", expression, re.I) is not None
    for kind, text, end in tokens(expression):
        if kind == "word" and text.lower() not in SQL_WORDS and not expression[end:].lstrip().startswith("(") and not (casts and text.lower() in _TYPES):
            return text
        if kind == "other" and (text.isalpha() or text in "\"`;"):
            return text
    return None


def has_window(expression: str) -> bool:
    """Whether a window stands over something that is not itself aggregated."""
    return re.search(r"\)\s*over\s*\(", expression, re.I) is not None and re.search(r"\(\s*(sum|count|min|max|avg)\s*\(", expression, re.I) is None


def bound(expression: str, name: Callable[[str, str], str]) -> str:
    """The expression with name(table, column) in place of each qualified column."""
    out, at = [], 0
    for m in _TOKEN.finditer(expression):
        if m.lastgroup == "column":
            out += [expression[at : m.start()], name(*m.group().split("."))]
            at = m.end()
    return "".join([*out, expression[at:]])


BARE_COLUMN = re.compile(r"\s*([A-Za-z_]\w*)\.([A-Za-z_]\w*)\s*")

"""Counts over one text that quality rules and the quality classifier share."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in a is that it for on was as with be by this are or an from at which not "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es "
    "de la le et les un une que du en est pour qui dans par plus au sur avec ne "
    "el los las se y del una con no su lo al como más o pero sus"
).split()

_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)


class TextStats(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    n_upper: int
    n_lower: int
    n_exclaim: int
    n_function: int
    n_digits: int
    n_marks: int
    n_distinct: int
    n_adjacent: int
    top_count: int


def _without(text: bytes, gone: bytes) -> int:
    return len(text) - len(text.translate(None, gone))


def text_stats(text: str | None) -> TextStats:
    """Counts over a whole text; null counts as empty.

    Words are maximal runs without ASCII white space. n_dup_lines counts lines
    that hold a word and equal an earlier line; n_repeat_words the words in
    windows of three words that occur twice or more; n_adjacent the words equal
    to the one before; n_function the words that are function words when
    lower-cased in A-Z; n_marks full stops, commas, colons and semicolons.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    counts = Counter(raw.lower().split())
    return TextStats(
        n,
        len(text or "") - _without(raw, b" \t\n\x0b\x0c\r"),
        _without(raw, SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        _without(raw, UPPER),
        _without(raw, LOWER),
        _without(raw, b"!"),
        sum(counts[w] for w in _FUNCTION if w in counts),
        _without(raw, b"0123456789"),
        _without(raw, b".,;:"),
        len(counts),
        sum(map(bytes.__eq__, words, words[1:])),
        max(counts.values(), default=0),
    )

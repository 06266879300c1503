"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, emitter, rows_of, sources, spark_schema, text_bytes, written

WINDOW = 8
#: Words of benchmark text in one automaton; more items make more automata, run one after another.
BLOCK_WORDS = 200_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z lower-cased, separators as blanks, all else as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class SuffixAutomaton:
    """All substrings of a set of word sequences; a state is a class of substrings that end alike."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(next_)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, tokens: Iterable[int]) -> None:
        last = 0
        for token in tokens:
            known = self.next[last].get(token)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and token not in self.next[p]:
                self.next[p][token] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][token]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
            last = new

    def step(self, state: int, matched: int, token: int) -> tuple[int, int]:
        """The longest suffix of the text so far that occurs, after one more token."""
        while state and token not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        found = self.next[state].get(token)
        return (0, 0) if found is None else (found, matched + 1)

    def walk(self, tokens: Iterable[int], width: int) -> Iterator[tuple[int, int]]:
        """After each token the longest match, and the state of the match cut to its last width tokens.

        The cut match moves along beside the full one, so no token climbs through
        the lengths above width.
        """
        state = matched = cut = held = 0
        for token in tokens:
            state, matched = self.step(state, matched, token)
            cut, held = self.step(cut, held, token)
            if held > width:
                cut, held = self.shortened(cut, width), width
            yield matched, cut

    def shortened(self, state: int, n: int) -> int:
        """The state of the last n tokens of a match that is at least as long."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state


class ItemIndex:
    """An automaton with the items behind each window of window words (whole items, if shorter)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        sequences = []
        for item, words in items:
            if words:
                tokens = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                sequences.append((item, tokens))
                self.automaton.add(tokens)
        self.sizes = sorted({min(window, len(t)) for _, t in sequences})
        self.items: dict[tuple[int, int], set[str]] = {}
        for item, tokens in sequences:
            size = min(window, len(tokens))
            for matched, state in self.automaton.walk(tokens, size):
                if matched >= size:
                    self.items.setdefault((self.automaton.shortened(state, size), size), set()).add(item)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Covered word ranges, items with occurring windows, and the longest match (0 if shorter than any window)."""
        if not self.sizes:
            return [], set(), 0
        get = self.vocabulary.get
        tokens = np.array([get(w, -1) for w in words] + [-1], dtype=np.int64)
        stops = np.flatnonzero(tokens < 0)
        starts = np.concatenate(([0], stops[:-1] + 1))
        runs = np.flatnonzero(stops - starts >= self.sizes[0])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        shortened, known = self.automaton.shortened, self.items
        for r in runs.tolist():
            first = int(starts[r])
            for at, (matched, state) in enumerate(self.automaton.walk(tokens[first : int(stops[r])].tolist(), self.sizes[-1]), first):
                longest = max(longest, matched)
                for size in self.sizes:
                    if matched < size:
                        break
                    found = known.get((shortened(state, size), size))
                    if found:
                        items |= found
                        start = at + 1 - size
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, at + 1))
        return spans, items, longest if longest >= self.sizes[0] else 0


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    ends = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    kept, at = [], 0
    for first, after in spans:
        kept.append(text[at : ends[first][0]])
        at = ends[after - 1][1]
    return b"".join([*kept, text[at:]])


_FOUND = [
    pa.field("doc_id", pa.int64()),
    pa.field("_text", pa.binary()),
    pa.field("spans", pa.list_(pa.list_(pa.int32()))),
    pa.field("items", pa.list_(pa.string())),
    pa.field("n_words", pa.int64()),
    pa.field("longest", pa.int64()),
]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """What of docs (doc_id, text) occurs in items (item_id, text), and the texts without it.

    Returns doc_id, n_words, n_hit, n_items, items (ids as sorted strings),
    spans (word ranges), longest (the longest matching length in words, 0 if shorter than
    any window),
    clean_text (the text without its spans; null where nothing was found),
    rejected (more than max_coverage of the words are hit) and the columns in
    carry.

    Texts are lower-cased in A-Z and split into words of letters, digits and
    non-ASCII characters. A window is window consecutive item words, or a whole
    shorter item. Items are small next to the corpus: they are counted first,
    and gathered in blocks of at most about block_words words; each block makes
    one automaton of bounded size, and each document streams past it where it
    lies. With more than one block, findings so far are written to the shared
    folder between them. The corpus itself is never shuffled.

    A null or empty text has no words and no spans; a very long text is scanned
    by one task in time proportional to its words; no documents give no rows;
    null and empty items have no windows; items with the same text all count; the same item_id in several
    rows counts once; repeated documents give repeated rows; extra columns are
    ignored; without items nothing is found.
    """
    spark = docs.sparkSession
    tests = items.select(F.col("item_id").cast("string").alias("item_id"), text_bytes().alias("body")).where(F.col("body").isNotNull() & F.col("item_id").isNotNull())
    # a word takes two bytes at least, with its separator; so this bounds the words without counting them
    blocks = max(1, -(-int((tests.agg(F.sum(F.octet_length("body"))).first()[0] or 0)) // (2 * block_words)))
    more, fields = carried(docs, carry)
    between = pa.schema([*_FOUND, *(pa.field(k, f.type) for k, f in zip(more, fields, strict=True))])
    found = sources(docs, doc_id=F.col("doc_id").cast("long"), _text=text_bytes(), spans=F.expr("cast(array() as array<array<int>>)"), items=F.expr("cast(array() as array<string>)"), n_words=F.lit(0).cast("long"), longest=F.lit(0).cast("long"), **more)
    schema = pa.schema([pa.field(n, pa.int64()) for n in ("doc_id", "n_words", "n_hit", "n_items", "longest")] + [pa.field("items", pa.list_(pa.string())), pa.field("items_sha256", pa.string()), pa.field("spans", pa.list_(pa.list_(pa.int32()))), pa.field("clean_text", pa.string()), pa.field("rejected", pa.bool_())] + fields)

    def finish(doc_id, text, spans, names, n_words, longest, *rest) -> tuple:
        hit = sum(b - a for a, b in spans)
        clean = cut(text, spans).decode("utf-8", "replace") if spans else None
        return doc_id, n_words, hit, len(names), longest, names, hashlib.sha256(",".join(names).encode()).hexdigest(), spans, clean, hit > max_coverage * n_words, *rest

    def text_of(row: tuple, last: bool) -> str | bytes:
        return (row[8] if last else row[1]) or ""

    for block in range(blocks):
        if block:
            found = written(found, "decontamination")
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex([(i, words_of(b)) for i, b in part.collect()], window))

        last = block == blocks - 1

        def look(batches: Iterator[pa.RecordBatch], index=index, last=last) -> Iterator[pa.RecordBatch]:
            known = index.value

            def rows():
                for doc_id, text, spans, names, _, longest, *rest in rows_of(batches, *between.names):
                    words = words_of(text)
                    more, which, length = known.scan(words)
                    row = doc_id, text, _merged([*map(tuple, spans), *more]), sorted({*names, *which}), len(words), max(longest, length), *rest
                    yield finish(*row) if last else row

            yield from emitter(schema if last else between, rows(), weigh=lambda r: 200 + len(text_of(r, last)))

        found = found.mapInArrow(look, spark_schema(schema if last else between))
    return found

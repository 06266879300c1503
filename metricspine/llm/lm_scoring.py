"""Language-model scoring: smoothed n-grams as a weighted backoff automaton."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, discard, scale_partitions, sources, spark_schema, written

#: The token that ends each text; no word holds a line break.
END = b"\n"
#: A history with this share of its part's tokens may be wide: its n-grams are dealt to all groups. This says where they are summed, and leaves nothing out.
WIDE_SHARE = 2e-4
#: Bytes of text that make a part. A part is scored by one task.
PART_BYTES = 8 << 20
#: Distinct n-grams of parts that a group sums.
GROUP_ROWS = 2_000_000
#: Tokens that are walked from one start; walks go on side by side.
SEGMENT = 256

_U = np.uint64


def word_code(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def longer(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit codes of n-grams from those of their histories and last words."""
    x = history * _U(0x9E3779B97F4A7C15) + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


#: Of a word's code, the bytes that tell n-grams with one history apart.
FOLLOWER_BYTES = 6


def group_of(code: np.ndarray, groups: int) -> np.ndarray:
    """Groups are ranges of codes, so sorted codes of a group are close together."""
    return ((code >> _U(32)) * _U(groups)) >> _U(32)


def packed(x: np.ndarray, first: int = 8) -> bytes:
    """Whole numbers (the first bytes of each), all first bytes first, then the second: what is small takes little."""
    if not len(x):
        return b""
    wide = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, wide).T[:first]).tobytes()
    wide = min(wide, first)
    return bytes([wide]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def plain(data: bytes | None) -> np.ndarray:
    """What packed() packed, as unsigned numbers."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    planes = pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    wide = 1 << (data[0] - 1).bit_length()
    rows = np.frombuffer(planes, dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((rows.shape[1], wide), dtype=np.uint8)
    out[:, : data[0]] = rows.T
    return out.view(f"<u{wide}").ravel()


def packed_steps(x: np.ndarray) -> bytes:
    """Sorted codes, as the differences between them."""
    return packed(np.diff(x, prepend=_U(0)))


def plain_steps(data: bytes | None) -> np.ndarray:
    return np.cumsum(plain(data), dtype=np.uint64)


def counts(rows: list[dict], name: str) -> np.ndarray:
    """The packed numbers of all rows one after another."""
    return np.concatenate([np.empty(0, dtype=np.int64), *(plain(r[name]).astype(np.int64) for r in rows)])


def small(x: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return x.astype(np.uint32) if not len(x) or int(x.max()) < 1 << 32 else x.astype(np.uint64)


@dataclass
class Part:
    """Texts one after another as numbers of words, which are places in words, their sorted codes; each text is led by the end before it."""

    doc_id: np.ndarray
    known: np.ndarray
    train: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    ids: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.ids), dtype=np.int32) - np.repeat(self.starts, self.sizes).astype(np.int32)
        self.learned = np.repeat(self.train, self.sizes)


@dataclass
class Level:
    """The n-grams of one length in a part, sorted by history and last word; a history is an n-gram of the level below.

    gram: the n-gram that ends at each token, or -1; word: the code of its last word; n: how often training texts
    hold it; state: its history; below: the n-gram less its first word; states:
    codes of the histories; end: a token at which it ends.
    """

    gram: np.ndarray
    code: np.ndarray
    word: np.ndarray
    n: np.ndarray
    state: np.ndarray
    below: np.ndarray
    states: np.ndarray
    end: np.ndarray


def _grouped(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in sorted order, and where a new pair begins there."""
    size = len(major)
    if not size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    high, bits = int(major.max()) + 1, (size - 1).bit_length()
    low = int(minor.max()) + 1
    if (high * low - 1).bit_length() + bits <= 64:
        # pair and place in one number, which sorts several times faster than places do
        key = (major.astype(np.uint64) * _U(low) + minor.astype(np.uint64)) << _U(bits) | np.arange(size, dtype=np.uint64)
        key.sort()
        order = (key & _U((1 << bits) - 1)).astype(np.int64)
        key >>= _U(bits)
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((minor, major))
        new = (major[order][1:] != major[order][:-1]) | (minor[order][1:] != minor[order][:-1])
    return order, np.flatnonzero(np.concatenate(([True], new)))


def levels_of(part: Part, order: int) -> Iterator[Level]:
    """Levels 1 (single words after the empty history) to order, one after another."""
    size = len(part.ids)
    lead = part.place == 0
    own = np.where(lead, -1, part.ids)
    n = np.bincount(part.ids[~lead & part.learned], minlength=len(part.words))
    end = np.zeros(len(part.words), dtype=np.int64)
    end[part.ids] = np.arange(size)
    zeros = np.zeros(len(part.words), dtype=np.int64)
    level = Level(own, part.words, part.words, n, zeros, zeros, np.zeros(1, dtype=np.uint64), end)
    yield level
    for k in range(2, order + 1):
        # the history of the first word is the end before the text
        at = np.flatnonzero(part.place >= k - 1)
        history = (part.ids if k == 2 else level.gram)[at - 1]
        by, first = _grouped(history, part.ids[at])
        number = np.empty(len(at), dtype=np.int32)
        number[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.concatenate((first, [len(by)]))))
        gram = np.full(size, -1, dtype=np.int32)
        gram[at] = number
        end = at[by[first]]
        state = history[by[first]].astype(np.int32)
        n = np.bincount(number[part.learned[at]], minlength=len(first))
        word = part.words[part.ids[end]]
        level = Level(gram, longer(level.code[state], word), word, n, state, level.gram[end], level.code, end)
        yield level


@dataclass
class BackoffAutomaton:
    """A weighted automaton over the n-grams of a part: a state for each history of 0 to order - 1 words, an arc for each n-gram, a failure arc for each state.

    The state after reading an n-gram is its longest suffix that is a known
    history. From a state, the word is read along the arc of history and word if
    that n-gram was learned, and else the failure arc leads, at a cost, to the
    history less its first word, and so on to the root, which reads every word.

    Smoothing is Witten-Bell's: a history h with c tokens of t types after it
    reads w at (count(h w) + t P(w)) / (c + t), where P is that of the shorter
    history, and fails at t / (c + t). The root discounts counts absolutely, and
    gives what that saves to unknown words. Probabilities from each state sum to one.
    """

    levels: list[Level]
    #: By level, log10 of the arcs; of the failure arcs of the states, which are histories; and whether a state is known.
    arcs: list[np.ndarray]
    fail: list[np.ndarray]
    known: list[np.ndarray]
    #: By level, the length of the state that an arc leads to.
    target: list[np.ndarray]

    @classmethod
    def build(cls, levels: list[Level], after: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray) -> BackoffAutomaton:
        """levels: with counts of the whole corpus; after: tokens and types after the states of levels 2 and on; root: P of each word."""
        p, arcs, fail, known = root, [np.log10(root)], [np.zeros(1)], [np.ones(1, dtype=bool)]
        for level, (tokens, types) in zip(levels[1:], after, strict=True):
            known.append(tokens > 0)
            t, c = types[level.state], tokens[level.state]
            # from an unknown history all goes on as from the shorter one
            p = np.where(c > 0, (level.n + t * p[level.below]) / np.maximum(c + t, 1), p[level.below])
            with np.errstate(divide="ignore"):
                arcs.append(np.log10(p))
                fail.append(np.where(tokens > 0, np.log10(types / np.maximum(tokens + types, 1)), 0.0))
        target = []
        for k, level in enumerate(levels):
            own = target[-1][level.below] if k else np.zeros(len(level.code), dtype=np.int8)
            target.append(np.where(known[k + 1], np.int8(k + 1), own) if k + 1 < len(levels) else own)
        return cls(levels, arcs, fail, known, target)

    def traverse(self, part: Part, segment: int = SEGMENT) -> np.ndarray:
        """log10 probability of each token, by one walk from left to right that carries the state.

        Walks start at the texts, and in long texts again after each segment
        tokens, from the state that the tokens before lead to; all walks take
        a step at a time together. A state is a history's length and its place
        among the states of that length.
        """
        top = len(self.levels) - 1
        total = np.zeros(len(part.ids))
        pieces = -(-(part.sizes - 1) // segment)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(part.starts + 1, pieces) + nth * segment
        size = np.minimum(segment, np.repeat(part.starts + part.sizes, pieces) - begin)
        by_size = np.argsort(-size, kind="stable")
        begin, size = begin[by_size], size[by_size]
        walking = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")
        depth = self._depth(begin)
        for step, n in enumerate(walking.tolist()):
            at, depth = begin[:n] + step, depth[:n]
            waits, after = np.ones(n, dtype=bool), np.empty(n, dtype=np.int8)
            for k in range(top, 0, -1):
                on = np.flatnonzero(waits & (depth == k))
                level, gram = self.levels[k], self.levels[k].gram[at[on]]
                learned = level.n[gram] > 0
                total[at[on]] += np.where(learned, self.arcs[k][gram], self.fail[k][level.state[gram]])
                read = on[learned]
                waits[read], after[read], depth[on] = False, self.target[k][gram[learned]], k - 1
            on = np.flatnonzero(waits)
            gram = self.levels[0].gram[at[on]]
            total[at[on]] += self.arcs[0][gram]
            after[on] = self.target[0][gram]
            depth = after
        return total

    def _depth(self, at: np.ndarray) -> np.ndarray:
        """The length of the state before the tokens at: the longest known history."""
        depth = np.zeros(len(at), dtype=np.int8)
        for k in range(1, len(self.levels)):
            gram = self.levels[k].gram[at]
            fits = np.flatnonzero(gram >= 0)
            depth[fits[self.known[k][self.levels[k].state[gram[fits]]]]] = k
        return depth


_PART = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("doc_id", "known", "train", "sizes", "words", "ids", "often", "often_n"))])
_OFTEN = pa.schema([("code", pa.int64()), ("n", pa.int64())])
#: What a part asks a group about n-grams of one length: codes of their last words by history, the histories, how many n-grams each has, and how often the part has learned each; and tokens and types after histories that it doesn't ask about.
_ASK = pa.schema([("to", pa.int64()), ("part", pa.int64()), ("k", pa.int64()), *((c, pa.binary()) for c in ("code", "n", "history", "followers", "rest", "rest_n", "rest_types"))])
#: What the group answers, in the order asked: which n-grams other parts have too, as bits, and the counts; and tokens and types after the histories, then after the rest. Rows without a part are sums after wide histories, or counts of words.
_TOLD = pa.schema([("part", pa.int64()), ("to", pa.int64()), ("k", pa.int64()), *((c, pa.binary()) for c in ("also", "n", "after", "types", "state"))])
_WIDE, _WORDS = -1, -2


def _part_of(row: dict) -> Part:
    signed = plain(row["doc_id"]).view(np.int64)
    return Part(signed, plain(row["known"]) > 0, plain(row["train"]) > 0, plain(row["sizes"]).astype(np.int64), plain_steps(row["words"]), plain(row["ids"]).view(np.int32))


def _often(part: Part, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams shorter than order that have WIDE_SHARE of the part's tokens; at most order / WIDE_SHARE of them."""
    least = max(2, WIDE_SHARE * len(part.ids))
    held = np.bincount(part.ids, minlength=len(part.words))
    frequent = held >= least
    found, at, code = [(part.words[frequent], held[frequent])], np.flatnonzero(frequent[part.ids]), part.words[part.ids]
    on = np.zeros(len(part.ids), dtype=bool)
    on[at] = True
    word, codes = code, code.copy()
    for k in range(2, order):
        at = np.flatnonzero(on[:-1] & frequent[part.ids[1:]] & (part.place[1:] >= k - 1)) + 1
        own = longer(codes[at - 1], word[at])
        grams, which, n = np.unique(own, return_inverse=True, return_counts=True)
        found.append((grams[n >= least], n[n >= least]))
        on, codes = np.zeros(len(part.ids), dtype=bool), codes.copy()
        on[at], codes[at] = (n >= least)[which], own
    return np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])


@dataclass
class Question:
    """What of a level a part asks: the n-grams by group, their groups and where a history begins; and histories of which it only tells what follows."""

    grams: np.ndarray
    to: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    rest_to: np.ndarray

    @classmethod
    def of(cls, level: Level, k: int, shared: np.ndarray | None, wide: np.ndarray, groups: int) -> Question:
        """shared: which n-grams of the level below other parts have too. An n-gram that holds one that no other part has is in no other part."""
        send = np.arange(len(level.code)) if shared is None else np.flatnonzero(shared[level.state] & shared[level.below])
        state = level.state[send]
        if k == 1:
            to, rank = group_of(level.code, groups), np.zeros(1, dtype=np.int32)
        else:
            to = group_of(level.states, groups)[state]
            scattered = np.flatnonzero(_among(level.states, wide)[state])
            to[scattered] = group_of(level.code[send[scattered]], groups)
            # histories in the order of their codes
            rank = np.empty(len(level.states), dtype=np.int32)
            rank[np.argsort(level.states, kind="stable")] = np.arange(len(level.states), dtype=np.int32)
        by = _grouped(to, rank[state])[0]
        to, state = to[by].astype(np.int64), state[by]
        head = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (to[1:] != to[:-1])))) if len(to) else np.empty(0, dtype=np.int64)
        rest = np.empty(0, dtype=np.int64)
        if shared is not None:
            rest = level.state[shared[level.state] & ~shared[level.below]]  # sorted
            rest = rest[np.concatenate(([True], rest[1:] != rest[:-1]))] if len(rest) else rest
        rest = rest[np.argsort(level.states[rest], kind="stable")]
        return cls(send[by], to, head, rest, group_of(level.states[rest], groups).astype(np.int64))

    def rows(self, level: Level, k: int, part: int, groups: int, shared: np.ndarray | None) -> pa.RecordBatch:
        state = level.state[self.grams]
        n_rest = types_rest = np.empty(0, dtype=np.uint32)
        if len(self.rest):
            here = np.flatnonzero(shared[level.state] & ~shared[level.below])
            n_rest, types_rest = (small(np.bincount(level.state[here], x, len(level.states))[self.rest].astype(np.int64)) for x in (level.n[here], level.n[here] > 0))
        every, heads, rests = (np.searchsorted(x, np.arange(groups + 1)) for x in (self.to, self.to[self.head], self.rest_to))
        used = np.flatnonzero((np.diff(every) > 0) | (np.diff(rests) > 0))
        columns = [pa.array(used), *(pa.array(np.full(len(used), v), type=pa.int64()) for v in (part, k))]
        followers = small(np.diff(np.concatenate((self.head, [len(self.to)]))))
        none = np.empty(0, dtype=np.uint64), np.zeros(groups + 1, dtype=np.int64)
        if k == 1:
            sent = [(packed_steps, level.code[self.grams], every), (packed, small(level.n[self.grams]), every), (packed, *none), (packed, *none)]
        else:
            sent = [(partial(packed, first=FOLLOWER_BYTES), level.word[self.grams], every), (packed, small(level.n[self.grams]), every)]
            sent += [(packed_steps, level.states[state[self.head]], heads), (packed, followers, heads)]
        sent += [(packed_steps, level.states[self.rest], rests), (packed, n_rest, rests), (packed, types_rest, rests)]
        columns += [pa.array([pack(x[b[g] : b[g + 1]]) for g in used], type=pa.binary()) for pack, x, b in sent]
        return pa.RecordBatch.from_arrays(columns, schema=_ASK)


def _sum_group(wide: np.ndarray):
    def reduce(table: pa.Table) -> pa.Table:
        """Sums over a group's n-grams, and answers to every part in the order in which it asked."""
        rows = table.to_pylist()
        out = []
        for k in sorted({r["k"] for r in rows}):
            mine = [r for r in rows if r["k"] == k]
            code, sizes = _unpacked(mine, "code", plain_steps if k == 1 else plain)
            if k > 1:
                history, heads = _unpacked(mine, "history", plain_steps)
                rest, rests = _unpacked(mine, "rest", plain_steps)
                code = longer(np.repeat(history, counts(mine, "followers")), code)
            by, first = _grouped_codes(code)
            which = np.empty(len(code), dtype=np.int64)
            which[by] = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(by)]))))
            total = np.bincount(which, counts(mine, "n"), len(first)).astype(np.int64)
            several = np.bincount(which, minlength=len(first)) > 1
            sums, also = (np.split(x[which], np.cumsum(sizes)[:-1]) for x in (total, several))
            after, types = [None] * len(mine), [None] * len(mine)
            if k == 1:
                out.append({"part": _WORDS, "k": 1, "n": packed(np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()], dtype=np.uint64))})
            else:
                states, place = np.unique(np.concatenate((history, rest)), return_inverse=True)
                state = np.empty(len(first), dtype=np.int64)
                state[which] = np.repeat(place[: len(history)], counts(mine, "followers"))
                place_rest = place[len(history) :]
                tokens = (np.bincount(state, total, len(states)) + np.bincount(place_rest, counts(mine, "rest_n"), len(states))).astype(np.int64)
                kinds = (np.bincount(state, total > 0, len(states)) + np.bincount(place_rest, counts(mine, "rest_types"), len(states))).astype(np.int64)
                is_wide = _among(states, wide)
                if is_wide.any():
                    out.append({"part": _WIDE, "k": k, "state": packed(states[is_wide]), "after": packed(tokens[is_wide]), "types": packed(kinds[is_wide])})
                asked = zip(np.split(place[: len(history)], np.cumsum(heads)[:-1]), np.split(place_rest, np.cumsum(rests)[:-1]), strict=True)
                answers = [np.concatenate(x) for x in asked]
                after, types = ([packed(small(x[a])) for a in answers] for x in (tokens, kinds))
            out += [{"part": r["part"], "to": r["to"], "k": k, "also": np.packbits(b).tobytes(), "n": packed(small(s)), "after": a, "types": t} for r, b, s, a, t in zip(mine, also, sums, after, types, strict=True)]
        return pa.Table.from_pylist(out, schema=_TOLD)

    return reduce


def _among(codes: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of many codes are among a few sorted ones: a table of their first bits rules most out."""
    out = np.zeros(len(codes), dtype=bool)
    if len(few):
        table = np.zeros(1 << 16, dtype=bool)
        table[few >> _U(48)] = True
        near = np.flatnonzero(table[codes >> _U(48)])
        at = np.minimum(np.searchsorted(few, codes[near]), len(few) - 1)
        out[near] = few[at] == codes[near]
    return out


def _unpacked(rows: list[dict], name: str, unpack: Callable[[bytes | None], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all rows one after another, and how many each row has."""
    own = [unpack(r[name]) for r in rows]
    return np.concatenate([np.empty(0, dtype=np.uint64), *own]), np.array([len(x) for x in own], dtype=np.int64)


def _grouped_codes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(code)
    if not len(by):
        return by, by
    return by, np.flatnonzero(np.concatenate(([True], code[by][1:] != code[by][:-1])))


def _also(level: Level, rows: list[dict], asked: Question) -> np.ndarray:
    """Which n-grams other parts have too."""
    shared = np.zeros(len(level.code), dtype=bool)
    sizes = np.bincount(asked.to)
    bits = [np.unpackbits(np.frombuffer(r["also"], dtype=np.uint8), count=int(sizes[r["to"]])) if r["to"] < len(sizes) else [] for r in sorted(rows, key=lambda r: r["to"])]
    shared[asked.grams] = np.concatenate([np.empty(0, dtype=np.uint8), *bits]) == 1
    return shared


def _answered(level: Level, k: int, rows: list[dict], asked: Question, wide: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray] | None:
    """Puts the corpus's counts in the level; returns tokens and types after the states."""
    rows = sorted(rows, key=lambda r: r["to"])
    if k > 1:
        after = [np.bincount(level.state, x, len(level.states)).astype(np.int64) for x in (level.n, level.n > 0)]
    level.n = level.n.copy()
    level.n[asked.grams] = counts(rows, "n")
    if k == 1:
        return None
    heads = level.state[asked.grams][asked.head]
    # a group answers about histories first and then about the rest
    to = np.concatenate((asked.to[asked.head], asked.rest_to))
    states = np.concatenate((heads, asked.rest))[np.argsort(to, kind="stable")]
    for x, name in zip(after, ("after", "types"), strict=True):
        x[states] = counts(rows, name)
    names, *sums = wide
    hit = np.flatnonzero(_among(level.states, names))
    for x, v in zip(after, sums, strict=True):
        x[hit] = v[np.searchsorted(names, level.states[hit])]
    return tuple(after)


def score_texts(docs: DataFrame, folds: int = 7, held_out_fold: int = 2, part_bytes: int = PART_BYTES, order: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    Tokens are the words of the text lower-cased in A-Z, and one end. The model
    learns from all documents outside the held-out fold (crc32 of the doc_id as
    text, modulo folds): every word, and every n-gram of 2 to order words,
    however rare. score is the automaton's log10 probability of the whole text,
    base_score that of add-one smoothed words.

    1. Texts are dealt into parts of about part_bytes where they lie; a part is
       written as numbers of its words, and the words as 64-bit codes.
    2. Each part sends its distinct words and pairs, and later its longer n-grams,
       to groups by the code of their history, so that a group sees all that
       follows a history. Those of wide histories, which have a large share of all
       tokens (at most 2 * order / WIDE_SHARE of them), are dealt to all groups,
       and their sums are broadcast.
    3. A group sums counts, tokens and types, and answers each part in the order
       in which it asked, so answers are small numbers without codes.
    4. Longer n-grams are only sent if other parts have both n-grams that they
       consist of. The others occur in this part alone, so its own count is the
       corpus's; what they add to a history that others have too is sent as a sum.
    5. Each part builds the automaton of its own n-grams with the weights of the
       whole corpus, and walks its texts.

    No task needs more than a part and its n-grams, or a group. Two words, or
    histories, among n have the same code with a chance of about n * n / 2 ** 65,
    and two of t words after one history with one of t * t / 2 ** 49; counts are
    otherwise exact. Steps hand over tables in the shared folder.

    A null or empty text is an end alone; a text longer than a part is a part;
    rows with one doc_id are scored and counted one by one; a null doc_id counts
    as the empty text in the fold; extra columns are ignored; without training
    documents all scores are 0; an empty table gives no rows.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, sizes, words = _words(table.column("text").combine_chunks())
            doc_id = table.column("doc_id")
            train = np.array([crc_bucket(d, folds) != held_out_fold for d in doc_id.to_pylist()], dtype=np.uint8)
            known = doc_id.is_valid().to_numpy().astype(np.uint8)
            part = Part(doc_id.fill_null(0).to_numpy(), known > 0, train > 0, sizes, words, ids)
            columns = {"doc_id": part.doc_id.view(np.uint64), "known": known, "train": train, "sizes": small(sizes), "ids": ids.view(np.uint32)}
            columns |= zip(("often", "often_n"), _often(part, order), strict=True)
            row = {"part": next(number), "words": packed_steps(words)} | {c: packed(x) for c, x in columns.items()}
            return pa.RecordBatch.from_pylist([row], schema=_PART)

        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at, done = 0, 0
            while at < batch.num_rows:
                upto = min(int(np.searchsorted(ends, done + part_bytes - size)) + 1, batch.num_rows)
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1]) - done
                at, done = upto, int(ends[upto - 1])
                if size >= part_bytes:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    body = sources(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    parts = written(body.mapInArrow(deal, spark_schema(_PART)), "lm-parts")

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Under code 0, how many tokens parts have."""
        for r in _rows(batches):
            code, n = plain(r["often"]).view(np.int64), plain(r["often_n"]).view(np.int64)
            tokens = plain(r["sizes"]).astype(np.int64).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([0], code))), pa.array(np.concatenate(([tokens], n)))], schema=_OFTEN)

    often = written(parts.select("sizes", "often", "often_n").mapInArrow(frequent, spark_schema(_OFTEN)).groupBy("code").agg(F.sum("n").alias("n")), "lm-often")
    tokens = next((r[0] for r in often.where("code = 0").select("n").collect()), 0)
    # the sums miss parts where a history has less than its share, so half of it is asked for; at most 2 * order / WIDE_SHARE rows
    wide = np.sort(np.array([r[0] for r in often.where(f"code <> 0 and n >= {WIDE_SHARE / 2 * tokens!r}").select("code").collect()], dtype=np.int64).view(np.uint64))
    discard(often)
    parts = parts.drop("often", "often_n")
    wide_of = spark.sparkContext.broadcast(wide)
    groups = max(scale_partitions(spark), int(tokens // group_rows) + 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            for k, level in enumerate(levels_of(_part_of(row), 2), 1):
                yield Question.of(level, k, None, wide_of.value, groups).rows(level, k, row["part"], groups, None)

    def longer_ones(k: int):
        def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
            row = texts.to_pylist()[0]
            part = _part_of(row)
            level = None
            for j, level in enumerate(levels_of(part, k), 1):
                if j == k:
                    break
                if j == 1:
                    shared = None
                    continue
                shared = _also(level, [r for r in answers.to_pylist() if r["k"] == j], Question.of(level, j, shared, wide_of.value, groups))
            return pa.Table.from_batches([Question.of(level, k, shared, wide_of.value, groups).rows(level, k, row["part"], groups, shared)])

        return send

    def answered(asked: DataFrame, k: int) -> DataFrame:
        return written(asked.groupBy("to").applyInArrow(_sum_group(wide), spark_schema(_TOLD)), f"lm-told-{k}")

    told = answered(parts.mapInArrow(first, spark_schema(_ASK)), 2)
    for k in range(3, order + 1):
        about = told.where(f"part >= 0 and k between 2 and {k - 1}").select("part", "to", "k", "also")
        more = answered(parts.groupBy("part").cogroup(about.groupBy("part")).applyInArrow(longer_ones(k), spark_schema(_ASK)), k)
        told = told.unionByName(more)

    # a row for each group
    stats = [plain(bytes(r[0])) for r in told.where(f"part = {_WORDS}").select("n").collect()]
    total, types, once, twice = (int(x) for x in np.sum(stats, axis=0)) if stats else (0, 0, 0, 0)
    discount = once / (once + 2 * twice) if once else 0.5
    sums: defaultdict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    # a row for each group and length, with the wide histories that it saw
    for r in told.where(f"part = {_WIDE}").select("k", "state", "after", "types").toLocalIterator():
        for s, a, t in zip(*(plain(bytes(x)).tolist() for x in r[1:]), strict=True):
            sums[r[0], s][0] += a
            sums[r[0], s][1] += t
    after_wide = {}
    for k in range(2, order + 1):
        own = sorted((s, *v) for (j, s), v in sums.items() if j == k)
        after_wide[k] = tuple(np.array(c, dtype=t) for c, t in zip(zip(*own, strict=True), (np.uint64, np.int64, np.int64), strict=True)) if own else (np.empty(0, dtype=np.uint64), *[np.empty(0, dtype=np.int64)] * 2)
    model = spark.sparkContext.broadcast(after_wide)

    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = _part_of(texts.to_pylist()[0])
        said = defaultdict(list)
        for r in answers.to_pylist():
            said[r["k"]].append(r)
        levels, after, shared = [], [], None
        for k, level in enumerate(levels_of(part, order), 1):
            question = Question.of(level, k, shared if k > 2 else None, wide_of.value, groups)
            shared = _also(level, said[k], question) if 1 < k < order else None
            after.append(_answered(level, k, said[k], question, model.value.get(k, ())))
            levels.append(level)
        c = levels[0].n.astype(float)
        root = np.where(c > 0, (c - discount) / max(total, 1), discount * types / total if total else 1.0)
        each = BackoffAutomaton.build(levels, after[1:], root).traverse(part)
        real = part.place > 0
        base = np.where(real, np.log10((c + 1) / (total + types + 1))[part.ids], 0.0)
        n_tokens, n_known, bases, scores = (np.add.reduceat(x, part.starts) for x in (real.astype(np.int64), (real & (c > 0)[part.ids]).astype(np.int64), base, each))
        columns = (pa.array(part.doc_id, mask=~part.known), ~part.train, n_tokens, n_known, np.full(len(n_tokens), total), bases, scores)
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return parts.groupBy("part").cogroup(told.where("part >= 0").select("part", "to", "k", "also", "n", "after", "types").groupBy("part")).applyInArrow(score, spark_schema(out))


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the tokens of the texts, each text led by an end; tokens of each, with that end; and the sorted codes of the words, whose places the numbers are."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    values = split.flatten()
    full = pc.greater(pc.binary_length(values), 0)
    upto = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    sizes = np.diff(upto[offsets])
    coded = values.filter(full).dictionary_encode()
    offsets, data = (np.frombuffer(b, dtype=t) for b, t in zip(coded.dictionary.buffers()[1:], (np.int32, np.uint8), strict=True)) if len(coded.dictionary) else (np.zeros(1, dtype=np.int32), b"")
    data, bounds = bytes(data), offsets[: len(coded.dictionary) + 1].tolist()
    codes = np.fromiter(map(word_code, [END, *(data[a:b] for a, b in zip(bounds, bounds[1:], strict=False))]), dtype=np.uint64, count=len(coded.dictionary) + 1)
    by = np.argsort(codes, kind="stable")
    rank = np.empty(len(by), dtype=np.int32)
    rank[by] = np.arange(len(by), dtype=np.int32)
    ids = np.full(len(coded) + 2 * len(sizes), rank[0], dtype=np.int32)
    inside = np.ones(len(ids), dtype=bool)
    sizes = sizes + 2
    ends = np.cumsum(sizes)
    inside[ends - sizes] = inside[ends - 1] = False
    ids[inside] = rank[coded.indices.to_numpy() + 1]
    return ids, sizes, codes[by]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]

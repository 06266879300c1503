"""Suffix arrays in numpy: Larsson-Sadakane refinement, common prefixes by direct comparison, merging by binary search."""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number; text must have eight bytes to spare."""
    key = np.zeros(len(at), dtype=np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | text[at + j].astype(np.uint64)
    return key


def suffix_array(text: np.ndarray, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Positions of text sorted by their first depth bytes (bytes past the end count as 0).

    Larsson and Sadakane's refinement: suffixes are sorted by eight bytes, then
    each pass sorts what is still tied by the rank of the suffix h later, which
    doubles the sorted depth; suffixes that are alone in their group are left
    where they are. With starts, only these positions are returned, and the
    last pass sorts no others.
    """
    n = len(text)
    if not n:
        return np.empty(0, dtype=np.int64)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    key = _words(padded, np.arange(n))
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = 0
    index = np.arange(n)
    sorted_key = key[sa]
    first = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank[sa] = np.maximum.accumulate(np.where(first, index, 0)) + 1
    h = min(8, depth)
    wanted = np.ones(n, dtype=bool)
    if starts is not None:
        wanted = np.zeros(n, dtype=bool)
        wanted[starts] = True
    while h < depth:
        step = min(h, depth - h)
        tied = ~(first & np.concatenate((first[1:], [True])))
        at = np.flatnonzero(tied & wanted[sa]) if h + step >= depth else np.flatnonzero(tied)
        if len(at):
            sub = sa[at]
            key = (rank[sub] << 32) | rank[np.minimum(sub + step, n)]
            order = np.argsort(key, kind="stable")
            sub, key = sub[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            sa[at] = sub
            first[at] = new
            # ranks stay comparable: a group's rank is the place of its first member
            rank[sub] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        h += step
    return sa if starts is None else sa[wanted[sa]]


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the length, at most depth, of the prefix it shares with the one before it in sa.

    Each suffix is compared with its predecessor in sa from the first byte, in
    the order of the text, eight bytes at a time; those that differ drop out.
    Kasai's carried length (the last one less 1) would be wrong here: it presumes
    that all suffixes are in full order, and these are sorted to depth alone and
    are not all there. Depth bounds the comparison instead.
    """
    lcp = np.zeros(len(sa), dtype=np.int64)
    if len(sa) < 2:
        return lcp
    padded = np.concatenate((text, np.zeros(depth + 16, dtype=np.uint8)))
    by_text = np.argsort(sa[1:], kind="stable") + 1
    here, before = sa[by_text], sa[by_text - 1]
    live = np.arange(len(by_text))
    length = np.zeros(len(by_text), dtype=np.int64)
    for at in range(0, depth, 8):
        a, b = _words(padded, here[live] + at), _words(padded, before[live] + at)
        diff = a ^ b
        same = diff == 0
        if not same.all():
            apart = diff[~same]
            # the highest differing byte decides
            lead = np.zeros(len(apart), dtype=np.int64)
            for j in range(8):
                lead += (apart >> np.uint64(56 - 8 * j)) == 0
            length[live[~same]] = at + lead
        live = live[same]
        length[live] = at + 8
    lcp[by_text] = np.minimum(length, depth)
    return lcp


def windows_as_keys(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The depth bytes from each position as fixed-width keys that compare byte by byte."""
    table = np.full((len(at), depth + 1), 1, dtype=np.uint8)
    for j in range(depth):
        table[:, j] = text[at + j]
    return table.view(f"S{depth + 1}").ravel()


def merged(keys: np.ndarray, values: np.ndarray, more: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted arrays of distinct keys as one, with the lesser value of keys in both, by binary search."""
    at = np.searchsorted(keys, more)
    known = np.zeros(len(more), dtype=bool)
    inside = at < len(keys)
    known[inside] = keys[at[inside]] == more[inside]
    values = values.copy()
    np.minimum.at(values, at[known], their[known])
    return np.insert(keys, at[~known], more[~known]), np.insert(values, at[~known], their[~known])


def least_by_window(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> list[np.ndarray]:
    """For shards (text, window starts, value of each), the least value of any equal window in any shard.

    Each shard gets a suffix array and common prefixes of its own, which give
    classes of equal windows. With several shards, their sorted classes are
    merged by binary search, and each shard looks up its own again.
    """
    classes = []
    for text, starts, value in shards:
        sa = suffix_array(text, depth, starts)
        new = common_prefixes(text, sa, depth) < depth
        if len(new):
            new[0] = True
        group = np.cumsum(new) - 1
        slot = np.empty(len(text) + 1, dtype=np.int64)
        slot[starts] = np.arange(len(starts))
        member = slot[sa]
        least = np.minimum.reduceat(value[member], np.flatnonzero(new)) if len(sa) else value[:0]
        classes.append((sa[new], group, member, least))
    if len(shards) > 1:
        keys = [windows_as_keys(text, c[0], depth) for (text, _, _), c in zip(shards, classes, strict=True)]
        all_keys, all_least = keys[0], classes[0][3]
        for k in range(1, len(shards)):
            all_keys, all_least = merged(all_keys, all_least, keys[k], classes[k][3])
        classes = [(first, group, member, all_least[np.searchsorted(all_keys, k)]) for (first, group, member, _), k in zip(classes, keys, strict=True)]
    out = []
    for (_, starts, value), (_, group, member, least) in zip(shards, classes, strict=True):
        result = np.empty(len(starts), dtype=value.dtype)
        result[member] = least[group]
        out.append(result)
    return out

"""Plain versions of the operators, one document and one definition at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(text):
    return (text or "").translate(UPPER)


def base_rules(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def contamination(docs, items, window=8):
    """doc -> (n_words, hit positions, items); docs and items are lists of (id, text)."""
    index = defaultdict(set)
    sizes = set()
    for item, text in items:
        w = bench_words(text)
        size = min(window, len(w))
        if item is not None and size:
            sizes.add(size)
            for i in range(len(w) - size + 1):
                index[tuple(w[i : i + size])].add(str(item))
    out = []
    for doc, text in docs:
        w = bench_words(text)
        hit, which = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                found = index.get(tuple(w[i : i + size]))
                if found:
                    hit |= set(range(i, i + size))
                    which |= found
        out.append((doc, len(w), hit, sorted(which)))
    return out


def shingles(text, n):
    w = words(fold(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def components(docs, n, percent):
    """[(doc_id, set size, component, links)] for a list of (doc_id, text) with distinct ids or None."""
    sets = [(d, shingles(t, n)) for d, t in docs]
    parent = list(range(len(sets)))
    links = [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)), links[i]) for i, (d, s) in enumerate(sets)]


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :]).group()


def url_verdict(url, rules, default="allow"):
    host, path = url_parts(url)
    best = max(((len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[3], best[4] if best else default


def fold_of(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def language_model(docs, order, folds=7, held=2):
    """(rows, probability(history, word), words, histories) of the Witten-Bell model of all n-grams up to order, none left out."""
    texts = [(d, fold_of(d, folds) == held, ["\n", *words(fold(t)), "\n"]) for d, t in docs]
    uni = Counter(w for _, out, t in texts if not out for w in t[1:])
    total, types = sum(uni.values()), len(uni)
    once, twice = sum(v == 1 for v in uni.values()), sum(v == 2 for v in uni.values())
    discount = once / (once + 2 * twice) if once else 0.5
    follow = defaultdict(Counter)
    for _, out, t in texts:
        for k in range(1, order):
            for i in range(k, len(t)):
                if not out:
                    follow[tuple(t[i - k : i])][t[i]] += 1

    def p(h, w):
        if not h:
            return 1.0 if not total else (uni[w] - discount) / total if w in uni else discount * types / total
        if h not in follow:
            return p(h[1:], w)
        return (follow[h][w] + len(follow[h]) * p(h[1:], w)) / (follow[h].total() + len(follow[h]))

    rows = []
    for d, out, t in texts:
        base = sum(math.log10((uni[w] + 1) / (total + types + 1)) for w in t[1:])
        rows.append((d, out, len(t) - 1, sum(w in uni for w in t[1:]), total, base, sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))))
    return rows, p, uni, list(follow)


def line_dedup(docs, min_chars=20, min_docs=3):
    keys = defaultdict(set)

    def key(line):
        return line.strip(SPACE).translate(UPPER)

    for d, text in docs:
        if d is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    keys[key(line)].add(d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(keys.get(key(x), ())) < min_docs or max(keys[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def repeated_bytes(docs, depth=50):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - depth + 1):
                w = b[i : i + depth]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, b in raw:
        gone = [False] * len(b)
        if d is not None:
            for i in range(len(b) - depth + 1):
                if least[b[i : i + depth]] < d:
                    gone[i : i + depth] = [True] * depth
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()

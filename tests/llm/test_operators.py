"""Each operator against its plain version, on a table with nulls, empty and long texts, ties and clashing columns; and on no rows."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from metricspine.llm import (
    components,
    decontamination,
    jaccard_join,
    line_dedup,
    lm_scoring,
    packing,
    quality_classifier,
    quality_rules,
    repeated_bytes,
    sharding,
    url_filters,
)

from . import brute, messy


@pytest.fixture(scope="module")
def rows():
    return messy.texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return messy.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return messy.frame(spark, [])


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_rules(docs, none, rows):
    df = quality_rules.judge_quality(docs)
    got = found(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((d, *brute.base_rules(t)) for d, t in rows), key=repr)
    for r in df.collect():
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
    assert quality_rules.judge_quality(none).count() == 0


def test_estimation_recovers_accuracies():
    r = np.random.default_rng(0)
    y = r.random(20_000) < 0.8
    votes = np.zeros((len(y), 6), dtype=int)
    for k, (speaks, right) in enumerate([(0.9, 0.9), (0.7, 0.85), (0.8, 0.8), (0.6, 0.95), (0.9, 0.75), (0.5, 0.9)]):
        vote = np.where(r.random(len(y)) < right, y, ~y) * 2 - 1
        votes[:, k] = np.where(r.random(len(y)) < speaks, vote, 0)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, tables = quality_rules.estimate(patterns, counts.astype(float), rounds=60)
    assert abs(prior - 0.8) < 0.05
    assert np.abs(quality_rules.accuracies(tables)[0] - [0.9, 0.85, 0.8, 0.95, 0.75, 0.9]).max() < 0.05
    assert ((quality_rules.posterior(votes, prior, tables) >= 0.5) == y).mean() > 0.93


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_decontamination(spark, docs, none, rows, block_words):
    passage = next(t for d, t in rows if d == -5)
    w = passage.split()
    items = [*messy.ITEMS, (10, passage), (11, " ".join(w[20:31])), (12, " ".join(w[:9]).upper()), (12, "one two"), (None, passage)]
    bench = messy.frame(spark, items, "item_id long, text string")
    df = decontamination.decontaminate(docs, bench, block_words=block_words, carry=("lang", "text"))
    want = brute.contamination(rows, items)
    assert found(df, "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == sorted(((d, n, len(h), len(i), brute.sha(",".join(i))) for d, n, h, i in want), key=repr)
    hits = {d: (n, h) for d, n, h, _ in want}
    for r in df.collect():
        if r.doc_id is None:
            continue
        n, h = hits[r.doc_id]
        assert sorted(p for a, b in r.spans for p in range(a, b)) == sorted(h)
        if h:
            left = [x for k, x in enumerate(brute.bench_words(r.text)) if k not in h]
            assert brute.bench_words(r.clean_text) == left
        else:
            assert r.clean_text is None
        assert r.rejected == (len(h) > 0.5 * n)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_of_one_word_repeated():
    """A long item and a longer text of equal words: time in proportion, and the same findings."""
    import time

    took = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        index = decontamination.ItemIndex([("1", [b"a"] * n)], 8)
        spans, names, longest = index.scan([b"a"] * (4 * n))
        took.append(time.perf_counter() - began)
        assert (spans, names, longest) == ([(0, 4 * n)], {"1"}, n)
    assert took[1] < 30 * took[0] + 1


def test_decontamination_at_random():
    r = random.Random(3)
    for _ in range(200):
        items = [(k, [bytes([97 + r.randrange(3)]) for _ in range(r.randint(0, 12))]) for k in range(r.randint(1, 5))]
        index = decontamination.ItemIndex([(str(k), w) for k, w in items], 4)
        doc = [bytes([97 + r.randrange(4)]) for _ in range(r.randint(0, 40))]
        spans, names, longest = index.scan(doc)
        (_, _, hit, want), = brute.contamination([(0, b" ".join(doc).decode())], [(k, b" ".join(w).decode()) for k, w in items], 4)
        assert {p for a, b in spans for p in range(a, b)} == hit and sorted(names) == want
        subs = {tuple(w[i:j]) for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        known = [len(x) for x in subs if any(tuple(doc[i : i + len(x)]) == x for i in range(len(doc)))]
        assert longest == (max(known, default=0) if index.sizes and max(known, default=0) >= index.sizes[0] else 0)


def test_packing(docs, none, rows):
    df = packing.pack(docs, max_length=64, buckets=4, token_budget=256, piece_rows=9)
    out = df.collect()
    joined = {}
    for r in sorted(out, key=lambda r: r.chunk):
        if r.doc_id is not None:
            joined[r.doc_id] = joined.get(r.doc_id, "") + r.text
    assert joined == {d: t or "" for d, t in rows if d is not None}
    assert sum(r.n_tokens for r in out) == sum(len(brute.words(t)) + 1 for _, t in rows)
    sizes = {}
    for r in out:
        sizes[r.n_tokens] = sizes.get(r.n_tokens, 0) + 1
    bounds = packing.boundaries(sizes, 4)
    assert {r.bucket for r in out} <= set(bounds)
    batches = {}
    for r in out:
        assert r.n_tokens <= r.bucket and r.padding == r.bucket - r.n_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r.place)
    for (bucket, batch), places in batches.items():
        room = max(1, 256 // bucket)
        last = max(b for k, b in batches if k == bucket)
        assert sorted(places) == list(range(len(places)))
        assert len(places) == room if batch < last else 0 < len(places) <= room
    assert packing.pack(none).count() == 0


def test_best_boundaries():
    import itertools

    r = random.Random(1)
    for _ in range(150):
        h = {r.randint(1, 14): r.randint(1, 9) for _ in range(r.randint(1, 7))}
        k = r.randint(1, 4)
        lengths = sorted(h)

        def padding(bounds, h=h):
            return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in h.items())

        best = min(padding(b) for n in range(1, k + 1) for b in itertools.combinations(lengths, min(n, len(lengths))) if b[-1] == lengths[-1])
        got = packing.boundaries(h, k)
        assert len(got) <= k and padding(got) == best


def test_quality_classifier_on_edges(spark, docs, none):
    labels = messy.frame(spark, [(d, 1) for d in range(10, 30)] + [(3, 1), (3, 0), (999, 1), (None, 1), (12, None)], "doc_id long, quality int")
    df = quality_classifier.score_quality(docs, labels)
    out = df.collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (brute.fold_of(r.doc_id, 3) == 1)
    assert {r.score for r in quality_classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(none, labels).count() == 0


def test_quality_classifier_learns_and_ignores_the_held_out_fold(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scores = {r.doc_id: r for r in quality_classifier.score_quality(d, labels).collect()}
    judged = [(scores[r.doc_id], r.quality) for r in labels.collect() if scores[r.doc_id].held_out]
    assert sum(s.predicted == q for s, q in judged) / len(judged) >= 0.95
    good, bad = [s.score for s, q in judged if q == 1], [s.score for s, q in judged if q == 0]
    assert np.mean(np.array(good)[:, None] > np.array(bad)[None]) > 0.98
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    again = {r.doc_id: r.score for r in quality_classifier.score_quality(d, turned).collect()}
    assert max(abs(again[k] - v.score) for k, v in scores.items()) < 1e-6


def test_the_risk_is_minimised(spark):
    """Newton steps over partial sums against plain gradient descent on the same risk."""
    r = np.random.default_rng(3)
    y = r.random(600) < 0.6
    x = r.normal(size=(600, 3)) + np.where(y, 0.8, -0.8)[:, None]
    positive = y & (r.random(600) < 0.5)
    prior = 0.6
    rows = spark.createDataFrame([(list(map(float, a)), bool(p)) for a, p in zip(x, positive, strict=True)], "x array<float>, positive boolean").repartition(3)
    got = quality_classifier._fit(rows, np.zeros(3), np.ones(3), prior, np.zeros(4), 30)
    z = np.column_stack((np.ones(600), np.clip(x.astype(np.float32), -8, 8)))
    ridge = quality_classifier.RIDGE * np.array([0, 1, 1, 1])

    def risk(w):
        g = z @ w
        above = np.logaddexp(0, g)
        negative = above.mean() - prior * above[positive].mean()
        return prior * (above - g)[positive].mean() + max(0.0, negative) + 0.5 * (ridge * w * w).sum()

    w = np.zeros(4)
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(z @ w)))
        w -= 0.5 * ((z * p[:, None]).mean(axis=0) - prior * z[positive].mean(axis=0) + ridge * w)
    assert risk(got) <= risk(w) + 1e-5


def test_jaccard_join(docs, none, rows):
    want = brute.components(rows, 4, 85)
    for block in (64, 2):
        df = jaccard_join.jaccard_components(docs, 4, 85, block=block)
        assert found(df, "doc_id", "n_shingles", "component_id", "n_links") == sorted(want, key=repr)
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_join_of_random_sets(spark):
    """Chains of small edits at many sizes: links at, above and below the threshold."""
    r = random.Random(5)
    rows, at = [], 0
    for size in [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 33, 60, 120]:
        for _ in range(4):
            w = [f"w{r.randrange(10**6)}" for _ in range(size + 3)]
            for _ in range(6):
                rows.append((at, " ".join(w)))
                at += 1
                w = list(w)
                for _ in range(max(1, size // 30)):
                    k = r.randrange(len(w))
                    w[k : k + 1] = r.choice([[], [f"v{r.randrange(10**6)}"], [w[k], "u"]])
    df = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, block=4)
    assert found(df, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute.components(rows, 4, 80), key=repr)


def test_jaccard_join_of_one_family_of_many_sizes(spark):
    """Texts that grow a word at a time link with all whose sizes allow it; cells of like size lose none of them."""
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[: 8 + k])) for k in range(110)] + [(200, " ".join(words[:60])), (201, "nothing like it here at all")]
    for percent in (80, 85, 100):
        df = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent, block=2)
        assert found(df, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute.components(rows, 4, percent), key=repr)


def test_jaccard_signatures():
    """Sets at the threshold have one in common, whatever they leave out; unlike ones have none, however many small segments they have."""
    r = np.random.default_rng(7)
    for low, high, deletion in ((60, 76, 0), (60, 76, 3), (300, 376, 0), (300, 376, 20)):
        h = 2 * high * 20 // 180
        spare = jaccard_join._spare(h + 1, deletion, low * 80 // 100)
        scheme = jaccard_join.Scheme(1, low, high, h + 1 + spare - 2 * deletion, deletion, spare)
        seen = {}
        for k in range(400):
            a = np.unique(r.integers(0, 2**64, low + k % (high - low), dtype=np.uint64))
            swapped = len(a) // 9
            b = np.unique(np.concatenate((a[swapped:], r.integers(0, 2**64, swapped, dtype=np.uint64))))
            assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
            (left, near), (right, close) = jaccard_join.signatures(a, scheme), jaccard_join.signatures(b, scheme)
            assert set(left[~near]) & set(right) or set(left) & set(right[~close])
            assert jaccard_join.may_link(len(a), jaccard_join.sketch(a), len(b), jaccard_join.sketch(b), 80)
            for x in left.tolist():
                assert seen.setdefault(x, k) == k


def test_jaccard_meetings(monkeypatch):
    """Signatures reduced a few at a time: each full one and every other of its group are a pair, or connected by stars."""
    monkeypatch.setattr(jaccard_join, "_HELD", 50)
    monkeypatch.setattr(jaccard_join, "_FULL", 3)
    r = np.random.default_rng(3)
    sig, doc, near = r.integers(0, 60, 600) ** 2 // 60, r.integers(0, 300, 600), r.random(600) < 0.4
    batches = [pa.record_batch([pa.array(x[k : k + 20]) for x in (sig, doc, near)], names=["sig", "doc_id", "near"]) for k in range(0, 600, 20)]
    pairs, root = set(), list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for out in jaccard_join._meet(iter(batches)):
        for a, b, star in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if star:
                root[top(a)] = top(b)
            else:
                pairs.add((a, b))
    assert pairs and any(top(x) != x for x in range(300))
    for i in range(600):
        for j in range(600):
            if sig[i] == sig[j] and doc[i] < doc[j] and not (near[i] and near[j]):
                assert (doc[i], doc[j]) in pairs or top(doc[i]) == top(doc[j])


def test_jaccard_join_of_texts_that_share_half(spark, monkeypatch):
    """Texts that meet in a passage but do not link form no family; tables that nothing reads any more are gone."""
    met = []
    real = jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges: met.append(edges.count()) or real(edges))
    folders = []
    write = jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df, label: folders.append(write(df, label)) or folders[-1])
    words = [f"w{k}" for k in range(6000)]
    rows = [(k, " ".join(words[100 * k : 100 * k + 200])) for k in range(58)] + [(90, " ".join(words[:199]))]
    df = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, block=2)
    assert found(df, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute.components(rows, 5, 80), key=repr)
    assert met[0] == 1
    left = [f._written_at for f in folders if os.path.exists(f._written_at.removeprefix("file:"))]
    assert {os.path.basename(x).rsplit("-", 1)[0] for x in left} == {"jaccard-classes", "jaccard-links"}


def test_jaccard_groups(monkeypatch):
    """Groups are sent as members, no more rows than signatures; each full one and every other of its group share a group or a star."""
    monkeypatch.setattr(jaccard_join, "_HELD", 50)
    monkeypatch.setattr(jaccard_join, "_FULL", 6)
    r = np.random.default_rng(4)
    sig, doc, near = r.integers(0, 90, 900) ** 2 // 90, r.integers(0, 300, 900), r.random(900) < 0.4
    batches = [pa.record_batch([pa.array(x[k : k + 20]) for x in (sig, doc, near)], names=["sig", "doc_id", "near"]) for k in range(0, 900, 20)]
    groups, root, sent = {}, list(range(300)), 0

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for out in jaccard_join._gather(iter(batches)):
        for a, b, close in zip(*(c.to_pylist() for c in out.columns), strict=True):
            if close is None:
                root[top(a)] = top(b)
            else:
                groups.setdefault(b, {})[a] = close
                sent += 1
    assert 0 < sent <= 900 and any(top(x) != x for x in range(300))
    for i in range(900):
        for j in range(900):
            if sig[i] == sig[j] and doc[i] < doc[j] and not (near[i] and near[j]):
                left, right = groups.get(doc[i], {}), groups.get(doc[j], {})
                assert top(doc[i]) == top(doc[j]) or any(not (left[g] and right[g]) for g in left.keys() & right.keys())
    assert [len(b) for b in jaccard_join._gather(iter([]))] == [0]


def test_jaccard_judgement():
    """A forest connects what pairs of groups that may link connect, and a doc_id with several sets links by any of them."""
    r = np.random.default_rng(8)
    base = [np.unique(r.integers(0, 2**64, 120, dtype=np.uint64)) for _ in range(3)]
    sets = [(k, np.unique(np.concatenate((base[k % 3][1 + k % 5 :], r.integers(0, 2**64, k % 4, dtype=np.uint64))))) for k in range(30)]
    sets.append((4, base[0]))
    rows = [(g, k, len(s), jaccard_join.sketch(s)) for g in range(3) for k, s in sets if g or k < 12]
    a, b, n, bits = (list(x) for x in zip(*rows, strict=True))
    batch = pa.record_batch([pa.array(a), pa.array(b), pa.array([False] * len(a)), pa.array(n), pa.array(bits)], names=["a", "b", "near", "n", "sketch"])
    edges = jaccard_join._judge(iter([batch]), 80).tolist()
    assert len(edges) == 28
    # base 1 holds 4, which has a set of base 0 too
    assert all((x % 3 == 2) == (y % 3 == 2) for x, y in edges)


def test_jaccard_join_sends_no_pairs_of_near_copies(spark, monkeypatch):
    """Near copies that meet in many groups send forests: the edges grow with the copies, not with their square."""
    met = []
    real = jaccard_join.connected_components
    monkeypatch.setattr(jaccard_join, "connected_components", lambda edges: met.append(edges.count()) or real(edges))
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[:7 * k] + [f"v{k}"] + words[7 * k + 1 :])) for k in range(30)]
    df = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert found(df, "doc_id", "n_shingles", "component_id", "n_links") == sorted(brute.components(rows, 4, 85), key=repr)
    assert 29 <= met[0] <= 29 * 6 < 30 * 29 // 2


def test_connected_components(spark):
    """A star, a chain, a clique and random edges, with self-edges, repeats and nulls."""
    r = random.Random(3)
    edges = [(k, 500) for k in range(400, 600)] + [(k, k + 1) for k in range(700, 760)] + [(a, b) for a in range(800, 812) for b in range(800, 812)]
    edges += [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(160)] + [(400, 500), (None, 3), (3, None), (9, 9)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(near):
        reach = [] if node in want else [node]
        for x in reach:
            if x not in want:
                want[x] = node
                reach += near[x]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in components.connected_components(df).collect()} == set(want.items())
    assert components.connected_components(df.limit(0)).count() == 0


def test_signatures_never_miss():
    """The pigeonhole claim itself, for both kinds of allocation."""
    r = np.random.default_rng(2)
    for partners, percent in ((0.0, 85), (1e9, 85), (0.0, 70), (1e9, 80)):
        schemes = [jaccard_join.allocate(low, high, k, percent, 1000, partners=partners) for k, (low, high) in enumerate(jaccard_join.bands(600, percent))]
        for _ in range(400):
            n = int(r.integers(1, 330))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = np.setdiff1d(a, r.choice(a, int(r.integers(0, max(1, len(a) // 6) + 1)), replace=False))
            b = np.unique(np.concatenate((b, r.integers(0, 2**63, int(r.integers(0, max(1, len(a) // 6) + 1))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
                continue
            signed = []
            for s in (a, b):
                k = next(i for i, x in enumerate(schemes) if x.low <= len(s) <= x.high)
                parts = [jaccard_join.signatures(s, x) for x in schemes[k : k + 2] if 100 * len(s) >= percent * x.low]
                signed.append(({int(v) for x, near in parts for v in x[~near]}, {int(v) for x, near in parts for v in x[near]}))
            (fa, na), (fb, nb) = signed
            assert fa & fb or fa & nb or na & fb


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("Odd.org", "/a/b", "block"), ("odd.org", "/a/b", "allow"), ("x.y", "", "block")]


def test_url_filters(spark, none):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://com/", "http://a.Example.COM/en/1?x=/es/", "https://www.example.com/en/", "https://m.www.example.com/en/#t", "http://notexample.com/en/", "http://z.net/es", "http://z.net/es/", "http://z.net?/fr/", "ftp://q.net/fr/a/b/c/d/e/f/g", "http://odd.org/a/bc", "http://odd.org/a", "http://x.y?q", "http://k.x.y#f", "a://b://c.com/", "http://x\n.com/\n", "http://" + "a." * 500 + "com/" + "p/" * 3000]
    rows = [(k, u) for k, u in enumerate(urls)] + [(5, urls[5]), (None, urls[6])]
    pages = messy.frame(spark, [(i, u) for i, u in rows], "page_id long, text string").withColumnRenamed("text", "url")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("n.com", None, "block")], "host string, path string, verdict string")
    want = sorted(((i, *brute.url_verdict(u, [(h.lower(), p, v) for h, p, v in RULES])) for i, u in rows), key=repr)
    for limit in (200_000, 0):
        assert found(url_filters.judge_urls(pages, rules, broadcast_rules=limit), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def scored(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("order", "wide", "size"), [(3, 2e-4, 8 << 20), (3, 0.01, 2000), (3, 1.0, 2000), (2, 0.02, 700), (4, 0.005, 3000)])
def test_language_model(docs, rows, monkeypatch, order, wide, size):
    """Every n-gram is learned, wherever it is summed: with all histories wide, few, and none."""
    monkeypatch.setattr(lm_scoring, "WIDE_SHARE", wide)
    want = sorted(((*w[:5], round(w[5], 6), round(w[6], 6)) for w in brute.language_model(rows, order)[0]), key=repr)
    assert scored(lm_scoring.score_texts(docs, part_bytes=size, order=order, group_rows=500)) == want


def test_language_model_on_edges(spark, docs, none, rows):
    _, p, uni, histories = brute.language_model(rows, 3)
    for h in [(), *histories[:10], *histories[-10:]]:
        assert abs(sum(p(h, w) for w in uni) + p(h, None) - 1) < 1e-9
    assert lm_scoring.score_texts(none).count() == 0
    held = next(d for d, _ in rows if d is not None and brute.fold_of(d, 7) == 2)
    assert {(r.train_tokens, r.score) for r in lm_scoring.score_texts(docs.where(f"doc_id = {held}")).collect()} == {(0, 0.0)}
    again = [(3, "a b c a b"), (3, "a b c a b"), (3, "c"), (9, "a b d"), (None, "a b c a b")]
    want = sorted(((*w[:5], round(w[5], 6), round(w[6], 6)) for w in brute.language_model(again, 3)[0]), key=repr)
    assert scored(lm_scoring.score_texts(spark.createDataFrame(again, "doc_id long, text string"))) == want


def test_the_walk_is_the_same_from_any_start():
    """Segments of a long text begin in the state that the tokens before them lead to."""
    r = np.random.default_rng(4)
    sizes = np.array([2, 900, 40, 2, 333])
    ids = np.concatenate([np.concatenate(([0], r.integers(1, 30, n - 2), [0])) for n in sizes])
    part = lm_scoring.Part(np.arange(5), np.ones(5, dtype=bool), np.array([True, True, False, False, True]), sizes, np.sort(r.integers(1, 2**63, 30).astype(np.uint64)), ids.astype(np.int32))
    levels = list(lm_scoring.levels_of(part, 3))
    after = [tuple(np.bincount(x.state, w, len(x.states)).astype(np.int64) for w in (x.n, x.n > 0)) for x in levels[1:]]
    walked = [lm_scoring.BackoffAutomaton.build(levels, after, np.full(len(levels[0].code), 1 / 30)).traverse(part, n) for n in (10_000, 256, 7, 1)]
    for other in walked[1:]:
        assert np.allclose(walked[0], other)


@pytest.mark.parametrize(("bits", "keys"), [(1 << 30, 1_000_000), (1 << 16, 1), (1 << 16, 40)])
def test_line_dedup(docs, none, rows, bits, keys):
    """All repeated lines broadcast, none, and the most frequent."""
    df = line_dedup.dedup_lines(docs, max_filter_bits=bits, max_broadcast_keys=keys, carry=("lang",))
    want = brute.line_dedup(rows)
    assert found(df, "doc_id", "clean_text") == sorted(((d, x if t is not None else None) for (d, _, _, x), (_, t) in zip(want, rows, strict=True)), key=repr)
    assert found(df, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(((d, n, k, brute.sha(t)) for d, n, k, t in want), key=repr)
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line that is long enough to count"
    rows = [(1, line), (1, line), (2, line), (2, f"{line}\n{line}")]
    assert found(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_dropped") == [(1, 0), (1, 0), (2, 0), (2, 0)]
    rows.append((3, line))
    assert found(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_dropped") == [(1, 1), (1, 1), (2, 1), (2, 2), (3, 0)]


def test_sharding(docs, none, rows):
    out = sharding.shard_documents(docs, 7, piece_rows=4).collect()
    assert len(out) == len(rows)
    by_id = {d: t for d, t in rows if d is not None}
    for r in out:
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.law == "key" and r.grown_shard in (r.shard, 7)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(none, 7).count() == 0


def test_jump_hash_moves_only_what_it_must():
    keys = np.arange(40_000)
    before = sharding.jump_hash(keys, 40)
    after = sharding.jump_hash(keys, 41)
    assert set(after[after != before]) == {40}
    assert abs((after != before).mean() - 1 / 41) < 0.005
    counts = np.bincount(before, minlength=40)
    assert counts.min() > 850 and counts.max() < 1150
    assert (sharding.jump_hash(keys, 1) == 0).all()


def test_repeated_bytes(docs, none, rows):
    want = brute.repeated_bytes(rows)
    for size in (4 << 20, 600):
        df = repeated_bytes.remove_repeats(docs, 50, shard_bytes=size)
        assert found(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((d, n, k, s, brute.sha(b)) for d, n, k, s, b in want), key=repr)
    assert repeated_bytes.remove_repeats(none).count() == 0


def test_repeated_bytes_of_one_document(spark):
    """Rows with one doc_id are one document, whatever their texts."""
    text = "".join(chr(97 + (7 * i * i + i) % 26) for i in range(140))
    rows = [(1, text), (1, "xx" + text), (2, text[:80]), (2, text)]
    got = found(repeated_bytes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got == [(1, 140, 0, 0), (1, 142, 0, 0), (2, 140, 140, 1), (2, 80, 80, 1)]


def test_repeated_bytes_tells_texts_of_one_number_apart(spark, docs, rows, monkeypatch):
    """Numbers of texts that clash are replaced; the results are those of unlike numbers."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(repeated_bytes, "_ident", lambda salt: F.xxhash64(F.lit(salt), "text") % (3 if salt == 0 else 40 if salt == 1 else 2**62))
    df = repeated_bytes.remove_repeats(docs, 50)
    assert found(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((d, n, k, s, brute.sha(b)) for d, n, k, s, b in brute.repeated_bytes(rows)), key=repr)


def test_suffix_arrays_at_random():
    from metricspine.llm import suffix_array as sa

    r = np.random.default_rng(1)
    for _ in range(60):
        n, d = int(r.integers(1, 300)), int(r.integers(1, 60))
        text = r.integers(97, 97 + int(r.integers(1, 4)), n).astype(np.uint8)
        padded = text.tobytes() + bytes(100)
        order = sa.suffix_array(text, d)
        keys = [padded[i : i + d] for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
        lcp = sa.common_prefixes(text, order, d)
        for i in range(1, n):
            same = next((k for k in range(d) if keys[i][k] != keys[i - 1][k]), d)
            assert lcp[i] == same


LONG = [("word " * 300_000)[:-1], "x" * 1_200_000, "a line of its own\n" * 60_000]


def test_repeated_rows_and_very_long_texts(spark):
    """Rows with one doc_id, alike and unlike, and texts of more than a megabyte: one word repeated, one line, one line repeated."""
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(1, near), (1, near), (2, near), (2, near + " more"), (3, near + " more"), (3, "else"), *[(10 + k, t) for k, t in enumerate(LONG)], (20, LONG[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(quality_rules.judge_quality(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((d, *brute.base_rules(t)) for d, t in rows), key=repr)
    items = [(1, "word " * 9), (2, near)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = found(decontamination.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items")
    assert got == sorted(((d, n, len(h), len(i)) for d, n, h, i in brute.contamination(rows, items)), key=repr)
    assert sum(r.n_tokens for r in packing.pack(docs, keep_text=False).collect()) == sum(len(brute.words(t)) + 1 for _, t in rows)
    assert quality_classifier.score_quality(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")).count() == len(rows)
    got = {(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.jaccard_components(docs, 4, 85).collect()}
    assert got == {(1, 1, 3), (2, 1, 3), (3, 1, 3), (3, 1, 0), (10, 10, 1), (20, 10, 1), (11, 11, 0), (12, 12, 0)}, got
    want = sorted(brute.language_model(rows, 3)[0], key=lambda w: repr(w[:3]))
    got = sorted(scored(lm_scoring.score_texts(docs)), key=lambda w: repr(w[:3]))
    assert [x[:5] for x in got] == [w[:5] for w in want]
    assert sorted(x[5] for x in got) == pytest.approx(sorted(w[5] for w in want)) and sorted(x[6] for x in got) == pytest.approx(sorted(w[6] for w in want), rel=1e-4)
    got = found(line_dedup.dedup_lines(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == sorted(((d, n, k, brute.sha(t)) for d, n, k, t in brute.line_dedup(rows)), key=repr)
    assert sorted(r.size for r in sharding.shard_documents(docs, 3).collect()) == sorted(len(t) + 16 for _, t in rows)
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeated_bytes.remove_repeats(docs, 50).collect()}
    assert got[20, len(LONG[0])] == len(LONG[0]) and all(got[10 + k, len(t)] == 0 for k, t in enumerate(LONG))

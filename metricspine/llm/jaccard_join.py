"""Exact n-gram Jaccard self-join by universe partition, one-deletion neighbourhoods and block verification.

The scheme follows Deng, Li, Wen and Feng, "An Efficient Partition Based Method
for Exact Set Similarity Joins" (PVLDB 2015), laid out for shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, emitter, rows_of, scale_partitions, sources, spark_schema, text_bytes, written
from .components import connected_components

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = value
        return value


def shingle_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text lower-cased in A-Z.

    Fewer words than n make one shingle of all of them; no words make none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(n, len(h))
    rows = len(h) - width + 1
    total = np.full(rows, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = _mix(total * _U(0x9E3779B97F4A7C15) + h[i : i + rows])
    return np.unique(total)


def sketch(tokens: np.ndarray) -> bytes:
    """The parity of the elements at each of as many bits as the set has elements, rounded up to a power of two (64 at least).

    An element that two sets do not share changes one bit, so the sketches of
    two sets differ in no more bits than the sets in elements.
    """
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_link(m: int, a: bytes, n: int, b: bytes, percent: int) -> bool:
    """Whether sets of m and n elements with the sketches a and b can have a similarity of percent %; false is certain."""
    if 100 * min(m, n) < percent * max(m, n):
        return False
    short, long = sorted((np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)), key=len)
    while len(long) > len(short):
        long = long[: len(long) // 2] ^ long[len(long) // 2 :]
    return (100 + percent) * int(np.bitwise_count(short ^ long).sum()) <= (100 - percent) * (m + n)


@dataclass(frozen=True)
class Scheme:
    """How sets of two neighbouring size bands are cut: exact segments and, after them, segments with one-deletion neighbourhoods."""

    number: int
    low: int
    high: int
    exact: int
    deletion: int
    spare: int

    @property
    def segments(self) -> int:
        return self.exact + self.deletion


def bands(largest: int, percent: int) -> list[tuple[int, int]]:
    """Size bands so that sets of at least percent % similarity lie in one band or in neighbours."""
    out, low = [], 1
    while low <= largest:
        after = 100 * low // percent + 1
        out.append((low, after - 1))
        low = after
    return out


def _spare(bound: int, deletion: int, size: int) -> int:
    """The weight of small segments that a set of size elements may have, two deviations above the mean (see signatures)."""
    spare = 0
    for _ in range(100):
        exact = bound + spare - 2 * deletion
        unit = size / (bound + spare)
        few = exact * np.exp(-unit) * (1 + unit) if exact > 1 else 0.0
        pair = 2 * unit
        near = deletion * np.exp(-pair) * (1 + pair + pair**2 / 2 + pair**3 / 6) if deletion > 1 else 0.0
        need = int(np.ceil(few + 2 * near + 2 * np.sqrt(few + 4 * near)))
        if need <= spare or spare > bound // 3:
            break
        spare += 1
    return spare


def allocate(low: int, high: int, number: int, percent: int, sets: int, shared: float = 0.3, partners: float = 1e-3) -> Scheme:
    """The cheapest split of the distance bound among segments, for sets up to high.

    Sets of similarity percent % differ in at most h elements. An exact segment
    takes one from the bound, a segment with its one-deletion neighbourhood
    takes two, so h + 1 + spare must be taken for some segment to match;
    the spare pays for exact segments of less than two elements (see
    signatures), so that few sets have more of them. The cost is a row for each
    signature, plus the sets that meet by chance: of sets sets, the share
    partners has the share shared of its elements in common.
    """
    h = 2 * high * (100 - percent) // (100 + percent)
    best = None
    for tenths in range(0, 11):
        deletion = (h + 1) * tenths // 20
        spare = _spare(h + 1, deletion, low * percent // 100)
        exact = h + 1 + spare - 2 * deletion
        if exact < 0 or exact + deletion < 1:
            continue
        # a segment with a neighbourhood holds twice the elements
        unit = high / (exact + 2 * deletion)
        rows = exact + deletion * (1 + 2 * unit)
        met = np.exp(-unit * (1 - shared)) * exact + np.exp(-2 * unit * (1 - shared)) * (1 + 2 * unit * (1 - shared)) * deletion
        cost = rows + met * sets * partners
        if best is None or cost < best[0]:
            best = cost, Scheme(number, low, high, exact, deletion, spare)
    return best[1]


def signatures(tokens: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set under a scheme, and which of them are one-deletion neighbours.

    Of two sets of the needed similarity, segments that match (equal, or one
    element apart where neighbourhoods are kept) weigh at least 1 + spare, an
    exact one 1 and one with neighbourhoods 2. Small segments meet many others
    by chance, so a set leaves out exact ones of less than two elements and
    others of less than three, as long as those that are small, or match a
    small one, weigh at most spare. They are taken in one order for all sets:
    empty exact ones, those with neighbourhoods, then exact ones of one element
    by its value. Segments that match have one place in it, so all that two
    sets leave out of their matches was counted by the set that went further,
    and something else matches too.
    """
    weights = scheme.exact + 2 * scheme.deletion
    with np.errstate(over="ignore"):
        scattered = _mix(tokens + _U(scheme.number) * _U(0xD1B54A32D192ED03))
        slot = ((scattered >> _U(32)) * _U(weights)) >> _U(32)
        values = _mix(scattered + _U(0x8CB92BA72F3D8DD7))
    slot = slot.astype(np.int64)
    segment = np.where(slot < scheme.exact, slot, scheme.exact + (slot - scheme.exact) // 2)
    order = np.argsort(segment, kind="stable")
    segment, values = segment[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sums = np.zeros(scheme.segments, dtype=np.uint64)
    with np.errstate(over="ignore"):
        sums[segment[first]] = np.add.reduceat(values, first)
        held = np.bincount(segment, minlength=scheme.segments)
        exact, pair = held[: scheme.exact], held[scheme.exact :]
        kept = np.ones(scheme.segments, dtype=bool)
        label = _mix(np.arange(scheme.segments, dtype=np.uint64) + (_U(scheme.number) << _U(32)) + _U(1))
        full = _mix(sums + label)
        one = np.flatnonzero(exact == 1)
        small = np.concatenate((np.flatnonzero(exact == 0), scheme.exact + np.flatnonzero(pair <= 3), one[np.argsort(full[one])]))
        small = small[np.cumsum(np.where(small < scheme.exact, 1, 2)) <= scheme.spare]
        kept[small[held[small] < np.where(small < scheme.exact, 2, 3)]] = False
        full = full[kept]
        near = (segment >= scheme.exact) & kept[segment]
        fewer = _mix(sums[segment[near]] - values[near] + label[segment[near]])
    return np.concatenate((full, fewer)), np.concatenate((np.zeros(len(full), dtype=bool), np.ones(len(fewer), dtype=bool)))


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Members b of groups a; where near is null, edges of stars.
_GROUPED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_())])
_SIGNED = pa.schema([("sig", pa.int64()), ("doc_id", pa.int64()), ("near", pa.bool_())])
#: Signatures of a scheme that are grouped together. The sets that meet in a unit are sent on as one edge each, so a few large units send less than many small ones.
_UNIT = 250_000
#: Signatures that a task holds at once before it reduces large groups.
_HELD = 3_000_000
#: Groups in which more sets than this hold the signature in full are sent as stars, others as members whose pairs sketches may refuse.
_FULL = 32
#: Members of groups that a task holds with their sketches.
_JUDGED = 500_000


def _rooted(edges: np.ndarray) -> np.ndarray:
    """Edges (root, node) that connect what edges connect, with the smallest node of each component as its root."""
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(edges.shape)
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        np.minimum.at(least, at[:, 0], low)
        np.minimum.at(least, at[:, 1], low)
        least = np.minimum(least, least[least])
        if (least == root).all():
            break
        root = least
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[other]], nodes[other]], axis=1)


def _reduce(sig: np.ndarray, doc: np.ndarray, near: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """What must stay of the signatures, and edges that connect the members of each group with more than _FULL full ones.

    Of such a group one full signature more than _FULL stays, so that it is
    known again; groups that are small so far stay, for more may come.
    """
    order = np.lexsort((doc, near, sig))
    sig, doc, near = sig[order], doc[order], near[order]
    new = np.concatenate(([True], sig[1:] != sig[:-1])) if len(sig) else np.empty(0, dtype=bool)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    large = (np.bincount(group[~near], minlength=len(first)) > _FULL)[group] if len(sig) else new
    centre = doc[first][group] if len(sig) else doc
    edge = large & (centre != doc)
    stay = ~large | (np.arange(len(sig)) - first[group] <= _FULL) if len(sig) else new
    edges = _rooted(np.stack([centre[edge], doc[edge]], axis=1))
    return (sig[stay], doc[stay], near[stay]), edges


def _pairs(sig: np.ndarray, doc: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Distinct pairs that meet in what _reduce lets stay: each full signature of a small group with all others of it."""
    if not len(sig):
        return np.empty((0, 2), dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    rows = np.diff(np.append(first, len(sig)))
    full = np.add.reduceat(~near, first, dtype=np.int64)
    found = []
    for k in range(_FULL):
        chosen = np.flatnonzero((full > k) & (full <= _FULL) & (rows > k + 1))
        others = rows[chosen] - k - 1
        at = np.repeat(first[chosen] + k, others)
        step = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
        a, b = doc[at], doc[at + 1 + step]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b])
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(axis=1)))] if len(pairs) else pairs


def _groups(sig: np.ndarray, doc: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, ...]:
    """Members (group, doc, near) of the small groups of what _reduce lets stay in which a full signature meets another set.

    A group is named by a hash of its members, so that those with the same ones
    are one; groups that share a name by chance only make more candidates.
    """
    order = np.lexsort((near, doc, sig))
    sig, doc, near = sig[order], doc[order], near[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]))) if len(sig) else np.empty(0, dtype=bool)
    sig, doc, near = sig[new], doc[new], near[new]
    if not len(sig):
        return sig, doc, near
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    rows = np.diff(np.append(first, len(sig)))
    full = np.add.reduceat(~near, first, dtype=np.int64)
    with np.errstate(over="ignore"):
        name = _mix(np.add.reduceat(_mix(_mix(doc.view(_U)) + near), first)).view(np.int64)
    chosen = np.flatnonzero((rows > 1) & (full > 0) & (full <= _FULL))
    chosen = chosen[np.unique(name[chosen], return_index=True)[1]]
    at = np.repeat(first[chosen] - np.cumsum(rows[chosen]) + rows[chosen], rows[chosen]) + np.arange(rows[chosen].sum())
    return np.repeat(name[chosen], rows[chosen]), doc[at], near[at]


def _reducing(batches: Iterator[pa.RecordBatch], star) -> Iterator[pa.RecordBatch]:
    """Yields star(edges) for the large groups of signatures, and returns the rest."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    kept = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool))

    def reduced():
        nonlocal kept, held, count
        kept, edges = _reduce(*(np.concatenate(x) for x in zip(kept, *held, strict=True)))
        held, count = [], 0
        return star(edges)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
        count += batch.num_rows
        if count >= _HELD + len(kept[0]):
            yield reduced()
    if held:
        yield reduced()
    return kept


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures as distinct pairs, and stars for large groups."""

    def batch_of(edges: np.ndarray, star: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.array(np.full(len(edges), star))], schema=_MET)

    kept = yield from _reducing(batches, lambda edges: batch_of(edges, True))
    yield batch_of(_pairs(*kept), False)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures as members of small groups, and stars for large groups; never more rows than signatures."""

    def stars(edges: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1]), pa.nulls(len(edges), pa.bool_())], schema=_GROUPED)

    kept = yield from _reducing(batches, stars)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _groups(*kept)], schema=_GROUPED)


def _units(schemes: list[Scheme], sizes: dict[int, int], percent: int) -> tuple[list[int], int]:
    """How many units each scheme's signatures are dealt into, and how many signatures are expected in all; sizes: sets by size."""
    lows = np.array([s.low for s in schemes])
    rows = [0.0] * len(schemes)
    for size, count in sizes.items():
        band = int(np.searchsorted(lows, size, side="right")) - 1
        for s in schemes[band : band + 2]:
            if 100 * size >= percent * s.low:
                rows[s.number] += count * (s.segments + 2 * s.deletion * size / (s.exact + 2 * s.deletion))
    return [int(r // _UNIT) + 1 for r in rows], int(sum(rows))


def _candidates(rows: DataFrame, read, schemes: list[Scheme], percent: int, sizes: dict[int, int]) -> DataFrame:
    """Distinct candidates (a, b, near) among the sets that read yields from the batches of rows.

    Two sets that must be compared are members b of one group a, not both near,
    or both connected with one centre by edges (a, b) with near null.

    A signature's upper 24 bits name its unit, the lower 40 tell it apart there;
    two that agree by chance make a candidate that verification refuses.
    """
    lows = np.array([s.low for s in schemes])
    units, expected = _units(schemes, sizes, percent)
    base = np.concatenate(([0], np.cumsum(units))).astype(np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for doc_id, tokens in read(batches):
            if not len(tokens):
                continue
            band = int(np.searchsorted(lows, len(tokens), side="right")) - 1
            for scheme in schemes[band : band + 2]:
                if 100 * len(tokens) >= percent * scheme.low:
                    sig, near = signatures(tokens, scheme)
                    unit = base[scheme.number] + sig % _U(units[scheme.number])
                    sig = (unit << _U(40)) | (sig >> _U(24))
                    out.append((sig.view(np.int64), np.full(len(sig), doc_id, dtype=np.int64), near))
                    size += len(sig)
            if size >= 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_SIGNED)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_SIGNED)

    spark = rows.sparkSession
    parts = max(scale_partitions(spark), expected // _HELD + 1)
    signed = rows.mapInArrow(sign, spark_schema(_SIGNED))
    return signed.repartition(parts, F.shiftrightunsigned("sig", 40)).mapInArrow(_gather, spark_schema(_GROUPED)).distinct()


def _judge(batches: Iterator[pa.RecordBatch], percent: int) -> np.ndarray:
    """Edges that connect the sets that meet in groups (a, b, near, n, sketch) and may link.

    A pair that is connected already need not be judged, and a forest is sent,
    so a group of g sets gives fewer than g edges.
    """
    sketches: dict[int, set[tuple[int, bytes]]] = {}
    root: dict[int, int] = {}

    def signed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, n, bits in rows_of(iter([batch]), "b", "n", "sketch"):
                sketches.setdefault(doc_id, set()).add((n, bits))
            yield batch.select(["a", "b", "near"])

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for met in _meet(signed()):
        for a, b, star in zip(*(c.to_pylist() for c in met.columns), strict=True):
            low, high = sorted((top(a), top(b)))
            # a doc_id with several rows has several sets
            if low != high and (star or any(may_link(*x, *y, percent) for x in sketches[a] for y in sketches[b])):
                root[high] = low
    return np.array([(top(x), x) for x in root], dtype=np.int64).reshape(-1, 2)


def _likely(met: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the candidates met (a, b, near; a table) but not for pairs whose sketches (rep, n, sketch) rule a link out."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _judge(batches, percent)
        yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=_PAIRS)

    members = met.where("near is not null")
    parts = max(scale_partitions(met.sparkSession), members.count() // _JUDGED + 1)
    members = members.join(sketches.withColumnRenamed("rep", "b"), "b").select("a", "b", "near", "n", "sketch")
    edges = members.repartition(parts, "a").mapInArrow(judge, spark_schema(_PAIRS))
    return met.where("near is null").select("a", "b").unionByName(edges).distinct()


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block of sets, in slices of shared elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    out = np.zeros((len(sets), len(sets)), dtype=np.int64)
    if len(column):
        column = np.cumsum(np.concatenate(([0], (np.diff(column) != 0).astype(np.int64))))
        for low in range(0, int(column[-1]) + 1, 16_384):
            a, b = np.searchsorted(column, (low, low + 16_384))
            plane = np.zeros((len(sets), int(column[b - 1]) - low + 1), dtype=np.float32)
            plane[owner[a:b], column[a:b] - low] = 1
            out += (plane @ plane.T).astype(np.int64)
    return out


#: Families of so many blocks are compared as they are: a set that is cut again has some thousand signatures, more than a few copies of its elements.
_RECUT = 16
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _verify_block(members: list[tuple], cross: bool, percent: int) -> Iterator[tuple]:
    """(member, a member it is connected with, number of documents linked) for those with links. members: doc_id, block, copies, tokens."""
    sizes = np.array([len(m[3]) for m in members])
    both = _intersections([m[3] for m in members])
    link = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(link, False)
    if cross:
        block = np.array([m[1] for m in members])
        link &= block[:, None] != block[None, :]
    copies, ids = np.array([m[2] for m in members]), np.array([m[0] for m in members])
    counts = (link * copies[None, :] * (ids[:, None] != ids[None, :])).sum(axis=1)
    root = np.arange(len(members))
    while True:
        lower = np.where(link, root[None, :], len(members)).min(axis=1)
        after = np.minimum(root, lower)
        if (after == root).all():
            break
        root = after
    for k in np.flatnonzero(counts).tolist():
        yield members[k][0], members[int(root[k])][0], int(counts[k])


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, block: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links for each row of docs (doc_id, text).

    A document's set holds the distinct word n-grams of its text lower-cased in
    A-Z (all words as one, if fewer). Two documents link if their sets have a
    Jaccard similarity of at least percent %; component_id is the smallest
    doc_id reachable by links, n_links the number of other documents linked.

    1. Each set is digested; equal sets form a class with its smallest doc_id.
    2. Sets are cut by universe partition for their size band and the next,
       the distance bound dealt among segments by cost (see allocate), and the
       signatures are grouped: what meets nobody is finished. Groups are sent
       as their members, never as pairs; parity sketches, which never refuse a
       link, refuse the pairs of a group that meet by chance, and a forest of
       the others is sent. Only groups of very many sets are taken as they are.
    3. Sets that meet form families. Those of more than _RECUT * block sets, for
       which comparing all blocks would send more, are cut again with
       one-deletion neighbourhoods of larger segments, which few sets meet by
       chance, and form smaller families.
    4. Families are compared exactly, in pairs of blocks of about block sets,
       however large they are; blocks of a large family hold sets of like size,
       and meet only those whose sizes allow a link. A pair of blocks sends a
       spanning forest of its links and a count for each member, never all pairs.
    5. Links join classes into components by alternating stars.

    Only ids, digests, sketches and signatures are shuffled, and the texts once
    to pick those that go to step 4; nothing goes to the driver but sizes. Steps
    hand over written tables, which go as soon as nothing reads them.

    Null and empty texts have empty sets and link with nothing; a very long text
    is one set, held by a task whole; similarities of exactly percent % link; rows
    with one doc_id are one document, and where their texts differ n_links is that
    of the row's own text, and counts a document for each of its texts; a null doc_id gets no component and no links;
    extra columns are ignored; an empty table gives no rows.
    """
    body = sources(docs, doc_id=F.col("doc_id").cast("long"), text=text_bytes())
    set_schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def from_text(batches):
        hashes = WordHashes()
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            yield doc_id, shingle_set(text, n, hashes)

    def from_tokens(batches):
        for doc_id, tokens in rows_of(batches, "doc_id", "tokens"):
            yield doc_id, np.frombuffer(tokens, dtype=np.uint64)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitter(set_schema, ((i, len(s), *((xxhash.xxh3_128_digest(s.tobytes()), sketch(s)) if len(s) else (None, None))) for i, s in from_text(batches)), weigh=lambda r: len(r[3] or b""))

    sets = written(body.mapInArrow(digest, spark_schema(set_schema)), "jaccard-sets")
    named = sets.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    owned = written(sets.join(classes, "digest", "left").select("doc_id", "n_shingles", "rep", "copies", F.when(F.col("rep") == F.col("doc_id"), F.col("sketch")).alias("sketch")), "jaccard-classes")
    # a class for each set that a rep stands for
    sketches = owned.where("rep = doc_id").select("rep", F.col("n_shingles").alias("n"), "sketch").distinct()
    largest, count = owned.where("rep = doc_id").agg(F.max("n_shingles"), F.count(F.lit(1))).first()
    sized = bands(largest or 1, percent)
    sized.append((sized[-1][1] + 1, 100 * (sized[-1][1] + 1) // percent))

    def schemes(partners: float, sets: int) -> list[Scheme]:
        return [allocate(low, high, k, percent, sets, partners=partners) for k, (low, high) in enumerate(sized)]

    # at most one row for each size that occurs
    sizes = {r[0]: r[1] for r in owned.where("rep is not null").groupBy("n_shingles").count().collect()}

    reps = owned.where("rep is not null").select("doc_id", "rep").distinct()
    coarse = _candidates(body.where("doc_id is not null"), from_text, schemes(1e-6, count or 0), percent, sizes)
    left = reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    coarse = written(coarse, "jaccard-coarse")
    stars = coarse.where("near is null").join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "near")
    met = written(stars.unionByName(coarse.where("near is not null").join(right, "b").select("a", F.col("rb").alias("b"), "near")).distinct(), "jaccard-met")
    discard(coarse)
    wide = connected_components(_likely(met, sketches, percent)).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    wide = written(wide.join(wide.groupBy("family").agg(F.count(F.lit(1)).alias("size")), "family"), "jaccard-wide")
    discard(met)

    token_schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.binary()), ("digest", pa.binary())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emitter(token_schema, ((i, s.tobytes(), xxhash.xxh3_128_digest(s.tobytes())) for i, s in from_text(batches)), weigh=lambda r: len(r[1]))

    copies = owned.where("rep = doc_id").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    kept = body.join(wide, "doc_id", "left_semi").mapInArrow(keep, spark_schema(token_schema)).where(F.length("tokens") > 0)
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        # a doc_id with several rows, alike or not: one row for each class that it stands for
        kept = kept.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"]).distinct()
    kept = written(kept.drop("digest"), "jaccard-rest")
    discard(sets)
    large = kept.join(wide.where(F.col("size") > _RECUT * block), "doc_id", "left_semi")
    sizes = {r[0]: r[1] for r in large.groupBy((F.length("tokens") / 8).cast("int")).count().collect()}
    fine = written(_candidates(large, from_tokens, schemes(1.0, count or 0), percent, sizes), "jaccard-fine")
    families = connected_components(_likely(fine, sketches, percent)).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    families = written(families.unionByName(wide.where(F.col("size") <= _RECUT * block).select("doc_id", "family")), "jaccard-families")
    discard(wide, fine)
    # cells of a family that sizes allow to hold links: a member meets those of its own band and of two more on either side
    step = max(np.log(100 / percent) / 2 * (1 + 1e-9), 1e-3)
    sets_held = F.length("tokens") / 8
    total = families.groupBy("family").agg(F.count(F.lit(1)).alias("total"))
    band = F.when(F.col("total") > 5 * block, F.floor(F.log(sets_held) / float(step))).otherwise(0).cast("long")
    placed = kept.select("doc_id", "tokens").join(families.join(total, "family"), "doc_id").select("family", band.alias("band"))
    cells = placed.groupBy("family", "band").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    shapes = cells.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("shape")).join(total, "family")
    members = kept.join(families.join(shapes, "family"), "doc_id").join(copies, "doc_id").withColumn("band", band)
    members = members.withColumn("block", F.shiftleft("band", 32) + F.pmod(F.xxhash64("doc_id"), F.element_at("shape", F.col("band"))))
    beside = F.filter(F.sequence(F.col("band") - 2, F.col("band") + 2), lambda x: F.map_contains_key("shape", x))
    others = F.flatten(F.transform(beside, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), F.element_at("shape", x) - 1), lambda y: F.shiftleft(x, 32) + y)))
    dealt = members.withColumn("other", F.explode(others))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "block", "copies", "tokens")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, group = None, []
            for family, i, j, doc_id, block, copies, tokens in rows_of(batches, "family", "i", "j", "doc_id", "block", "copies", "tokens"):
                if (family, i, j) != at:
                    if len(group) > 1:
                        yield from _verify_block(group, at[1] != at[2], percent)
                    at, group = (family, i, j), []
                group.append((doc_id, block, copies, np.frombuffer(tokens, dtype=np.uint64)))
            if len(group) > 1:
                yield from _verify_block(group, at[1] != at[2], percent)

        yield from emitter(_LINKS, rows())

    parts = scale_partitions(docs.sparkSession)
    links = dealt.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(verify, spark_schema(_LINKS))
    links = written(links, "jaccard-links")
    discard(kept, families)
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("_reps")).where(F.size("_reps") > 1).select("a", F.explode("_reps").alias("b"))
    labels = connected_components(links.select("a", "b").unionByName(several)).withColumnRenamed("node", "rep")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_n"))
    found = owned.join(labels, "rep", "left").join(counts, "rep", "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNull() | F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
    )

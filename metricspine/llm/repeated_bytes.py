"""Removal of long byte strings that repeat across documents, by suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, emitter, rows_of, scale_partitions, sources, spark_schema, text_bytes, written
from .jaccard_join import _mix
from .suffix_array import least_by_window

DEPTH = 50
#: Bytes of text under one suffix array; what needs more is spread over several, which are merged.
SHARD_BYTES = 4 << 20
_SIG_ROWS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Anchors:
    """For each window of depth bytes, the least hash of the strings of gram bytes inside it.

    Equal windows have equal anchors, wherever they stand, and neighbouring
    windows mostly share theirs: two changes in depth - gram + 2 bytes.
    """

    def __init__(self, depth: int):
        self.depth, self.gram = depth, max(1, 2 * depth // 5)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, text: np.ndarray) -> np.ndarray:
        n = len(text)
        if n < self.depth:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            if len(self.up) <= n:
                size = max(n + 1, 2 * len(self.up), 1 << 16)
                self.up = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, _BASE))))
                self.down = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(size, _INVERSE))))
            total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.down[:n], dtype=np.uint64)))
            low = _mix((total[self.gram :] - total[: -self.gram]) * self.up[: n - self.gram + 1])
        width, have = self.depth - self.gram + 1, 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        return low


def _runs(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal anchors, and the places after them."""
    starts = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return starts, np.concatenate((starts[1:], [len(anchor)]))


_SIGS = pa.schema([("sig", pa.int64()), ("ident", pa.int64())])
_SIGNED = pa.schema([*_SIGS, ("kind", pa.int8())])
#: Kinds of signed rows: an anchor of one text, as far as the block shows; an anchor that the block has found in several; and one of these several texts.
_ALONE, _MARK, _FOUND = 0, 1, 2
_BLOCK = 1_000_000


def _signed_block(sig: np.ndarray, ident: np.ndarray) -> pa.RecordBatch:
    """An anchor that several texts of a block share is sent once to be told to other blocks; its texts know already."""
    order = np.lexsort((ident, sig))
    sig, ident = sig[order], ident[order]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])))
    sig, ident = sig[new], ident[new]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    sizes = np.diff(np.concatenate((first, [len(sig)])))
    found = np.repeat(sizes > 1, sizes)
    mark = first[sizes > 1]
    kind = np.concatenate((np.where(found, _FOUND, _ALONE), np.full(len(mark), _MARK))).astype(np.int8)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((sig, sig[mark]))), pa.array(np.concatenate((ident, ident[mark]))), pa.array(kind)], schema=_SIGNED)


def _shared_anchors(body: DataFrame, depth: int, expected: int) -> DataFrame:
    """(ident, sigs): the anchors of each text that another text has as well."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(depth)
        sigs, idents, size = [], [], 0
        for ident, text in rows_of(batches, "ident", "text"):
            a = anchors.of(np.frombuffer(text, dtype=np.uint8))
            if len(a):
                own = np.unique(a[_runs(a)[0]])
                sigs.append(own.view(np.int64))
                idents.append(np.full(len(own), ident, dtype=np.int64))
                size += len(own)
            if size >= _BLOCK:
                yield _signed_block(np.concatenate(sigs), np.concatenate(idents))
                sigs, idents, size = [], [], 0
        if sigs:
            yield _signed_block(np.concatenate(sigs), np.concatenate(idents))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams: of each anchor its first text stays, until another comes; after that every text is sent on."""
        held_sig = held_ident = np.empty(0, dtype=np.int64)
        held_sent = np.empty(0, dtype=bool)
        waiting: list[pa.RecordBatch] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held_sig, held_ident, held_sent, waiting, count
            sig = np.concatenate((held_sig, *(b.column(0).to_numpy() for b in waiting)))
            ident = np.concatenate((held_ident, *(b.column(1).to_numpy() for b in waiting)))
            # a mark says that there are several, and needs no answer
            sent = np.concatenate((held_sent, *(b.column(2).to_numpy() == _MARK for b in waiting)))
            waiting, count = [], 0
            order = np.lexsort((~sent, sig))
            sig, ident, sent = sig[order], ident[order], sent[order]
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            several = sent[first] | np.logical_or.reduceat(ident != ident[first][group], first)
            out = several[group] & ~sent
            held_sig, held_ident, held_sent = sig[first], ident[first], several
            return pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(ident[out])], schema=_SIGS)

        for batch in batches:
            found = batch.column(2).to_numpy() == _FOUND
            if found.any():
                told = batch.filter(pa.array(found))
                yield pa.RecordBatch.from_arrays([told.column(0), told.column(1)], schema=_SIGS)
                batch = batch.filter(pa.array(~found))
            waiting.append(batch)
            count += batch.num_rows
            if count >= _SIG_ROWS + len(held_sig):
                yield flush()
        if count:
            yield flush()

    parts = max(scale_partitions(body.sparkSession), expected // _SIG_ROWS + 1)
    # what blocks have found needs no anchor's task, so a frequent anchor sends there a row for each block
    to = F.when(F.col("kind") == _FOUND, F.col("ident")).otherwise(F.col("sig"))
    signed = body.mapInArrow(sign, spark_schema(_SIGNED)).repartition(parts, to)
    return signed.mapInArrow(shared, spark_schema(_SIGS)).groupBy("ident").agg(F.collect_list("sig").alias("sigs"))


_PIECES = pa.schema([("sig", pa.int64()), ("ident", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())])
_SOLVED = pa.schema([("sig", pa.int64()), ("digest", pa.int64()), ("least", pa.int64()), ("inner", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _pieces(depth: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(depth)

        def rows():
            for ident, doc_id, text, sigs in rows_of(batches, "ident", "doc_id", "text", "sigs"):
                a = anchors.of(np.frombuffer(text, dtype=np.uint8))
                if len(a):
                    starts, stops = _runs(a)
                    value = a[starts].view(np.int64)
                    of_run = np.isin(value, np.array(sigs, dtype=np.int64))
                    for sig, s, e in zip(value[of_run].tolist(), starts[of_run].tolist(), stops[of_run].tolist(), strict=True):
                        yield sig, ident, doc_id, s, text[s : e + depth - 1]

        yield from emitter(_PIECES, rows(), size=20_000)

    return cut


def _solve(rows: list[tuple], depth: int, shard_bytes: int) -> Iterator[tuple]:
    """(sig, digest, least, spans) for distinct pieces (sig, digest, piece, least), all those of an anchor among them.

    least is the smallest document that holds the piece. spans are the parts of
    the piece that a smaller document holds in another piece; they matter to that
    smallest document alone, for in all others the whole piece repeats.
    """
    contents = [(r[0], r[2]) for r in rows]
    least = np.array([r[3] for r in rows], dtype=np.int64)
    order = sorted(range(len(contents)), key=lambda k: contents[k][0])
    widths = np.array([len(c[1]) - depth + 1 for c in contents], dtype=np.int64)
    base = np.concatenate(([0], np.cumsum(widths)))
    by_window = np.empty(int(base[-1]), dtype=np.int64)

    def solve(group: list[list[int]]) -> None:
        shards = []
        for part in group:
            text = np.frombuffer(b"".join(contents[k][1] for k in part), dtype=np.uint8)
            ends = np.cumsum([len(contents[k][1]) for k in part])
            w = widths[part]
            starts = np.repeat(ends - w - depth + 1, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            shards.append((text, starts, np.repeat(least[part], w)))
        for part, found in zip(group, least_by_window(shards, depth), strict=True):
            w = widths[part]
            by_window[np.repeat(base[part], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)] = found

    # shards end between anchors; only an anchor with more text than a shard holds is spread over several
    shard, size, at = [], 0, 0
    while at < len(order):
        end, length = at, 0
        while end < len(order) and contents[order[end]][0] == contents[order[at]][0]:
            length += len(contents[order[end]][1])
            end += 1
        if length > shard_bytes:
            several, own, held = [], [], 0
            for k in order[at:end]:
                if own and held + len(contents[k][1]) > shard_bytes:
                    several.append(own)
                    own, held = [], 0
                own.append(k)
                held += len(contents[k][1])
            solve([*several, own])
        else:
            if size + length > shard_bytes and shard:
                solve([shard])
                shard, size = [], 0
            shard += order[at:end]
            size += length
        at = end
    if shard:
        solve([shard])

    gone = np.flatnonzero(by_window < np.repeat(least, widths))
    owner = np.searchsorted(base, gone, side="right") - 1
    offset = gone - base[owner]
    inner: dict[int, list[dict[str, int]]] = {}
    if len(gone):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + depth)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:] - 1, [len(gone) - 1]))
        for k, s, e in zip(owner[first].tolist(), offset[first].tolist(), offset[last].tolist(), strict=True):
            inner.setdefault(k, []).append({"start": s, "stop": e + depth})
    for k, r in enumerate(rows):
        yield r[0], r[1], r[3], inner.get(k, [])


def _repeated_spans(body: DataFrame, homes: DataFrame, depth: int, shard_bytes: int) -> DataFrame:
    spark = body.sparkSession
    texts, total = homes.where(f"n_bytes >= {depth}").agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    per_window = (depth - max(1, 2 * depth // 5) + 2) / 2
    sigs = _shared_anchors(body, depth, int((total or 0) / per_window))
    sigs = written(sigs.join(homes.select("ident", "home"), "ident"), "repeats-anchors")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by anchor; those of some anchors are held at once, about shard_bytes of text or one anchor's."""

        def rows():
            held, size = [], 0
            for row in rows_of(batches, "sig", "digest", "piece", "least"):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield from _solve(held, depth, shard_bytes)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
            if held:
                yield from _solve(held, depth, shard_bytes)

        yield from emitter(_SOLVED, rows(), size=20_000)

    parts = max(scale_partitions(spark), int((total or 0) // (16 << 20)) + 1)
    pieces = _cut(body, sigs, depth)
    distinct = pieces.groupBy("sig", "piece").agg(F.min("doc_id").alias("least")).select("sig", F.xxhash64("piece").alias("digest"), "piece", "least")
    solved = distinct.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(solve, spark_schema(_SOLVED))
    placed = pieces.select("sig", F.xxhash64("piece").alias("digest"), "ident", "doc_id", "start", F.octet_length("piece").alias("n")).join(solved, ["sig", "digest"])
    whole = F.array(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("stop")))
    shifted = F.transform("inner", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["stop"]).alias("stop")))
    found = placed.select("ident", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(shifted).alias("spans")).where(F.size("spans") > 0)
    return written(found.groupBy("ident").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats-spans")


def _cut(body: DataFrame, sigs: DataFrame, depth: int) -> DataFrame:
    """The pieces of the texts that stand for their class, as a table."""
    chosen = body.join(sigs, "ident").where("doc_id = home").select("ident", "doc_id", "text", "sigs")
    return written(chosen.mapInArrow(_pieces(depth), spark_schema(_PIECES)), "repeats-pieces")


def _ident(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "text") if salt else F.xxhash64("text")


def _identified(body: DataFrame) -> tuple[Column, DataFrame]:
    """A number for each text, and (ident, home, n_bytes) of the texts, home being the smallest doc_id.

    Numbers are 64-bit hashes. Texts of unlike digests with one number (about
    n * n / 2 ** 65 among n texts) are numbered by another hash, until none are left.
    """
    ident, salt = _ident(0), 0
    while True:
        homes = body.withColumn("ident", ident).groupBy("ident", F.unhex(F.md5("text")).alias("_digest")).agg(F.min("doc_id").alias("home"), F.max(F.octet_length("text")).cast("long").alias("n_bytes"))
        homes = written(homes.select("ident", "home", "n_bytes"), "repeats-homes")
        clash = [r[0] for r in homes.groupBy("ident").count().where("count > 1").select("ident").collect()]
        if not clash:
            return ident, homes
        discard(homes)
        salt += 1
        ident = F.when(ident.isin(clash), _ident(salt)).otherwise(ident)


def remove_repeats(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept for each row of docs (doc_id, text).

    Texts are judged as UTF-8 bytes. A byte goes if it is covered by a string
    of depth bytes that also starts in a document with a smaller doc_id;
    overlaps count, and strings are judged on the input. spans are the maximal
    removed byte ranges, kept the remaining bytes.

    1. Equal texts form a class; all but its smallest doc_id go as a whole, and
       only that one takes part below.
    2. Each window of depth bytes is named by an anchor, the least hash of the
       short strings in it; equal windows have equal anchors. Texts and anchors
       are shuffled as numbers, and anchors of one text alone end here: their
       windows occur nowhere else.
    3. Windows with a shared anchor are written as the pieces of text around it.
       Equal pieces are reduced to one with its smallest doc_id before they are
       sent to the shard of their anchor, so a passage in a third of all documents
       arrives once. A shard's suffix arrays (Larsson-Sadakane) and common
       prefixes give classes of equal windows and the smallest doc_id of
       each; an anchor with more text than shard_bytes is spread over several
       suffix arrays, which are merged by binary search.
    4. Occurrences join their pieces again, by a join that adaptive execution
       splits, and the spans return to their documents.

    Each step hands over a table in the shared folder; nothing but sizes goes to
    the driver. A null or empty text has no bytes; a very long text is held by one
    task, with eight bytes for each of its own; rows with one doc_id never
    remove from each other; a null doc_id keeps everything and removes nothing;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    whole = sources(docs, doc_id=F.col("doc_id").cast("long"), text=text_bytes())
    body = whole.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    ident, homes = _identified(body)
    body = body.withColumn("ident", ident)
    spans = _repeated_spans(body, homes, depth, shard_bytes)
    judged = homes.select("ident", "home").join(spans, "ident", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, home, spans in rows_of(batches, "doc_id", "text", "home", "spans"):
                text = text or b""
                ranges: list[list[int]] = []
                if home is not None and doc_id is not None and doc_id > home:
                    ranges = [[0, len(text)]]
                elif spans:
                    for s, e in sorted((x["start"], x["stop"]) for x in spans):
                        if ranges and s <= ranges[-1][1]:
                            ranges[-1][1] = max(e, ranges[-1][1])
                        else:
                            ranges.append([s, e])
                kept, at = [], 0
                for s, e in ranges:
                    kept.append(text[at:s])
                    at = e
                left = b"".join([*kept, text[at:]])
                yield doc_id, len(text), len(text) - len(left), len(ranges), ranges, left, hashlib.sha256(left).hexdigest()

        yield from emitter(schema, rows(), weigh=lambda r: len(r[5]))

    # texts that take no part meet nothing, and are dealt out by a number of their own
    part = F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth)
    marked = whole.withColumn("_part", part).withColumn("_at", F.when(part, ident).otherwise(F.monotonically_increasing_id()))
    judged = judged.select(F.col("ident").alias("_at"), F.lit(True).alias("_part"), "home", "spans")
    return marked.join(judged, ["_at", "_part"], "left").select("doc_id", "text", "home", "spans").mapInArrow(remove, spark_schema(schema))

"""Line deduplication: two Bloom filters find suspects, a shuffle of the suspects alone confirms them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, emitter, rows_of, scale_partitions, sources, spark_schema, text_bytes, written

#: A filter has a bit for so many bytes of text, and so many bits at most: 128 MB. Beyond that the filters fill up and more lines are confirmed by the shuffle, at 24 bytes for each; results stay the same.
BYTES_PER_BIT = 8
MAX_FILTER_BITS = 1 << 30
#: Confirmed lines that are broadcast, at 24 bytes for each: all, or else the most frequent. The rest return to their documents by a join.
MAX_BROADCAST_KEYS = 1_000_000
_SLICES = 256
_BLOCK = 500_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and lower-cased in A-Z; None if shorter than min_chars code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _keys(text: bytes | None, min_chars: int) -> set[bytes]:
    return {k for k in (line_key(line, min_chars) for line in (text or b"").split(b"\n")) if k is not None}


def digest(key: bytes) -> bytes:
    """128 bits that stand for a key from here on; their first half is what the filters hash."""
    return xxhash.xxh3_128_digest(key)


class Places:
    """Where hashes lie in a filter of 2 ** bits bits: a slice, by the first bits, and two places in it."""

    def __init__(self, bits: int):
        self.slices = max(1, min(_SLICES, 1 << max(0, bits - 16)))
        self.width = (1 << bits) // self.slices
        self.shift = np.uint64(64 - (self.slices.bit_length() - 1))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.uint64(self.width - 1)
        number = (hashes >> self.shift if self.slices > 1 else np.zeros_like(hashes)).astype(np.int64)
        return number, (hashes & inside).astype(np.int64), ((hashes >> np.uint64(28)) & inside).astype(np.int64)

    def known(self, filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which hashes have both their bits in the filter (packed bits of the slices in order)."""
        number, *places = self.of(hashes)
        hit = np.ones(len(hashes), dtype=bool)
        for place in places:
            at = number * self.width + place
            hit &= (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return hit


def _pack(places: np.ndarray) -> bytes:
    """Sorted distinct numbers as zstd of their differences."""
    found = np.unique(places).astype(np.uint32)
    raw = np.diff(found, prepend=np.uint32(0)).tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.empty(0, dtype=np.int64)
    raw = pa.decompress(packed[4:], decompressed_size=int.from_bytes(packed[:4], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, dtype=np.uint32), dtype=np.int64)


def _twice_seen(docs: DataFrame, places: Places, min_chars: int) -> bytes:
    """Packed bits of the twice-seen filter over all documents.

    A task sends, for each block of lines, the places that the block sets in the
    once-seen filter, and those in the twice-seen filter of lines that two of
    its documents have. A slice's merge streams over blocks: twice gains what the
    block says and what once already had.
    """
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(found: list[int], ids: list[int]) -> Iterator[tuple]:
            h, d = np.array(found, dtype=np.uint64), np.array(ids, dtype=np.int64)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            again = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            number, a, b = places.of(h[first])
            cuts = np.searchsorted(number, np.arange(places.slices + 1))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[k], cuts[k + 1])
                twice = again[part]
                yield k, _pack(np.concatenate((a[part], b[part]))), _pack(np.concatenate((a[part][twice], b[part][twice])))

        found: list[int] = []
        ids: list[int] = []
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            keys = _keys(text, min_chars)
            found += [int.from_bytes(digest(k)[:8], "little") for k in keys]
            ids += [doc_id] * len(keys)
            if len(found) >= _BLOCK:
                yield from emitter(schema, block(found, ids), size=64)
                found, ids = [], []
        if found:
            yield from emitter(schema, block(found, ids), size=64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at, once, twice = None, None, None
            for k, once_in, twice_in in rows_of(batches, "slice", "once", "twice"):
                if k != at:
                    if at is not None:
                        yield at, b"", np.packbits(twice).tobytes()
                    at, once, twice = k, np.zeros(places.width, dtype=bool), np.zeros(places.width, dtype=bool)
                found = _unpack(once_in)
                twice[found] |= once[found]
                twice[_unpack(twice_in)] = True
                once[found] = True
            if at is not None:
                yield at, b"", np.packbits(twice).tobytes()

        yield from emitter(schema, rows(), size=4)

    sent = docs.mapInArrow(fill, spark_schema(schema)).repartition(min(places.slices, scale_partitions(docs.sparkSession)), "slice").sortWithinPartitions("slice")
    merged = sent.mapInArrow(merge, spark_schema(schema))
    size = places.width // 8
    out = bytearray(size * places.slices)
    for row in merged.select("slice", "twice").toLocalIterator():
        out[row[0] * size : (row[0] + 1) * size] = row[1]
    return bytes(out)


class Homes:
    """The largest doc_id that holds a line, for lines that are repeated, found by their digests."""

    def __init__(self, digests: list[bytes], homes: np.ndarray):
        words = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        self.first, self.second, self.home = words[order, 0], words[order, 1], homes[order]
        # digests with the same first half stand together; two of them are rare, more unheard of
        self.most = int(np.unique(self.first, return_counts=True)[1].max(initial=0))

    def of(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the digests (two numbers each) are known, and their homes."""
        known, home = np.zeros(len(digests), dtype=bool), np.zeros(len(digests), dtype=np.int64)
        at = np.searchsorted(self.first, digests[:, 0])
        for _ in range(self.most):
            inside = np.flatnonzero(at < len(self.first))
            hit = inside[(self.first[at[inside]] == digests[inside, 0]) & (self.second[at[inside]] == digests[inside, 1])]
            known[hit], home[hit] = True, self.home[at[hit]]
            at = at + 1
        return known, home


def _slices(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], min_chars: int) -> Iterator[tuple[tuple, list[bytes], list[int], np.ndarray]]:
    """(row, lines, which lines have a key, their digests as two numbers each) for every row; digests are made for many rows at once."""

    def done(held):
        flat = np.frombuffer(b"".join(d for _, _, _, ds in held for d in ds), dtype="<u8").reshape(-1, 2)
        at = 0
        for row, lines, which, ds in held:
            yield row, lines, which, flat[at : at + len(ds)]
            at += len(ds)

    held, weight = [], 0
    for row in rows_of(batches, *names):
        lines = (row[1] or b"").split(b"\n")
        keys = [line_key(x, min_chars) for x in lines]
        which = [k for k, x in enumerate(keys) if x is not None]
        held.append((row, lines, which, [digest(keys[k]) for k in which]))
        weight += len(row[1] or b"")
        if weight > 1 << 20 or len(held) >= 256:
            yield from done(held)
            held, weight = [], 0
    yield from done(held)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text: str = "text", max_filter_bits: int = MAX_FILTER_BITS, max_broadcast_keys: int = MAX_BROADCAST_KEYS, carry: tuple[str, ...] = (), keep_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, the columns in carry and, with keep_text, clean_text: texts without repeated lines.

    A line's key is the line stripped of ASCII white space at both ends and
    lower-cased in A-Z. A key of at least min_chars code points that occurs in
    at least min_docs (2 or more) different documents loses all its lines
    except those in the largest doc_id that holds it.

    1. Two Bloom filters are filled over all documents; the twice-seen one (at
       most max_filter_bits / 8 bytes) is broadcast. A line that it doesn't know
       occurs in one document only and never moves.
    2. The other lines are shuffled as (digest of 128 bits, doc_id), reduced by
       both and then counted exactly, so a line in a third of all documents makes
       no large group.
    3. The repeated lines, each with the doc_id that keeps it, are broadcast, and
       every document is rewritten where it lies; no text is shuffled. If there
       are more than max_broadcast_keys, this holds for the most frequent of
       them; the rest, each of which few documents have, become a list for each
       doc_id, and only documents with another suspected line are joined with it.

    A null or empty text has one empty line and stays null or empty; a very
    long text, or line, is held whole by one task, with its lines; rows with
    one doc_id are one document, each with its own result row; rows with a null
    doc_id keep all lines and count for no key; extra columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    more, fields = carried(docs, carry)
    whole = sources(docs, doc_id=F.col("doc_id").cast("long"), text=text_bytes(text), **more)
    known = whole.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = Places(max(16, min(max_filter_bits.bit_length() - 1, (size // BYTES_PER_BIT).bit_length())))
    filter_ = spark.sparkContext.broadcast(_twice_seen(known, places, min_chars))

    suspect_schema = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64())])

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(filter_.value, dtype=np.uint8)

        def rows():
            for (doc_id, _), _, _, digests in _slices(batches, ("doc_id", "text"), min_chars):
                for d in {x.tobytes() for x in digests[places.known(twice, digests[:, 0])]}:
                    yield d, doc_id

        yield from emitter(suspect_schema, rows(), size=50_000)

    found = written(known.mapInArrow(suspects, spark_schema(suspect_schema)), "line-suspects")
    counted = found.groupBy("digest").agg(F.max("doc_id").alias("home"), F.count_distinct("doc_id").alias("docs"))
    repeated = written(counted.where(F.col("docs") >= min_docs), "line-repeated")
    lines, held = repeated.agg(F.count(F.lit(1)), F.sum("docs")).first()
    # of lines that least documents have, there are at most held / least
    least = min_docs if lines <= max_broadcast_keys else held // max_broadcast_keys + 1
    often = repeated.where(F.col("docs") >= least).select("digest", "home").toArrow()
    homes_of = spark.sparkContext.broadcast(Homes(often.column("digest").to_pylist(), often.column("home").to_numpy()))

    names, rest_at = ("doc_id", "text", *more), slice(2, 2 + len(more))
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), *fields] + ([("clean_text", pa.string())] if keep_text else []))
    open_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), *(pa.field(c, f.type) for c, f in zip(more, fields, strict=True))])

    def rewriter(settled: bool, listed: bool):
        """settled: whether documents that wait for a list are left out; listed: whether rows have a list."""

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            homes, twice = homes_of.value, np.frombuffer(filter_.value, dtype=np.uint8)

            def rows():
                for row, lines, which, digests in _slices(batches, names + ("_drops",) * listed, min_chars):
                    doc_id, text = row[:2]
                    repeats, home = homes.of(digests) if doc_id is not None else (np.zeros(len(which), dtype=bool), None)
                    if settled and doc_id is not None and (places.known(twice, digests[:, 0]) & ~repeats).any():
                        continue
                    gone = {which[k] for k in np.flatnonzero(repeats & (home != doc_id)).tolist()} if doc_id is not None else set()
                    if listed and row[-1]:
                        drops = set(row[-1])
                        gone |= {which[k] for k, d in enumerate(digests) if d.tobytes() in drops}
                    kept = [x for k, x in enumerate(lines) if k not in gone] if gone else lines
                    out = b"\n".join(kept)
                    rest = row[rest_at]
                    yield doc_id, len(lines), len(gone), hashlib.sha256(out).hexdigest(), *rest, *([None if text is None else out.decode("utf-8", "replace")] if keep_text else [])

            yield from emitter(schema, rows(), weigh=lambda r: len(r[-1] or "") if keep_text else 0)

        return rewrite

    def waiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, twice = homes_of.value, np.frombuffer(filter_.value, dtype=np.uint8)

        def rows():
            for row, _, _, digests in _slices(batches, names, min_chars):
                if row[0] is not None and (places.known(twice, digests[:, 0]) & ~homes.of(digests)[0]).any():
                    yield row

        yield from emitter(open_schema, rows(), weigh=lambda r: len(r[1] or b""))

    if least == min_docs:
        return whole.mapInArrow(rewriter(False, False), spark_schema(schema))
    rare = repeated.where(F.col("docs") < least)
    drops = found.join(rare, "digest").where(F.col("doc_id") != F.col("home")).groupBy("doc_id").agg(F.collect_set("digest").alias("_drops"))
    opened = whole.mapInArrow(waiting, spark_schema(open_schema)).join(drops, "doc_id", "left")
    return whole.mapInArrow(rewriter(True, False), spark_schema(schema)).unionByName(opened.mapInArrow(rewriter(False, True), spark_schema(schema)))

"""Packing into length buckets whose boundaries dynamic programming places for the least padding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emitter, rows_of, sources, spark_schema, text_bytes, written

MAX_LENGTH = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
#: A bucket's rows are dealt into pieces of about so many, if buckets were of one size; each piece is numbered by itself.
PIECE_ROWS = 20_000

_GAP = re.compile(rb"[^\x20\x09-\x0D]+")


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most buckets upper bounds for the lengths of histogram (length: count) with the least padding.

    best[j] is the least padding of the lengths up to j with one more bucket,
    by the recurrence over where the bucket before it ends. Among equal
    splits the one whose earlier buckets end lowest is taken.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    if not len(lengths):
        return []
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    n = len(lengths)
    best = lengths * rows[1:] - tokens[1:]
    came = [np.full(n, -1)]
    for _ in range(1, min(buckets, n)):
        after, frm = best.copy(), np.full(n, -2)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], frm[j] = cost[i], i
        best = after
        came.append(frm)
    out, j = [], n - 1
    for frm in reversed(came):
        if frm[j] == -2:
            continue
        out.append(int(lengths[j]))
        j = int(frm[j])
    return out[::-1]


def chunks_of(text: bytes, max_length: int) -> list[tuple[int, bytes]]:
    """(tokens, bytes) of the parts of a text; a token is a word, and the end is one more. Joined, the parts are the text."""
    n = len(text.split()) + 1
    if n <= max_length:
        return [(n, text)]
    starts = [m.start() for m in _GAP.finditer(text)]
    cuts = [0, *starts[max_length::max_length], len(text)]
    if (n - 1) % max_length == 0:
        cuts.insert(-1, len(text))
    sizes = [max_length] * ((n - 1) // max_length) + [(n - 1) % max_length + 1]
    return [(size, text[a:b]) for size, a, b in zip(sizes, cuts, cuts[1:], strict=False)]


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, keep_text: bool = True, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per chunk: doc_id, chunk, n_tokens, bucket, batch, place, padding and, with keep_text, text.

    A text has a token for each word and one for its end; longer texts are cut
    into chunks of max_length tokens, so every token is in exactly one chunk.
    The histogram of chunk lengths (at most max_length rows, over all chunks)
    goes to the driver, where dynamic programming chooses the bucket bounds. A
    batch holds token_budget // bucket chunks (one at least) of a bucket, each
    padded to the bucket's bound; only a bucket's last batch may be smaller.

    Chunks are numbered without a gap and without sorting a bucket in one
    task: a bucket is dealt into pieces by a hash of the doc_id, as many as the
    number of chunks asks for, chunks are numbered within a piece, and pieces
    follow one another by their counts.

    A null or empty text is one chunk of one token; a null doc_id counts as 0;
    rows with one doc_id are packed one by one; extra columns are ignored; an
    empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_tokens", pa.int64())] + ([("text", pa.string())] if keep_text else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                for k, (n, part) in enumerate(chunks_of(text or b"", max_length)):
                    yield (doc_id, k, n, part.decode("utf-8", "replace")) if keep_text else (doc_id, k, n)

        yield from emitter(schema, rows(), weigh=lambda r: len(r[3]) if keep_text else 0)

    body = sources(docs, doc_id=F.col("doc_id").cast("long"), text=text_bytes())
    chunks = written(body.mapInArrow(cut, spark_schema(schema)), "packing-chunks")
    histogram = {r[0]: r[1] for r in chunks.groupBy("n_tokens").count().collect()}
    bounds = boundaries(histogram, buckets)
    pieces = 1 + sum(histogram.values()) // (buckets * piece_rows)
    bucket = F.lit(None).cast("long")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound).cast("long")).otherwise(bucket)
    mixed = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(1 << 31).cast("long")) * F.lit(2654435761)
    chunks = chunks.withColumn("bucket", bucket).withColumn("_piece", F.pmod(F.shiftright(mixed, 16), F.lit(pieces).cast("long")))
    counts = chunks.groupBy("bucket", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("bucket", "_piece", (F.sum("_n").over(Window.partitionBy("bucket").orderBy("_piece")) - F.col("_n")).alias("_start"))
    numbered = chunks.withColumn("_nth", F.row_number().over(Window.partitionBy("bucket", "_piece").orderBy("doc_id", "chunk", "n_tokens")))
    rank = F.col("_start") + F.col("_nth") - 1
    placed = numbered.join(starts, ["bucket", "_piece"]).withColumn("_rank", rank).withColumn("_room", F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket"))).cast("long"))
    return placed.select(
        "doc_id", "chunk", "n_tokens", "bucket", F.floor(F.col("_rank") / F.col("_room")).cast("long").alias("batch"), F.pmod("_rank", "_room").cast("long").alias("place"), (F.col("bucket") - F.col("n_tokens")).alias("padding"), *(["text"] if keep_text else [])
    )

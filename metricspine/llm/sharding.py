"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. One more shard takes 1/(shards+1) of the keys and moves no others."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    jump = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = jump
            key = key * _MULTIPLIER + np.uint64(1)
            jump = np.floor((out[live] + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            on = jump < shards
            live, key, jump = live[on], key[on], jump[on]
    return out.astype(np.int32)


#: Rows that a task numbers at once, on average.
PIECE_ROWS = 100_000


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per document: size, text_crc32, law, shard, slot and grown_shard.

    The shard follows from the key and the shard count alone, so there is no
    ring table, and no row depends on another. The slot numbers a shard's rows
    without a gap: each shard is dealt into pieces of about piece_rows (by a hash
    of the key), rows are numbered within a piece, and a piece starts where those
    before it end; so no task sorts a whole shard, and one count for each piece
    is joined back. The text itself never moves, however long.

    A null key counts as key 0 and keeps its null id, so it shares the shard of a
    key that is 0; a null text has size 16 and the checksum of no bytes; rows with
    the same key share a shard and get slots of their own, in the order of size
    and checksum (those with both the same in any order); an empty table gives no
    rows; other columns are ignored.
    """
    pieces = 1 + docs.count() // (shards * piece_rows)

    @F.pandas_udf("int")
    def here(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64), shards))

    @F.pandas_udf("int")
    def grown(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(dtype=np.int64), shards + 1))

    raw = F.coalesce(F.col(key).cast("string"), F.lit("")) if dict(docs.dtypes)[key] not in ("bigint", "int", "smallint", "tinyint") else None
    number = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")) if raw is None else F.xxhash64(raw)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), number.alias("_key"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows = rows.withColumn("shard", here("_key")).withColumn("grown_shard", grown("_key")).withColumn("_piece", F.pmod(F.shiftright(F.pmod("_key", F.lit(1 << 31).cast("long")) * F.lit(2654435761), 16), F.lit(pieces)))
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("shard", "_piece").orderBy("_key", "size", "text_crc32")))
    counts = rows.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("shard", "_piece", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_piece")) - F.col("_n")).alias("_start"))
    return numbered.join(starts, ["shard", "_piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"), "grown_shard"
    )

"""Sharding by jump consistent hashing (Lamping and Veach).

A key's shard depends on the key and the number of shards alone; there is no ring table. When a
shard is appended, a key either stays or moves into the new shard, the fraction 1/(n+1) of them.

Slots number the rows of a shard without gaps: rows of a shard fall into hash buckets of bounded
size, buckets get running offsets from their counts, and rows are numbered inside their bucket.
No task holds a whole shard.

Defined cases: a null text has size 8 (no bytes) and crc32 0; texts of any length count whole; a null id is
the key ""; rows that repeat an id share the shard and get slots of their own, in the order of their text's
crc32 and size, and rows equal in those too in any order, which their values do not tell; an empty table gives
no rows; other columns are ignored by `shard_table` and carried through by `shard_documents`, which sets `shard`
and `slot` anew and reserves names beginning `__sh_`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import settle

BUCKET_ROWS = 1024  # rows of a shard that a bucket holds on average, up to
MOST_BUCKETS = 1 << 20  # buckets of a shard, whose offsets one task makes; beyond, buckets hold more


def bucket_count(rows: int, shards: int) -> int:
    return min(MOST_BUCKETS, max(1, math.ceil(rows / shards / BUCKET_ROWS)))


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Vectorised jump consistent hash of unsigned 64-bit keys."""
    key = keys.astype(np.uint64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    j = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = j
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            j = np.floor((out[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
            stay = j < shards
            live, j = live[stay], j[stay]
    return out


def shard_column(shards: int):
    @F.arrow_udf("int")
    def jump(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return jump


def stable_key(id_col: str):
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def shard_table(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot, grown_shard (the shard after one more is appended) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), stable_key(id_col).alias("key"))
    rows = settle(rows.withColumn("shard", shard_column(shards)("key")).withColumn("grown_shard", shard_column(shards + 1)("key")))
    buckets = bucket_count(rows.count(), shards)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with their own columns, and their shard and slot. Columns of those names are replaced."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.drop("shard", "slot").withColumns({"__sh_key": stable_key(id_col), "__sh_size": F.octet_length(text), "__sh_crc": F.crc32(text.cast("binary"))})
    rows = rows.withColumn("shard", shard_column(shards)("__sh_key"))
    buckets = bucket_count(docs.count(), shards)
    rows = rows.withColumn("__sh_bucket", F.pmod(F.xxhash64("__sh_key", "__sh_crc", "__sh_size"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__sh_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "__sh_bucket").agg(F.count("*").alias("n"))
    starts = settle(starts.select("shard", "__sh_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__sh_start")))
    inside = Window.partitionBy("shard", "__sh_bucket").orderBy(id_col, "__sh_crc", "__sh_size")
    numbered = rows.withColumn("__sh_rank", F.row_number().over(inside) - 1).join(starts, ["shard", "__sh_bucket"], "left")  # every row has its start; an inner join would compute the shard once more to test it for null
    slot = (F.col("__sh_start") + F.col("__sh_rank")).cast("long").alias("slot")
    return numbered.select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", slot)

"""Exact duplicate removal by progressive refinement: length, then prefix hash, then full hash.

Each level looks only at rows that the level before could not tell apart:

1. byte lengths that occur more than once (map-side counted);
2. among those, (length, hash of a prefix) pairs that occur more than once, as a bit table sized by
   their number (`mark_held`); a table that would be too large to broadcast marks every row, since a join in its
   place would move the texts, which are read where they lie anyway;
3. among the rows so marked, SHA-256 of the whole text decides. Groups are counted map-side and joined
   to their rows with the largest groups broadcast (`spread_join`), so no group's rows meet in one task.

No text is ever shuffled, at any number of pairs; ids and hashes of the marked rows are.

Defined cases: a null text counts as the empty text; texts are equal when identical after
lower-casing A-Z; of equal texts the row with the largest id stays (a tie of ids is a repeated row);
rows that repeat both id and text share one verdict and each counts in group_size; null ids never win
over others (a group of null ids keeps the null id); texts of any length are hashed whole; other
columns are ignored whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, bit_words, broadcast_if, mark_held, settle, spread_join

LENGTHS_BOUND = 1_000_000  # distinct lengths, 4 bytes each, above which the length table is joined by shuffle


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, digest_all: bool = False) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of each row.

    text_sha256 is null for rows that an earlier level settled, unless digest_all asks for it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"))

    lengths = settle(rows.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"))
    lengths = broadcast_if(lengths, lengths.count(), LENGTHS_BOUND)

    pair = F.xxhash64("len", ascii_lower(F.substring("text", 1, prefix_chars)))
    pairs = rows.select("len", pair.alias("h")).join(lengths, "len", "left_semi").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    keys = settle(pairs.select("h"))
    marked = rows.withColumn("doubted", F.lit(True)) if bit_words(keys.count()) is None else mark_held(rows, keys, pair, "doubted")
    sha = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)

    doubted = settle(marked.filter("doubted").select("id", sha.alias("sha")))
    groups = settle(doubted.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    joined = spread_join(doubted, groups.withColumn("n", F.col("group_size")), "sha", "n", "left")
    alone = marked.filter("not doubted").select("id", (sha if digest_all else F.lit(None).cast("string")).alias("sha"), F.lit(None).cast(dict(docs.dtypes)[id_col]).alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    out = joined.unionByName(alone)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of a word budget by weight. A source that would be read more
than `max_epochs` times is clamped there, and what it leaves is dealt again to the others in
proportion to their weights until none is above its cap. The fixed point has a closed form:
order sources by cap / weight; the water level is the first (budget - caps before) /
(weights from here on) that its own source can bear.

A source's target is then met by whole repetitions of all its documents plus one fractional
repetition: documents in the order of a seeded hash of their id, up to the point nearest to the
remaining words. Only per-(source, hash bucket) sums are shuffled; the one bucket in which the
point lies is looked at document by document; the documents themselves are joined with one row
per source and are never shuffled, so a hot source costs nothing extra.

Defined cases: a null text has size 0; texts of any length are counted whole and taken whole; null sources
form one source, last in order; sources that tie in cap / weight are filled by name; documents that share an
id, and so repeated rows, share their fate; a source of size 0 has target 0; an empty table gives no rows;
other columns are carried through by `mix` whatever their names, except those beginning `__mix_`. The source
table, one row a source, is worked on by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import broadcast_if, settle

SOURCES_BOUND = 200_000  # sources above which the plan is joined by shuffle
BUCKET_ROWS = 1024  # documents that a hash bucket holds on average, over all sources, up to
MOST_BUCKETS = 1 << 20  # buckets of a source, whose running sums one task makes; beyond, buckets hold more


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sample_key(id_: Column, seed: int) -> Column:
    """60 seeded bits of the id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def water_fill(sizes: DataFrame, budget: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """sizes: source, size. Returns source, size, weight, target. Sources by code point, null last, take the weights in turn."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rn") - 1) % len(weights) + 1)
    ranked = sizes.withColumn("rn", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    total = F.sum("size").over(Window.partitionBy()).cast("double") * F.lit(float(budget))
    all_w = F.sum("weight").over(Window.partitionBy())
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rn").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = ranked.select("*", total.alias("total"), all_w.alias("all_w"), F.coalesce(F.sum("cap").over(before), zero).alias("caps"), F.coalesce(F.sum("weight").over(before), zero).alias("ws"))
    level = level.withColumn("level", (F.col("total") - F.col("caps")) / (F.col("all_w") - F.col("ws")))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "rn", "level"))).over(Window.partitionBy())
    water = F.coalesce(first["level"] * F.col("weight"), F.col("cap"))
    return level.select("source", "size", "weight", F.least(F.col("cap"), water).alias("target"))


def mix_plan(sized: DataFrame, budget: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """sized: source, size, key. One row a source: source, size, target, whole, cutoff (largest key that the fractional repetition takes)."""
    n = sized.count()
    buckets = min(MOST_BUCKETS, max(1, n) / BUCKET_ROWS)
    shift = 60 - max(0, math.ceil(math.log2(buckets)))
    bucketed = sized.withColumn("bucket", F.shiftright("key", shift))
    sums = settle(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    filled = water_fill(sums.groupBy("source").agg(F.sum("size").alias("size")), budget, max_epochs, weights)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    filled = settle(filled)
    n_sources = filled.count()
    small = broadcast_if(filled.select("source", "whole", "rest"), n_sources, SOURCES_BOUND)

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # the last bucket that begins while the remaining words last holds the cutoff, however many buckets there are
    s = small.withColumnRenamed("source", "s")
    edges = edges.join(s, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") > 0))
    edges = edges.groupBy("source", "rest").agg(F.max(F.struct("bucket", "before")).alias("e")).select("source", "rest", "e.bucket", "e.before")
    e = broadcast_if(edges.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "rest"), n_sources, SOURCES_BOUND)
    inside = bucketed.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = inside.groupBy("source", "bucket", "before", "rest", "key").agg(F.sum("size").alias("size"))
    run = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key")) - F.col("size") / 2
    picked = inside.withColumn("run", run)
    floor_key = F.expr(f"shiftleft(bucket, {shift}) - 1")  # every bucket before is taken whole
    cut = picked.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("run") <= F.col("rest"), F.col("key"))), F.min(floor_key)).alias("cutoff"))
    cut = settle(cut.withColumnRenamed("source", "s"))
    return settle(filled.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", "target", "whole", F.coalesce("cutoff", F.lit(-1).cast("long")).alias("cutoff")))


def mix_copies(docs: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target and copies (times that the mix takes the document) of every document."""
    sized = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"), sample_key(F.col(id_col), seed).alias("key")))
    plan = mix_plan(sized.select("source", "size", "key"), budget, max_epochs, weights)
    plan = broadcast_if(plan, plan.count(), SOURCES_BOUND).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "whole", "cutoff")
    copies = F.col("whole") + F.when(F.col("key") <= F.col("cutoff"), 1).otherwise(0)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(id_col), "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as many times as the plan takes it, with its own columns."""
    sized = docs.select(F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"), sample_key(F.col(id_col), seed).alias("key"))
    plan = mix_plan(settle(sized), budget, max_epochs, weights)
    plan = broadcast_if(plan, plan.count(), SOURCES_BOUND).select(F.col("source").alias("__mix_s"), F.col("whole").alias("__mix_w"), F.col("cutoff").alias("__mix_c"))
    copies = F.col("__mix_w") + F.when(sample_key(F.col(id_col), seed) <= F.col("__mix_c"), 1).otherwise(0)
    joined = docs.join(plan, docs[source_col].eqNullSafe(F.col("__mix_s"))).withColumn("__mix_n", copies.cast("int")).filter("__mix_n > 0")
    return joined.withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*[docs[c] for c in docs.columns])

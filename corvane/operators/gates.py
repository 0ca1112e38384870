"""Lexical gates, semantic buckets, routing, review flags and the run report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.config import ExtractionConfig
from corvane.functions import text as tx


def lexical_gate(df: DataFrame, terms: list[str], col: str = "text") -> DataFrame:
    """Rows whose text holds a gate term. A pattern on an input column: it runs in the scan's stage, before any split."""
    return df.filter(F.col(col).rlike(tx.gate_pattern(terms)))


def lexical_gate_tokens(df: DataFrame, lexicon: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """The same for a lexicon too large for one pattern: tokens semi-joined with term."""
    hit = df.select(*keys, F.explode(F.array_distinct(tx.tokens(F.col(col)))).alias("term")).join(lexicon.select("term"), "term", "left_semi").select(*keys).distinct()
    return df.join(hit, keys, "left_semi")


def bucket(pos: Column, margin: Column, human: Column, c: ExtractionConfig = ExtractionConfig()) -> Column:
    """First rule that holds: strict, semantic rescue, lexical-human rescue, reject."""
    return (
        F.when((pos >= c.semantic_min) & (margin >= c.semantic_margin), "STRICT")
        .when((pos >= c.rescue_min) & (margin >= c.rescue_margin), "SEMANTIC_RESCUE")
        .when(human, "LEXICAL_HUMAN_RESCUE")
        .otherwise("REJECT")
    )


def route(bucket_: Column, prob: Column, noise: Column, c: ExtractionConfig = ExtractionConfig()) -> Column:
    """keep, review or drop. Noise blocks a keep and sends the row to review."""
    need = F.when(bucket_ == "STRICT", c.keep).when(bucket_ == "SEMANTIC_RESCUE", c.rescue_keep).when(bucket_ == "LEXICAL_HUMAN_RESCUE", c.human_keep)
    review = F.when(bucket_ == "LEXICAL_HUMAN_RESCUE", c.human_review).otherwise(c.borderline)
    blocked = noise & F.lit(c.block_noise)
    return F.when(bucket_ == "REJECT", "drop").when((prob >= need) & ~blocked, "keep").when((prob >= review) | blocked, "review").otherwise("drop")


def review_flags(bucket_: Column, pos: Column, margin: Column, prob: Column, noise: Column, c: ExtractionConfig = ExtractionConfig()) -> Column:
    """noise: array of noise flags."""
    flags = F.concat(
        F.array_compact(
            F.array(
                F.when(bucket_ == "SEMANTIC_RESCUE", F.lit("semantic_rescue")),
                F.when(bucket_ == "LEXICAL_HUMAN_RESCUE", F.lit("lexical_human_rescue")),
                F.when(margin < c.low_margin, F.lit("low_margin")),
                F.when(((pos >= c.high_pos) | (margin >= c.high_margin)) & (prob < c.keep), F.lit("high_semantic_low_classifier")),
            )
        ),
        noise,
    )
    return F.when(F.size(flags) == 0, F.array(F.lit("classifier_borderline"))).otherwise(flags)


def dimension_winner(scores: dict[str, Column], floor: float = 0.60, margin: float = 0.04) -> Column:
    """Name of the dimension that reaches the floor and beats every other by the margin, or null."""
    out = F.lit(None).cast("string")
    for name, s in scores.items():
        others = [x for n, x in scores.items() if n != name]
        out = F.when((s >= floor) & (s - (F.greatest(*others) if len(others) > 1 else others[0]) >= margin), F.lit(name)).otherwise(out)
    return out


LANES = (("STRICT", "strict"), ("SEMANTIC_RESCUE", "rescue"), ("LEXICAL_HUMAN_RESCUE", "human"))


def rate(a: Column, b: Column) -> Column:
    """a / b with a zero denominator read as 1."""
    return a / F.when(b == 0, F.lit(1)).otherwise(b)


def extraction_report(routed: DataFrame) -> DataFrame:
    """One row of counters and rates. routed: bucket, decision, noise."""
    n = lambda c: F.count_if(c)
    b, d = F.col("bucket"), F.col("decision")
    r = routed.agg(
        F.count("*").alias("hits"),
        n(b == "STRICT").alias("strict"),
        n(b == "SEMANTIC_RESCUE").alias("rescue"),
        n(b == "LEXICAL_HUMAN_RESCUE").alias("human"),
        n(b == "REJECT").alias("rejected"),
        n(d == "keep").alias("kept"),
        n(d == "review").alias("review"),
        n((d == "drop") & (b != "REJECT")).alias("dropped"),
        n((b != "REJECT") & F.col("noise")).alias("noise_blocked"),
        *[n((b == k) & (d == x)).alias(f"{name}_{x}") for k, name in LANES for x in ("keep", "review", "drop")],
    )
    scored = F.col("strict") + F.col("rescue") + F.col("human")
    return r.select(
        "*",
        F.round(rate(F.col("strict"), F.col("hits")), 4).alias("strict_rate"),
        F.round(rate(F.col("kept"), F.col("hits")), 4).alias("kept_rate"),
        F.round(rate(F.col("review"), scored), 4).alias("review_rate"),
        F.round(rate(F.col("noise_blocked"), scored), 4).alias("noise_rate"),
        F.round(rate(F.col("rescue"), F.col("hits")), 4).alias("rescue_rate"),
        F.round(rate(F.col("human"), F.col("hits")), 4).alias("human_rate"),
        F.round(rate(F.col("rejected"), F.col("hits")), 4).alias("reject_rate"),
        F.round(rate(F.col("strict_keep"), F.col("strict")), 4).alias("strict_keep_rate"),
        F.round(rate(F.col("dropped"), scored), 4).alias("drop_rate"),
    )


def scan_counters(docs: DataFrame, terms: list[str], c: ExtractionConfig = ExtractionConfig(), col: str = "text") -> DataFrame:
    """One row: documents, documents past the gate, their sentences, and those past the gate. One scan, nothing exploded."""
    past = lambda x: F.coalesce(x.rlike(tx.gate_pattern(terms)), F.lit(False))
    d = docs.select(past(F.col(col)).alias("open"), F.col(col).alias("text"))
    d = d.withColumn("sentences", F.when(F.col("open"), tx.split_sentences(F.col("text"), c.min_sentence, c.max_sentence)))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return d.agg(
        F.count("*").alias("documents_total"),
        F.count_if("open").alias("documents_lexical"),
        total(F.coalesce(F.size("sentences"), F.lit(0))).alias("total_sentences"),
        total(F.coalesce(F.size(F.filter("sentences", past)), F.lit(0))).alias("lexical_hits"),
    )


def report_samples(routed: DataFrame, key: list[str], most: int = 15) -> DataFrame:
    """The first rows, by key, of what was rejected, kept and sent to review: at most `most` of each."""
    out = None
    for name, rows in (("rejected", F.col("bucket") == "REJECT"), ("kept", F.col("decision") == "keep"), ("review", F.col("decision") == "review")):
        part = routed.filter(rows).orderBy(*key).limit(most).withColumn("sample", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def review_rows(routed: DataFrame) -> DataFrame:
    """Rows for review; a strict bucket is shown as BORDERLINE."""
    shown = F.when(F.col("bucket") == "STRICT", "BORDERLINE").otherwise(F.col("bucket"))
    return routed.filter(F.col("decision") == "review").withColumn("bucket", shown)

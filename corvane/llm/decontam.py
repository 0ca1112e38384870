"""Benchmark decontamination with a broadcast hash set of benchmark n-grams.

Benchmark texts become windows of `n` consecutive normalised words (a shorter text is one window).
Documents are scanned once for hits: words are hashed once, the window hashes that start at a word are
made from those, one for each window length in use, and probed against the broadcast set; a probe that
hits is verified word by word in the same stage before anything is shuffled. Only verified hits, a few
rows, leave the scan.

The set is broadcast while its counted bytes are within `WINDOWS_BOUND`; beyond, windows whose hash may
be in the set (`only_held`) carry their words into a shuffled join, which compares the same words.

Defined cases: a null text has no words; an item without words has no windows; texts of any length are
read whole; items that share a window are all reported, so ties don't matter; rows that repeat an id are
told apart by their text, and repeated rows share their result; an empty benchmark leaves every document
clean; an empty table gives no rows; other columns are carried through by the removing functions
whatever their names, except those beginning `__`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ascii_lower, bit_words, drop_rows, only_held, settle, weigh

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"  # what stands between gaps, before lower-casing
WINDOWS_BOUND = 32 << 20  # bytes of windows that are broadcast


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _window_hash(hashes: str, at: str, k: int) -> str:
    """Hash of the k words from position `at` on, from the words' hashes; the length is part of it."""
    return f"xxhash64({k}, {', '.join(f'get({hashes}, {at} + {i})' for i in range(k))})"


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct window: len, h, win (its words), items (ids as strings)."""
    b = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    b = b.withColumn("len", F.least(F.size("w"), F.lit(n)))
    b = b.withColumn("at", F.explode(F.expr("sequence(0, size(w) - len)")))
    b = b.select("item", "len", F.expr("slice(w, at + 1, len)").alias("win"))
    b = b.groupBy("len", "win").agg(F.collect_set("item").alias("items"))
    b = b.withColumn("hw", F.expr("transform(win, x -> xxhash64(x))"))
    cases = " ".join(f"when {k} then {_window_hash('hw', '0', k)}" for k in range(1, n + 1))
    return b.select("len", F.expr(f"case len {cases} end").alias("h"), "win", "items")


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, th (hash of the text), spans (array of start, end of merged hit word ranges), items (sorted ids) of every document with a verified hit."""
    windows = settle(benchmark_windows(benchmark, n, item_col, item_text_col))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most n
    if not lengths:
        return docs.sparkSession.createDataFrame([], f"id {dict(docs.dtypes)[id_col]}, th bigint, spans array<struct<start:int,end:int>>, items array<string>")
    _, size = weigh(windows, F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 8 * F.size("win") + 8 * F.size("items") + 48)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    d = d.withColumn("hw", F.expr("transform(w, x -> xxhash64(x))"))
    # the outer forms keep the optimizer from filtering by, and so computing twice, what they read
    d = d.select("id", "th", "w", "hw", F.explode_outer(F.expr("if(size(w) > 0, sequence(0, size(w) - 1), cast(null as array<int>))")).alias("at"))
    probes = [f"case when at + {k} <= size(hw) then struct({k} as len, {_window_hash('hw', 'at', k)} as h) end" for k in lengths]
    if len(probes) == 1:
        d = d.select("id", "th", "w", "at", F.expr(probes[0]).alias("p"))
    else:
        d = d.select("id", "th", "w", "at", F.explode_outer(F.expr(f"array({', '.join(probes)})")).alias("p"))
    d = d.select("id", "th", "w", "at", F.col("p.len").alias("k"), F.col("p.h").alias("h")).filter("h is not null")
    if size <= WINDOWS_BOUND:
        found = d.join(F.broadcast(windows), "h").filter("k = len and slice(w, at + 1, k) = win")
    else:
        keys = settle(windows.select("h").distinct())
        cut = lambda rows: rows.select("id", "th", "at", "k", "h", F.expr("slice(w, at + 1, k)").alias("own"))
        # past the largest bit table the probes are shuffled: with the words of their window, never with the text
        likely = only_held(cut(d), keys, F.col("h")) if bit_words(keys.count()) is None else cut(only_held(d, keys, F.col("h")))
        found = likely.join(windows, "h").filter("own = win")
    found = found.select("id", "th", F.struct(F.col("at").alias("start"), (F.col("at") + F.col("k")).alias("end")).alias("span"), "items")
    found = found.groupBy("id", "th").agg(F.array_sort(F.collect_set("span")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merge = """aggregate(s, cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
        if(size(acc) > 0 and acc[size(acc) - 1].end >= x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))),
           concat(acc, array(x))))"""
    return found.select("id", "th", F.expr(merge).alias("spans"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, spans, items of every document row."""
    found = hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col)
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    f = found.select(F.col("id").alias("i"), F.col("th").alias("t"), "spans", "items")
    out = d.join(f, d["id"].eqNullSafe(F.col("i")) & (d["th"] == F.col("t")), "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.lit(0).cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without any verified hit, with their own columns."""
    found = hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col)
    return drop_rows(docs, settle(found.select(F.col("id").alias("__id"), F.col("th").alias("__th"))), id_col, F.xxhash64(docs[text_col]))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All rows; in the texts with hits, the hit words go and the others stay, in normalised form joined by single spaces."""
    found = hits(docs, benchmark, n, id_col, text_col, item_col, item_text_col).select(F.col("id").alias("__dec_i"), F.col("th").alias("__dec_t"), F.col("spans").alias("__dec_s"))
    out = docs.join(found, docs[id_col].eqNullSafe(F.col("__dec_i")) & (F.xxhash64(docs[text_col]) == F.col("__dec_t")), "left")
    out = out.withColumn("__dec_w", words(F.col(text_col)))
    kept = F.expr("array_join(filter(__dec_w, (x, i) -> not exists(__dec_s, s -> i >= s.start and i < s.end)), ' ')")
    return out.select(*[F.when(F.col("__dec_s").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])

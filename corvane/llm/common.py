"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.scratch import settle, settle_last  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts that are all ASCII take the cheap built-in path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo `mod`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


@contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most `size` bytes for what is executed inside: a batch stands in memory several times, in the JVM and in its worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hints a broadcast only for a table whose counted rows stay within the bound."""
    return F.broadcast(df) if rows <= bound else df


def weigh(df: DataFrame, size: Column) -> tuple[int, int]:
    """Rows of a settled table and the sum of `size` (a row's bytes) over them: what decides whether it may be broadcast."""
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20  # 64-bit words of a bit table: at most this many rows are broadcast, 16 bytes each
KEYS_A_WORD = 4  # keys for which a word of the table is made; with more than MOST_WORDS * KEYS_A_WORD keys a join takes its place


def bit_words(n: int) -> int | None:
    """Words of a bit table for n keys, or None where a table of bounded size would let too much through."""
    words = LEAST_WORDS
    while words * KEYS_A_WORD < n:
        words *= 2
    return words if words <= MOST_WORDS else None


def bit_table(df: DataFrame, hash_col: str, words: int) -> DataFrame:
    """A set of hashes as at most `words` rows (bit_word, bits): a filter of known size without false negatives."""
    word = F.pmod(F.col(hash_col), F.lit(words))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright({hash_col}, 32), 64) as int))")
    return df.groupBy(word.alias("bit_word")).agg(F.bit_or(bit).alias("bits"))


def mark_held(df: DataFrame, keys: DataFrame, hash_: Column, out: str = "held") -> DataFrame:
    """df with a boolean column: true for every row whose hash is in `keys` (settled, column h, distinct).

    Up to MOST_WORDS * KEYS_A_WORD keys, a bit table sized by their number is broadcast, and few other rows
    are true as well; beyond, keys and rows meet exactly in a shuffled join: what df carries then moves, so callers leave texts out of it.
    """
    n = keys.count()
    words = bit_words(n)
    cols = [df[c] for c in df.columns]
    if words is None:
        k = keys.select(F.col("h").alias("__bit_key"))
        return df.withColumn("__bit_hash", hash_).join(k, F.col("__bit_hash") == F.col("__bit_key"), "left").select(*cols, F.col("__bit_key").isNotNull().alias(out))
    b = settle(bit_table(keys, "h", words)).toDF("__bit_word", "__bits")
    hit = df.withColumn("__bit_hash", hash_).join(F.broadcast(b), F.pmod(F.col("__bit_hash"), F.lit(words)) == F.col("__bit_word"), "left")
    return hit.select(*cols, F.expr("coalesce(getbit(__bits, cast(pmod(shiftright(__bit_hash, 32), 64) as int)) = 1, false)").alias(out))


def only_held(df: DataFrame, keys: DataFrame, hash_: Column) -> DataFrame:
    """The rows that `mark_held` marks."""
    return mark_held(df, keys, hash_, "__held").filter("__held").drop("__held")


GONE_BOUND = 64 << 20  # bytes of row keys that are broadcast


def drop_rows(docs: DataFrame, gone: DataFrame, id_col: str, th: Column) -> DataFrame:
    """docs without the rows whose id and text hash `th` are in gone (settled: __id, __th).

    A few keys are broadcast; of many, the rows that a bit table lets through are shuffled, the others stay where they are.
    Only past the largest bit table (MOST_WORDS * KEYS_A_WORD rows to drop) are all rows shuffled, with their columns.
    """
    _, size = weigh(gone, F.coalesce(F.octet_length(F.col("__id").cast("string")), F.lit(0)) + 24)
    match = lambda d: d[id_col].eqNullSafe(gone["__id"]) & (th == gone["__th"])
    if size <= GONE_BOUND:
        return docs.join(F.broadcast(gone), match(docs), "left_anti")
    keys = settle(gone.select(F.xxhash64("__id", "__th").alias("h")).distinct())
    marked = mark_held(docs, keys, F.xxhash64(docs[id_col], th), "__held")
    likely = marked.filter("__held").drop("__held")
    return marked.filter("not __held").drop("__held").unionByName(likely.join(gone, match(likely), "left_anti"))


HOT_KEYS = 100_000  # keys that are broadcast; any other key then has at most one row in this many


def spread_join(facts: DataFrame, dim: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """facts joined (inner or left) with dim on `key`, without a hot key's rows in one task.

    dim is settled and has one row a key; `weight` is a column of it, the key's number of fact rows (or
    more), and is left out of the result. A dim of at most HOT_KEYS rows is broadcast. Of a larger one the keys of the
    largest weights, at most HOT_KEYS of them, are, so their facts stay where they are; the others are joined by
    shuffle, and none of them has more than a HOT_KEYS-th of all facts.
    """
    values = [c for c in dim.columns if c not in (key, weight)]
    own = [facts[c] for c in facts.columns]

    def side(rows: DataFrame) -> DataFrame:  # fresh names, so that no column is ambiguous
        return rows.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__value{i}") for i, c in enumerate(values)])

    out = [*own, *[F.col(f"__value{i}").alias(c) for i, c in enumerate(values)]]
    match = facts[key] == F.col("__key")
    if dim.count() <= HOT_KEYS:
        return facts.join(F.broadcast(side(dim)), match, how).select(*out)
    sizes = dim.filter(f"{weight} > 1").groupBy(F.floor(F.log2(weight) * 4).alias("q")).count().collect()  # at most 256 rows
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["q"]):
        total += r["count"]
        if total > HOT_KEYS:
            break
        least = r["q"]
    if least is None:
        return facts.join(side(dim), match, how).select(*out)
    is_hot = F.coalesce(F.floor(F.log2(weight) * 4) >= least, F.lit(False))
    hot = dim.filter(is_hot)
    both = facts.join(F.broadcast(side(hot)), match).select(*out)
    rest = facts.join(F.broadcast(hot.select(F.col(key).alias("__hot"))), facts[key] == F.col("__hot"), "left_anti")
    return both.unionByName(rest.join(side(dim.filter(~is_hot)), match, how).select(*out))


def least_hashes(rows: DataFrame, hash_: Column, most: int, out: str = "__h") -> DataFrame:
    """The rows with the `most` smallest hashes (64 bits, column `out`), and those that tie with the last of them.

    Rows are counted, hashes cut at four times the share wanted, and the exact bound is found among what is
    left, so no task sorts more than a bounded number of hashes, at any size. Only where copies of a hash leave
    too few below the cut does the bound come from all hashes. Ties are the caller's to limit.
    """
    hashed = rows.withColumn(out, hash_.bitwiseAND(F.lit(2**63 - 1)))
    n = rows.count()
    if n <= most:
        return hashed

    def bound(some: DataFrame) -> tuple[int, int | None]:
        r = some.select(out).orderBy(out).limit(most).agg(F.count("*").alias("n"), F.max(out).alias("m")).first()
        return r["n"], r["m"]

    found, last = bound(hashed.filter(F.col(out) <= min(2**63 - 1, 2**63 * 4 * most // n)))
    if found < most:
        _, last = bound(hashed)
    return hashed.filter(F.col(out) <= last)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): node, root (smallest reachable node).

    Alternating large and small stars (Kiveris et al.), each a map-side minimum and a join in which hubs
    are spread; no neighbourhood is gathered, and every step is written to the shared folder.
    """
    e = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if e.isEmpty():
        return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    while True:
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        low = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = settle(spread_join(both.filter("v > u"), low, "u", "n").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        down = settle(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, down, "hi", "n")
        new = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(down.select("hi", F.col("m").alias("lo"))).filter("hi <> lo").distinct()
        new = settle(new)
        same = new.count() == e.count() and new.join(e, ["hi", "lo"], "left_anti").isEmpty()
        e = new
        if same:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))

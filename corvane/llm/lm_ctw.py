"""Language-model scoring by context-tree weighting over byte contexts.

A byte is eight binary decisions. Each decision has a binary context tree whose contexts are the
bytes before it, nearest first, up to DEPTH bytes. A node holds the bits seen in its context and
estimates by Krichevsky-Trofimov; its weighted probability is half that estimate and half the
product of its children's. The posterior weight of stopping at a node, w = KT / (2 * weighted), then
mixes the estimates of all depths of a context path:

    p0 = w0*kt0 + (1-w0)*(w1*kt1 + (1-w1)*( ... ktD))

so that every byte of a text gets a proper probability, seen or not, and a text's score is their
log10 sum: its code length, negated. A text is its lower-cased UTF-8 bytes and one end byte (0xFF,
which UTF-8 never uses); before it stand DEPTH bytes 0xFF.

The corpus is counted as (DEPTH+1)-byte grams and as tokens, in array batches with combining before
the shuffle; the held-out rows' grams are listed with count 0. Nodes that share their three nearest
bytes lie in one partition, sorted, and are worked off in bounded chunks: bottom-up for the weights
of depths 3 and more, SQL sums for depths 2 to 0, then top-down for the log-probability of every
gram. No context or gram is pruned or capped.

Scoring looks grams and tokens up in hash tables that are broadcast while they have at most
GRAMS_BOUND and TOKENS_BOUND entries (8 and 16 bytes each, with 12 of the key and the index); beyond, the
tables hold the most frequent entries and the others are joined by shuffle. Both ways read the same 32-bit
log-probability of a gram, so that a text's score does not depend on the bounds.

Defined cases: a null text is empty (its end is scored); texts of any length are scored whole, in pieces
of bounded size; ids that repeat are scored row by row; equal texts have equal scores, and ties play
no part; without training rows all estimates are KT's prior, 1/2 a bit; an empty table gives no rows;
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, ascii_lower, fold, settle, settle_last, small_batches

DEPTH = 5
FOLDS = 10
END = 0xFF
GRAMS_BOUND = 6_000_000
TOKENS_BOUND = 2_000_000
PIECE = 1 << 19  # bytes that are turned into grams at a time
HOLD = 1 << 20  # distinct keys that a counting task holds before it emits them
CHUNK = 1 << 16  # grams of a tree chunk
LN2 = np.log(2.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2 by shifting to x >= 8 and Stirling's series."""
    x = np.asarray(x, dtype=np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    i = 1 / x
    i2 = i * i
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680)))


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def log_weighted(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, children) - LN2


def text_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A gram for every byte of every text and for its end, and the text of each gram.

    The scored byte is in bits 0-7, the byte before it in bits 8-15, and so on.
    """
    pad = bytes([END]) * DEPTH
    raw = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    at = np.arange(len(owner)) + DEPTH * owner
    g = raw[at + DEPTH]
    for k in range(1, DEPTH + 1):
        g |= raw[at + (DEPTH - k)] << np.uint64(8 * k)
    return g, owner


def _by_row(keys: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """Lists of keys by row; owner is ascending."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys))


def pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PIECE bytes."""
    at = 0
    while at < len(sizes):
        to, total = at, 0
        while to < len(sizes) and (to == at or total + sizes[to] <= PIECE):
            total += int(sizes[to])
            to += 1
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of the values of a binary column."""
    return np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))])


class Counts:
    """Distinct keys with counts; parts are merged when they add up to HOLD, so that memory stays bounded."""

    def __init__(self, kind: int) -> None:
        self.kind = kind
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counted: bool = True) -> Iterator[pa.RecordBatch]:
        """Counts keys (or lists them with count 0); yields what no longer fits."""
        own, n = np.unique(keys, return_counts=True)
        self.parts.append((own, n if counted else np.zeros(len(own), dtype=np.int64)))
        self.size += len(own)
        if self.size > HOLD:
            self.merge()
            if self.size > HOLD // 2:
                yield from self.drain()

    def merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
        self.parts, self.size = [(keys, n)], len(keys)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.merge()
            keys, n = self.parts[0]
            for at in range(0, len(keys), 1 << 15):
                k = keys[at : at + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), self.kind, dtype=np.int32)), pa.array(k), pa.array(n[at : at + (1 << 15)])], ["kind", "key", "n"])
        self.parts, self.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: grams, kind 1: tokens; held-out rows list their grams with count 0."""
    grams, tokens = Counts(0), Counts(1)
    for batch in batches:
        held = batch.column("held").to_numpy(zero_copy_only=False)
        raw = batch.column("raw")
        lists = batch.column("tokens")
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for lo, hi in pieces(np.diff(_offsets(raw))):
            g, who = text_grams(raw[lo:hi].to_pylist())
            g, h = g.view(np.int64), held[lo:hi][who]
            yield from grams.add(g[~h])
            yield from grams.add(g[h], counted=False)
            owner = np.repeat(held[lo:hi], np.diff(ends[lo : hi + 1]))
            yield from tokens.add(flat[ends[lo] : ends[hi]][~owner])
        del batch, raw, lists, flat
        pa.default_memory_pool().release_unused()
    yield from grams.drain()
    yield from tokens.drain()


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Chunks of a stream sorted by k3, cut where k3 changes."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        held.append(own)
        size += len(own[0])
        if size < CHUNK:
            continue
        all_ = [np.concatenate(x) for x in zip(*held)]
        k3 = all_[0]
        cut = int(np.searchsorted(k3, k3[-1], "left"))
        if cut:
            yield [x[:cut] for x in all_]
        held, size = [[x[cut:] for x in all_]], len(k3) - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _up(keys: np.ndarray, depth: int) -> np.ndarray:
    """Node keys (context bytes, nearest lowest, then 8 bits of prefix) of one depth less."""
    u = np.uint64
    return (keys & u(0xFF)) | (((keys >> u(8)) & u((1 << (8 * (depth - 1))) - 1)) << u(8))


def _bits(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node keys at DEPTH and bits of the eight decisions of each gram, shape (8, n)."""
    u = np.uint64
    b, ctx = g & u(0xFF), g >> u(8)
    keys = np.stack([(ctx << u(8)) | u(1 << j) | (b >> u(8 - j)) for j in range(8)])
    bits = np.stack([(b >> u(7 - j)) & u(1) for j in range(8)]).astype(bool)
    return keys, bits


def _levels(g: np.ndarray, n: np.ndarray, least: int) -> list[dict]:
    """Nodes of depths DEPTH down to `least`: keys, n0, n1, weighted, w, and `up`, each node's index one depth less."""
    keys, bits = _bits(g)
    own, inv = np.unique(keys.ravel(), return_inverse=True)
    weight = np.tile(n, 8).astype(np.float64)
    n1 = np.bincount(inv, weight * bits.ravel(), len(own))
    n0 = np.bincount(inv, weight, len(own)) - n1
    kt = log_kt(n0, n1)
    out = [{"keys": own, "n0": n0, "n1": n1, "weighted": kt, "w": np.ones(len(own)), "inv": inv.reshape(8, -1), "bits": bits}]
    for depth in range(DEPTH, least, -1):
        below = out[-1]
        own, up = np.unique(_up(below["keys"], depth), return_inverse=True)
        n0, n1, children = (np.bincount(up, below[x], len(own)) for x in ("n0", "n1", "weighted"))
        kt = log_kt(n0, n1)
        weighted = log_weighted(kt, children)
        below["up"] = up
        out.append({"keys": own, "n0": n0, "n1": n1, "weighted": weighted, "w": np.exp(kt - LN2 - weighted)})
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted grams -> nodes of depth 3: key, n0, n1, weighted."""
    for _, g, n in _chunks(batches, ["k3", "key", "n"]):
        top = _levels(g.view(np.uint64), n, 3)[-1]
        yield pa.RecordBatch.from_arrays([pa.array(top["keys"].view(np.int64)), pa.array(top["n0"]), pa.array(top["n1"]), pa.array(top["weighted"])], ["key", "n0", "n1", "weighted"])


def _gram_logp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted grams, with rows of kind 1 for the mixture above each depth-3 node (a: probability of a 1 from depths 0-2, b: weight left) -> key, logp, n."""
    u = np.uint64
    for k3, kind, key, n, a, b in _chunks(batches, ["k3", "kind", "key", "n", "a", "b"]):
        node = kind == 1
        at = np.argsort(key[node].view(np.uint64))
        known, ka, kb = key[node].view(np.uint64)[at], a[node][at], b[node][at]
        g, n = key[~node].view(np.uint64), n[~node]
        if not len(g):
            continue
        levels = _levels(g, n, 3)
        for i, level in enumerate(levels):
            kt = (level["n1"] + 0.5) / (level["n0"] + level["n1"] + 1.0)
            if i == len(levels) - 1:
                found = np.searchsorted(known, level["keys"])
                level["a"], level["b"] = ka[found], kb[found]
            level["kt"] = kt
        # top-down: probability of a 1 at each node, given everything above it
        above = levels[-1]
        a_, b_ = above["a"] + above["b"] * above["w"] * above["kt"], above["b"] * (1 - above["w"])
        for level in levels[-2::-1]:
            a_, b_ = a_[level["up"]], b_[level["up"]]
            a_, b_ = a_ + b_ * level["w"] * level["kt"], b_ * (1 - level["w"])
        inv, bits = levels[0]["inv"], levels[0]["bits"]
        p = np.clip(a_, 1e-300, 1 - 1e-16)[inv]
        logp = np.log10(np.where(bits, p, 1 - p)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(logp.astype(np.float32)), pa.array(n)], ["key", "logp", "n"])


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over children -> the same with weighted and w."""
    for x in batches:
        n0, n1, children = (x.column(c).to_numpy(zero_copy_only=False) for c in ("n0", "n1", "children"))
        kt = log_kt(n0, n1)
        weighted = log_weighted(kt, children)
        yield pa.RecordBatch.from_arrays([x.column("key"), pa.array(n0), pa.array(n1), pa.array(weighted), pa.array(np.exp(kt - LN2 - weighted)), pa.array((n1 + 0.5) / (n0 + n1 + 1.0))], ["key", "n0", "n1", "weighted", "w", "kt"])


def gram_table(grams: DataFrame) -> DataFrame:
    """grams: key, n. Returns key, logp (log10 of the scored byte given its context), n."""
    grams = grams.withColumn("k3", F.expr("shiftright(key, 8) & 16777215"))
    parts = max(1, int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = grams.repartition(parts, "k3").sortWithinPartitions("k3").select("k3", "key", "n")
    nodes = settle(laid.mapInArrow(_nodes, "key long, n0 double, n1 double, weighted double"))
    above = None
    level = nodes
    for depth in (3, 2, 1):
        mask = (1 << (8 * (depth - 1))) - 1
        up = F.expr(f"(key & 255) | shiftleft(shiftright(key, 8) & {mask}L, 8)")
        sums = level.groupBy(up.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("children"))
        level = settle(sums.mapInArrow(_weights, "key long, n0 double, n1 double, weighted double, w double, kt double"))
        above = [level, *(above or [])]
    # probability of a 1 from depths 0-2 and the weight left, down to each depth-2 node
    mixed = above[0].select("key", (F.col("w") * F.col("kt")).alias("a"), (1 - F.col("w")).alias("b"))
    for depth, level in ((1, above[1]), (2, above[2])):
        mask = (1 << (8 * (depth - 1))) - 1
        up = F.expr(f"(key & 255) | shiftleft(shiftright(key, 8) & {mask}L, 8)")
        down = level.select("key", "w", "kt", up.alias("up")).join(mixed.withColumnRenamed("key", "up"), "up")
        mixed = down.select("key", (F.col("a") + F.col("b") * F.col("w") * F.col("kt")).alias("a"), (F.col("b") * (1 - F.col("w"))).alias("b"))
    up = F.expr("(key & 255) | shiftleft(shiftright(key, 8) & 65535L, 8)")
    tops = nodes.select("key", up.alias("up")).join(mixed.withColumnRenamed("key", "up"), "up")
    tops = tops.select(F.expr("shiftright(key, 8)").alias("k3"), F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("n"), "a", "b")
    rows = grams.select("k3", F.lit(0).alias("kind"), "key", "n", F.lit(0.0).alias("a"), F.lit(0.0).alias("b")).unionByName(tops)
    laid = rows.repartition(parts, "k3").sortWithinPartitions("k3")
    return settle(laid.mapInArrow(_gram_logp, "key long, logp float, n long"))


class Lookup:
    """Hash table of int64 keys in flat arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(2, len(keys))))))
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[order], np.int64(0))
        self.values = np.append(values[order], 0).astype(values.dtype)
        self.starts = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.int64).view(np.uint64)
        k = (k ^ (k >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (k >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing) and which keys were found."""
        s = self.slot(keys)
        at, end = self.starts[s].astype(np.int64), self.starts[s + 1]
        found = (at < end) & (self.keys[at] == keys)
        open_ = np.flatnonzero(~found & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            hit = self.keys[at[open_]] == keys[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (at[open_] + 1 < end[open_])]
        return np.where(found, self.values[at], 0), found


def _head(counts: DataFrame, bound: int) -> tuple[DataFrame, bool]:
    """The entries with the largest counts, as many as the bound allows; and whether those are all."""
    if counts.count() <= bound:
        return counts, True
    sizes = counts.groupBy(F.floor(F.log2(F.col("n") + 1) * 4).alias("q")).count().collect()  # at most 260 rows
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["q"]):
        total += r["count"]
        if total > bound:
            break
        least = r["q"]
    if least is None:
        return counts.limit(0), False
    return counts.filter(F.floor(F.log2(F.col("n") + 1) * 4) >= least), False


def _arrays(df: DataFrame, value: str, dtype: type) -> Lookup:
    t = df.select("key", value).toArrow()
    return Lookup(t["key"].to_numpy(), t[value].to_numpy().astype(dtype))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every row.

    The result is written before it is returned, so that batches are small only meanwhile.
    """
    with small_batches(docs.sparkSession):
        return settle_last(docs.sparkSession, lambda: _score(docs, id_col, text_col))


def _score(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    held = fold(F.col(id_col), FOLDS) == 0
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), low.alias("low"))
    words = F.array_append(F.array_remove(F.split("low", SPACES), ""), "")  # the empty word stands for the end
    rows = rows.select("id", "held", F.col("low").cast("binary").alias("raw"), words.alias("words"))
    rows = rows.select("id", "held", "raw", F.transform("words", lambda w: F.xxhash64(w)).alias("tokens"))

    counted = rows.select("held", "raw", "tokens").mapInArrow(_count, "kind int, key long, n long")
    counted = settle(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = counted.filter("kind = 1").select("key", "n")
    grams = gram_table(counted.filter("kind = 0").select("key", "n"))
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_types = int(total["n"]), int(total["v"])
    norm = float(np.log10(n_all + 0.1 * (n_types + 1)))

    head_t, all_t = _head(tokens, TOKENS_BOUND)
    head_g, all_g = _head(grams, GRAMS_BOUND)
    shipped = spark.sparkContext.broadcast((_arrays(head_t, "n", np.int64), _arrays(head_g, "logp", np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, by_gram = shipped.value
        for batch in batches:
            raw, rows = batch.column("raw"), batch.num_rows
            lists = batch.column("tokens")
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            n_bytes = np.diff(_offsets(raw))
            known, base, logp = np.zeros(rows, dtype=np.int64), np.zeros(rows), np.zeros(rows)
            more = {"tokens": [], "grams": []}  # (keys, rows) that the tables lack
            for lo, hi in pieces(n_bytes):
                t = flat[ends[lo] : ends[hi]]
                who = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
                c, found = by_token.get(t)
                if all_t:
                    found[:] = True
                known[lo:hi] = np.bincount(who, (c > 0) & found, hi - lo)
                base[lo:hi] = np.bincount(who, np.where(found, np.log10(c + 0.1) - norm, 0.0), hi - lo)
                more["tokens"].append((t[~found], who[~found] + lo))
                g, who = text_grams(raw[lo:hi].to_pylist())
                g = g.view(np.int64)
                v, hit = by_gram.get(g)
                logp[lo:hi] = np.bincount(who, v.astype(np.float64), hi - lo)
                more["grams"].append((g[~hit], who[~hit] + lo))
            rest, tail = (_by_row(*(np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (zip(*more[k]) if more[k] else ((), ()))), rows) for k in ("tokens", "grams"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(np.diff(ends).astype(np.int64)), pa.array(known), pa.array(base), pa.array(logp), pa.array(n_bytes.astype(np.int64)), rest, tail],
                ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes", "more_tokens", "more_grams"],
            )
            pa.default_memory_pool().release_unused()

    id_type = dict(docs.dtypes)[id_col]
    out = rows.mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, more_tokens array<long>, more_grams array<long>")
    if not (all_t and all_g):
        out = settle(out.withColumn("row", F.monotonically_increasing_id()))
        t = out.select("row", F.explode("more_tokens").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k")).join(tokens, "key", "left")
        c = F.coalesce("n", F.lit(0))
        t = t.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known2"), F.sum(F.col("k") * (F.log10(c + 0.1) - norm)).alias("base2"))
        g = out.select("row", F.explode("more_grams").alias("key")).groupBy("row", "key").agg(F.count("*").alias("k")).join(grams, "key")
        g = g.groupBy("row").agg(F.sum(F.col("k") * F.col("logp").cast("double")).alias("score2"))
        zero = F.lit(0.0)
        out = out.join(t, "row", "left").join(g, "row", "left").withColumns(
            {"n_known": F.col("n_known") + F.coalesce("known2", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("base2", zero), "score": F.col("score") + F.coalesce("score2", zero)}
        )
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")

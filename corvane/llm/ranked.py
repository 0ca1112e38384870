"""Ranked lexical search: posting blocks of variable size, chosen by dynamic programming, and exact block-skipping search of every shard.

Documents are indexed where they are read: a task cuts its rows into shards of at most SHARD_DOCS documents
or SHARD_POSTINGS postings and writes a row for each, the postings of its terms as typed arrays. Nothing is shuffled for
the index. Statistics (documents, terms, documents of a term) are summed over these rows, map-side.

Each list is then cut into blocks so that bound error (a block's largest impact less the posting's own, summed over the
postings) plus BLOCK_COST a block is least; cuts may stand after every STEP postings, and a block has at most
STEP * REACH of them. Of a query, a document's bound is the sum of the largest impacts of the blocks that cover it, times the
terms' weights. Documents are scored from the highest bound down, opening only the blocks that reach them, until no
bound reaches the k-th best score; a bound equal to it is still opened, since the smaller id wins a tie. A task keeps
its k best of a query from shard to shard, so later shards begin with a threshold, and a shard whose lists together
stay under it is skipped whole. Results are exact: all scores are 64-bit integers.

Queries are worked on in blocks of at most QUERY_BYTES, each shipped to the workers; the terms indexed are those of the
queries if they fit in TERM_BYTES, or else all.

Defined cases: a null or empty text has no terms and is not counted; a null id ranks before all others in a tie; repeated rows are documents of
their own; rows of one item id make one query; a query without terms, or whose terms stand nowhere, has no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.llm.common import settle, small_batches, weigh

SHARD_DOCS, SHARD_POSTINGS = 8_192, 1 << 20
STEP, REACH = 8, 32  # postings between possible cuts; steps in the longest block
BLOCK_COST = 4_000_000  # bound error that a further block must save; an impact is at most a million
FIRST = 32  # documents scored for a first threshold
TERM_BYTES, QUERY_BYTES = 16 << 20, 16 << 20

# a byte of a term stands for itself, in lower case; any other for a blank
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

SHARD = "docs array<bigint>, lens array<bigint>, terms array<string>, starts array<bigint>, doc array<int>, tf array<bigint>"
_ARROW = pa.schema([("docs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("doc", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])


def text_terms(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


@F.arrow_udf(ArrayType(StringType()))
def distinct_terms(text: pa.Array) -> pa.Array:
    found = [sorted(set(text_terms(t or b""))) for t in text.cast(pa.binary()).to_pylist()]
    return pa.array([[w.decode() for w in ws] for ws in found], pa.list_(pa.string()))


def indexer(vocabulary: frozenset[bytes] | None) -> Callable:
    """Arrow batches of (id, text) -> rows of SHARD. A shard's `docs` and `lens` are its documents with a term; `doc` points into them."""

    def shard(docs: list, lens: list, lists: dict[bytes, tuple[list, list]]) -> pa.RecordBatch:
        terms = sorted(lists)
        starts = np.cumsum([0, *[len(lists[t][0]) for t in terms]])
        doc = np.fromiter((d for t in terms for d in lists[t][0]), dtype=np.int32, count=starts[-1])
        tf = np.fromiter((f for t in terms for f in lists[t][1]), dtype=np.int64, count=starts[-1])
        row = {"docs": docs, "lens": lens, "terms": [t.decode() for t in terms], "starts": starts, "doc": doc, "tf": tf}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _ARROW], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, lens, lists, size = [], [], {}, 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text_terms(text or b"")
                if not words:
                    continue
                counts = Counter(words)
                for w in counts if vocabulary is None else vocabulary & counts.keys():
                    own = lists.setdefault(w, ([], []))
                    own[0].append(len(docs))
                    own[1].append(counts[w])
                    size += 1
                docs.append(id_)
                lens.append(len(words))
                if len(docs) >= SHARD_DOCS or size >= SHARD_POSTINGS:
                    yield shard(docs, lens, lists)
                    docs, lens, lists, size = [], [], {}, 0
        if docs:
            yield shard(docs, lens, lists)

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of SHARD, settled: an index of all terms, or of those in `terms` (column term, settled) if they fit in TERM_BYTES."""
    vocabulary = None
    if terms is not None:
        _, size = weigh(terms, F.octet_length("term") + 64)
        if size <= TERM_BYTES:
            vocabulary = frozenset(r["term"].encode() for r in terms.collect())
    with small_batches(docs.sparkSession):
        return settle(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(indexer(vocabulary), SHARD))


def weights(index: DataFrame, terms: DataFrame) -> tuple[int, int, DataFrame]:
    """Documents and terms in all, and the weight of each term that stands somewhere: term, w."""
    all_ = index.agg(F.coalesce(F.sum(F.size("docs").cast("long")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("aggregate(lens, 0L, (a, x) -> a + x)")), F.lit(0)).alias("l")).first()
    size = F.expr("transform(terms, (t, i) -> struct(t as term, starts[i + 1] - starts[i] as df))")
    df = index.select(F.inline(size)).join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2 * F.lit(all_["n"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return all_["n"], all_["l"], df.select("term", w.cast("long").alias("w"))


def cut(impacts: np.ndarray) -> np.ndarray:
    """Bounds of the blocks of a list, 0 and its length included: those of the least bound error plus BLOCK_COST a block."""
    n = len(impacts)
    edges = np.append(np.arange(0, n, STEP), n)
    if len(edges) <= 2:
        return edges
    top = np.maximum.reduceat(impacts, edges[:-1])
    steps = len(top)
    cost, back = np.zeros(steps + 1, dtype=np.int64), np.zeros(steps + 1, dtype=np.int64)
    for j in range(steps):  # the postings' own impacts are the same in every cut, so only the bounds count
        i = max(0, j + 1 - REACH)
        high = np.maximum.accumulate(top[i : j + 1][::-1])[::-1]
        total = cost[i : j + 1] + high * (edges[j + 1] - edges[i : j + 1])
        best = int(total.argmin())
        cost[j + 1], back[j + 1] = total[best] + BLOCK_COST, i + best
    out, j = [n], steps
    while j:
        j = int(back[j])
        out.append(edges[j])
    return np.array(out[::-1])


class Shard:
    """Postings of one row of the index: per term the documents and impacts, and the blocks that cover them."""

    def __init__(self, row: dict, n: int, length: int):
        self.docs = row["docs"]
        lens = np.array(row["lens"], dtype=np.int64)
        m = 100 - 90 + (90 * lens * n) // length
        self.lists = {}
        starts, doc, tf = row["starts"], np.array(row["doc"], dtype=np.int64), np.array(row["tf"], dtype=np.int64)
        for term, lo, hi in zip(row["terms"], starts[:-1], starts[1:]):
            d, f = doc[lo:hi], tf[lo:hi]
            impacts = (1_000_000_000 * f) // (1000 * f + 8 * m[d])
            at = cut(impacts)
            self.lists[term] = d, impacts, at, np.maximum.reduceat(impacts, at[:-1])

    def bounds(self, query: list[tuple[str, int]]) -> np.ndarray:
        """Of each document, the sum of w times the largest impact over the blocks that cover it."""
        steps = np.zeros(len(self.docs) + 1, dtype=np.int64)
        for term, w in query:
            d, _, at, top = self.lists[term]
            np.add.at(steps, d[at[:-1]], w * top)
            np.subtract.at(steps, d[at[1:] - 1] + 1, w * top)
        return np.cumsum(steps[:-1])

    def scores(self, query: list[tuple[str, int]], some: np.ndarray) -> np.ndarray:
        """Exact scores of the documents in `some` (sorted), from the blocks that reach them."""
        out = np.zeros(len(some), dtype=np.int64)
        for term, w in query:
            d, impacts, at, _ = self.lists[term]
            block = np.searchsorted(d[at[1:] - 1], some)  # the first block that ends at the document or after it
            inside = np.flatnonzero(block < len(at) - 1)
            inside = inside[d[at[block[inside]]] <= some[inside]]
            place = np.searchsorted(d, some[inside])
            found = d[place] == some[inside]
            out[inside[found]] += w * impacts[place[found]]
        return out


def best_of(scores: np.ndarray, ids: list, k: int) -> list[tuple[int, int | None]]:
    """The k best (score, id): higher scores first, then smaller ids, null before all."""
    floor = np.partition(scores, -k)[-k] if len(scores) > k else 0
    some = [(int(s), i) for s, i in zip(scores, ids) if s >= floor and s > 0]
    return sorted(some, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))[:k]


def search_shard(shard: Shard, query: list[tuple[str, int]], best: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    """The k best (score, id) of `best` and the shard."""
    query = [(t, w) for t, w in query if w > 0 and t in shard.lists]
    least = best[-1][0] if len(best) == k else 1
    if sum(w * int(shard.lists[t][3].max()) for t, w in query) < least:
        return best
    bounds = shard.bounds(query)
    live = np.flatnonzero(bounds >= least)
    live = live[np.argsort(-bounds[live], kind="stable")]
    at, size = 0, max(FIRST, k)
    while at < len(live) and bounds[live[at]] >= least:
        some = np.sort(live[at : at + size])
        some = some[bounds[some] >= least]
        found = shard.scores(query, some)
        keep = np.flatnonzero(found >= least)
        ids = [shard.docs[i] for i in some[keep]]
        best = best_of(np.append(found[keep], [s for s, _ in best]).astype(np.int64), ids + [i for _, i in best], k)
        least = best[-1][0] if len(best) == k else 1
        at, size = at + size, size * 2
    return best


def searcher(queries: list[tuple[int, list[tuple[str, int]]]], n: int, length: int, k: int) -> Callable:
    """Arrow batches of SHARD -> query, doc_id, score: the k best of a task's shards for each query (its number, terms and weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {q: [] for q, _ in queries}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({f.name: batch.column(f.name)[i].as_py() for f in _ARROW}, n, length)
                for q, query in queries:
                    best[q] = search_shard(shard, query, best[q], k)
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_col, rank, doc_id, score: the k best documents of each item. index: of `build_index`, over at least the items' terms."""
    wanted = settle(item_terms(items, item_col, text_col))
    n, length, w = weights(index, wanted.select("term").distinct())
    own = F.sort_array(F.collect_list(F.struct("term", "w")))
    queries = wanted.join(w, "term").groupBy("item").agg(own.alias("terms"))
    size = F.expr("aggregate(terms, 64L, (a, t) -> a + octet_length(t.term) + 64)")
    queries = settle(queries.select("item", "terms", size.alias("size"), F.xxhash64("item").alias("h")))
    _, total = weigh(queries, F.col("size"))
    blocks = -(-total // QUERY_BYTES) or 1
    found = None
    for b in range(blocks):  # as many passes over the postings as the queries fill blocks
        some = queries.filter(F.pmod("h", F.lit(blocks)) == b).orderBy("item").collect()
        task = searcher([(i, [(t["term"], t["w"]) for t in r["terms"]]) for i, r in enumerate(some)], n, length, k)
        names = index.sparkSession.createDataFrame([(i, r["item"]) for i, r in enumerate(some)], f"query long, item {queries.schema['item'].dataType.simpleString()}")
        part = index.mapInArrow(task, "query long, doc_id long, score long").join(F.broadcast(names), "query").select("item", "doc_id", "score")  # names: a part of the block
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))  # a group limit: each task sends k rows a query
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", "doc_id", "score")


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, term: the distinct terms of each item."""
    return items.select(F.col(item_col).alias("item"), F.explode(distinct_terms(F.col(text_col))).alias("term")).distinct()


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score over an index of the items' terms."""
    terms = settle(item_terms(items).select("term").distinct())
    index = build_index(docs, terms)
    with small_batches(docs.sparkSession):
        return settle(search(index, items, k))

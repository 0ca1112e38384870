"""Full-text search: postings, a prefix dictionary over them, prefix queries, tag queries, excerpts. Rank: title, then content, then tags; then id.

Postings can be searched as they come from `postings`, in one scan, or through `prefix_index`: ranges of terms, each sorted and
kept in a folder of its own, with a dictionary of the first and last term of each. A query then reads the ranges in
which a term can begin with one of its words, and within them the row groups whose bounds allow it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import search_tokens
from corvane.sources.scratch import new_path, settle

BLOCK_ROWS = 1 << 22  # postings of a range of the prefix dictionary


def postings(pages: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, field, term, n. fields: field -> column of text."""
    out = None
    for f, col in fields.items():
        p = pages.select(key, F.lit(f).alias("field"), F.explode(search_tokens(F.col(col))).alias("term"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key, "field", "term").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class PrefixIndex:
    """dictionary: block, first, last, n, one row a block. rows: postings with their block, in folders by block."""

    dictionary: DataFrame
    rows: DataFrame

    def opened(self, query: list[str]) -> list[int]:
        """The blocks in which a term can begin with a word of the query."""
        reach = [(F.col("last") >= q) & ((F.col("first") <= q) | F.startswith("first", F.lit(q))) for q in query]
        return sorted(r["block"] for r in self.dictionary.filter(reduce(lambda a, b: a | b, reach)).select("block").collect())

    def holding(self, query: list[str]) -> DataFrame:
        """The postings of the blocks that the query opens."""
        return self.rows.filter(F.col("block").isin(self.opened(query))).drop("block")


def prefix_index(index: DataFrame, key: str, block_rows: int = BLOCK_ROWS, path: str | None = None) -> PrefixIndex:
    """Postings dealt over ranges of terms, sorted, with their dictionary. A frequent term's postings fill several blocks."""
    spark = index.sparkSession
    own = settle(index)  # a range shuffle reads its input twice
    blocks = max(1, -(-own.count() // block_rows))
    path = path or new_path(spark, "prefix-index")
    dealt = own.repartitionByRange(blocks, "term", "field", key).sortWithinPartitions("term", "field", key)
    dealt.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in own.dtypes)}, block int").parquet(f"{path}/rows")
    rows.groupBy("block").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count("*").alias("n")).write.parquet(f"{path}/dictionary")
    return PrefixIndex(spark.read.schema("block int, first string, last string, n long").parquet(f"{path}/dictionary"), rows)


def matches(index: DataFrame | PrefixIndex, key: str, query: list[str], fields: tuple[str, ...]) -> DataFrame:
    """key, field: documents whose field holds, for every query word, a term that begins with it. One scan serves all fields."""
    rows = index.holding(query) if isinstance(index, PrefixIndex) else index
    starts = [F.startswith("term", F.lit(q)) for q in query]
    any_ = reduce(lambda a, b: a | b, starts)
    every = reduce(lambda a, b: a & b, [F.bool_or(s) for s in starts])
    hit = rows.filter(F.col("field").isin(list(fields)) & any_).groupBy(key, "field").agg(every.alias("all"))
    return hit.filter("all").select(key, "field")


def search(index: DataFrame | PrefixIndex, key: str, query: list[str], fields: tuple[str, ...] = ("title", "content", "tags"), limit: int = 8) -> DataFrame:
    """key, rank: first `limit` of each field in turn, a document once, by its first field."""
    place = F.row_number().over(Window.partitionBy("field").orderBy(key))  # a group limit, so each task sends `limit` rows a field
    found = matches(index, key, query, fields).withColumn("place", place).filter(F.col("place") <= limit)
    rank = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field")) - 1
    return found.groupBy(key).agg(F.min(rank).cast("int").alias("rank"))


def search_tag(index: DataFrame | PrefixIndex, tags: DataFrame, key: str, tag: str, query: list[str], limit: int = 8) -> DataFrame:
    """The same over title and content, of the documents that carry the tag. tags: key, tag."""
    own = tags.filter(F.col("tag") == tag).select(key).distinct()
    if not query:
        return own.orderBy(key).limit(limit).withColumn("rank", F.lit(0))
    rows = index.holding(query) if isinstance(index, PrefixIndex) else index
    return search(rows.join(own, key, "left_semi"), key, query, ("title", "content"), limit)


def excerpt(docs: DataFrame, key: str, text: str, terms: list[str], width: int = 30) -> DataFrame:
    """key, start, hits, excerpt: the window of `width` words with most hits, the last one on a tie; twice the width is shown from `width` before it."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    hit = lambda w: reduce(lambda a, b: a | b, [F.contains(F.lower(w), F.lit(t)) for t in terms])
    d = docs.select(key, words.alias("w"))
    # a best window begins at a hit, or anywhere if there is none, so only hits leave their row
    at = F.filter(F.transform("w", lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    near = Window.partitionBy(key).orderBy("i").rangeBetween(0, width - 1)
    each = d.select(key, F.explode(at).alias("i")).withColumn("hits", F.count("*").over(near))
    best = each.groupBy(key).agg(F.max(F.struct("hits", "i")).alias("b"))
    j = d.filter(F.size("w") > 0).join(best, key, "left")
    start = F.greatest(F.coalesce("b.i", F.size("w") - 1) - width, F.lit(0))
    return j.select(key, start.alias("start"), F.coalesce("b.hits", F.lit(0)).alias("hits"), F.array_join(F.slice("w", start + 1, F.lit(2 * width)), " ").alias("excerpt"))


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    from corvane.functions.text import alternation

    return F.regexp_replace(text, rf"(?iU)({alternation(terms)})", f"{before}$1{after}")

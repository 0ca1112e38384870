"""Similarity, centroids, association tests and sampling over embedding columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from corvane.config import Placement
from corvane.functions.text import escape_regex, trie
from corvane.functions.vectors import best_dots, cosine


class Encoder(Protocol):
    """Turns texts into unit vectors. Production plugs a model in; `HashEncoder` stands in for tests."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in: signed hashed words, normalised."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def encode(df: DataFrame, encoder: Encoder, text_col: str, out: str = "vec") -> DataFrame:
    """Adds the encoding of a text column, null for null. Nothing is shuffled; texts that repeat in a batch are encoded once."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes, own = pd.factorize(texts)  # -1 for null
            vecs = [v.tolist() for v in encoder.encode(list(own))] if len(own) else []
            yield pd.Series([vecs[c] if c >= 0 else None for c in codes], dtype=object)

    return df.withColumn(out, run(F.col(text_col)))


def encode_placed(df: DataFrame, encoder: Encoder, text_col: str, out: str, place: Placement) -> DataFrame:
    """The same as a stage of its own, with the placement's resources and no more texts at a time than its batch."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, own = pd.factorize(batch.column(text_col).to_pandas())
            parts = [encoder.encode(list(own[i : i + place.batch])) for i in range(0, len(own), place.batch)]
            vecs = np.concatenate(parts) if parts else np.zeros((0, encoder.dim))
            column = pa.array([vecs[c].tolist() if c >= 0 else None for c in codes], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, out])

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, `{out}` array<double>", profile=place.profile())


BANK_BOUND = 10_000  # prompts of all banks together, which every task gets as one row


def bank_scores(df: DataFrame, banks: DataFrame, names: list[str], key: str, vec: str = "embedding") -> DataFrame:
    """key and one column a bank: the best dot product, null for an empty bank. banks: bank, bvec; at most BANK_BOUND prompts, which go along with the function."""
    rows = banks.filter(F.col("bank").isin(names)).select("bank", "bvec").limit(BANK_BOUND + 1).collect()
    if len(rows) > BANK_BOUND:
        raise ValueError("too many prompts for a broadcast")
    matrices = [np.array([r["bvec"] for r in rows if r["bank"] == n], dtype=float) for n in names]
    scored = df.select(key, best_dots(F.col(vec), matrices).alias("__best"))
    return scored.select(key, *[F.col("__best")[i].alias(n) for i, n in enumerate(names)])


def semantic_scores(df: DataFrame, banks: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """key, pos, neg, margin: best dot product with the banks `pos` and `neg`."""
    return bank_scores(df, banks, ["pos", "neg"], key, vec).withColumn("margin", F.col("pos") - F.col("neg"))


def disambiguate(pos: Column, neg: Column, floor: float = 0.26, margin: float = 0.04) -> Column:
    """Whether a focus context carries the group sense."""
    return (pos >= floor) & (pos - neg >= margin)


def admit_frames(pos: Column, neg: Column, floor: float = 0.55, margin: float = 0.04) -> Column:
    """Sign with which a candidate term enters the frame inventory, 0 if it does not."""
    far = (F.greatest(pos, neg) >= floor) & (F.abs(neg - pos) >= margin)
    return F.when(far, F.when(neg > pos, -1).otherwise(1)).otherwise(0)


def attitude_label(pos: Column, neg: Column, floor: float = 0.24, margin: float = 0.02) -> Column:
    strong = (F.greatest(pos, neg) >= floor) & (F.abs(pos - neg) >= margin)
    return F.when(strong, F.when(neg > pos, "negAttI").otherwise("posAttI"))


def centroids(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """key, centroid: mean vector. Sums by (key, position), so that no group is gathered."""
    each = df.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(key, F.transform("p", lambda s: s["x"]).alias("centroid"))


def weat(vec: Column, neg: Column, pos: Column) -> Column:
    """Cosine to the negative centroid less cosine to the positive one."""
    return cosine(vec, neg) - cosine(vec, pos)


def vector_literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


@F.arrow_udf(BinaryType())
def context_digest(text: pa.Array) -> pa.Array:
    """blake2b of eight bytes."""
    return pa.array([None if t is None else hashlib.blake2b(t, digest_size=8).digest() for t in text.cast(pa.binary()).to_pylist()], pa.binary())


def stable_sample(df: DataFrame, key: str, text: str, most: int = 500, digest: Callable[[Column], Column] = context_digest) -> DataFrame:
    """At most `most` rows of each key: the lowest digests of key, tab and text. The rank filter becomes a group limit before the shuffle."""
    value = digest(F.concat_ws("\t", F.col(key).cast("string"), F.col(text).cast("string")))
    w = Window.partitionBy(key).orderBy("__digest", text)
    return df.withColumn("__digest", value).withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= most).drop("__digest", "__rank")


def ceat_summary(values: DataFrame, key: str, value: str = "assoc", least: int = 10) -> DataFrame:
    """key, n, mean, sd (0 for one value), se of the keys with enough contexts."""
    out = values.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s")).filter(F.col("n") >= least)
    return out.select(key, "n", F.round("m", 4).alias("mean"), F.round("s", 4).alias("sd"), F.round(F.col("s") / F.sqrt("n"), 4).alias("se"))


def context_lemmas(lines: DataFrame, terms: list[str], col: str = "line") -> DataFrame:
    """Every distinct term that a line holds; blanks and hyphens inside a term match each other, longer terms first."""
    gap = r"[\s-]+"
    units = [[c for p in t.replace("-", " ").split() for c in (gap, *map(escape_regex, p))][1:] for t in terms]
    found = F.regexp_extract_all(F.lower(F.col(col)), F.lit(rf"(?U)(?<!\w)(?:{trie(units)})(?!\w)"), F.lit(0))
    norm = F.transform(found, lambda x: F.regexp_replace(x, r"[\s-]+", " "))
    return lines.withColumn("lemma", F.explode(F.array_distinct(norm)))

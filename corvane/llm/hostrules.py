"""Host-level quality rules: rule failures by host, shrunk with an empirical beta prior, joined back to documents.

Every text is measured once, whole, in Arrow batches. A host's failures of each rule are counted map-side,
so a hot host is one row a task. The rate of a rule in a host is (f + s*m) / (n + s): m is the rule's rate
over all documents, s the strength of a beta prior fitted by moments to the hosts' rates (the beta-binomial's
correlation). Small hosts stay near m, large ones near their own rate. A host is bad, and so are all its documents, if
a rate less CERTAINTY standard deviations of its posterior is above `limit`: a few failures of a small host are not
enough. A document that breaks the base rules itself is dropped whatever its host.

Defined cases: a null text is empty, has no words and breaks the rule of length; a document without a host has
no host's verdict, so only the base rules hold; repeated rows count as often as they stand there; a table without
rows gives none; a rule that all documents keep, or all break, has the same rate in every host; other columns of
the documents are ignored by `judge` and kept by `keep_documents` (those beginning `__` are reserved).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.llm.common import settle, small_batches, spread_join

BLANKS = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
TAILS = bytes(range(0x80, 0xC0))  # bytes that begin no code point
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
LIMIT = 0.5  # rate of a rule's failures beyond which a host is bad
CERTAINTY = 1.0
LEAST_CORRELATION = 1e-6  # of a host's documents: hosts that differ by less are taken for alike
WINDOW = 3


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of `window` words found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    code = ids[:n]
    for k in range(1, window):
        if k > 1:  # keeps codes below the square of the number of words
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(number) + ids[k : n + k]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    hit = np.zeros(len(words), dtype=bool)
    for k in range(window):
        hit[k : n + k] |= again
    return int(hit.sum())


def measures(text: bytes) -> tuple[int, ...]:
    """MEASURES of one text in UTF-8."""
    words = text.split()  # bytes: at the six blanks of ASCII alone
    lines = [x for x in text.split(b"\n") if x.strip()]
    shown = len(text.translate(None, BLANKS + TAILS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), shown, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


@F.arrow_udf(StructType([StructField(m, LongType()) for m in MEASURES]))
def measure(text: pa.Array) -> pa.Array:
    found = np.array([measures(t or b"") for t in text.cast(pa.binary()).to_pylist()], dtype=np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(MEASURES))], list(MEASURES))


def rules(of: str = "") -> dict[str, Column]:
    """Rules over the measures (fields of `of`, as in "m."): true where a document breaks one. The first two are the base."""
    n, chars, symbols, again, repeats, lines = (F.col(of + m) for m in MEASURES)
    return {
        "short": n < 50,
        "repeats": 100 * repeats > 50 * n,
        "symbols": 100 * symbols > 10 * n,
        "lines": 100 * again > 30 * lines,
        "lengths": (n > 0) & ((chars < 3 * n) | (chars > 12 * n)),
    }


def base_failed(of: str = "") -> Column:
    return rules(of)["short"] | rules(of)["repeats"]


def host_rates(measured: DataFrame, host_col: str) -> DataFrame:
    """host, n and, for each rule, `rate_<rule>`, the shrunken rate, and `low_<rule>`, its lower bound. measured: host_col and the measures."""
    by = rules()
    hosts = measured.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host"))
    hosts = settle(hosts.agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in by.items()]))
    sums = [x for r in by for x in (F.sum(f"f_{r}").alias(f"s_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}"))]
    all_ = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), *sums).first()
    docs, n_hosts = all_["docs"] or 0, all_["hosts"]

    def rates(rule: str) -> list[Column]:
        m = all_[f"s_{rule}"] / docs if docs else 0.0
        if m in (0.0, 1.0):
            return [F.lit(m).alias(f"rate_{rule}"), F.lit(m).alias(f"low_{rule}")]
        # the hosts' squared deviations: m(1-m) * (hosts + correlation * (docs - hosts)) is expected
        apart = (all_[f"q_{rule}"] - m * m * docs) / (m * (1 - m))
        correlation = min(1.0, max(LEAST_CORRELATION, (apart - n_hosts) / (docs - n_hosts) if docs > n_hosts else 1.0))
        strength = 1 / correlation - 1
        rate = (F.col(f"f_{rule}") + strength * m) / (F.col("n") + strength)
        return [rate.alias(f"rate_{rule}"), (rate - CERTAINTY * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))).alias(f"low_{rule}")]

    return hosts.select("host", "n", *[c for r in by for c in rates(r)])


def bad_hosts(measured: DataFrame, host_col: str, limit: float = LIMIT) -> DataFrame:
    """__host, n, bad (true): the hosts with a rate surely above the limit."""
    above = reduce(lambda a, b: a | b, [F.col(f"low_{r}") > limit for r in rules()])
    return settle(host_rates(measured, host_col).filter(above).select(F.col("host").alias("__host"), "n", F.lit(True).alias("bad")))


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """id_col, __host, the measures, base_failed, kept: one row a document."""
    m = docs.select(F.col(id_col), F.col(host_col).alias("__host"), measure(F.col(text_col)).alias("m"))
    with small_batches(docs.sparkSession):
        rows = settle(m.select(id_col, "__host", "m.*"))
    j = spread_join(rows, bad_hosts(rows, "__host", limit), "__host", "n", "left")
    return j.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad")


def keep_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The documents that are kept, with their own columns. Texts stay where they are: only measures and verdicts move."""
    spark = docs.sparkSession
    host = docs.select(F.col(host_col).alias("__host"), measure(F.col(text_col)).alias("m"))
    with small_batches(spark):
        bad = bad_hosts(settle(host.select("__host", "m.*")), "__host", limit)
    rows = docs.select(*docs.columns, F.col(host_col).alias("__host"), measure(F.col(text_col)).alias("__m"))
    j = spread_join(rows, bad, "__host", "n", "left")
    return j.filter(~base_failed("__m.") & F.col("bad").isNull()).select(*docs.columns)

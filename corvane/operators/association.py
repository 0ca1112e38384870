"""Non-adjacent collocation: sentence counts of (target, collocate) pairs, log-likelihood ratio and logDice.

A pair counts in a sentence when some occurrence of the target and some of the collocate are at least
`min_distance` words apart. With first and last positions of both words, that is
greatest(last_a - first_b, last_b - first_a) >= min_distance, so no pair of positions is formed.

Sentences are counted where they are read, an Arrow batch at a time: words become integers, one sort by (sentence, word) gives
first and last positions, and pairs come from the targets' spans alone. A task hands on a batch's counts, not its words; Spark
combines them before its only shuffle. Work is n log n in the words, however long a sentence is.

sents: words, an array; tags, if the column is there, the part of speech of each word. With tags, collocates are the
words whose part of speech is one of `pos`; without, the words of at least `min_length` characters. Targets and
the terms of `lexicon` (those of all groups) are never collocates. A null array has no words; it counts as a sentence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.scratch import settle

CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV")
PAIRS_AT_ONCE = 1 << 20  # pairs of spans that stand in memory


class Spans:
    """Of a batch, one entry for each (sentence, word) that is a target or a collocate, by sentence: number of the sentence, code of the word, first and last position."""

    def __init__(self, words: pa.ListArray, tags: pa.ListArray | None, targets: list[str], lexicon: list[str], pos: Sequence[str], min_length: int):
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        flat = words.flatten().dictionary_encode()
        self.names = flat.dictionary
        among = lambda terms: pc.is_in(self.names, pa.array(terms, self.names.type)).to_numpy(zero_copy_only=False)
        code = pc.fill_null(flat.indices, -1).to_numpy().astype(np.int64)
        sentence = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        wanted = among(targets)
        is_target = np.append(wanted, False)[code]  # -1, a null word, is neither
        allowed = np.append(~(wanted | among(lexicon)), False)[code]
        if tags is None:
            long = pc.greater_equal(pc.utf8_length(self.names), min_length).to_numpy(zero_copy_only=False)
            allowed &= np.append(long, False)[code]
        else:
            allowed &= pc.fill_null(pc.is_in(tags.flatten(), pa.array(list(pos), pa.string())), False).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(is_target | allowed)
        key = sentence[keep] * max(1, len(self.names)) + code[keep]
        order = np.argsort(key, kind="stable")
        key, keep = key[order], keep[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(key)) - 1 if len(key) else first
        self.sentence, self.code = sentence[keep[first]], code[keep[first]]
        self.lo, self.hi, self.target = at[keep[first]], at[keep[last]], is_target[keep[first]]

    def pairs(self, min_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the target's and the collocate's span, of pairs at the distance, a bounded number at a time."""
        t = np.flatnonzero(self.target)
        begin, end = (np.searchsorted(self.sentence, self.sentence[t], side) for side in ("left", "right"))
        total = np.cumsum(end - begin)
        cuts = np.unique(np.searchsorted(total, np.arange(0, (total[-1] if len(t) else 0) + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "left"))
        for i, j in zip(cuts, np.append(cuts[1:], len(t))):
            n = (end - begin)[i:j]
            a = np.repeat(t[i:j], n)
            b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[i:j], n)
            apart = np.maximum(self.hi[a] - self.lo[b], self.hi[b] - self.lo[a]) >= min_distance
            apart &= ~self.target[b]
            yield a[apart], b[apart]


def _spans(sents: DataFrame, targets: list[str], lexicon: Sequence[str], pos: Sequence[str], min_length: int) -> Callable[[pa.RecordBatch], Spans]:
    tagged, targets, lexicon = "tags" in sents.columns, sorted(targets), sorted(lexicon)

    def of(batch: pa.RecordBatch) -> Spans:
        return Spans(batch.column("words"), batch.column("tags") if tagged else None, targets, lexicon, pos, min_length)

    return of


def _columns(sents: DataFrame, *keep: str) -> DataFrame:
    if "tags" not in sents.columns:
        return sents.select(*keep, "words")
    tags = F.when(F.size("tags") == F.size("words"), F.col("tags")).otherwise(F.transform("words", lambda w: F.lit("")))  # words without parts of speech
    return sents.select(*keep, "words", tags.alias("tags"))


def sentence_pairs(sents: DataFrame, targets: list[str], min_distance: int = 2, min_length: int = 3, lexicon: Sequence[str] = (), pos: Sequence[str] = CONTENT_POS) -> DataFrame:
    """doc_id, sent_pos, target, collocate: pairs at the distance, once a sentence. sents: doc_id, sent_pos, words and perhaps tags."""
    spans = _spans(sents, targets, lexicon, pos, min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = spans(batch)
            for a, b in s.pairs(min_distance):
                own = [batch.column(c).take(pa.array(s.sentence[a])) for c in ("doc_id", "sent_pos")]
                yield pa.RecordBatch.from_arrays([*own, s.names.take(pa.array(s.code[a])), s.names.take(pa.array(s.code[b]))], ["doc_id", "sent_pos", "target", "collocate"])

    kinds = dict(sents.dtypes)
    some = sents.filter(F.arrays_overlap("words", F.array(*[F.lit(t) for t in targets])))
    return _columns(some, "doc_id", "sent_pos").mapInArrow(run, f"doc_id {kinds['doc_id']}, sent_pos {kinds['sent_pos']}, target string, collocate string")


def sentence_counts(sents: DataFrame, targets: list[str], min_distance: int = 2, min_length: int = 3, lexicon: Sequence[str] = (), pos: Sequence[str] = CONTENT_POS) -> DataFrame:
    """kind, a, b, n: sentences in all ('t'), of each target and collocate ('w', word) and of each pair ('p', target, collocate). One scan serves all."""
    spans = _spans(sents, targets, lexicon, pos, min_length)

    def rows(kind: str, a: pa.Array, b: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
        b = pa.array([""] * len(a), pa.string()) if b is None else b
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), a, b, pa.array(n, pa.int64())], ["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = spans(batch)
            yield rows("t", pa.array([""]), None, np.array([batch.num_rows]))
            code, n = np.unique(s.code, return_counts=True)
            yield rows("w", s.names.take(pa.array(code)), None, n)
            for a, b in s.pairs(min_distance):
                both, n = np.unique(s.code[a] * max(1, len(s.names)) + s.code[b], return_counts=True)
                x, y = np.divmod(both, max(1, len(s.names)))
                yield rows("p", s.names.take(pa.array(x)), s.names.take(pa.array(y)), n)

    counted = _columns(sents).mapInArrow(run, "kind string, a string, b string, n long")
    return counted.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def pair_counts(sents: DataFrame, targets: list[str], min_count: int = 5, min_distance: int = 2, lexicon: Sequence[str] = ()) -> DataFrame:
    """target, collocate, pair_n."""
    pairs = sentence_counts(sents, targets, min_distance, lexicon=lexicon).filter(f"kind = 'p' and n >= {int(min_count)}")
    return pairs.select(F.col("a").alias("target"), F.col("b").alias("collocate"), F.col("n").alias("pair_n"))


def llr(k11: Column, k12: Column, k21: Column, k22: Column) -> Column:
    """G2 = 2 * sum k ln(k / e) over the contingency table, zero cells skipped, never negative."""
    k = [F.greatest(x.cast("double"), F.lit(0.0)) for x in (k11, k12, k21, k22)]
    n = k[0] + k[1] + k[2] + k[3]
    r1, r2, c1, c2 = k[0] + k[1], k[2] + k[3], k[0] + k[2], k[1] + k[3]

    def term(x: Column, r: Column, c: Column) -> Column:
        return F.when((x > 0) & (r > 0) & (c > 0), x * F.log(x * n / (r * c))).otherwise(F.lit(0.0))

    return F.greatest(F.lit(0.0), 2.0 * (term(k[0], r1, c1) + term(k[1], r1, c2) + term(k[2], r2, c1) + term(k[3], r2, c2)))


def log_dice(pair: Column, t: Column, c: Column) -> Column:
    return F.when(pair > 0, 14 + F.log2(2.0 * pair / (t + c))).otherwise(F.lit(0.0))


def association_scores(sents: DataFrame, targets: dict[str, str], min_count: int = 5, min_distance: int = 2, lexicon: Sequence[str] = (), pos: Sequence[str] = CONTENT_POS) -> DataFrame:
    """target, group_type, collocate, pair_n, target_n, collocate_n, llr, logdice.

    targets: term -> group type. Marginals count sentences regardless of distance; min_count filters
    pairs alone. The counts are read three times, so they are written once; pairs are the small side of every join.
    """
    terms = sorted(targets)
    counts = settle(sentence_counts(sents, terms, min_distance, lexicon=lexicon, pos=pos))
    pairs = counts.filter(f"kind = 'p' and n >= {int(min_count)}").select(F.col("a").alias("target"), F.col("b").alias("collocate"), F.col("n").alias("pair_n"))
    words = counts.filter("kind = 'w'")
    total = counts.filter("kind = 't'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    kinds = F.create_map(*[x for t in terms for x in (F.lit(t), F.lit(targets[t]))])
    p = pairs.join(words.select(F.col("a").alias("collocate"), F.col("n").alias("collocate_n")), "collocate")
    p = p.join(F.broadcast(words.filter(F.col("a").isin(terms)).select(F.col("a").alias("target"), F.col("n").alias("target_n"))), "target")  # one row a target
    p = p.join(F.broadcast(total))  # one row
    k11, t, c = F.col("pair_n"), F.col("target_n"), F.col("collocate_n")
    scored = llr(k11, t - k11, c - k11, F.col("total") - t - c + k11)
    return p.select("target", kinds[F.col("target")].alias("group_type"), "collocate", "pair_n", "target_n", "collocate_n", F.round(scored, 4).alias("llr"), F.round(log_dice(k11, t, c), 4).alias("logdice"))


def association_report(scores: DataFrame, limit: int | None = None) -> DataFrame:
    out = scores.orderBy(F.desc("llr"), F.desc("logdice"), "target", "collocate")
    return out.limit(limit) if limit else out


def signed_association(scores: DataFrame, signs: DataFrame, score_col: str = "llr") -> DataFrame:
    """Score times the sign of a framing collocate. signs: collocate, sign."""
    return scores.join(signs, "collocate").select("target", "collocate", "sign", (F.col("sign") * F.col(score_col)).alias("signed_score"))


def find_candidates(scores: DataFrame, existing: list[str], political: list[str] = (), top: int = 60, min_llr: float = 3.0) -> DataFrame:
    """Collocates that lean to the minority side: best score of each side, the logDice of its row, and who they were found with."""
    s = scores.filter(~F.col("collocate").isin(list(existing)) if existing else F.lit(True))
    s = s.filter(~F.col("target").isin(list(political)) if political else F.lit(True))
    out = {}
    for side in ("minority", "dominant"):
        own = (F.col("group_type") == side) & (F.col("llr") > 0)
        best = F.max(F.when(own, F.struct("llr", "logdice")))
        out[side] = best
    agg = s.groupBy(F.col("collocate").alias("term")).agg(
        out["minority"].alias("m"), out["dominant"].alias("d"), F.sort_array(F.collect_set(F.when(F.col("group_type") == "minority", F.col("target")))).alias("found_with")
    )
    zero = F.lit(0.0)
    cols = [F.coalesce(f"m.{x}", zero).alias(f"minority_{x}") for x in ("llr", "logdice")] + [F.coalesce(f"d.{x}", zero).alias(f"dominant_{x}") for x in ("llr", "logdice")]
    agg = agg.select("term", *cols, "found_with").withColumn("differential", F.round(F.col("minority_llr") - F.col("dominant_llr"), 3))
    agg = agg.filter((F.col("minority_llr") >= min_llr) & (F.col("differential") > 0))
    return agg.orderBy(F.desc("differential"), F.desc("minority_logdice"), "term").limit(top)


def delta_association(full: DataFrame, filtered: DataFrame, keys: list[str], score_col: str) -> DataFrame:
    """Full minus filtered score of the keys that both have."""
    a = full.select(*keys, F.col(score_col).alias("full_score"))
    b = filtered.select(*keys, F.col(score_col).alias("filtered_score"))
    return a.join(b, keys).withColumn("delta", F.round(F.col("full_score") - F.col("filtered_score"), 4))

"""Extraction pipeline: documents to kept, review and dropped sentences.

Gate on documents, split, gate on sentences, similarity, bucket, classify, route. Only the encoder
leaves the JVM; each stage sees what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.config import ExtractionConfig, Placement
from corvane.functions import text as tx
from corvane.functions.vectors import best_dots
from corvane.operators import gates, models, sentences, vectors
from corvane.sources import sinks
from corvane.sources.scratch import settle


class Seen:
    """Rows that pass certain places of a plan, counted by the pass that writes it, so that no count scans the corpus again."""

    PLACES = ("documents_total", "documents_lexical", "total_sentences", "lexical_hits")

    def __init__(self) -> None:
        self._at = {name: Observation() for name in self.PLACES}

    def count(self, df: DataFrame, name: str) -> DataFrame:
        return df.observe(self._at[name], F.count("*").alias("n"))

    def row(self, spark: SparkSession) -> DataFrame:
        """One row of the counts, once the plan has been written."""
        return spark.createDataFrame([tuple(int(self._at[name].get.get("n", 0)) for name in self.PLACES)], ", ".join(f"{name} long" for name in self.PLACES))


def lexical_hits(docs: DataFrame, terms: list[str], c: ExtractionConfig = ExtractionConfig(), seen: Seen | None = None) -> DataFrame:
    """doc_id, sent_pos, sentence of the sentences that hold a gate term."""
    count = seen.count if seen else lambda df, _: df
    d = count(docs.select("doc_id", "text"), "documents_total")
    d = count(gates.lexical_gate(d, terms), "documents_lexical")
    s = count(sentences.sentences(d, c.min_sentence, c.max_sentence), "total_sentences")
    return count(gates.lexical_gate(s, terms, "sentence"), "lexical_hits")


def extract(
    docs: DataFrame, terms: list[str], heads: list[str], encoder: vectors.Encoder, positive: list[str], negative: list[str], model, c: ExtractionConfig = ExtractionConfig(), seen: Seen | None = None, place: Placement | None = None
) -> DataFrame:
    """Routed sentences: doc_id, sent_pos, sentence, pos, neg, margin, bucket, noise_flags, probability, decision, review_flags. One pass over the documents."""
    found = lexical_hits(docs, terms, c, seen)
    hits = vectors.encode_placed(found, encoder, "sentence", "vec", place) if place else vectors.encode(found, encoder, "sentence", "vec")
    best = best_dots(F.col("vec"), [encoder.encode(positive), encoder.encode(negative)])
    scored = hits.withColumn("best", best).withColumns({"pos": F.col("best")[0], "neg": F.col("best")[1]}).withColumn("margin", F.col("pos") - F.col("neg")).drop("best")
    flagged = scored.withColumns({"noise_flags": tx.noise_flags(F.col("sentence")), "human": tx.lexical_human_rescue(F.col("sentence"), terms, heads)})
    b = flagged.withColumn("bucket", gates.bucket(F.col("pos"), F.col("margin"), F.col("human"), c))
    routed = models.relevant_probability(model, b).withColumn("probability", F.when(F.col("bucket") == "REJECT", 0.0).otherwise(F.col("probability")))
    noise = F.size("noise_flags") > 0
    routed = routed.withColumn("decision", gates.route(F.col("bucket"), F.col("probability"), noise, c))
    flags = gates.review_flags(F.col("bucket"), F.col("pos"), F.col("margin"), F.col("probability"), F.col("noise_flags"), c)
    r4 = [F.round(x, 4).alias(x) for x in ("pos", "neg", "margin", "probability")]
    return routed.select("doc_id", "sent_pos", "sentence", *r4, "bucket", "noise_flags", "decision", F.when(F.col("decision") == "review", flags).alias("review_flags"))


SHOWN = {"pos": "semantic_pos", "neg": "semantic_neg", "margin": "semantic_margin", "probability": "relevant_probability"}


def run(docs: DataFrame, terms: list[str], heads: list[str], encoder: vectors.Encoder, positive: list[str], negative: list[str], model, folder: str, c: ExtractionConfig = ExtractionConfig(), place: Placement | None = None) -> dict[str, str]:
    """The whole run: kept and review sheets, the lexical hits as lines, and the report, each below the folder; returns their paths.

    Documents are scanned once: routed rows are written, and what was seen on the way is counted by that pass; every sink reads those rows.
    """
    seen = Seen()
    routed = settle(extract(docs, terms, heads, encoder, positive, negative, model, c, seen, place))
    paths = {name: f"{folder}/{name}" for name in ("kept", "review", "lexical_hits", "report")}
    kept = routed.filter("decision = 'keep'").withColumnsRenamed(SHOWN).select("sentence", *SHOWN.values())
    review = gates.review_rows(routed).withColumnsRenamed(SHOWN).select("bucket", "review_flags", "sentence", *SHOWN.values())
    sinks.write_tsv(kept, folder, "kept")
    sinks.write_tsv(review, folder, "review")
    sinks.write_lines(routed, paths["lexical_hits"])
    flags = lambda f: F.count_if((F.col("decision") == "review") & F.array_contains("review_flags", f)).alias(f"review_{f}")
    of_review = routed.agg(*[flags(f) for f in ("low_margin", "high_semantic_low_classifier", "semantic_rescue", "lexical_human_rescue", "classifier_borderline")])
    report = seen.row(docs.sparkSession).join(gates.extraction_report(routed.withColumn("noise", F.size("noise_flags") > 0))).join(of_review)  # one row each
    sinks.write_report(report, paths["report"])
    return paths

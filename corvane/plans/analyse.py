"""Analysis pipeline: kept sentences to collocations, roles, frames and one profile a group.

Parsed once, mentions and roles resolved in the same pass; everything else is joins and counts over that table. Parser,
lexicon, matcher, role labeller and encoder are the caller's. Only the group tables (one row a group)
reach the driver, for the index and the regressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import AnalysisConfig
from corvane.functions.vectors import cosine
from corvane.operators import annotate, association, frames, lexicon as lex, mentions, models, roles, vectors
from corvane.sources.scratch import settle

KEYS = ["doc_id", "sent_pos"]
EFI = {"pi": 1, "net_atti": 1, "weat": 1, "ceat": 1, "agi": -1, "si": -1}
PREDICTORS = ["agi", "pi", "si", "net_atti"]


@dataclass(frozen=True)
class Seeds:
    """Terms that frame, by sign, and the sentences whose mean vectors stand for the two poles."""

    negative: list[str]
    positive: list[str]
    negative_texts: list[str]
    positive_texts: list[str]


@dataclass(frozen=True)
class Analysis:
    association: DataFrame
    candidates: DataFrame
    inventory: DataFrame
    findings: DataFrame
    sentences: DataFrame
    groups: DataFrame
    index: DataFrame
    regressions: DataFrame


def candidate_rows(found: DataFrame, encoder: vectors.Encoder, seeds: Seeds, c: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Candidates with their closeness to the poles, the sign that suggests, its name, and whether they enter the inventory."""
    neg, pos = (vectors.vector_literal(encoder.encode(t).mean(axis=0)) for t in (seeds.negative_texts, seeds.positive_texts))
    v = vectors.encode(found, encoder, "term", "__vec")
    v = v.withColumns({"frame_neg_sim": F.round(cosine(F.col("__vec"), neg), 4), "frame_pos_sim": F.round(cosine(F.col("__vec"), pos), 4)})
    sign = vectors.admit_frames(F.col("frame_pos_sim"), F.col("frame_neg_sim"), c.frame_floor, c.frame_margin)
    v = v.withColumn("suggested_frame_sign", sign).drop("__vec")
    name = F.when(F.col("suggested_frame_sign") < 0, "negative").when(F.col("suggested_frame_sign") > 0, "positive").otherwise("none")
    return v.withColumns({"suggested_frame_bucket": name, "used_in_frame_inventory": F.col("suggested_frame_sign") != 0})


def context_association(contexts: DataFrame, encoder: vectors.Encoder, neg, pos, c: AnalysisConfig) -> DataFrame:
    """lemma, n, mean, sd, se of sampled contexts (lemma, text)."""
    sample = vectors.stable_sample(contexts, "lemma", "text", c.contexts_max)
    e = vectors.encode(sample, encoder, "text", "vec")
    return vectors.ceat_summary(e.select("lemma", vectors.weat(F.col("vec"), neg, pos).alias("assoc")), "lemma", least=c.contexts_min)


def group_profiles(findings: DataFrame, attitude: DataFrame, kinds, encoder: vectors.Encoder, neg, pos, ceat: DataFrame, ceat_full: DataFrame) -> DataFrame:
    """One row a group: role indices, frame attitude, and association of the term, its kept contexts and all its contexts; zeros for what is missing."""
    idx = roles.group_indices(findings).withColumnsRenamed({"neg_atti": "local_neg_atti", "pos_atti": "local_pos_atti"})
    att = attitude.select("lemma", F.col("neg_atti").alias("frame_neg_atti"), F.col("pos_atti").alias("frame_pos_atti"), "net_atti", F.col("review_share").alias("frame_review"))
    own = vectors.encode(idx.select("lemma").distinct(), encoder, "lemma", "vec").select("lemma", F.round(vectors.weat(F.col("vec"), neg, pos), 4).alias("weat"))
    some = ceat.select("lemma", F.col("mean").alias("ceat"), F.col("n").alias("ceat_n"), F.col("se").alias("ceat_se"))
    full = ceat_full.select("lemma", F.col("mean").alias("ceat_full"), F.col("n").alias("ceat_full_n"), F.col("se").alias("ceat_full_se"))
    out = idx
    for x in (att, own, some, full):
        out = out.join(x, "lemma", "left")
    delta = F.round(F.col("ceat_full") - F.col("ceat"), 4)
    out = out.withColumns({"type": kinds, "delta_ceat": delta}).withColumnRenamed("total", "n")
    return out.fillna(0).select(
        "lemma", "type", "n", "subjecthood", "agi", "pi", "si", "local_neg_atti", "local_pos_atti", "frame_neg_atti", "frame_pos_atti", "net_atti", "frame_review",
        "weat", "ceat", "ceat_n", "ceat_se", "ceat_full", "ceat_full_n", "ceat_full_se", "delta_ceat",
    )


def _words(row: dict) -> list[str]:
    """Lower-cased lemmas, with a mention's group in its token's place."""
    group = {}
    for m in row["mentions"]:
        if not m["is_mwe_child"]:
            group.setdefault(m["token_i"], m["lemma"])
    return [group.get(t["i"]) or t["lemma"].lower() for t in row["tokens"]]


WORDS = [annotate.Step("words", "string", _words), annotate.Step("tags", "string", lambda row: [t["pos"] for t in row["tokens"]])]


def collocations(resolved: DataFrame, group_lexicon: mentions.GroupLexicon, seeds: Seeds, encoder: vectors.Encoder, c: AnalysisConfig = AnalysisConfig()) -> tuple[dict[str, str], DataFrame, DataFrame]:
    """Types of the groups that are named, association scores, and candidates. resolved: mentions, words, tags."""
    named = resolved.select(F.explode("mentions").alias("m")).select("m.lemma").distinct().collect()  # at most pairs of lexicon terms
    kinds = {r["lemma"]: group_lexicon.report_type(r["lemma"]) for r in sorted(named)} or {t: group_lexicon.report_type(t) for t in sorted(group_lexicon.rank)}
    scores = settle(association.association_scores(resolved.select(*KEYS, "words", "tags"), kinds, c.min_pair, c.min_distance, sorted(group_lexicon.rank)))
    found = association.find_candidates(scores, [*seeds.negative, *seeds.positive], sorted(group_lexicon.political), c.candidate_top, c.candidate_min_llr)
    return kinds, scores, settle(candidate_rows(found, encoder, seeds, c))


def candidates(sents: DataFrame, group_lexicon: mentions.GroupLexicon, seeds: Seeds, annotator: annotate.Annotator, encoder: vectors.Encoder, c: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """The candidates of `analyse` alone, without roles, frames and profiles, and without storing tokens."""
    steps = [annotate.annotate_step(annotator), mentions.mention_step(group_lexicon, c.group_window), *WORDS]
    resolved = settle(annotate.run_steps(sents.select(*KEYS, "sentence"), steps, [*KEYS, "mentions", "words", "tags"]))
    return collocations(resolved, group_lexicon, seeds, encoder, c)[2]


def analyse(
    sents: DataFrame,
    group_lexicon: mentions.GroupLexicon,
    seeds: Seeds,
    annotator: annotate.Annotator,
    encoder: vectors.Encoder,
    matcher: roles.Matcher | None = None,
    labeller: roles.Labeller | None = None,
    all_lines: DataFrame | None = None,
    c: AnalysisConfig = AnalysisConfig(),
) -> Analysis:
    """sents: doc_id, sent_pos, sentence (kept sentences). all_lines: sentence of every lexical hit, kept or not; the kept ones if left out."""
    spark = sents.sparkSession
    labelled = [roles.label_step(labeller)] if labeller else []
    steps = [annotate.annotate_step(annotator), mentions.mention_step(group_lexicon, c.group_window), *WORDS, *labelled, roles.role_step(group_lexicon, matcher, c.group_window)]
    resolved = settle(annotate.run_steps(sents.select(*KEYS, "sentence"), steps, [*KEYS, "sentence", "tokens", "mentions", "words", "tags", "findings"]))

    kinds, scores, candidates = collocations(resolved, group_lexicon, seeds, encoder, c)
    own = dict.fromkeys(seeds.positive, 1) | dict.fromkeys(seeds.negative, -1)  # a term of both poles is negative
    prior = spark.createDataFrame(sorted(own.items()), "term string, sign int")
    inventory = settle(frames.refresh_inventory(prior, candidates.select("term", F.col("suggested_frame_sign").alias("sign"))))
    signs = inventory.collect()  # seeds and at most candidate_top admitted terms
    negative, positive = ([r["term"] for r in signs if r["sign"] == s] for s in (-1, 1))

    bound = settle(frames.bind_frames(resolved.select(*KEYS, "tokens", "mentions"), negative, positive, c.binding_distance))
    findings = resolved.select(*KEYS, F.inline("findings"))

    signed = association.signed_association(scores, inventory.select(F.col("term").alias("collocate"), "sign"))
    labels = frames.sentence_labels(bound, KEYS, negative, positive)
    rows = resolved.select(*KEYS, "sentence").join(roles.sentence_metrics(findings, KEYS), KEYS, "left")
    rows = rows.join(labels.drop("anchors", "frame_lemmas"), KEYS).join(frames.strongest_association(labels, signed, KEYS), KEYS)
    counts = ["subjecthood", "agi", "pi", "si", "neg_atti", "pos_atti", "role_confidence_min"]
    rows = rows.fillna(0, counts).withColumnsRenamed({"neg_atti": "local_neg_atti", "pos_atti": "local_pos_atti"})

    neg, pos = (vectors.vector_literal(encoder.encode(t).mean(axis=0)) for t in (seeds.negative_texts, seeds.positive_texts))
    reported = lex.reported_groups(findings, c.min_group).select("lemma")
    each = resolved.select("sentence", F.explode("mentions").alias("m")).select(F.col("m.lemma").alias("lemma"), F.col("sentence").alias("text"))
    ceat = context_association(each.join(reported, "lemma", "left_semi"), encoder, neg, pos, c)
    lines = (sents if all_lines is None else all_lines).select(F.col("sentence").alias("text"))
    every = vectors.context_lemmas(lines, sorted(group_lexicon.rank), "text").select("lemma", "text")
    ceat_full = context_association(every.join(reported, "lemma", "left_semi"), encoder, neg, pos, c)

    attitude = frames.frame_attitude(frames.sentence_frames(bound, KEYS))
    lookup = F.create_map(*[x for t, kind in kinds.items() for x in (F.lit(t), F.lit(kind))])
    kind = F.coalesce(F.try_element_at(lookup, F.col("lemma")), F.lit("unknown"))
    profiles = settle(group_profiles(findings, attitude, kind, encoder, neg, pos, ceat, ceat_full))
    large = profiles.filter(F.col("n") >= c.min_group)
    index = models.efi(large, "lemma", EFI, least=3)
    groups = profiles.join(index.select("lemma", F.col("score").alias("efi_pc1")), "lemma", "left").orderBy(F.desc("n"), "lemma")
    fitted = [(t, models.ols(large, t, PREDICTORS)) for t in ("weat", "ceat")]
    schema = "target string, n int, intercept double, r2 double, " + ", ".join(f"b_{p} double" for p in PREDICTORS)
    regressions = spark.createDataFrame([(t, r["n"], r["intercept"], r["r2"], *[r[f"b_{p}"] for p in PREDICTORS]) for t, r in fitted if r], schema)
    return Analysis(scores, candidates, inventory, findings, rows, groups, index, regressions)

"""The analysis pipeline from sentences to group profiles, with stand-ins for its models."""

import sys

import pytest
from pyspark import cloudpickle

from corvane.config import AnalysisConfig
from corvane.operators import annotate as ann
from corvane.operators import mentions as mn
from corvane.operators import roles as rl
from corvane.operators import vectors as vec
from corvane.plans import analyse as an
from corvane.plans.q_models import _Labeller, _Parser

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEX = mn.GroupLexicon(target=frozenset({"refugee", "migrant"}), contrast=frozenset({"citizen"}), political=frozenset({"party"}))
SEEDS = an.Seeds(["threat"], ["help"], ["threat crisis danger", "danger threat"], ["help and support", "support help"])


class Agent:
    def match(self, s, t, head, span):
        return {"agi": 0.8, "pi": 0.1, "si": 0.1, "neg": 0.3, "pos": 0.1, "label": "negAttI"}


@pytest.fixture(scope="module")
def result(spark):
    texts = ["Refugees are the threat here now"] * 8 + ["Citizens are glad to help people today"] * 8 + ["Nobody from the party was there"] * 3 + ["A migrant is here , they say no threat at all"] * 2
    sents = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_pos int, sentence string")
    c = AnalysisConfig(min_pair=2, min_group=2, contexts_min=2, candidate_min_llr=0.1)
    return an.analyse(sents, LEX, SEEDS, _Parser(), vec.HashEncoder(32), Agent(), _Labeller(), c=c)


def test_sentences(result):
    rows = {r["doc_id"]: r for r in result.sentences.collect()}
    assert len(rows) == 21
    first, glad, none = rows[0], rows[8], rows[16]
    assert (first["targets"], first["subjecthood"], first["agi"], first["local_neg_atti"]) == ("Refugees", 1, 1, 1)
    assert "threat(-)" in first["frames"] and "refugee:threat(-)" in first["bound_frames"]
    assert first["association"] < 0 < glad["association"] and "citizen:help(+)" in glad["bound_frames"]
    assert (none["targets"], none["agi"], none["association"], none["bound_frames"]) == (None, 0, 0.0, [])
    denied = rows[19]
    assert "frame_negated" in denied["frame_binding_flags"] and "migrant:threat(-)" not in denied["bound_frames"]


def test_groups(result):
    cols = "lemma type n subjecthood agi pi si local_neg_atti local_pos_atti frame_neg_atti frame_pos_atti net_atti frame_review weat ceat ceat_n ceat_se ceat_full ceat_full_n ceat_full_se delta_ceat efi_pc1"
    assert result.groups.columns == cols.split()
    g = {r["lemma"]: r for r in result.groups.collect()}
    assert set(g) == {"refugee", "citizen", "migrant"}
    assert (g["refugee"]["type"], g["citizen"]["type"], g["refugee"]["n"], g["refugee"]["ceat_n"], g["refugee"]["ceat_full_n"]) == ("minority", "dominant", 8, 8, 0)
    assert g["refugee"]["ceat"] > 0 > g["citizen"]["ceat"] and g["refugee"]["net_atti"] == 1.0 and g["citizen"]["net_atti"] == -1.0
    assert g["migrant"]["frame_neg_atti"] == 0.0 and g["migrant"]["frame_review"] == 1.0
    assert g["refugee"]["efi_pc1"] > g["citizen"]["efi_pc1"]
    assert result.regressions.count() == 0  # three groups are too few for four predictors


def test_candidates_and_inventory(result):
    assert {"frame_neg_sim", "frame_pos_sim", "suggested_frame_sign", "suggested_frame_bucket", "used_in_frame_inventory"} <= set(result.candidates.columns)
    admitted = {r["term"] for r in result.candidates.collect() if r["used_in_frame_inventory"]}
    assert {r["term"] for r in result.inventory.collect()} == {"threat", "help"} | admitted


def test_labelled_roles(spark):
    df = spark.createDataFrame([(1, "Police are refugees now"), (2, "no verb")], "doc_id long, sentence string")
    out = {r["doc_id"]: r["srl"] for r in rl.label_roles(ann.annotate(df, _Parser()), _Labeller()).collect()}
    assert [(f["predicate_i"], f["predicate_lemma"], dict(f["labels"])) for f in out[1]] == [(1, "are", {0: "ARG0", 2: "ARG1"})] and out[2] == []


def test_predicate_candidates(spark):
    from pyspark.sql import functions as F

    rows = [(0, "NOUN", "NN", "x", 0), (1, "VERB", "VB", "ROOT", 1), (2, "ADJ", "VBN", "x", 1), (3, "ADJ", "JJ", "x", 1), (4, "AUX", "VBZ", "auxpass", 5), (5, "ADJ", "JJ", "x", 1), (6, "AUX", "VBG", "x", 1)]
    df = spark.createDataFrame([(rows,)], "tokens array<struct<i:int,pos:string,tag:string,dep:string,head_i:int>>")
    assert df.select(rl.predicate_candidates(F.col("tokens"))).first()[0] == [1, 2, 5, 6]


def test_candidates_alone_are_those_of_the_analysis(spark, result):
    texts = ["Refugees are the threat here now"] * 8 + ["Citizens are glad to help people today"] * 8 + ["Nobody from the party was there"] * 3 + ["A migrant is here , they say no threat at all"] * 2
    sents = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, sent_pos int, sentence string")
    c = AnalysisConfig(min_pair=2, min_group=2, contexts_min=2, candidate_min_llr=0.1)
    alone = an.candidates(sents, LEX, SEEDS, _Parser(), vec.HashEncoder(32), c).collect()
    assert alone and sorted(map(str, alone)) == sorted(map(str, result.candidates.collect()))

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import association as assoc
from corvane.operators import gates
from corvane.operators import roles as rl
from corvane.operators import vectors as vec


@pytest.mark.parametrize("k,llr,dice", [((10, 20, 30, 940), 30.0691, 12.1926), ((8, 2, 40, 950), 40.0917, 12.142), ((5, 0, 0, 95), 39.703, 14.0), ((1, 9, 9, 81), 0.0, 10.6781)])
def test_anchors(one, k, llr, dice):
    s = "a int, b int, c int, d int"
    assert one(lambda a, b, c, d: F.round(assoc.llr(a, b, c, d), 4), [k], s)[0] == pytest.approx(llr, abs=2e-4)
    assert one(lambda a, b, c, d: F.round(assoc.log_dice(a, a + b, a + c), 4), [k], s)[0] == pytest.approx(dice, abs=2e-4)


def test_llr_is_never_negative(one):
    r = random.Random(1)
    rows = [tuple(r.randint(0, 40) for _ in range(4)) for _ in range(200)] + [(0, 0, 0, 0), (3, -1, 2, 5)]
    got = one(assoc.llr, rows, "a int, b int, c int, d int")
    assert all(x >= 0 and not math.isnan(x) for x in got)


def test_pairs_match_brute_force(spark):
    r = random.Random(2)
    sents = [(i, 0, [r.choice(["tee", "vee", "one", "two", "six", "to"]) for _ in range(r.randint(0, 9))]) for i in range(300)]
    df = spark.createDataFrame(sents, "doc_id long, sent_pos int, words array<string>")
    want = set()
    for i, _, w in sents:
        for a, t in enumerate(w):
            for b, c in enumerate(w):
                if t in ("tee", "vee") and c not in ("tee", "vee") and len(c) >= 3 and abs(a - b) >= 2:
                    want.add((i, t, c))
    assert {(x["doc_id"], x["target"], x["collocate"]) for x in assoc.sentence_pairs(df, ["tee", "vee"]).collect()} == want


def test_a_long_sentence_takes_linear_time(spark):
    import time

    words = [f"word{i % 9000}" for i in range(40_000)] + ["tee"]
    df = spark.createDataFrame([(1, 0, words), (2, 0, ["tee"]), (3, 0, [])], "doc_id long, sent_pos int, words array<string>")
    at = time.perf_counter()
    counts = {(r["kind"], r["a"], r["b"]): r["n"] for r in assoc.sentence_counts(df, ["tee"]).collect()}
    assert time.perf_counter() - at < 10
    assert counts["t", "", ""] == 3 and counts["w", "tee", ""] == 2 and sum(k[0] == "p" for k in counts) == 9000


def test_candidates_keep_row_of_best_score(spark):
    rows = [("m1", "minority", "x", 9.0, 3.0), ("m2", "minority", "x", 9.5, 2.0), ("d1", "dominant", "x", 1.0, 9.0), ("m1", "minority", "y", 2.0, 1.0), ("d1", "dominant", "z", 9.0, 1.0), ("m1", "minority", "z", 8.0, 1.0)]
    s = spark.createDataFrame(rows, "target string, group_type string, collocate string, llr double, logdice double")
    got = assoc.find_candidates(s, []).collect()
    assert [(r["term"], r["minority_llr"], r["minority_logdice"], r["differential"], r["found_with"]) for r in got] == [("x", 9.5, 2.0, 8.5, ["m1", "m2"])]


ROUTES = [(.40, .05, False, "STRICT", .56, False, "keep"), (.40, .05, False, "STRICT", .55, False, "review"), (.40, .05, False, "STRICT", .44, False, "drop"), (.40, .05, False, "STRICT", .90, True, "review"),
          (.30, .09, False, "SEMANTIC_RESCUE", .59, False, "review"), (.30, .09, False, "SEMANTIC_RESCUE", .60, False, "keep"), (.20, .0, True, "LEXICAL_HUMAN_RESCUE", .31, False, "review"),
          (.20, .0, True, "LEXICAL_HUMAN_RESCUE", .65, False, "keep"), (.20, .0, False, "REJECT", .9, False, "drop"), (.34, .02, False, "REJECT", .9, False, "drop")]


def test_routing(one):
    s = "pos double, margin double, human boolean, prob double, noise boolean"
    rows = [(p, m, h, q, n) for p, m, h, _, q, n, _ in ROUTES]
    assert one(lambda p, m, h, q, n: gates.bucket(p, m, h), rows, s) == [r[3] for r in ROUTES]
    assert one(lambda p, m, h, q, n: gates.route(gates.bucket(p, m, h), q, n), rows, s) == [r[6] for r in ROUTES]


def test_review_flags(one):
    none = F.array().cast("array<string>")
    fn = lambda b, p, m, q: gates.review_flags(b, p, m, q, none)
    got = one(fn, [("STRICT", .4, .07, .5), ("STRICT", .7, .05, .5), ("SEMANTIC_RESCUE", .3, .09, .59)], "b string, p double, m double, q double")
    assert got == [["classifier_borderline"], ["low_margin", "high_semantic_low_classifier"], ["semantic_rescue"]]


def test_gate_forms_agree(spark):
    docs = spark.createDataFrame([(1, "the north wind"), (2, "nothing"), (3, "Northmen"), (4, "north-south")], "doc_id long, text string")
    a = {r[0] for r in gates.lexical_gate(docs, ["north"]).select("doc_id").collect()}
    b = {r[0] for r in gates.lexical_gate_tokens(docs, spark.createDataFrame([("north",)], "term string"), ["doc_id"]).select("doc_id").collect()}
    assert a == {1, 3, 4} and b == {1, 4}


def test_ceat_summary(spark):
    rows = [("a", x) for x in (0.1, 0.2, -0.05, 0.3)] + [("b", 0.5)]
    got = {r["k"]: tuple(r)[1:] for r in vec.ceat_summary(spark.createDataFrame(rows, "k string, assoc double"), "k", least=1).collect()}
    assert got == {"a": (4, 0.1375, 0.1493, 0.0747), "b": (1, 0.5, 0.0, 0.0)}


def test_stable_sample_is_bounded_and_ignores_order(spark):
    rows = [(i % 3, f"t{i}") for i in range(200)]
    a = vec.stable_sample(spark.createDataFrame(rows, "k int, t string"), "k", "t", 20).collect()
    b = vec.stable_sample(spark.createDataFrame(rows[::-1], "k int, t string").repartition(5), "k", "t", 20).collect()
    assert len(a) == 60 and sorted(map(str, a)) == sorted(map(str, b))


def test_cosine_of_zero_vector(one):
    from corvane.functions.vectors import cosine

    assert one(cosine, [([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>") == [0.0, pytest.approx(1.0)]


def test_context_lemmas(spark):
    lines = spark.createDataFrame([(1, "The asylum-seeker and the asylum  seekers met"), (2, "asylum seeker, Asylum Seeker"), (3, "seekers")], "i int, line string")
    got = sorted((r["i"], r["lemma"]) for r in vec.context_lemmas(lines, ["asylum seeker", "seekers"]).collect())
    assert got == [(1, "asylum seeker"), (1, "seekers"), (2, "asylum seeker"), (3, "seekers")]


def test_srl_labels(spark):
    rows = [(0, 1, "B", 1.0), (0, 1, "B", 3.0), (0, 1, "C-ARG1", 2.5), (0, 2, "R-ARG0", 1.0)]
    got = {r["word_i"]: r["label"] for r in rl.srl_labels(spark.createDataFrame(rows, "s int, word_i int, label string, logit double"), ["s"]).collect()}
    assert got == {1: "ARG1", 2: "ARG0"}


def test_models(spark):
    import numpy as np

    from corvane.operators import models

    r = np.random.default_rng(0)
    rows = [("RELEVANT", r.normal(1, 0.5, 6).tolist()) for _ in range(40)] + [("IRRELEVANT", r.normal(-1, 0.5, 6).tolist()) for _ in range(20)]
    df = spark.createDataFrame(rows, "label string, vec array<double>")
    m = models.train_classifier(df)
    p = models.relevant_probability(m, df).collect()
    assert all((x["probability"] > 0.5) == (x["label"] == "RELEVANT") for x in p)
    with pytest.raises(ValueError):
        models.train_classifier(df.filter("label = 'RELEVANT'"))
    x = r.normal(size=(30, 2))
    prof = spark.createDataFrame([(f"g{i}", float(2 * a - b + 1), float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, y double, a double, b double")
    fit = models.ols(prof, "y", ["a", "b"])
    assert (fit["intercept"], fit["b_a"], fit["b_b"], fit["r2"]) == (1.0, 2.0, -1.0, 1.0)
    assert models.ols(prof.limit(3), "y", ["a", "b"]) is None
    e = models.efi(prof, "k", {"y": 1, "a": 1, "b": -1}).collect()
    z = x.copy()
    mat = np.column_stack([2 * z[:, 0] - z[:, 1] + 1, z[:, 0], z[:, 1]])
    mat = (mat - mat.mean(0)) / mat.std(0)
    ev = np.linalg.eigvalsh(np.cov(mat.T))
    assert e[0]["variance_ratio"] == pytest.approx(ev[-1] / ev.sum(), abs=1e-3)
    assert sum(s * e[0][f"load_{n}"] for n, s in (("y", 1), ("a", 1), ("b", -1))) >= 0


def test_ceat_full_samples_the_operators_number_of_contexts(spark, tmp_path):
    from corvane.plans import q_models

    rows = [(i, f"Number {i} came with a long tail of words that follow it.", "en", "x", 60) for i in range(620)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["n"] for r in q_models.ceat_full(spark, str(tmp_path)).collect() if r["lemma"] == "with"} == {500}


def test_counts_by_part_of_speech_and_lexicon(spark):
    r = random.Random(6)
    vocab, kinds = ["tee", "vee", "one", "two", "of", "six", "other", None], ["NOUN", "VERB", "DET", "ADP", None]
    sents = []
    for i in range(400):
        words = [r.choice(vocab) for _ in range(r.randint(0, 9))]
        sents.append((i, 0, words, [r.choice(kinds) for _ in words]))
    sents += [(900, 0, None, None), (901, 0, ["tee", "one", "two"], None), (902, 0, ["tee", "one", "two"], ["NOUN"])]  # without parts of speech there are no collocates
    df = spark.createDataFrame(sents, "doc_id long, sent_pos int, words array<string>, tags array<string>").repartition(3)
    want, pairs = {("t", "", ""): len(sents)}, set()
    for i, _, words, tags in sents:
        words = words or []
        tags = tags if tags and len(tags) == len(words) else [""] * len(words)
        t = {w: [k for k, x in enumerate(words) if x == w] for w in words if w in ("tee", "vee")}
        c = {w: [k for k, x in enumerate(words) if x == w and tags[k] in assoc.CONTENT_POS] for w, p in zip(words, tags) if p in assoc.CONTENT_POS and w not in ("tee", "vee", "other", None)}
        found = {(x, y) for x in t for y in c if any(abs(a - b) >= 2 for a in t[x] for b in c[y])}
        pairs |= {(i, *p) for p in found}
        for k in [("w", w, "") for w in {*t, *c}] + [("p", *p) for p in found]:
            want[k] = want.get(k, 0) + 1
    got = {(x["kind"], x["a"], x["b"]): x["n"] for x in assoc.sentence_counts(df, ["tee", "vee"], lexicon=["other", "tee"]).collect()}
    assert got == want
    assert {(x["doc_id"], x["target"], x["collocate"]) for x in assoc.sentence_pairs(df, ["tee", "vee"], lexicon=["other"]).collect()} == pairs


def test_pairs_come_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(assoc, "PAIRS_AT_ONCE", 10)
    words = [["a", "b", "c", "d", "x", "y", "a"], ["x", "a"], [], ["y", "c", "z", "b"], ["b"]]
    s = assoc.Spans(pa.array(words, pa.list_(pa.string())), None, ["a", "b"], [], (), 1)
    got = [(int(s.sentence[i]), s.names[int(s.code[i])].as_py(), s.names[int(s.code[j])].as_py()) for a, b in s.pairs(1) for i, j in zip(a, b)]
    assert len(got) == len(set(got))
    assert set(got) == {(k, t, c) for k, w in enumerate(words) for t in w for c in w if t in "ab" and c not in "ab"}
    assert len(list(s.pairs(1))) > 1


def test_bank_scores_against_plain_products(spark):
    import numpy as np

    from corvane.functions import vectors as fv

    r = np.random.default_rng(2)
    banks = [("x", v.tolist()) for v in r.normal(size=(7, 5))] + [("y", v.tolist()) for v in r.normal(size=(3, 5))]
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(50, 5)))] + [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [1.0]), (53, []), (3, [0.0] * 5)]
    df = spark.createDataFrame(rows, "k long, embedding array<double>").repartition(3)
    b = spark.createDataFrame(banks, "bank string, bvec array<double>")
    got = sorted((tuple(x) for x in vec.bank_scores(df, b, ["x", "y", "none"], "k").collect()), key=str)
    one_bank = lambda n, v: max(float(np.dot(v, w)) for m, w in banks if m == n)
    want = sorted(((k, *([one_bank("x", v), one_bank("y", v)] if v and None not in v and len(v) == 5 else [None, None]), None) for k, v in rows), key=str)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:])
    assert vec.bank_scores(df.limit(0), b, ["x"], "k").count() == 0
    assert df.filter("k = 0").select(fv.best_dot(F.col("embedding"), [v for n, v in banks if n == "x"])).first()[0] == pytest.approx(one_bank("x", rows[0][1]))


def test_index_and_regression_of_a_large_table(spark):
    from corvane.operators import models

    big = spark.range(150_000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"))
    big = big.withColumn("y", 3 * F.col("a") - F.col("b") + 5)
    fit = models.ols(big, "y", ["a", "b"])
    assert (fit["n"], fit["intercept"], fit["b_a"], fit["b_b"], fit["r2"]) == (150_000, 5.0, 3.0, -1.0, 1.0)
    assert models.efi(big, "k", {"y": 1, "a": 1}).count() == 150_000
    flat = big.withColumn("y", F.lit(2.0)).withColumn("a", F.lit(None).cast("double"))
    assert models.ols(flat, "y", ["a"])["r2"] == 0.0 and models.efi(flat.limit(5), "k", {"y": 1, "a": 1}).first()["score"] == 0.0


def test_samples_take_the_lowest_digests(spark):
    import hashlib

    rows = [("k", f"text {i}") for i in range(90)]
    got = {x["t"] for x in vec.stable_sample(spark.createDataFrame(rows, "k string, t string"), "k", "t", 10).collect()}
    assert got == set(sorted((t for _, t in rows), key=lambda t: hashlib.blake2b(f"k\t{t}".encode(), digest_size=8).digest())[:10])


def test_encoder_catalogue_and_placement(spark):
    from corvane import config

    model = config.encoder_model("minilm")
    assert [config.placement(model, d).batch for d in ("cpu", "mps", "cuda")] == [32, 64, 256]
    assert config.placement(config.encoder_model("bge_small"), "cuda").batch == 32 and config.placement(model, "cpu", 7).batch == 7
    own = {"tiny": config.EncoderModel("own/tiny", 8, {"cpu": 2}), "minilm": config.EncoderModel("own/mini", 16)}
    assert config.encoder_model("tiny", own).batches["cpu"] == 2 and config.encoder_model("minilm", own).dim == 16
    for bad in (lambda: config.encoder_model("none"), lambda: config.placement(model, "abacus"), lambda: config.placement(model, batch=0)):
        with pytest.raises(ValueError):
            bad()
    assert config.Placement().profile() is None
    gpu = config.placement(model, "cuda", executor_memory="4g").profile()
    assert gpu.taskResources["gpu"].amount == 1.0 and gpu.executorResources["gpu"].amount == 1

    class Fake:  # what a stage with resources of its own asks of Spark
        columns, dtypes = ["t"], [("t", "string")]

        def mapInArrow(self, fn, schema, profile=None):
            self.asked = (schema, profile)

    fake = Fake()
    vec.encode_placed(fake, vec.HashEncoder(4), "t", "v", config.placement(model, "cuda"))
    assert fake.asked[0] == "`t` string, `v` array<double>" and fake.asked[1].taskResources["gpu"].amount == 1.0

    sizes = spark.sparkContext.accumulator(0)

    class Small(vec.HashEncoder):
        def encode(self, texts):
            sizes.add(len(texts) > 2)
            return super().encode(texts)

    df = spark.createDataFrame([(i, f"word{i % 5} here" if i % 7 else None) for i in range(40)], "i int, t string")
    placed = vec.encode_placed(df, Small(8), "t", "v", config.Placement(batch=2)).collect()
    assert sorted(placed) == sorted(vec.encode(df, vec.HashEncoder(8), "t", "v").collect()) and sizes.value == 0

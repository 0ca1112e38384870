"""The pipeline's stages against their operators' brute-force meaning, on a small planted corpus."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    d = tmp_path_factory.mktemp("corpus")
    prose = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(n)).capitalize() + "."
    rows = []
    for i in range(240):
        rows.append((i, prose(r.randint(30, 90)) if i % 6 else "CLICK!! $$$ | " * 25, ["a", "b", "c", None][i % 4]))
    rows += [(300 + i, rows[5][1] + " tail", "a") for i in range(4)]
    bench = [(1, prose(25)), (2, prose(30))]
    rows += [(400 + i, prose(20) + " " + bench[i % 2][1] + " " + prose(20), "b") for i in range(6)]
    rows += [(500, None, "a"), (501, prose(2), "c")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        seen[name] = Counter(x["doc_id"] for x in docs.collect())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == cols
    junk = {i for i, t, _ in rows if t and t.startswith("CLICK")}
    assert not junk & set(seen["quality"])
    clean = {i for i, t, _ in rows if i < 240} - junk
    assert clean <= set(seen["quality"])
    assert {5, 300, 301, 302, 303} & set(seen["near_duplicates"]) == {5}
    assert clean <= set(seen["near_duplicates"]) | {5}
    assert set(seen["decontaminate"]) == set(seen["near_duplicates"]) - set(range(400, 406))
    assert set(seen["mixture"]) <= set(seen["decontaminate"]) and max(seen["mixture"].values()) <= 2
    assert seen["shards"] == seen["mixture"]


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.count() > 100


def test_empty_tables_repeats_and_clashing_columns(spark, folder, tmp_path):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)
    odd = docs.filter("doc_id < 30").selectExpr("*", "'a' as id", "1 as n", "'b' as root", "2 as component", "3 as sig", "4 as score", "5 as size", "'k' as key", "6 as bucket", "7 as h", "8 as at")
    odd = odd.union(odd.filter("doc_id = 1"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        odd_out = stage(spark, odd, d)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert odd_out.columns == odd.columns
        odd = odd_out
        if name == "near_duplicates":
            assert odd.filter("doc_id = 1").count() == 1
    assert odd.count() > 0 and {"id", "n", "root", "shard", "slot"} <= set(odd.columns)


def test_a_stage_may_keep_nothing(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id between 400 and 405")  # all hold a benchmark text
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert (docs.count() > 0) == (name in ("quality", "near_duplicates"))


def test_size_of_the_input_switches_no_result(spark, monkeypatch):
    from corvane.llm import mix, quality_pu

    docs = spark.createDataFrame([(i, "w " * (i % 3), "a") for i in range(3000)], "doc_id long, text string, source string")
    plans = []
    for rows in (1, 7, 1 << 20):
        monkeypatch.setattr(mix, "BUCKET_ROWS", rows)
        plans.append(sorted(map(tuple, mix.mix_copies(docs).collect())))
    assert plans[0] == plans[1] == plans[2]
    monkeypatch.setattr(quality_pu, "MAX_POSITIVE", 40)
    monkeypatch.setattr(quality_pu, "fit", lambda p, u: len(p))
    few = spark.range(3000).selectExpr("id as doc_id", "1 as quality")
    many = spark.range(300_000).selectExpr("id as doc_id", "1 as quality")  # most of them of no document
    assert quality_pu.train(docs, few) == quality_pu.train(docs, many) == 40

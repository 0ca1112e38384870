"""Queries on tables larger than the smoke tables in what matters to each, against their SQL."""

import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from corvane.plans import registry


@pytest.fixture
def same(spark, tmp_path):
    """Writes the tables, given as rows and schema, and compares a query with its SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLE_SQL[name])
        at = [[c[0] for c in want.description].index(c) for c in got.columns]
        text = lambda rows: Counter(tuple(map(str, r)) for r in rows)
        assert text(got.collect()) == text(tuple(r[i] for i in at) for r in want.fetchall())

    return run


EMBEDDINGS = [(i, i % 2, [float(i % 7) - 3 + 4 * (i % 2), float(i % 11) - 4, float(i % 5) + 1]) for i in range(1300)]


def test_ceat_summary_samples_large_labels(same):
    same("ceat_summary", embeddings=(EMBEDDINGS, "vec_id long, label int, embedding array<float>"))


def test_file_changes_of_paths_that_repeat(same):
    pages = [(i, f"http://a.example/{i % 40}", "x" * (i % 9)) for i in range(300)]
    same("file_changes", pages=(pages, "page_id long, url string, html string"))


def test_stable_sample_of_large_sources(same):
    docs = [(i, "t", "en", f"src{i % 2}" if i % 50 else None, 1) for i in range(1600)]
    same("stable_sample", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))


def test_neighborhood_all_follows_twelve_links(same):
    pages = [(i, f"http://a.example/{i}", "") for i in range(25_640)]  # the farthest of them are more than twelve links away
    same("neighborhood_all", pages=(pages, "page_id long, url string, html string"))


@pytest.mark.parametrize("name", ["mentions", "bind_frames", "extract_roles", "anaphora"])
def test_sentences_cross_to_python_once(spark, tmp_path, name):
    rows = [(1, "It was with them. They are from here.", "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan


def test_batches_of_sentences_are_small_whatever_comes_in(spark):
    from corvane.operators import annotate as ann

    s = spark.range(3000).selectExpr("id as doc_id", "'a b' as sentence").coalesce(1)
    sizes = ann.annotate(s, ann.RuleAnnotator()).mapInArrow(lambda batches: batches, "doc_id long, sentence string, tokens array<" + ann.TOKEN + ">")
    assert sizes.count() == 3000 and ann.SENTENCES_AT_ONCE <= 1024


def test_tokens_in_columns_are_those_of_records(spark):
    from corvane.operators import annotate as ann

    class Records:
        annotate = ann.RuleAnnotator().annotate

    rows = [(i, x) for i, x in enumerate(["It was - \u00c9t\u00e9's co-worker, 3 x!", "", None, "\u0130 \u1e9e _a 2b \u00b2", " "] * 200)]
    s = spark.createDataFrame(rows, "doc_id int, sentence string").coalesce(1)
    assert ann.annotate_step(ann.RuleAnnotator()).whole is not None
    assert sorted(map(str, ann.annotate(s, ann.RuleAnnotator()).collect())) == sorted(map(str, ann.annotate(s, Records()).collect()))


@pytest.mark.parametrize("name", ["report_types", "annotate_tokens", "extract_roles"])
def test_tasks_of_slow_work_grow_in_number_not_in_size(spark, tmp_path, monkeypatch, name):
    from corvane.sources import readers

    docs = spark.range(2000).selectExpr("id as doc_id", "'It was with them. They are from here.' as text", "'en' as lang", "'a' as source", "1 as n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")  # one row group
    size = sum(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("*.parquet"))
    monkeypatch.setattr(readers, "DEALT", (1, 2))  # larger than what is dealt over the cores once
    monkeypatch.setattr("corvane.plans.q_models.SHARE", size // 40)
    plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().toString()
    tasks = [int(n) for n in re.findall(r"RoundRobinPartitioning\((\d+)\)", plan)]
    assert tasks and min(tasks) >= 40


def test_words_are_looked_up_once(spark, monkeypatch):
    """A resolver asks its lexicon about a word once, not once a token."""
    from corvane.operators import annotate as ann
    from corvane.operators import mentions as mn

    asked = []
    base = mn.GroupLexicon.base
    monkeypatch.setattr(mn.GroupLexicon, "base", lambda self, t: asked.append(t.text) or base(self, t))
    step = mn.mention_step(mn.GroupLexicon(target=frozenset({"with"}), contrast=frozenset({"from"})))
    rows = [{"tokens": ann.RuleAnnotator().annotate("with them and from them and with us")} for _ in range(3)]
    assert [len(step.of(r)) for r in rows] == [3, 3, 3]
    assert sorted(asked) == sorted(set(asked))


def test_tokens_are_made_when_asked_for():
    from corvane.operators import annotate as ann
    from corvane.operators import frames as fr
    from corvane.operators import mentions as mn

    s = mn.Sentence(ann.RuleAnnotator().annotate("this is a long one and with them all of that"))
    lex = mn.GroupLexicon(target=frozenset({"with"}), contrast=frozenset())
    found = mn.Resolver(lex).resolve_all(s)
    assert [i for i, t in enumerate(s.tokens.made) if t] == list(range(11))  # every word is new to the lexicon
    s2 = mn.Sentence(s.rows)
    bound = fr.bind(s2, mn.sentence_mentions(s2, found), frozenset({"that"}), frozenset({"and"}))
    assert [b["term"] for b in bound] == ["and", "that"]
    assert [i for i, t in enumerate(s2.tokens.made) if t] == [5, 6, 10]


def test_words_are_counted_where_their_text_is_read(spark, same, tmp_path):
    docs = [(i, f"It was {i}. Was it {i} \u00e9t\u00e9?" if i % 7 else None if i % 2 else " .!", "en", "a", 1) for i in range(60)]
    same("tokenize_words", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    assert "Exchange" not in registry.QUERIES["tokenize_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_texts_that_share_an_id(same):
    docs = [(i % 9 if i % 5 else None, f"It was {i}. Was it {i}?", "en", "a", 1) for i in range(40)] + [(99, "Once.", "en", "a", 1)]
    same("tokenize_words", documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))


def test_notes_are_few_files(spark, same, tmp_path):
    titles = ["a", " b %% c ", "", "-> ==x==", "two\nlines", "no title \\E"]
    pages = [(i, f"http://a.example/{i}", f"<title>{titles[i % 6]}</title>" if i % 11 else "") for i in range(500)]
    same("markdown_notes", pages=(pages, "page_id long, url string, html string"))
    files = registry.QUERIES["markdown_notes"](spark, str(tmp_path)).inputFiles()
    assert 0 < len(files) < 50


def test_executors_need_no_copy_of_the_package(tmp_path):
    from pyspark import cloudpickle

    from corvane.operators import mentions as mn
    from corvane.operators import roles as rl
    from corvane.plans import q_models as q

    (tmp_path / "steps").write_bytes(cloudpickle.dumps([mn.mention_step(q.LEX), rl.role_step(q.LEX, q._Words())]))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", "import pickle; pickle.load(open('steps', 'rb'))"], cwd=tmp_path, env=env, check=True)

"""State stores, watched folders and sentence-bounded batches."""

import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import sentences as sent
from corvane.streaming import incremental as inc
from corvane.streaming import watch
from corvane.streaming.store import DeltaStore

CHANGE = "key string, seq int, type string, tag string"


def new(spark, tmp_path, **more):
    return DeltaStore(spark, str(tmp_path / "state"), "key", "seq", "key string, tag string", **more)


def rows(store):
    return sorted(tuple(r) for r in store.state().collect())


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_store_survives_a_restart_and_a_replay(spark, tmp_path):
    assert rows(new(spark, tmp_path)) == []
    new(spark, tmp_path)(spark.createDataFrame([("a", 1, "add", "x")], CHANGE), 0)
    u = new(spark, tmp_path)  # another driver
    u(spark.createDataFrame([("a", 2, "delete", "x"), ("b", 3, "add", "y"), ("b", 2, "add", "older")], CHANGE), 1)
    new(spark, tmp_path)(spark.createDataFrame([("a", 1, "add", "x")], CHANGE), 0)  # replayed
    assert rows(u) == [("b", "y")]
    (tmp_path / "state" / "delta" / f"{2:020d}").mkdir()  # begun, but not whole
    assert rows(new(spark, tmp_path)) == [("b", "y")]
    for epoch in (2, 3):
        u(spark.createDataFrame([(f"k{epoch}", epoch, "add", "z")], CHANGE), epoch)
    assert rows(u) == [("b", "y"), ("k2", "z"), ("k3", "z")]
    u(spark.createDataFrame([], CHANGE), 4)
    assert len(rows(u)) == 3


def test_a_batch_writes_its_changes_and_compaction_only_their_buckets(spark, tmp_path):
    s = new(spark, tmp_path, buckets=16, compact_after=3)
    big = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), F.lit(0).alias("seq"), F.lit("add").alias("type"), F.sha2(F.col("id").cast("string"), 256).alias("tag"))
    s(big, 0)
    s.compact()
    folder = tmp_path / "state"
    whole = size(folder / "base")
    for n in range(1, 4):
        s(spark.createDataFrame([("k7", n, "change", f"v{n}"), ("k8", n, "delete", None)], CHANGE), n)
        assert size(folder / "delta" / f"{n:020d}") < whole / 100
    assert s._numbers("manifest", whole=False) == [0, 3] and s._numbers("base") == [0, 3]
    assert size(folder / "base" / f"{3:020d}") < whole / 4  # two buckets of sixteen at most
    assert s.state().count() == 39_999 and s.state().filter("key = 'k7'").first()["tag"] == "v3"
    late = s.state()  # a reader of the state before the next compaction
    for n in range(4, 7):
        s(spark.createDataFrame([(f"new{n}", n, "add", "x")], CHANGE), n)
    assert late.count() == 39_999
    assert s.state().count() == 40_002 and s._numbers("manifest", whole=False) == [3, 6] and s._numbers("delta")[0] == 4
    assert new(spark, tmp_path, buckets=16).state().count() == 40_002


def test_a_bucket_can_empty(spark, tmp_path):
    s = new(spark, tmp_path, buckets=1, compact_after=1)
    s(spark.createDataFrame([("a", 1, "add", "x")], CHANGE), 0)
    s(spark.createDataFrame([("a", 2, "delete", "x")], CHANGE), 1)
    assert rows(s) == [] and s._manifest() == (1, {})
    s(spark.createDataFrame([("c", 3, "add", "y")], CHANGE), 2)
    assert rows(s) == [("c", "y")]


def test_a_later_build_supersedes(spark, tmp_path):
    s = new(spark, tmp_path)
    s(spark.createDataFrame([("a", 1, "add", "x"), ("b", 1, "add", "x")], CHANGE), 0)
    s.propose(spark.createDataFrame([("a", 2, "change", "y"), ("b", 2, "delete", None)], CHANGE), 1)
    s.propose(spark.createDataFrame([("a", 3, "change", "z"), ("c", 3, "add", "w")], CHANGE), 2)
    assert s.build(1) is None and rows(s) == [("a", "x"), ("b", "x")]
    done = {(r["key"], r["type"], r["tag"]) for r in s.build(2).collect()}  # takes along what the first would have done
    assert done == {("a", "change", "z"), ("b", "delete", None), ("c", "add", "w")}
    assert rows(s) == [("a", "z"), ("c", "w")] and s.build(2) is None


def test_two_writers_are_fenced(spark, tmp_path):
    a, b = new(spark, tmp_path), new(spark, tmp_path)
    a(spark.createDataFrame([("a", 1, "add", "x")], CHANGE), 0)
    b(spark.createDataFrame([("b", 1, "add", "x")], CHANGE), 1)
    with pytest.raises(RuntimeError, match="another writer"):
        a(spark.createDataFrame([("a", 2, "delete", "x")], CHANGE), 2)
    assert rows(b) == [("a", "x"), ("b", "x")]


def test_store_under_a_stream(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(f"k{n % 2}", n, "add", f"t{n}")], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    for _ in range(2):  # the second run has nothing to do
        s = new(spark, tmp_path)
        stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(s).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert [k for k, _ in rows(s)] == ["k0", "k1"] and s._numbers("delta") == [0, 1, 2]


def test_watched_folder_sees_each_change_once(spark, tmp_path):
    folder, seen = tmp_path / "w", []
    folder.mkdir()
    (folder / "old.md").write_text("1")
    (folder / "skip.txt").write_text("1")

    def run():
        events = watch.file_events(spark, str(folder), str(tmp_path / "listings"), "*.md", r"(^|/)\.private/")
        out = watch.quiet_changes(events, 250)
        take = lambda df, _: seen.extend((r["path"], r["type"]) for r in df.collect())
        return out.writeStream.foreachBatch(take).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()

    def until(n, more=1.5):
        end = time.time() + 60
        while len(seen) < n and time.time() < end and query.exception() is None:
            time.sleep(0.1)
        time.sleep(more)  # nothing else may follow

    query = run()
    try:
        until(1)
        assert seen == [("old.md", "add")]
        (folder / "new.md").write_text("1")
        os.makedirs(folder / ".private")
        (folder / ".private" / "x.md").write_text("1")
        until(2)
        (folder / "new.md").write_text("22")
        until(3)
        (folder / "old.md").unlink()
        until(4)
        assert seen[1:] == [("new.md", "add"), ("new.md", "change"), ("old.md", "delete")]
    finally:
        query.stop()
    (folder / "while_down.md").write_text("1")
    query = run()  # goes on from its checkpoint
    try:
        until(5)
        assert seen[4:] == [("while_down.md", "add")]
    finally:
        query.stop()


def test_events_fold_while_a_file_is_not_quiet():
    fold = lambda *kinds: __import__("functools").reduce(lambda a, b: b if a is None else watch.FOLD.get((a, b), b), kinds)
    assert fold("add", "change", "change") == "add" and fold("add", "delete") is None and fold("change", "delete") == "delete"
    assert fold("delete", "add") == "change" and fold("add", "delete", "add") == "add" and fold("delete", "add", "delete") == "delete"


def test_one_large_file_gives_several_batches(spark, tmp_path):
    docs = spark.range(2_500).select(F.col("id").alias("doc_id"), F.expr("repeat('A short sentence. ', 40)").alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    each = lambda df, epoch: sizes.append(df.count())
    out = inc.stream_by_sentences(spark, str(tmp_path), "documents", sent.sentences_simple, each, str(tmp_path / "work"))
    assert max(sizes) <= 4096 and sum(sizes) == out.count() == 100_000 and len(sizes) == 25
    inc.stream_by_sentences(spark, str(tmp_path), "documents", sent.sentences_simple, each, str(tmp_path / "work"))  # again: nothing is left
    assert sum(sizes) == 100_000

"""Incremental forms: streamed extraction, change sets, and the rollups that a change touches. State is kept by `store`, folders are watched by `watch`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int) -> DataFrame:
    source = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_extract(spark: SparkSession, folder: str, name: str, transform, out: str, checkpoint: str, files_per_batch: int = 1):
    """Reads a Parquet table as a stream, applies a stateless transform and appends Parquet; stops when the input is used up."""
    stream = _table_stream(spark, folder, name, files_per_batch)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_by_sentences(spark: SparkSession, folder: str, name: str, split, each, work: str, sentences_per_batch: int = 4096, files_per_batch: int = 1):
    """Streams a table in two steps, so that a batch of the second holds a bounded number of sentences, however many a file has.

    split (documents -> sentences) runs as the files come; its rows go to files of at most `sentences_per_batch`, and what is left
    of an input's partition to a last one. each(batch, epoch) then gets `files_per_batch` of those files at a time. Both steps
    keep their place under `work`: after a failure they go on where they were. Stops when the input is used up, and
    returns the sentences.
    """
    out = f"{work}/sentences"
    sentences = split(_table_stream(spark, folder, name, 1))
    sentences.writeStream.format("parquet").option("maxRecordsPerFile", sentences_per_batch).option("checkpointLocation", f"{work}/split").trigger(availableNow=True).start(out).awaitTermination()
    batches = spark.readStream.schema(sentences.schema).option("maxFilesPerTrigger", files_per_batch).parquet(out)
    batches.writeStream.foreachBatch(each).option("checkpointLocation", f"{work}/each").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(sentences.schema).parquet(out)


def latest_changes(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of each key. changes: key, order, type (add, change, delete), and the new row's columns."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def apply_changes(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """State after the changes: deleted keys gone, changed ones replaced, new ones added."""
    last = latest_changes(changes, key, order)
    rest = state.join(last.select(key), key, "left_anti")
    return rest.unionByName(last.filter("type <> 'delete'").select(*state.columns))


def affected_keys(old: DataFrame, changes: DataFrame, key: str, order: str, rollup, always: tuple[str, ...] = ()) -> DataFrame:
    """Rollup keys that the changes touch: those of the old rows and those of the new ones, and those that any change touches.

    rollup: rows -> DataFrame of one column of rollup keys. Old and new are both needed: a deleted row, or one
    that lost a tag, must refresh the rollups that it left. always: keys such as a listing of all, touched if anything changed.
    """
    last = latest_changes(changes, key, order)
    before = rollup(old.join(last.select(key), key, "left_semi"))
    after = rollup(last.filter("type <> 'delete'").select(*old.columns))
    if always:
        after = after.union(last.limit(1).select(F.explode(F.array(*[F.lit(k) for k in always]))))
    return before.union(after).distinct()


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (below the folder), size, modified of the files that match; contents are not read. ignore: patterns of paths to leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), f"^.*{re.escape(base)}/", "")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.filter(~F.col("path").rlike("|".join(ignore))) if ignore else out


def file_changes(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("path",)) -> DataFrame:
    """The key, type (add, change, delete), and the new size and time: how one listing became the other. key: what tells a listing's rows apart, the path unless it repeats."""
    j = old.select(*key, F.struct("size", "modified").alias("before")).join(new.select(*key, F.struct("size", "modified").alias("after")), list(key), "full")
    kind = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "delete").when(F.col("before") != F.col("after"), "change")
    return j.select(*key, kind.alias("type"), "after.size", "after.modified").filter("type is not null")


def partial_emit(changes: DataFrame, kinds: tuple[str, ...] = ("add", "change")) -> DataFrame:
    """The changes that an emitter acts on: pages and redirects are written when something is added or changed, assets go when theirs do."""
    return changes.filter(F.col("type").isin(list(kinds)))


def emit(rollup, rows: DataFrame, affected: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """An emitter's rollup over all rows, or, where it can tell its keys, over the rows of the affected keys alone."""
    if affected is None:
        return rollup(rows)
    return rollup(rows.join(affected.select(F.col(affected.columns[0]).alias(key)).distinct(), key, "left_semi"))

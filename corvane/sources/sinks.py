"""Sinks: sheets, reports, inventories, indexes and snapshots keyed by their inputs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sheet_value(c: Column, dtype: T.DataType) -> Column:
    """Numbers get a leading blank, so that spreadsheets keep them as text; nulls stay empty."""
    if isinstance(dtype, T.NumericType):
        return F.concat(F.lit(" "), c.cast("string"))
    if isinstance(dtype, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ", ")
    return c.cast("string")


def sheet(df: DataFrame, null_text: dict[str, str] | None = None) -> DataFrame:
    """All columns as sheet text. null_text: what an empty value of a column is shown as."""
    shown = []
    for f in df.schema.fields:
        c = sheet_value(F.col(f"`{f.name}`"), f.dataType)
        if null_text and f.name in null_text:
            c = F.coalesce(F.nullif(c, F.lit("")), F.lit(null_text[f.name]))
        shown.append(c.alias(f.name))
    return df.select(*shown)


def write_tsv(df: DataFrame, folder: str, name: str | None = None, mode: str = "errorifexists") -> str:
    path = f"{folder}/{name or 'sheet-' + uuid.uuid4().hex}"
    sheet(df).write.mode(mode).csv(path, sep="\t", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def write_lines(df: DataFrame, path: str, col: str = "sentence", mode: str = "errorifexists") -> None:
    df.select(F.col(col).alias("value")).write.mode(mode).text(path)


NOTE_END = "<!-- end of note -->\n"
NOTES_A_FILE = 10_000


def write_notes(df: DataFrame, path: str, col: str = "value", mode: str = "errorifexists") -> None:
    """Notes, many to a file, each before a NOTE_END, which none may hold; `readers.markdown_files` reads them. Files by the note would cost more to open than to read."""
    df.select(F.col(col).alias("value")).write.mode(mode).option("lineSep", NOTE_END).option("maxRecordsPerFile", NOTES_A_FILE).text(path)


def write_by(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder a key value."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def inventory_json(inventory: DataFrame, note: str, today: Column | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """One JSON document of an inventory (term, sign, origin): sorted term lists, and the candidates (a few rows, by term) with all that is known of them."""
    own = lambda sign, origin: F.sort_array(F.collect_set(F.when((F.col("sign") == sign) & (F.col("origin") == origin), F.col("term"))))
    doc = F.struct(
        (F.current_date() if today is None else today).cast("string").alias("last_updated"),
        F.lit(note).alias("note"),
        own(-1, "seed").alias("seed_negative_terms"),
        own(1, "seed").alias("seed_positive_terms"),
        own(-1, "auto").alias("auto_negative_terms"),
        own(1, "auto").alias("auto_positive_terms"),
    )
    if candidates is None:
        return inventory.agg(F.to_json(doc).alias("value"))
    rows = candidates.agg(F.array_sort(F.collect_list(F.struct("term", *[c for c in candidates.columns if c != "term"]))).alias("candidates"))
    return inventory.agg(doc.alias("doc")).join(F.broadcast(rows)).select(F.to_json(F.struct("doc.*", "candidates")).alias("value"))


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row table as one JSON document."""
    report.coalesce(1).write.mode(mode).json(path)


def inputs_key(*parts: str) -> str:
    """Digest of everything that a snapshot depends on: paths, times, lexicon and model versions."""
    return hashlib.sha1("\x00".join(parts).encode()).hexdigest()


def snapshot(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The result kept under `key`, built and written if it is not there yet."""
    path = f"{folder}/{key}"
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Sources: Parquet corpora, label files, sentence tables, frame inventories, pages, bibliographies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


DEALT = (4 << 20, 128 << 20)  # bytes of a table that may be a single row group, and is worth dealing out


SHARE = 8 << 20  # bytes of a table for each task of slow work


def dealt(df: DataFrame, share: int | None = None) -> DataFrame:
    """A table whose files are too small for many row groups, and so would be read by one task, dealt over all cores; larger and tiny ones as they are.

    With a share, larger ones too, in whole rounds of the cores, so that no task takes longer than about a share does, however large the
    table and its row groups are: worth its shuffle where the work on a byte is slow.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if share and size >= DEALT[0]:
        return df.repartition(cores * -(-size // (cores * share)))
    return df.repartition(cores) if DEALT[0] <= size < DEALT[1] else df


def documents(spark: SparkSession, folder: str, columns: tuple[str, ...] = ("doc_id", "text"), share: int | None = None) -> DataFrame:
    """The corpus, read in the columns asked for alone."""
    docs = table(spark, folder, "documents")
    return (dealt(docs, share) if "text" in columns else docs).select(*columns)


def corpus_shards(spark: SparkSession, folder: str, most: int, pattern: str = "train-*.parquet") -> DataFrame:
    """`text` of the first `most` shards by name."""
    if most <= 0:
        raise ValueError("the number of shards must be positive")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(str(s.getPath()) for s in found)[:most]
    if not names:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return spark.read.parquet(*names).select("text")


def labelled_lines(lines: DataFrame, labels: tuple[str, ...] = ("RELEVANT", "IRRELEVANT")) -> DataFrame:
    """label, text of lines `LABEL | text`; blank lines, # comments, lines without | and other labels are skipped."""
    v = F.trim("value")
    cut = F.instr(v, "|")
    rows = lines.filter((v != "") & ~F.startswith(v, F.lit("#")) & (cut > 0))
    rows = rows.select(F.upper(F.trim(F.substring(v, F.lit(1), cut - 1))).alias("label"), F.trim(F.substring(v, cut + 1, F.length(v))).alias("text"))
    return rows.filter(F.col("label").isin(*labels) & (F.col("text") != ""))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    out = labelled_lines(spark.read.text(path))
    if out.isEmpty():
        raise ValueError(f"no labelled sentences in {path}")
    return out


def load_sentences_tsv(spark: SparkSession, path: str) -> DataFrame:
    """category, sentence: whichever of sentence/text and category/bucket the header has; numbers may carry a leading blank."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    pick = lambda names, default: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in raw.columns], F.lit(default))
    return raw.select(pick(("category", "bucket"), "FILTERED").alias("category"), pick(("sentence", "text"), "").alias("sentence")).filter("sentence <> ''")


def pipe_lines(lines: DataFrame) -> DataFrame:
    """category, sentence of lines `category|text`."""
    v = F.trim("value")
    cut = F.instr(v, "|")
    rows = lines.filter((cut > 0) & ~F.startswith(v, F.lit("#")))
    return rows.select(F.trim(F.substring(v, F.lit(1), cut - 1)).alias("category"), F.trim(F.substring(v, cut + 1, F.length(v))).alias("sentence")).filter("sentence <> ''")


def load_pipe_text(spark: SparkSession, path: str) -> DataFrame:
    return pipe_lines(spark.read.text(path))


INVENTORY = "seed_negative_terms array<string>, seed_positive_terms array<string>, auto_negative_terms array<string>, auto_positive_terms array<string>"


def frame_inventory(rows: DataFrame, json_col: str = "value", fallback: dict[str, list[str]] | None = None) -> DataFrame:
    """term, sign, origin (seed or auto), pos of an inventory document; the fallback stands in for one that can't be read."""
    fb = fallback or {"negative": [], "positive": []}
    j = F.from_json(F.col(json_col), INVENTORY)
    d = rows.select(j.alias("j"))
    parts = []
    for sign, side in ((-1, "negative"), (1, "positive")):
        for origin in ("seed", "auto"):
            default = F.array(*[F.lit(x) for x in fb[side]]).cast("array<string>") if origin == "seed" else F.array().cast("array<string>")
            arr = F.coalesce(F.col(f"j.{origin}_{side}_terms"), default)
            parts.append(d.select(F.posexplode(arr).alias("pos", "term"), F.lit(sign).alias("sign"), F.lit(origin).alias("origin")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_frame_inventory(spark: SparkSession, path: str, fallback: dict[str, list[str]] | None = None) -> DataFrame:
    return frame_inventory(spark.read.text(path, wholetext=True), fallback=fallback)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, side (minority, dominant, political), gate, ambiguous: a CSV that the user supplies."""
    raw = spark.read.csv(path, header=True, schema="term string, side string, gate boolean, ambiguous boolean")
    return raw.select(F.lower(F.trim("term")).alias("term"), "side", F.coalesce("gate", F.lit(True)).alias("gate"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def markdown_files(spark: SparkSession, folder: str, ignore: tuple[str, ...] = (), transforms: tuple[Callable[[Column], Column], ...] = (), pattern: str = "*.md", between: str | None = None) -> DataFrame:
    """file_path, text, modified of every Markdown file below a folder, less those that match an ignored pattern.

    between: what ends each note of files that hold many of them (`sinks.write_notes`); then a row is a note, not a file.
    transforms: text rewrites, such as those of `functions.markup`, applied to the trimmed text in their order.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/").split("://")[-1]
    path = F.regexp_replace(F.col("path"), rf"^.*?{base}/", "")
    texts = F.decode("content", "UTF-8")
    if between is not None:
        notes = F.split(texts, rf"\Q{between}\E", -1)
        texts = F.explode(F.slice(notes, F.lit(1), F.size(notes) - 1))  # nothing stands behind the last end
    out = raw.select(path.alias("file_path"), texts.alias("text"), F.col("modificationTime").alias("modified"))
    out = out.withColumn("text", F.trim("text", F.lit(" \t\r\n")))
    for p in ignore:
        out = out.filter(~F.col("file_path").rlike(p))
    return out.withColumn("text", reduce(lambda text, rewrite: rewrite(text), transforms, F.col("text"))) if transforms else out


def bib_entries(texts: DataFrame, col: str = "value") -> DataFrame:
    """key, kind, fields (map) of BibTeX entries. Values end at their closing quote or brace; entries begin with @ at a line's start."""
    entries = texts.select(F.explode(F.split(F.col(col), r"(?m)^\s*@")).alias("e")).filter(F.col("e").rlike(r"^\w+\s*\{"))
    pairs = F.regexp_extract_all("e", F.lit(r"(?s)(\w+)\s*=\s*[\{\"](?:.*?)[\}\"]\s*(?:,\s*\n|\n?\s*\}|\z)"), F.lit(0))
    name = lambda p: F.lower(F.regexp_extract(p, r"^(\w+)", 1))
    value = lambda p: F.regexp_replace(F.regexp_extract(p, r"(?s)=\s*[\{\"](.*?)[\}\"]\s*(?:,\s*\n|\n?\s*\}|\z)", 1), r"[{}]|\s+(?=\s)", "")
    fields = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(name(p), value(p)))))
    return entries.select(F.regexp_extract("e", r"^\w+\s*\{\s*([^,\s]+)", 1).alias("key"), F.lower(F.regexp_extract("e", r"^(\w+)", 1)).alias("kind"), fields.alias("fields"))


def load_bibliography(spark: SparkSession, path: str) -> DataFrame:
    return bib_entries(spark.read.text(path, wholetext=True))

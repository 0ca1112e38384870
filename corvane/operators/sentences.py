"""Sentence and token tables. Ids are (doc_id, sent_pos), stable across plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx


def sentences(docs: DataFrame, least: int = 40, most: int = 800, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_pos, sentence: full splitter."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.split_sentences(F.col(text_col), least, most)).alias("sent_pos", "sentence"))


def sentences_simple(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_pos, sentence: plain splitter, every part kept."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tx.sentence_parts_simple(F.col(text_col))).alias("sent_pos", "sentence"))


def token_arrays(sents: DataFrame) -> DataFrame:
    """doc_id, sent_pos, words: one row a sentence; operators on a sentence work inside the row."""
    return sents.select("doc_id", "sent_pos", tx.tokens(F.col("sentence")).alias("words"))


def token_table(sents: DataFrame) -> DataFrame:
    """doc_id, sent_pos, i, word."""
    return token_arrays(sents).select("doc_id", "sent_pos", F.posexplode("words").alias("i", "word"))

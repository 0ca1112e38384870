"""Lexicons as tables: matching, gate terms, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx


def match_inventory(words: DataFrame, inventory: DataFrame) -> DataFrame:
    """word, term: the first candidate form of each word that the inventory (form) holds."""
    forms = words.select("word", F.posexplode(tx.candidate_forms(F.col("word"))).alias("rank", "form"))
    return forms.join(inventory.select("form").distinct(), "form").groupBy("word").agg(F.min_by("form", "rank").alias("term"))


def gate_terms(sides: list[DataFrame], broad: DataFrame) -> DataFrame:
    """Terms of all sides, once each, less those too broad to open a gate."""
    out = sides[0].select("term")
    for x in sides[1:]:
        out = out.union(x.select("term"))
    return out.distinct().join(broad.select("term"), "term", "left_anti")


def strong_terms(terms: DataFrame, *ambiguous: DataFrame) -> DataFrame:
    """Terms that no list of ambiguous ones holds."""
    for x in ambiguous:
        terms = terms.select("term").subtract(x.select("term"))
    return terms


def prompt_bank(tokens: DataFrame, templates: DataFrame, own: DataFrame) -> DataFrame:
    """token, slot, prompt: every template (slot, template; a few rows) filled with every token, or the token's own template (token, slot, own) where it has one."""
    bank = tokens.select("token").join(F.broadcast(templates)).join(own, ["token", "slot"], "left")
    return bank.select("token", "slot", tx.fill_template(F.coalesce("own", "template"), F.col("token")).alias("prompt"))


def reported_groups(mentions: DataFrame, least: int = 50, key: str = "lemma") -> DataFrame:
    """Groups with enough mentions to report: key, total."""
    return mentions.groupBy(key).agg(F.count("*").alias("total")).filter(F.col("total") >= least)

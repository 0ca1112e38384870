"""Annotated tokens: a pluggable parser fills them; a rule tokenizer stands in and leaves `dep` null.

What is asked of a parsed sentence is a step; steps run in one pass through Python, so that tokens cross to the JVM only if
they are kept.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

SENTENCES_AT_ONCE = 256  # sentences that stand in a worker as Python objects
SENTENCES_IN_COLUMNS = 2048  # those whose tokens stand there as words alone

TOKEN = "struct<i:int,text:string,lemma:string,pos:string,tag:string,dep:string,head_i:int,ent_type:string>"


class Annotator(Protocol):
    """sentence -> list of token records (i, text, lemma, pos, tag, dep, head_i, ent_type).

    A `columns` (sentences -> tokens in each sentence, and every field of all their tokens) may say the same in columns.
    """

    def annotate(self, sentence: str) -> list[dict]: ...


class RuleAnnotator:
    """Words and punctuation; lemma is the lower-cased word; no parse, so `dep` is null and heads are the tokens themselves."""

    pattern = re.compile(r"\w+(?:-\w+)*|[^\w\s]")

    def annotate(self, sentence: str) -> list[dict]:
        return [
            {"i": i, "text": w, "lemma": w.lower(), "pos": "NOUN" if w[0].isalpha() else "PUNCT", "tag": "", "dep": None, "head_i": i, "ent_type": ""}
            for i, w in enumerate(self.pattern.findall(sentence))
        ]

    def columns(self, sentences: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        found = [self.pattern.findall(s) for s in sentences]
        sizes = np.array([len(x) for x in found], np.int64)
        text = pa.array(list(chain.from_iterable(found)), pa.string())
        word = text.dictionary_encode()  # words repeat
        of = lambda values: pa.array(values, pa.string()).take(word.indices)
        known = word.dictionary.to_pylist()
        i = pa.array(np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes), pa.int32())
        blank = pa.repeat(pa.scalar("", pa.string()), len(text))
        fields = {"i": i, "text": text, "lemma": of([w.lower() for w in known]), "pos": of(["NOUN" if w[0].isalpha() else "PUNCT" for w in known])}
        return sizes, fields | {"tag": blank, "dep": pa.nulls(len(text), pa.string()), "head_i": i, "ent_type": blank}


@dataclass(frozen=True)
class Step:
    """An array column of sentences: its name, the schema of its elements, and the function of a row, with the columns of the steps before, that makes them.

    `whole` makes the same of a batch and the column's type at once; it does not see other steps.
    """

    out: str
    schema: str
    of: Callable[[dict], list]
    whole: Callable[[pa.RecordBatch, pa.DataType], pa.Array] | None = None


def run_steps(df: DataFrame, steps: Sequence[Step], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns to keep, of df and of the steps; all of them if left out. Every worker holds a bounded number of sentences."""
    names, made = df.columns, {s.out: f"array<{s.schema}>" for s in steps}
    kinds = dict(df.dtypes) | made
    keep = [*names, *made] if keep is None else list(keep)
    at_once = all(s.whole for s in steps)
    most = SENTENCES_IN_COLUMNS if at_once else SENTENCES_AT_ONCE
    arrow = {c: to_arrow_type(DataType.fromDDL(made[c])) for c in keep if c in made}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if at_once:
                    ready = {s.out: s.whole(part, arrow[s.out]) for s in steps if s.out in arrow}
                    yield pa.RecordBatch.from_arrays([ready[c] if c in made else part.column(c) for c in keep], keep)
                    continue
                gc.disable()  # many small objects live until the part is done; to look through them for cycles takes longer than to make them
                try:
                    rows = part.to_pylist()
                    for row in rows:
                        for step in steps:
                            row[step.out] = step.of(row)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], arrow[c]) if c in made else part.column(c) for c in keep], keep)

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep))


def annotate_step(annotator: Annotator, col: str = "sentence") -> Step:
    def whole(part: pa.RecordBatch, kind: pa.DataType) -> pa.Array:
        sizes, fields = annotator.columns([x or "" for x in part.column(col).to_pylist()])
        tokens = pa.StructArray.from_arrays([fields[f.name] for f in kind.value_type], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens, type=kind)

    return Step("tokens", TOKEN, lambda row: annotator.annotate(row[col] or ""), whole if hasattr(annotator, "columns") else None)


def annotate(sents: DataFrame, annotator: Annotator, col: str = "sentence") -> DataFrame:
    """sents with `tokens`; the annotator is shipped once to each worker."""
    return run_steps(sents, [annotate_step(annotator, col)])


def token_rows(annotated: DataFrame, keys: list[str]) -> DataFrame:
    return annotated.select(*keys, F.inline("tokens"))

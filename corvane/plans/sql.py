"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

# the plain sentence splitter, and words of each sentence
SENT = r"""sent AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS sent_pos
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents)),
words AS (SELECT doc_id, sent_pos, regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+') AS words FROM sent)"""
TOK = SENT + r""",
tok AS (SELECT doc_id, sent_pos, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM words)"""


def values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows) + f") AS v({names})"

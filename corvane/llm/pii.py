"""Personal data by patterns, and information-theoretic sanitisation of the words that reveal it.

Patterns give the base spans (e-mail, IP, payment card, phone) and spans of kind `secret`: runs of 20 or
more letters, digits and underscores, with three digits and three letters at least and an empirical
entropy of SECRET_BITS a character. Their values are the protected entities. Every entity backs off to
classes, which are protected too: an e-mail to its domain, an IP to its network, a card to its issuer, a
phone number to its prefix, and all to their kind. So a word that announces personal data is found
from the whole kind's contexts, though every single value occurs once.

For every entity or class e and every term t that stands within `window` words of it, the corpus tells
how strongly t reveals e: P(e | t) = texts with t beside e / (texts with t + 1), and the gain
log2(P(e | t) / P(e)). The one added text, in which t stands without e, corrects small counts: a term
of one text has share 1/2, so a term unique to one entity qualifies however seldom the entity occurs,
and one met elsewhere as often does not. Texts are counted once however often they were copied, so a
copied page is no evidence. The window serves this estimate only: every occurrence, in any text, of a
term that reaches both thresholds for some e is a span of kind `term`, with the largest share and gain;
`sanitise` removes it, or generalises it to its kind when its gain is under `remove_bits`.

All patterns run in linear time: e-mail and IP are matched around their separators, which gives the
leftmost non-overlapping matches of the patterns without rescanning long runs. Contexts cost `window`
words a span.

Defined cases: a null text counts as empty; texts of any length are read whole; rows that repeat an id
are told apart by their text, and repeated rows get the same spans; a term that reaches the thresholds
for several entities has the largest of their shares and gains, so ties don't matter; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import only_held, settle, spread_join, weigh

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SECRET = re.compile(r"[A-Za-z0-9_]{20,}")
SECRET_BITS = 3.0
WORD = re.compile(r"[^\W\d_]{3,}")
TERMS_BOUND = 16 << 20  # bytes of candidate terms that are sent to every worker
NO_TERMS = "cast(array() as array<struct<start:int,end:int,share:double,bits:double>>)"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x) <= 3 and int(x) <= 255 or len(s := x.lstrip("0")) <= 3 and int(s or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    out += [("ip", s, e) for s, e in ips(text)]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs that look drawn at random, clear of the base spans."""
    taken = sorted((s, e) for _, s, e in spans)
    starts, out = [s for s, _ in taken], []
    longest = [0, *accumulate((e for _, e in taken), max)]  # the furthest end among the first k spans
    for m in SECRET.finditer(text):
        count = Counter(m[0])
        digits = sum(n for c, n in count.items() if "0" <= c <= "9")
        size = m.end() - m.start()
        if digits < 3 or size - digits - count["_"] < 3 or longest[bisect_left(starts, m.end())] > m.start():
            continue
        if sum(n * math.log2(size / n) for n in count.values()) >= SECRET_BITS * size:
            out.append(("secret", *m.span()))
    return out


def all_spans(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secrets(text, base)


def entities(kind: str, value: str) -> list[str]:
    """The entity that a span names, and the classes it backs off to, up to its kind."""
    if kind == "email":
        value = value.lower()
        classes = [f"domain:{value[value.index('@') + 1 :]}"]
    elif kind == "ip":
        classes = [f"network:{value[: value.rindex('.')]}"]
    elif kind in ("card", "phone"):
        value = re.sub("[^0-9]", "", value)
        classes = [f"{'issuer' if kind == 'card' else 'prefix'}:{value[: 6 if kind == 'card' else 4]}"]
    else:
        classes = []
    return [f"{kind}:{value}", *classes, f"kind:{kind}"]


def words(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """Start and end of every word, and whether it stands clear of the spans."""
    cover: list[tuple[int, int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if cover and s <= cover[-1][1]:
            s, e = cover[-1][0], max(e, cover.pop()[1])
        cover.append((s, e))
    out, k = [], 0
    for m in WORD.finditer(text):
        a, b = m.span()
        while k < len(cover) and cover[k][1] <= a:
            k += 1
        out.append((a, b, k == len(cover) or cover[k][0] >= b))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], window: int) -> list[dict]:
    """For each span: its entity, with its classes, and the terms within `window` words on either side."""
    all_words = words(text, spans)
    starts, ends = [x[0] for x in all_words], [x[1] for x in all_words]
    out = []
    for kind, s, e in spans:
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        near = all_words[max(0, i - window) : i] + all_words[j : j + window]
        out.append({"entities": entities(kind, text[s:e]), "terms": [text[a:b].lower() for a, b, clear in near if clear]})
    return out


FOUND = "id {id}, th long, spans array<struct<kind:string,start:int,end:int>>, contexts array<struct<entities:array<string>,terms:array<string>>>"
MARKED = "id {id}, th long, spans array<struct<kind:string,start:int,end:int>>, terms array<struct<start:int,end:int,share:double,bits:double>>"


def _find(window: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [all_spans(t) for t in f["text"]]
            near = [contexts(t, s, window) if s else [] for t, s in zip(f["text"], spans)]
            yield pd.DataFrame({"id": f["id"], "th": f["th"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], "contexts": near})

    return run


def _terms(wanted: frozenset[str] | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for th, t in zip(f["th"], f["text"]):
                own = {w.lower() for w in WORD.findall(t)}
                rows += [(x, th) for x in (own if wanted is None else own & wanted)]
            yield pd.DataFrame(rows, columns=["term", "th"]).astype({"th": "int64"})

    return run


def _mark(told: dict[str, tuple[float, float]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [all_spans(t) for t in f["text"]]
            marks = []
            for t, x in zip(f["text"], spans):
                some = not told.keys().isdisjoint(map(str.lower, WORD.findall(t)))
                hits = [(a, b, hit) for a, b, clear in words(t, x) if clear and (hit := told.get(t[a:b].lower()))] if some else []
                marks.append([{"start": a, "end": b, "share": hit[0], "bits": hit[1]} for a, b, hit in hits])
            yield pd.DataFrame({"id": f["id"], "th": f["th"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], "terms": marks})

    return run


def _places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for th, t in zip(f["th"], f["text"]):
            at: dict[str, list[dict]] = {}
            for a, b, clear in words(t, all_spans(t)):
                if clear:
                    at.setdefault(t[a:b].lower(), []).append({"start": a, "end": b})
            rows += [(th, term, x) for term, x in at.items()]
        yield pd.DataFrame(rows, columns=["th", "term", "at"]).astype({"th": "int64"})


def _mark_by_join(rows: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """The same as `_mark` for any number of terms: occurrences meet the terms in a shuffled join."""
    places = rows.dropDuplicates(["th"]).mapInPandas(_places, "th long, term string, at array<struct<start:int,end:int>>")
    places = only_held(places, settle(told.select(F.xxhash64("term").alias("h")).distinct()), F.xxhash64("term"))
    marks = places.join(told, "term").select("th", F.explode("at").alias("at"), "share", "bits").select("th", F.struct("at.start", "at.end", "share", "bits").alias("mark"))
    marks = settle(marks.groupBy("th").agg(F.array_sort(F.collect_list("mark")).alias("terms")))
    return found.join(marks, "th", "left").select("id", "th", "spans", F.coalesce("terms", F.expr(NO_TERMS)).alias("terms"))


def disclosing_terms(rows: DataFrame, found: DataFrame, min_share: float, min_bits: float) -> DataFrame:
    """entity, term, share (P(entity | term)), bits: the pairs that exceed the thresholds."""
    ctx = found.select("th", F.explode("contexts").alias("c")).select("th", F.explode("c.entities").alias("entity"), "c.terms")
    near = settle(ctx.select("entity", "th", F.explode("terms").alias("term")).distinct())
    pairs = settle(near.groupBy("entity", "term").agg(F.count("*").alias("n_et")))
    # texts whose contexts hold a term bound its texts from below: pairs that can't reach the share need no count over the corpus
    least = near.select("th", "term").distinct().groupBy("term").agg(F.count("*").alias("least"))
    least = settle(least.join(pairs.groupBy("term").agg(F.count("*").alias("weight")), "term"))
    pairs = settle(spread_join(pairs, least, "term", "weight").filter(F.col("n_et") >= min_share * (F.col("least") + 1)).drop("least"))
    terms = settle(pairs.groupBy("term").agg(F.count("*").alias("weight")))
    n_terms, size = weigh(terms, F.octet_length("term") + 16)
    if not n_terms:
        return pairs.select("entity", "term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
    wanted = frozenset(r[0] for r in terms.select("term").collect()) if size <= TERMS_BOUND else None
    texts = rows.mapInPandas(_terms(wanted), "term string, th long").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
    texts = settle(terms.join(texts, "term"))
    total = rows.select("th").distinct().agg(F.count("*").alias("n"))
    own = ctx.select("entity", "th").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    own = settle(own.join(pairs.groupBy("entity").agg(F.count("*").alias("weight")), "entity"))
    p = spread_join(spread_join(pairs, texts, "term", "weight"), own, "entity", "weight").join(F.broadcast(total))  # one row
    share = F.col("n_et") / (F.col("n_t") + 1)
    bits = F.log2(share * F.col("n") / F.col("n_e"))
    return p.select("entity", "term", share.alias("share"), bits.alias("bits")).filter((F.col("share") >= min_share) & (F.col("bits") >= min_bits))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, min_share: float = 0.5, min_bits: float = 3.0) -> DataFrame:
    """id, th (hash of the text), spans (base spans and secrets, by kind then start), terms (spans with share and bits) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = dict(docs.dtypes)[id_col]
    found = settle(rows.mapInPandas(_find(window), FOUND.format(id=id_type)))
    told = disclosing_terms(rows.select("th", "text"), found, min_share, min_bits)
    told = settle(told.groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")))
    n_told, size = weigh(told, F.octet_length("term") + 32)
    if not n_told:
        out = found.select("id", "th", "spans", F.expr(NO_TERMS).alias("terms"))
    elif size <= TERMS_BOUND:
        known = {x["term"]: (x["share"], x["bits"]) for x in told.collect()}
        out = rows.mapInPandas(_mark(known), MARKED.format(id=id_type))
    else:
        out = _mark_by_join(rows, found, told)
    return out.select(F.col("id").alias(id_col), "th", "spans", "terms")


def _clean(remove_bits: float):
    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, base, more in zip(texts, spans, terms):
            edits = [(x["start"], x["end"], f"[{x['kind'].upper()}]") for x in base] + [(x["start"], x["end"], "" if x["bits"] >= remove_bits else "[TERM]") for x in more]
            parts, at = [], 0
            for s, e, new in sorted(edits):
                if s >= at:
                    parts += [text[at:s], new]
                at = max(at, e)
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    return clean


def sanitise(docs: DataFrame, remove_bits: float = 8.0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and text of every row, with base spans and disclosing terms generalised or removed."""
    found = find_pii(docs, id_col, text_col, **options)
    f = found.dropDuplicates([id_col, "th"]).select(F.col(id_col).alias("i"), F.col("th").alias("t"), "spans", "terms")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    out = d.join(f, d["id"].eqNullSafe(f["i"]) & (d["th"] == f["t"]))
    return out.select(F.col("id").alias(id_col), _clean(remove_bits)("text", "spans", "terms").alias(text_col))

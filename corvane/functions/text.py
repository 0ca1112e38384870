"""Text functions on columns. No user-defined functions: everything stays in generated code."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
SPLIT_MARK = "\x01"
PRD = "<prd>"

# Abbreviations whose period does not end a sentence, and cues of bibliographic text.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Rev St Jr Sr vs Fig Figs fig figs Messrs No Nos Vol Ch chap pp p".split()
BIBLIOGRAPHIC = ["ISBN", "DOI", "Journal", "Proceedings", "University Press", "Cambridge University Press", "Oxford University Press", "Princeton University Press", r"Vol\.", r"No\.", r"Nr\.", "chapter", "edited by", "published by"]


def tokens(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def remove_noise(text: Column) -> Column:
    """Drops tags and all but printable ASCII and newlines, then joins runs of blanks."""
    t = F.regexp_replace(text, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"[^\x20-\x7E\n]", "")
    return F.trim(F.regexp_replace(t, r" {2,}", " "))


def protect_periods(text: Column) -> Column:
    """Marks periods of abbreviations, acronyms and initials; an initial's rule covers acronyms too."""
    t = F.regexp_replace(text, rf"(?U)\b({'|'.join(ABBREVIATIONS)})\.", f"$1{PRD}")
    return F.regexp_replace(t, r"(?U)\b([A-Z])\.", f"$1{PRD}")


def sentence_parts(text: Column) -> Column:
    """Splits after . ! ? and white space, before a capital, digit or quote."""
    return F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z0-9\"'“‘])", -1)


def sentence_parts_simple(text: Column) -> Column:
    """The split without protected periods or glued fragments, for plain ASCII cues."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+([A-Z0-9\"'])", f"$1{SPLIT_MARK}$2"), SPLIT_MARK)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once a row, however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


BRACKETS = ("()", "[]", "{}")
SHORT_TAIL = r"(?d)\([A-Za-z]{1,8}\.$"


def _surplus(s: Column) -> list[Column]:
    """By bracket kind, how many more are opened than closed."""
    count = lambda c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return [F.when(s.rlike(r"[()\[\]{}]"), count(pair[0]) - count(pair[1])).otherwise(F.lit(0)) for pair in BRACKETS]


def open_fragment(s: Column) -> Column:
    """A fragment that the next one must complete: an unclosed bracket, or a short bracketed abbreviation at its end."""
    return reduce(lambda a, b: a | b, [n > 0 for n in _surplus(s)]) | s.rlike(SHORT_TAIL)


def _open_marks(parts: Column) -> Column:
    """A text with one character a part: 1 where the fragment that ends there is open, 0 where it is complete. One pass, in integers."""
    seen = F.transform(parts, lambda p: F.struct(*[n.alias(f"n{i}") for i, n in enumerate(_surplus(p))], p.rlike(SHORT_TAIL).alias("tail"), (p == "").alias("empty")))
    start = F.struct(*[F.lit(0).alias(f"n{i}") for i in range(len(BRACKETS))], F.lit(False).alias("tail"), F.lit("").alias("marks"))

    def step(acc: Column, part: Column) -> Column:
        going = F.endswith(acc["marks"], F.lit("1"))
        sums = [F.when(going, acc[f"n{i}"]).otherwise(F.lit(0)) + part[f"n{i}"] for i in range(len(BRACKETS))]
        tail = F.when(part["empty"], going & acc["tail"]).otherwise(part["tail"])
        is_open = reduce(lambda a, b: a | b, [n > 0 for n in sums]) | tail
        return F.struct(*[n.alias(f"n{i}") for i, n in enumerate(sums)], tail.alias("tail"), F.concat(acc["marks"], F.when(is_open, F.lit("1")).otherwise(F.lit("0"))).alias("marks"))

    return F.aggregate(seen, start, step, lambda acc: acc["marks"])


def split_sentences(text: Column, least: int = 40, most: int = 800) -> Column:
    """Array of sentences: open fragments are glued to what follows; what is pending at the end is kept if its length fits.

    Cost is linear in the parts of a text; a text without open fragments is not folded at all.
    """
    split = F.transform(sentence_parts(protect_periods(text)), lambda p: F.trim(F.replace(p, F.lit(PRD), F.lit("."))))
    fits = lambda s: (F.length(s) >= least) & (F.length(s) <= most) & ~F.contains(s, F.lit("\n"))
    whole = lambda s: fits(s) & s.rlike(r"(?s)^\p{Lu}.*[.!?]\z")

    def glued(parts: Column, marks: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i == 1) | (F.substring(marks, i - 1, F.lit(1)) == "0"))

        def run(i: Column) -> Column:
            end = F.call_function("locate", F.lit("0"), marks, i)
            last = F.when(end > 0, end).otherwise(F.size(parts))
            s = F.array_join(F.filter(F.slice(parts, i, last - i + 1), lambda p: p != ""), " ")
            return F.struct(s.alias("s"), (end > 0).alias("done"))

        kept = F.filter(F.transform(starts, run), lambda x: F.when(x["done"], whole(x["s"])).otherwise(fits(x["s"])))
        return F.transform(kept, lambda x: x["s"])

    folded = lambda parts: let(_open_marks(parts), lambda marks: glued(parts, marks))
    return let(split, lambda parts: F.when(F.exists(parts, open_fragment), folded(parts)).otherwise(F.filter(parts, whole)))


def normalize_surface(text: Column) -> Column:
    """Lower case, with non-breaking hyphens and dashes as hyphens."""
    return F.translate(F.lower(text), "‑–—", "---")


def candidate_forms(form: Column) -> Column:
    """A word and its singular candidates, in order of preference, without repeats."""
    n = F.length(form)
    cut = lambda k: F.substring(form, F.lit(1), n - k)
    forms = F.array(
        form,
        F.regexp_replace(form, r"\.+\z", ""),
        F.when(F.endswith(form, F.lit("ies")) & (n > 3), F.concat(cut(3), F.lit("y"))),
        F.when(F.endswith(form, F.lit("es")) & (n > 2), cut(2)),
        F.when(F.endswith(form, F.lit("s")) & (n > 1), cut(1)),
    )
    return F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "")))


def surface_variants(term: Column) -> Column:
    """A term with its plural spellings."""
    y = F.endswith(term, F.lit("y")) & (F.length(term) > 1)
    forms = F.array(
        term,
        F.when(y, F.concat(F.substring(term, F.lit(1), F.length(term) - 1), F.lit("ies"))),
        F.when(~F.endswith(term, F.lit("s")), F.concat(term, F.lit("s"))),
        F.concat(term, F.lit("es")),
    )
    return F.array_distinct(F.array_compact(forms))


def noise_flags(s: Column) -> Column:
    """Flags of reference noise: index entries, addresses or markup, bibliographic cues."""
    return F.array_compact(
        F.array(
            F.when(s.rlike(r"(?d),\s*\d{1,4}\.$"), F.lit("index_page_ref")),
            F.when(s.rlike(r"https?://|www\.|<[^>]+>"), F.lit("url_or_markup")),
            F.when(s.rlike(rf"(?iU)\b({'|'.join(BIBLIOGRAPHIC)})\b"), F.lit("bibliographic")),
        )
    )


def escape_regex(term: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c for c in term)


def trie(terms: Iterable[Sequence[str]]) -> str:
    """A pattern for any of the terms, longer ones first. A term is a list of units, patterns that match no common text, such as escaped letters.

    Beginnings that terms share are written once, so that a match follows one path instead of trying all terms in turn:
    its cost depends on a term's length and not on their number.
    """
    root: dict[str, dict] = {}
    for units in terms:
        node = root
        for u in units:
            node = node.setdefault(u, {})
        node[""] = {}  # a term ends here

    def shape(node: dict[str, dict]) -> str:
        tail = ""
        while len(node) == 1 and "" not in node:  # no group for a single path
            ((u, node),) = node.items()
            tail += u
        ways = [u + shape(child) for u, child in sorted(node.items()) if u]
        return tail + (f"(?:{'|'.join(ways)}){'?' if '' in node else ''}" if ways else "")

    return shape(root)


def alternation(terms: list[str]) -> str:
    """A pattern for any of the terms, longer ones first."""
    return trie([escape_regex(c) for c in t] for t in terms)


# Person suffixes, and what may stand between a term and its human noun.
SUFFIXES = "man|men|woman|women|boy|boys|girl|girls|people"
GAP = r"""[\s,;'"“”‘’()\[\]-]+"""


def gate_pattern(terms: list[str]) -> str:
    """Any term between non-word characters, or a term with a person suffix."""
    a = alternation(terms)
    return rf"(?iU)(?<!\w)(?:{a})(?:{SUFFIXES})?(?!\w)"


def lexical_human_rescue(s: Column, terms: list[str], heads: list[str]) -> Column:
    """A term with a person suffix, or a term at most three words before a human noun."""
    a, h = alternation(terms), alternation(heads)
    gap = GAP
    suffixed = s.rlike(rf"(?U)\b[A-Z]?[a-z]+(?:{SUFFIXES})\b") & s.rlike(rf"(?iU)(?<!\w)(?:{a})(?:{SUFFIXES})(?!\w)")
    near = s.rlike(rf"(?iU)(?<!\w)(?:{h})(?!\w)") & s.rlike(rf"(?iU)(?<!\w)(?:{a})(?!\w)(?:{gap}\w+){{0,3}}?{gap}(?:{h})(?!\w)")
    return suffixed | near


def context_slice(words: Column, at: Column, window: int) -> tuple[Column, Column]:
    """Start (0-based) and words of the window of `window` words on each side of a position."""
    lo = F.greatest(at - window, F.lit(0))
    return lo, F.slice(words, lo + 1, at + window + 1 - lo)


def focus_context(words: Column, at: Column, window: int = 24) -> Column:
    """The window with its target in brackets, then the full text."""
    lo, near = context_slice(words, at, window)
    shown = F.transform(near, lambda w, i: F.when(i + lo == at, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return F.concat(F.array_join(shown, " "), F.lit(" || "), F.array_join(words, " "))


def focus_text(words: Column, span: Column, head: Column, window: int = 24) -> Column:
    """Window around a mention span and its predicate, both marked. span: array of positions."""
    lo = F.greatest(F.least(F.array_min(span), head) - window, F.lit(0))
    hi = F.greatest(F.array_max(span), head) + window + 1
    near = F.slice(words, lo + 1, hi - lo)
    mark = lambda w, i: F.when(F.array_contains(span, i + lo), F.concat(F.lit("[GROUP:"), w, F.lit("]"))).when(i + lo == head, F.concat(F.lit("[PRED:"), w, F.lit("]"))).otherwise(w)
    return F.array_join(F.transform(near, mark), " ")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_unescape(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def reading_minutes(text: Column, per_minute: int = 200) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(words / per_minute)


CJK = r"([぀-ヿ一-鿿가-힯\x{20000}-\x{2a6df}])"


def search_tokens(text: Column) -> Column:
    """Lower-cased words split at blanks; every kana, kanji and hangul character is a word."""
    spaced = F.regexp_replace(F.lower(text), CJK, " $1 ")
    return F.filter(F.split(spaced, "[ \t\r\n]+"), lambda x: x != "")


def query_terms(term: Column) -> Column:
    """Words of a query and its growing phrases, longest first, ties in order."""
    words = F.filter(F.split(term, r"\s+"), lambda w: w != "")
    phrases = F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, F.lit(1), i), " "))
    every = F.concat(words, F.when(F.size(words) >= 2, phrases).otherwise(F.array().cast("array<string>")))
    order = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(every, order)


def mark_predicate(words: Column, at: Column, marker: str = "[V]") -> Column:
    """Words, joined by blanks, with a marker put before the predicate (0-based); the predicate is then one place further."""
    return F.array_join(F.array_insert(words, at + 1, F.lit(marker)), " ")


def fill_template(template: Column, token: Column, slot: str = "{token}") -> Column:
    return F.replace(template, F.lit(slot), token)

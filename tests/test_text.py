import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx


def test_search_tokens(one):
    got = one(tx.search_tokens, ["hello\tworld\ntest", "これはtest文章です", "", "   ", "あ", "한글 Mixed"])
    assert got == [["hello", "world", "test"], list("これは") + ["test"] + list("文章です"), [], [], ["あ"], ["한", "글", "mixed"]]


def test_remove_noise(one):
    assert one(tx.remove_noise, ["<b>Hé</b>  there\t“x”\nnext ", " a   b "]) == ["H therex\nnext", "a b"]


def test_protect_periods(one):
    got = one(tx.protect_periods, ["Mr. Smith of the U.S. Army, Fig. 2, No. 4.", "J. Doe. End.", "éblaMr. x"])
    assert got == ["Mr<prd> Smith of the U<prd>S<prd> Army, Fig<prd> 2, No<prd> 4.", "J<prd> Doe. End.", "éblaMr. x"]


LONG = "This sentence is certainly longer than forty characters"


@pytest.mark.parametrize(
    "text,want",
    [
        (f"{LONG}. {LONG}!", [f"{LONG}.", f"{LONG}!"]),
        (f"{LONG} by Mr. Smith. {LONG}?", [f"{LONG} by Mr. Smith.", f"{LONG}?"]),
        (f"{LONG} (an aside. It goes on) and ends. Short.", [f"{LONG} (an aside. It goes on) and ends."]),
        (f"{LONG}. and lower case goes on here.", [f"{LONG}. and lower case goes on here."]),
        (f"lower first {LONG}.", []),
        (f"{LONG} without an end", []),
        (f"{LONG} with\na newline.", []),
        (f"{LONG} and then (never closed", [f"{LONG} and then (never closed"]),
        ("x" * 39 + ".", []),
        ("A" * 39 + ".", ["A" * 39 + "."]),
        ("A" * 799 + ".", ["A" * 799 + "."]),
        ("A" * 800 + ".", []),
        ("", []),
    ],
)
def test_split_sentences(one, text, want):
    assert one(tx.split_sentences, [text]) == [want]


def plain_split(text, least=40, most=800):
    """The splitter by one loop over the parts."""
    t = re.sub(rf"\b({'|'.join(tx.ABBREVIATIONS)})\.", r"\1<prd>", text)
    t = re.sub(r"\b([A-Z])\.", r"\1<prd>", t)
    parts = [p.replace("<prd>", ".").strip(" ") for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'“‘])", t)]
    fits = lambda s: least <= len(s) <= most and "\n" not in s
    out, pending = [], ""
    for part in parts:
        pending = f"{pending} {part}".strip(" ")
        if any(pending.count(a) > pending.count(b) for a, b in ("()", "[]", "{}")) or re.search(r"\([A-Za-z]{1,8}\.\Z", pending):
            continue
        if fits(pending) and pending[:1].isupper() and pending[-1] in ".!?":
            out.append(pending)
        pending = ""
    return out + ([pending] if fits(pending) else [])


def test_split_sentences_matches_a_loop(one):
    r = random.Random(3)
    bits = ["Alpha went home", "see (ed", "(an aside", "it ends)", "[one", "two]", "A. Smith", "No", "{x", "}", "Many words follow here to make it long", "(pp", "", "so on)", "Émile left"]
    texts = [" ".join(r.choice(bits) + r.choice([".", "!", "?", ".", ". ", ""]) for _ in range(r.randint(0, 14))) for _ in range(400)]
    assert one(tx.split_sentences, texts) == [plain_split(t) for t in texts]
    assert any(plain_split(t) and "(" in t for t in texts)


def test_long_texts_take_linear_time(one):
    text = "This sentence is certainly longer than forty characters. " * 20_000
    at = time.perf_counter()
    got = one(lambda c: F.size(tx.split_sentences(c)), [text, text + "(open " + text])
    assert got == [20_000, 19_999] and time.perf_counter() - at < 30


def test_open_fragments(one):
    assert one(tx.open_fragment, ["a (b", "a (b)", "x [y", "{", "see (ed.", "done.", ""]) == [True, False, True, True, True, False, False]


def test_candidate_forms(one):
    got = one(tx.candidate_forms, ["countries", "boxes", "is", "mr.", "s", "cat"])
    assert got == [["countries", "country", "countri", "countrie"], ["boxes", "box", "boxe"], ["is", "i"], ["mr.", "mr"], ["s"], ["cat"]]


def test_surface_variants(one):
    assert one(tx.surface_variants, ["lady", "bus", "y"]) == [["lady", "ladies", "ladys", "ladyes"], ["bus", "buses"], ["y", "ys", "yes"]]


def test_noise_flags(one):
    got = one(tx.noise_flags, ["Index entry, 12.", "see www.x.org", "Vol. 3 of it", "Vol.3 of it", "The Journal of X", "plain", "a <b>"])
    assert got == [["index_page_ref"], ["url_or_markup"], [], ["bibliographic"], ["bibliographic"], [], ["url_or_markup"]]


def test_gate_has_unicode_boundaries(one):
    p = tx.gate_pattern(["north", "old norse", "a-b"])
    got = one(lambda c: c.rlike(p), ["The NORTH wind", "énorth", "northé", "northmen came", "Old Norse", "an a-b c", "northern"])
    assert got == [True, False, False, True, True, True, False]


def test_human_rescue(one):
    fn = lambda c: tx.lexical_human_rescue(c, ["north"], ["people", "farmer"])
    got = one(fn, ["Northmen rule", "north and the old people", "north of all the very old people", "people of north", "north people"])
    assert got == [True, True, False, False, True]


def test_focus(one):
    from pyspark.sql import functions as F

    words = ["a", "b", "c", "d", "e"]
    assert one(lambda w: tx.focus_context(w, F.lit(2), 1), [(words,)], "w array<string>") == ["b [c] d || a b c d e"]
    assert one(lambda w: tx.focus_text(w, F.array(F.lit(1)), F.lit(3), 1), [(words,)], "w array<string>") == ["a [GROUP:b] c [PRED:d] e"]


def test_escape_round_trip(one):
    s = """<a href="x">&'&amp;</a>"""
    assert one(tx.html_escape, [s]) == ["&lt;a href=&quot;x&quot;&gt;&amp;&#039;&amp;amp;&lt;/a&gt;"]
    assert one(lambda c: tx.html_unescape(tx.html_escape(c)), [s]) == [s]


def test_query_terms(one):
    assert one(tx.query_terms, ["big red dog", "one"]) == [["big red dog", "big red", "big", "dog", "red"], ["one"]]


def test_trie_prefers_longer_terms_and_backs_off(one):
    terms = ["with", "with the", "within", "a.b", "a", "über", "x-y", "to", "tome"]
    p = rf"(?U)(?<!\w)(?:{tx.alternation(terms)})(?!\w)"
    found = lambda t: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    assert one(found, ["with the a.b", "with them within", "withi a.bc über x-y", "tomes to tom tome"]) == [["with the", "a.b"], ["with", "within"], ["a", "über", "x-y"], ["to", "tome"]]


def test_gate_cost_does_not_grow_with_the_terms(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    many = sorted({word() for _ in range(10_000)} | {f"{word()} {word()}" for _ in range(500)})
    texts = [" ".join(r.choice("rstuvwxyz") + word() for _ in range(400)) for _ in range(300)] + [f"the {many[77]}women here", "the " + many[5000].upper() + ".", many[3] + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()
    df.count()
    took = {}
    for terms in (many[:10], many):
        f = lambda terms=terms: {x[0] for x in df.filter(F.col("t").rlike(tx.gate_pattern(terms))).select("i").collect()}
        found = f()
        took[len(terms)] = min(timed(f) for _ in range(3))
    rest = {"man", "men", "woman", "women", "boy", "boys", "girl", "girls", "people"}
    known = set(many)
    holds = lambda t: any(t.lower()[i:j] in known or any(t.lower()[i:j].endswith(s) and t.lower()[i : j - len(s)] in known for s in rest) for i, j in spans(t))
    assert found == {i for i, t in enumerate(texts) if holds(t)} and {300, 301} <= found and 302 not in found
    assert took[len(many)] < 6 * took[10] + 0.5


def timed(f):
    at = time.perf_counter()
    f()
    return time.perf_counter() - at


def spans(t):
    """Spans between word bounds, of one or two words."""
    at = [m.span() for m in re.finditer(r"\w+", t)]
    return [(a, b) for a, b in at] + [(a, d) for (a, _), (_, d) in zip(at, at[1:])]


def test_links_in_tables_are_escaped(one):
    from corvane.functions import markup

    t = "[[a|b]] | x\n\n| h | i |\n| --- |:-:|\n| [[p|q]] | ![[r\\|s]] and [[t#u|v|w]] |\n| plain | [[y]] |\n\n| [[a|b]] |\nno table"
    got = one(markup.escape_table_links, [t, None, "", "| a |\n|-|"])
    assert got == [t.replace("[[p|q]]", "[[p\\|q]]").replace("[[t#u|v|w]]", "[[t#u\\|v\\|w]]"), None, "", "| a |\n|-|"]
    assert one(markup.wikilinks, [got[0]])[0][1][1:] == ("p", "", "q")

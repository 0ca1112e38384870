"""Personal data, page text, language and quality."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from corvane.llm import htmlmain, langid_crf, pii, quality_pu, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_patterns():
    r = random.Random(4)
    for _ in range(20_000):
        t = "".join(r.choice(["a", "1", "2", "55", "@", ".", "-", " ", "+", "(", ")", "é", "4111 1111 1111 1111", "_", "0"]) for _ in range(r.randint(0, 18)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_base_spans_are_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000):
        pii.base_spans(t)


def test_pii_query_columns_and_terms(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3))
    rows = [(i, " ".join(word() for _ in range(30))) for i in range(60)]
    for i in range(60, 70):  # a name that stands beside one address in many distinct contexts
        rows.append((i, " ".join(word() for _ in range(5)) + " Quixotina wrote é from q.t@mail.example.org " + " ".join(word() for _ in range(5))))
    rows += [(i, " ".join(word() for _ in range(30))) for i in range(1000, 1150)]
    rows += [(70, None), (71, ""), (72, rows[60][1]), (60, rows[60][1]), (None, "+1 (415) 555-0100")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, spans string, th string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {(x["doc_id"], x["base_sha256"]): x for x in got}
    for i, t in rows:
        base = brute_spans(t or "")
        base.sort(key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        x = by[i, hashlib.sha256(text.encode()).hexdigest()]
        assert [x[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert x["spans"].startswith(text)
        if i is not None and 60 <= i < 70:
            at = t.index("Quixotina")
            assert f"term:{at}:{at + 9}" in x["spans"].split(",")
        elif i is not None and i < 60:
            assert x["spans"] == ""
    clean = [x["text"] for x in pii.sanitise(df).collect()]
    assert len(clean) == len(rows) and not any("Quixotina" in t or "@" in t for t in clean)
    assert pii.find_pii(df.limit(0)).count() == 0


def brute_disclosure(texts, window, min_share, min_bits):
    """Share and gain of every (entity, term) by plain counting over distinct texts."""
    texts = sorted({t or "" for t in texts})
    near, own = {}, {}
    for n, t in enumerate(texts):
        spans = pii.all_spans(t)
        clear = [(m.start(), m.end(), m[0].lower(), all(e <= m.start() or s >= m.end() for _, s, e in spans)) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        for kind, s, e in spans:
            left, right = [w for w in clear if w[1] <= s][-window:], [w for w in clear if w[0] >= e][:window]
            for x in pii.entities(kind, t[s:e]):
                own.setdefault(x, set()).add(n)
                for w in left + right:
                    if w[3]:
                        near.setdefault((x, w[2]), set()).add(n)
    held = {}
    for n, t in enumerate(texts):
        for w in set(re.findall(r"[^\W\d_]{3,}", t.lower())):
            held[w] = held.get(w, 0) + 1
    out = {}
    for (x, w), at in near.items():
        share = len(at) / (held[w] + 1)
        bits = np.log2(share * len(texts) / len(own[x]))
        if share >= min_share and bits >= min_bits:
            out[x, w] = (pytest.approx(share), pytest.approx(bits))
    return out


def test_shares_and_gains_match_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(2))
    say = lambda k: " ".join(word() for _ in range(k))
    texts = [say(25) for _ in range(150)]
    for i in range(30):
        texts.append(f"{say(4)} reach Owner{'abc'[i % 3]} at o{i % 5}@{'xy'[i % 2]}.example.org {say(3)} token = {r.getrandbits(160):040x} {say(5)}")
    texts += [texts[155], None, "", "token of thanks " + say(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.selectExpr("doc_id as id", "xxhash64(coalesce(text, '')) as th", "coalesce(text, '') as text")
    found = rows.mapInPandas(pii._find(5), pii.FOUND.format(id="long"))
    got = {(x["entity"], x["term"]): (x["share"], x["bits"]) for x in pii.disclosing_terms(rows.select("th", "text"), found, 0.5, 1.0).collect()}
    want = brute_disclosure(texts, 5, 0.5, 1.0)
    assert got == want
    assert ("kind:secret", "token") in got and ("kind:email", "reach") in got  # cue words, though no value occurs twice


def test_secrets():
    kinds = lambda t: [k for k, _, _ in pii.all_spans(t)]
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962";') == ["secret"]
    assert kinds("a" * 30 + " 1" + "1" * 30 + " antidisestablishmentarianism ab1ab1ab1ab1ab1ab1ab1ab1") == []
    assert kinds("ab1cd2ef3gh4ij5kl6mn7op8@mail.example.org") == ["email"]


def test_many_spans_are_linear():
    t = " ".join(f"name{i} u{i}@mail{i % 7}.example.org" for i in range(50_000))
    at = time.perf_counter()
    assert len(pii.contexts(t, pii.all_spans(t), 5)) == 50_000
    assert time.perf_counter() - at < 5


def prose(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("klmnpr") + r.choice("aeiou") for _ in range(4))
    return [" ".join(word() for _ in range(20)) for _ in range(n)]


@pytest.mark.parametrize("bound", [pii.TERMS_BOUND, 0])
def test_disclosing_term_is_marked_everywhere(spark, monkeypatch, bound):
    monkeypatch.setattr(pii, "TERMS_BOUND", bound)
    fill = prose(205, 3)
    texts = [f"{x} Quixotina {'1 ' * 300} q.t@mail.example.org {x}" for x in fill[:5]]  # further than any fixed number of characters
    texts[0] += " and quixotina again, far from it: " + fill[5] + " Quixotina"
    texts += ["Quixotina has no address here", texts[1], None, "quixotina@mail.example.org is no term", *fill[5:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [t[s["start"] : s["end"]] for s in x["terms"]] for x in pii.find_pii(df).collect() for t in [texts[x["doc_id"]] or ""]}
    names = {i: [w for w in x if w.lower() == "quixotina"] for i, x in got.items()}
    assert names == {i: re.findall(r"(?i)\bquixotina\b(?!@)", t or "") for i, t in enumerate(texts)}
    assert not any("quixotina" in x["text"].lower() for x in pii.sanitise(df).collect())


def test_entity_of_one_or_two_texts_is_disclosed(spark):
    fill = prose(203, 4)
    texts = [f"{fill[0]} Zebulonia q.t@mail.example.org common {fill[0]}", *(f"{x} Ysoldina +1 (415) 555-0100 common {x}" for x in fill[1:3]), "Vivaldo common x@y.org", "Vivaldo", *(f"common {x}" for x in fill[3:])]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")  # a copy is no evidence
    got = {x["doc_id"]: {(texts + texts[:1])[x["doc_id"]][s["start"] : s["end"]] for s in x["terms"]} for x in pii.find_pii(df).collect()}
    assert "Zebulonia" in got[0] == got[len(texts)] and all("Ysoldina" in got[i] for i in (1, 2))
    assert not any({"common", "Vivaldo"} & x for x in got.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>x</p>"</script><style>p{{}}</style></head><body>
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><{tag}><h1>The  title &amp; more</h1><p>First <b>long</b> paragraph with many words that say a good deal about things.<br>next line of it</p>
<p>Short.</p><div class="advert">Buy this now</div><p>Second long paragraph, also with many words, entities &eacute;&#233;&nbsp;x, and more to tell.
<ul><li>point one<li>point two</ul></{tag}><aside>Other stories</aside></div>
<section id="comments"><p>I disagree strongly with all of this, said a reader.</p></section><form><p>Sign up</p></form><footer><p>&copy; nobody</p></footer>{tail}"""
WANT = ["The title & more", "First long paragraph with many words that say a good deal about things. next line of it", "Short.", "Second long paragraph, also with many words, entities éé x, and more to tell.", "point one", "point two"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize("tail", ["</body></html>", "", "<div class=ad>x", "<scr", "<!-- open"])
def test_main_text(tag, tail):
    assert htmlmain.main_lines(PAGE.format(tag=tag, tail=tail)) == WANT


LONG = "many words that say a good deal about the thing at hand, and then go on to say more of it, " * 12


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_is_whole(tag):
    lines = lambda body: htmlmain.main_lines(f"<body><nav><a href=/>Home</a></nav><div><a href=/a>One</a> <a href=/b>Two</a></div><{tag}>{body}</{tag}></body>")
    long = LONG.strip()
    assert lines(f"<h1>Title</h1><p>A lead.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div>") == ["Title", "A lead.", long, long]
    assert lines(f"<section><p>{LONG}</p></section><section><p>Fifteen per cent.</p></section>") == [long, "Fifteen per cent."]
    for block in ("<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>"):
        assert lines("<p>Short one.</p>" * 9 + block.format(LONG) + "<p>The end.</p>") == ["Short one."] * 9 + [long, "The end."]


@pytest.mark.parametrize("attrs", ["id=content class='has-sidebar'", "class='page-with-header'", "class='content no-comments'", "class=widget", "id=search"])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_layout_wrappers_and_slug_ids_are_no_chrome(attrs, tag):
    heads = ["related-work", "search", "comments"]
    parts = ["legal-background", "search-algorithms", "informed-consent"]
    body = "".join(f"<h2 id={h}>{h} head</h2><section id={s} class='social-science'><p>{s}: {LONG}</p></section>" for h, s in zip(heads, parts))
    want = [x for h, s in zip(heads, parts) for x in (f"{h} head", f"{s}: {LONG.strip()}")]
    chrome = "<div class='site-footer'>Nobody.</div><div id=cookie-notice>We use them.</div><div class='left-sidebar'>Other.</div><div class='comment-list'>I disagree.</div>"
    page = f"<body><div {attrs}><{tag}>{body}</{tag}></div>{chrome}</body>"
    assert htmlmain.main_lines(page) == want
    assert htmlmain.main_lines(f"<body><{tag}><div {attrs}>{body}</div></{tag}>{chrome}</body>") == want


@pytest.mark.parametrize("attrs", ["class='post comments-open'", "class=commentary", "class='promoted-by-editor'", "id=reply-essay", "class=comment"])
def test_an_article_is_never_emptied_by_its_class(attrs):
    body = f"<h1>Title</h1><p class=legal-history>{LONG}</p><p>Short.</p>"
    assert htmlmain.main_lines(f"<body><article {attrs}>{body}</article><footer>x</footer></body>") == ["Title", LONG.strip(), "Short."]


def test_reader_comments_are_no_articles():
    page = f"<article><h1>Title</h1><p>{LONG}</p><article class=comment><p>{LONG}</p></article></article><article class='comment reply'>No. {LONG}</article>"
    assert htmlmain.main_lines(page) == ["Title", LONG.strip()]


PLAIN = """<body><div><div><a href=/1>Home</a></div><div><a href=/2>World news</a></div><div><a href=/3>Sport</a></div><div>Est. 1900</div></div>
<div><div><span>Friday</span> <span>edition</span> <b>no</b> <i>4</i></div><div>{long}</div><div>A short one.</div><div>{long}</div><div>{long}</div></div>
<div><div><i>All</i> <b>rights</b> <u>kept</u></div><div><a href=/4>About</a> <a href=/5>Imprint</a></div></div></body>"""


def test_clustering_decides_where_no_name_does(monkeypatch):
    page, long = PLAIN.format(long=LONG), LONG.strip()
    want = [long, "A short one.", long, long]
    assert htmlmain.main_lines(page) == want
    monkeypatch.setattr(htmlmain, "content", lambda plain, tags: plain > 0)  # no clustering
    assert htmlmain.main_lines(page) != want
    monkeypatch.setattr(htmlmain, "content", lambda plain, tags, f=htmlmain.threshold: (x := htmlmain.smooth(np.log1p(plain / np.maximum(1, tags)))) < f(x))  # inverted
    assert htmlmain.main_lines(page) != want


def test_the_article_with_most_content_wins():
    teaser = "<article><h2><a href=/x>See also</a></h2><p>Read on.</p></article>"
    assert htmlmain.main_lines(f"<body>{teaser}<article><h1>It</h1><p>{LONG}</p></article>{teaser}</body>") == ["It", LONG.strip()]


def test_smoothing_and_threshold_match_brute_force():
    r = np.random.default_rng(8)
    for _ in range(200):
        x = np.round(r.gamma(1, 2, r.integers(1, 30)), 1)
        want = []
        w = {k: np.exp(-0.5 * k * k) for k in range(-3, 4)}
        for i in range(len(x)):
            want.append(sum(w[k] * x[i + k] for k in w if 0 <= i + k < len(x)) / sum(w.values()))
        assert np.allclose(htmlmain.smooth(x, 1.0), want)
        cut = htmlmain.threshold(x)
        inside = lambda up: sum(((part - part.mean()) ** 2).sum() for part in (x[up], x[~up]) if len(part))
        best = min((inside(x >= v) for v in np.unique(x)[1:]), default=0.0)
        assert inside(x >= cut) == pytest.approx(best)


@pytest.mark.parametrize("piece", ["<div>x ", "<fieldset><p>x ", "<div class=ad>x ", "<ul><li>x ", "</p></b><p>x ", "<article>x "])
def test_deep_pages_take_linear_time(piece):
    at = time.perf_counter()
    htmlmain.main_lines(piece * 50_000)
    assert time.perf_counter() - at < 5


def test_page_query_edges(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "just text"), (3, "u", "just text"), (4, None, "<p>"), (5, "u", "<article><p>" + "word " * 200_000), (6, "u", "<nav><a>x</a></nav>"), (7, "u", "<p>a</p>" * 3000)]
    spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {x["page_id"]: x for x in queries.op10_html_main(spark, str(tmp_path)).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4, 6)] == ["", "", "just text", "", ""]
    assert got[5]["n_chars"] == 999_999 and got[7]["text"] == "\n".join(["a"] * 3000)


def language_rows(n=160):
    r = random.Random(6)
    syl = {"en": ["the", "ing", "wh", "er", "ow"], "de": ["sch", "ung", "ä", "ein", "keit"], "fr": ["eau", "ç", "oi", "é", "que"]}
    text = lambda lang, k: " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 3))) for _ in range(k))
    rows = [(i, text(x := list(syl)[i % 3], r.randint(5, 120)), x) for i in range(n)]
    return rows + [(n + 1, None, "en"), (n + 2, "", "de"), (n + 3, "12 34 !!", "fr"), (n + 4, text("fr", 30_000), None), (None, text("de", 40), "de"), (1, rows[1][1], rows[1][2])]


def test_language(spark, tmp_path):
    rows = language_rows()
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = {i: x for i, _, x in rows if i is not None and i < 160}
    for x in got:
        assert 0 <= x["score"] <= 1
        assert x["held_out"] == (zlib.crc32(("" if x["doc_id"] is None else str(x["doc_id"])).encode()) % 4 == 2)
        if x["doc_id"] in want:
            assert x["lang_pred"] == want[x["doc_id"]]
    assert {x["doc_id"]: x["lang_pred"] for x in got if x["doc_id"] and x["doc_id"] > 160} == {161: "und", 162: "und", 163: "und", 164: "fr"}


def plain_language(model, text):
    """One chain over the whole text, a word at a time."""
    words = langid_crf.words_of(text)
    if not words:
        return "und", 0.0
    e = np.stack([langid_crf.word_scores([w], model["lexicon"], model["weights"])[0].astype(np.float32).astype(float) for w in words])
    x, a = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -30)), np.exp(model["trans"])
    alpha, beta = [np.exp(model["start"]) * x[0]], [np.ones(len(a))]
    for row in x[1:]:
        v = alpha[-1] / alpha[-1].sum()
        alpha.append((v @ a) * row)
    for row in x[:0:-1]:
        v = a @ (row * beta[0])
        beta.insert(0, v / v.sum())
    post = np.array(alpha) * np.array(beta)
    post /= post.sum(axis=1, keepdims=True)
    mean = np.average(post, axis=0, weights=[len(w) for w in words])
    return model["names"][int(mean.argmax())], mean.max()


def test_language_query_matches_a_plain_chain(spark, tmp_path):
    rows = [(*r, "x") for r in language_rows(90)]
    mixed = " ".join(t for _, t, x, _ in rows[:40] if t)
    rows.append((9999, mixed, None, "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    model = langid_crf.train(df)
    texts = {i: t for i, t, _, _ in rows if t is None or len(t) < 50_000}
    for r in queries.op3_language(spark, str(tmp_path)).collect():
        if r["doc_id"] is not None and r["doc_id"] in texts:
            lang, score = plain_language(model, texts[r["doc_id"]])
            assert r["lang_pred"] == lang and r["score"] == pytest.approx(min(1.0, score), abs=1e-6)


def test_language_sample_is_exact(spark, monkeypatch):
    rows = [(i, t, x) for i, t, x in language_rows(300) if t and x and i is not None]
    rows += [(7, f"same id {k}", "en") for k in range(400)]  # ids that repeat share a hash
    monkeypatch.setattr(langid_crf, "MAX_DOCS", 20)
    seen = []
    monkeypatch.setattr(langid_crf, "fit", lambda texts, langs: seen.append(list(zip(texts, langs))))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for d in (df, df.repartition(5)):
        langid_crf.train(d)
    assert seen[0] == seen[1] and {x: sum(y == x for _, y in seen[0]) for x in ("en", "de", "fr")} == {"en": 20, "de": 20, "fr": 20}


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid_crf.predict(df, langid_crf.train(df)).first()["lang_pred"] == "und"
    assert langid_crf.predict(df.limit(0), None).count() == 0


@pytest.mark.parametrize("segment", [2, 3, 64])
def test_crf_posteriors_match_enumeration(monkeypatch, segment):
    """Texts of several segments are one chain: the posteriors are those of all label paths."""
    monkeypatch.setattr(langid_crf, "SEGMENT", segment)
    monkeypatch.setattr(langid_crf, "SEGMENTS", 2)
    r = np.random.default_rng(1)
    start, trans = r.normal(size=3), r.normal(size=(3, 3)) * 2
    tagger = langid_crf.Tagger({"names": ["a", "b", "c"], "lexicon": {}, "weights": r.normal(size=(langid_crf.DIMS, 3)) * 0.3, "start": start, "trans": trans})
    docs = [["one", "two", "three", "four", "five", "six", "seven"], ["ein"], [], ["dos", "tres"], ["un", "deux", "trois", "quatre", "cinq", "six"]]
    got = [np.zeros((0, 3)) for _ in docs]
    for post, mask, owner in tagger.marginals(docs):
        for p, m, o in zip(post, mask, owner):
            got[o] = np.concatenate([got[o], p[m]])
    for d, g in zip(docs, got):
        e = [tagger.table[tagger.ids[w]] for w in d]
        want = np.zeros((len(d), 3))
        for path in np.ndindex(*[3] * len(d)) if d else []:
            w = np.exp(start[path[0]] + sum(e[i][p] for i, p in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for i, p in enumerate(path):
                want[i, p] += w
        assert np.allclose(g, want / want.sum(axis=1, keepdims=True) if d else want, atol=1e-6)


def test_word_labels_of_code_switched_text(spark):
    rows = [(t, x) for _, t, x in language_rows(240) if t and x]
    model = langid_crf.fit([t for t, _ in rows], [x for _, x in rows])
    r = random.Random(9)
    syl = {"en": ["the", "ing", "wh", "er", "ow"], "de": ["sch", "ung", "ä", "ein", "keit"], "fr": ["eau", "ç", "oi", "é", "que"]}
    hits = total = 0
    texts, truth = [], []
    for _ in range(12):
        words, own = [], []
        for lang in r.sample(sorted(syl), 3):
            n = r.randint(4, 50)
            words += ["".join(r.choice(syl[lang]) for _ in range(r.randint(1, 3))) for _ in range(n)]
            own += [lang] * n
        texts.append(", ".join(words).upper().replace("SS", "ß"))
        truth.append(own)
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, "1 2")], "doc_id long, text string")
    got = {x["doc_id"]: x["words"] for x in langid_crf.label_words(df, model).collect()}
    assert got[90] == got[91] == []
    for i, own in enumerate(truth):
        assert len(got[i]) == len(own)
        total += len(own)
        hits += sum(x["lang"] == y for x, y in zip(got[i], own))
    assert hits / total > 0.97
    assert (np.diag(model["trans"])[:, None] - model["trans"] >= 0).all() and model["trans"].min() > -4  # switches were seen


def test_every_character_of_a_long_word_counts():
    model = {"names": ["a", "b"], "lexicon": {}, "weights": np.zeros((langid_crf.DIMS, 2)), "start": np.zeros(2), "trans": np.zeros((2, 2))}
    model["weights"][langid_crf._hash(30, np.array([ord("京")], dtype=np.uint64))[0], 1] = 5.0
    t = langid_crf.Tagger(model)
    assert t.predict(["x" * 500 + "京" + "x" * 500])[0][0] == "b" and t.predict(["x" * 1001])[0][0] == "a"
    assert t.predict(["京" * 300_000])[0][0] == "b"


def quality_rows(n=400):
    r = random.Random(7)
    good = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(r.randint(20, 90))).capitalize() + "."
    bad = lambda: r.choice([" | ".join(r.choice(["buy", "CLICK", "$$$"]) for _ in range(40)), "spam " * 60, "WOW!! " * 30])
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_quality(spark, tmp_path):
    rows = quality_rows()
    docs = [(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (9002, "", "x"), (9003, "word " * 100_000, "x"), (None, rows[1][1], "x"), (1, rows[1][1], "x")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 or i % 8 == 0], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op4_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, _, q in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got)


def test_quality_query_matches_plain_scores(spark, tmp_path):
    rows = quality_rows(160)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, "x " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    m = quality_pu.train(docs, labels)
    for r in queries.op4_quality(spark, str(tmp_path)).join(docs, "doc_id").collect():
        z = sum(w * min(8.0, max(-8.0, (x - c) / s)) for w, x, c, s in zip(m["w"], map(float, quality_pu.features(r["text"])), m["centre"], m["scale"])) + m["w"][-1]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_quality_without_positives(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x["score"] for x in quality_pu.score(docs, none).collect()] == [1.0, 1.0]
    assert quality_pu.keep_good(docs.limit(0), none).count() == 0


def test_prior_is_estimated():
    r = np.random.default_rng(2)
    pos = lambda n: np.hstack([r.normal(2, 1, (n, 2)), np.ones((n, 1))])
    neg = lambda n: np.hstack([r.normal(-2, 1, (n, 2)), np.ones((n, 1))])
    for share in (0.4, 0.8):
        u = np.vstack([pos(int(3000 * share)), neg(int(3000 * (1 - share)))])
        r.shuffle(u)
        assert abs(quality_pu.estimate_prior(pos(2000), u) - share) < 0.08


def test_risk_gradient_and_its_non_negative_branch():
    r = np.random.default_rng(5)
    p, u = r.normal(1, 1, (40, 3)), r.normal(-0.3, 1, (60, 3))
    seen = set()
    for _ in range(40):
        w, prior = r.normal(0, 2, 3), r.uniform(0.1, 0.95)
        rest = lambda w: np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        full = lambda w: prior * np.logaddexp(0, -(p @ w)).mean() + rest(w)
        step = lambda f: np.array([(f(w + d) - f(w - d)) / 2e-5 for d in np.eye(3) * 1e-5])
        value, grad = quality_pu.nn_risk(p, u, w, prior)
        negative = rest(w) < 0
        seen.add(negative)
        assert value == pytest.approx(prior * np.logaddexp(0, -(p @ w)).mean() + max(0.0, rest(w)))
        assert np.allclose(grad, -step(rest) if negative else step(full), atol=1e-6)
    assert seen == {True, False}


def test_quality_sample_is_exact_at_any_size(spark, monkeypatch):
    """A corpus far above the bounds: the sample has exactly its size, and the model still rejects."""
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 or i % 8 == 0], "doc_id long, quality int")
    monkeypatch.setattr(quality_pu, "MAX_POSITIVE", 40)
    monkeypatch.setattr(quality_pu, "MAX_UNLABELLED", 60)
    seen = []
    monkeypatch.setattr(quality_pu, "fit", lambda p, u, fit=quality_pu.fit: seen.append((len(p), len(u))) or fit(p, u))
    kept = {r["doc_id"] for r in quality_pu.keep_good(docs, labels).collect()}
    assert seen == [(40, 60)]
    truth = {i: q for i, _, q in rows}
    assert np.mean([(i in kept) == bool(q) for i, q in truth.items()]) > 0.9
    from corvane.llm.common import least_hashes
    from pyspark.sql import functions as F

    big = spark.range(20_000_000)  # one in two million
    assert least_hashes(big, F.xxhash64(F.lit(4), "id"), 10).orderBy("__h").limit(10).count() == 10


FORMS = {
    "whole page": "<body><form action='/x'><h1>Title here</h1><p>{long}</p><p>{long}</p><input type='hidden' value='v'><button>Send</button></form></body>",
    "article": "<body><form><nav>Home About</nav><article><h1>Title here</h1><p>{long}</p><p>{long}</p></article></form><footer>foot</footer></body>",
    "by its side": "<body><main><h1>Title here</h1><p>{long}</p><p>{long}</p></main><form>Sign up for our letter <input><button>Go</button></form></body>",
    "inside": "<body><article><h1>Title here</h1><p>{long}</p><form>Leave a reply <textarea>x</textarea></form><p>{long}</p></article></body>",
}


@pytest.mark.parametrize("kind", FORMS)
def test_a_form_is_chrome_unless_it_holds_the_page(kind):
    long = "The quick brown fox jumps over the lazy dog and runs along the river until the evening comes. " * 4
    assert htmlmain.main_lines(FORMS[kind].format(long=long)) == ["Title here", long.strip(), long.strip()]

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import markup
from corvane.operators import graph, pages, search
from corvane.sources import readers, sinks
from corvane.streaming import incremental as inc


def test_wikilinks_and_embeds(one):
    t = "See [[Page#Head|shown]] and ![[pic.png]] [[a b]] ![v](x.mp4) ![](https://youtu.be/abcdefghijk) | [[cell\\\\|in a table]] | [[]] [[#here]]"
    t = t.replace("\\\\", "\\")
    assert [tuple(x) for x in one(markup.wikilinks, [t])[0]] == [(False, "Page", "Head", "shown"), (True, "pic.png", "", ""), (False, "a b", "", ""), (False, "cell", "", "in a table"), (False, "", "here", "")]
    assert [tuple(x) for x in one(markup.embed_refs, [t])[0]] == [("pic.png", "image"), ("x.mp4", "video"), ("https://youtu.be/abcdefghijk", "youtube")]
    urls = ["https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?t=1&v=a_b-c6789xz#t", "https://www.youtube.com/embed/abcdefghijk?rel=0", "https://youtu.be/tooshort", "https://x.org"]
    assert one(markup.youtube_id, urls) == ["abcdefghijk", "a_b-c6789xz", "abcdefghijk", None, None]


def test_inline_markup(one):
    assert one(markup.inline_tags, ["#one two #a/b #12 x#no\n#ünï #7/8"]) == [["one", "a/b", "ünï"]]
    assert one(markup.strip_comments, ["a %%x\ny%% b"]) == ["a  b"]
    assert one(markup.rewrite_inline, ["==hot== --> -> <- <== ="]) == ["<mark>hot</mark> &rArr; &rarr; &larr; &lArr; ="]
    assert [tuple(x) for x in one(markup.callouts, ["> [!TLDR|x]- Title\n> body\n> [!own]"])[0]] == [("abstract", "x", "-", "Title"), ("own", "", "", "")]
    assert one(markup.block_refs, ["line ^id1\nother ^id-2\nagain ^id1"]) == [["id1", "id-2"]]
    assert [tuple(x) for x in one(markup.blocks, ["line ^id1\n\na\nb\n^id-2\nagain ^id1"])[0]] == [("id1", "line"), ("id-2", "a\nb")]
    assert [tuple(x) for x in one(markup.checkboxes, ["- [ ] a\n* [x] b"])[0]] == [(False, "a"), (True, "b")]
    assert one(markup.has_mermaid, ["```mermaid\n```", "x"]) == [True, False]


def test_at_mentions(one):
    t = "2024-01-02: met @sam/home today\n`@code` and a@b\n```\n@fenced\n```\n@zoe\nnote: @kim"
    assert one(markup.at_mentions, [t]) == [["sam/home", "zoe", "kim"]]
    assert one(markup.linkify_at, ["hi @sam `@x` (@y)"]) == ["hi [[ats/sam|@sam]] `@x` ([[ats/y|@y]])"]
    assert [tuple(x) for x in one(markup.at_lines, [t])[0]] == [("sam/home", "met today"), ("kim", "note:")]


def test_dialects(one):
    hugo = {
        '[a]({{< relref "b" >}}) [c](d)': "[a](b) [c](d)", "# H {#id}\ntext": "# H\ntext", "{{x}} and {{y}}": "x and y", '< figure src="p.png" >': "![](p.png)",
        r"see \\\\(a\_b\\\\) or \\\\[c\\\\]".replace("\\\\", "\\"): "see $a_b$ or $$c$$", r"\begin{equation}e\_1\end{equation}": "$$e_1$$", r"cost \_ kept": r"cost \_ kept",
    }
    assert one(markup.hugo_rewrite, list(hugo)) == list(hugo.values())
    roam = {
        "{{[[TODO]]}} x": '<input type="checkbox" disabled> x', "{{DONE}}": '<input type="checkbox" checked disabled>', "^^h^^ __i__ and __j__": "<mark>h</mark> <i>i</i> and <i>j</i>",
        "[[>]] q": "> q", "pick {{or: a|b c |d}}": "pick <select><option>a</option><option>b c</option><option>d</option></select>", "{{[[pdf]]: http://x.org/a.pdf}}": '<embed src="http://x.org/a.pdf">',
    }
    assert one(markup.roam_rewrite, list(roam)) == list(roam.values())


def test_front_matter():
    rec, body = pages.front_record("---\ntitle: T\ntag: a b, c\nalias: [x, y]\ndate: 2024-01-02\ndraft: true\nweight: 3\n---\nBody", "slug")
    assert (rec["title"], rec["tags"], rec["aliases"], rec["created"], rec["draft"], rec["extra"], body) == ("T", ["a-b", "c"], ["x", "y"], "2024-01-02", "true", {"weight": "3"}, "Body")
    assert pages.front_record('+++\ntitle = "U"\n+++\nx', "s")[0]["title"] == "U"
    assert pages.front_record("---\n: [bad\n---\nx", "s")[0]["title"] == "s"
    assert pages.front_record(None, "s")[1] == ""


def test_description(one):
    long = "A sentence of some length. " * 20
    assert one(pages.description, ["One. Two.", long, "", "See https://x.org/a/b?q=1 now", "w" * 400])[0] == "One. Two."
    d = one(pages.description, [long, "See https://x.org/a/b?q=1 now", "w" * 400])
    assert len(d[0]) <= 150 and d[0].endswith("length.") and d[1] == "See x.org/a/b now." and d[2] == "w" * 300 + "..."
    assert one(lambda c: pages.description(c, F.lit("given")), ["x"]) == ["given"]


def test_dates(spark):
    now = F.lit("2030-01-01").cast("timestamp")
    df = spark.createDataFrame([("2024-01-02", "2023-01-01"), ("bad", "2023-01-01"), (None, "2023-01-01"), (None, None)], "f string, g string")
    (c,) = pages.page_dates([F.col("f")], [F.col("g").cast("timestamp")], [F.lit("2020-02-02").cast("timestamp")], now)
    assert [r[0].date() for r in df.select(c).collect()] == [dt.date(2024, 1, 2), dt.date(2030, 1, 1), dt.date(2023, 1, 1), dt.date(2020, 2, 2)]


@pytest.fixture
def site(spark):
    rows = [("a/b", "B", ["t/u"], dt.date(2024, 1, 1)), ("a/c", "c", ["t"], None), ("d", "D", [], dt.date(2024, 2, 1)), ("a", "Folder A", [], None), ("tags/t", "Own T", [], None)]
    return spark.createDataFrame(rows, "slug string, title string, tags array<string>, date date")


def test_listings(site):
    assert [r["slug"] for r in pages.page_list(site).collect()] == ["d", "a/b", "a/c", "a", "tags/t"]
    r = pages.recent_pages(site, 2).collect()
    assert [(x["slug"], x["remaining"]) for x in r] == [("d", 3), ("a/b", 3)]
    assert {x["tag"]: (x["n_pages"], x["title"]) for x in pages.tag_pages(site).collect()} == {"t": (2, "Own T"), "t/u": (1, "Tag: t/u")}
    assert {x["folder"]: (x["n_pages"], x["date"]) for x in pages.folder_rollup(site).collect()} == {"a": (2, dt.date(2024, 1, 1)), "tags": (1, None)}
    crumbs = sorted((x["depth"], x["name"]) for x in pages.breadcrumbs(site).filter("slug = 'a/b'").collect())
    assert crumbs == [(0, "Home"), (1, "Folder A"), (2, "B")]


def test_filters_and_redirects(spark):
    p = spark.createDataFrame([("a", "true", None), ("b", "false", "true"), ("c", None, "false")], "slug string, draft string, publish string")
    assert {r["slug"] for r in pages.run_filters(p, [pages.remove_drafts]).collect()} == {"b", "c"}
    assert [r["slug"] for r in pages.explicit_publish(p).collect()] == ["b"]
    a = spark.createDataFrame([("x/y/page", ["./old name", "../up", "abs/z"])], "slug string, aliases array<string>")
    assert {r["alias_slug"] for r in pages.alias_redirects(a).collect()} == {"x/y/old-name", "x/up", "abs/z"}


def test_toc(spark):
    p = spark.createDataFrame([(1, "## A\ntext\n### B b!\n## A\n```\n# no\n```\n#### deep"), (2, "# only")], "k int, t string")
    assert [(r["depth"], r["anchor"]) for r in pages.toc(p, "k", "t").orderBy("pos").collect()] == [(0, "a"), (1, "b-b"), (0, "a-1")]


def shown_by_hand(contents):
    """Reading order, one set of shown pages a root."""

    def show(root):
        seen = {root}

        def grow(text):
            def put(m):
                page, _, _ = (x.strip() for x in m[1].split("|")[0].partition("#"))
                if page in seen or not page:
                    return m[0]
                seen.add(page)
                return m[0] if contents.get(page) is None else grow(contents[page])

            return re.sub(r"!\[\[([^\[\]]+)\]\]", put, text)

        return grow(contents[root] or "")

    return {root: show(root) for root in contents}


def expanded(spark, contents):
    p = spark.createDataFrame(list(contents.items()), "slug string, content string")
    return {r["slug"]: r["content"] for r in pages.transclude(p).collect()}


def test_transclusion(spark):
    rows = {
        "a": "A(![[b]])", "b": "B(![[a]])", "c": "C ![[a]] ![[none]] ![[a|shown]]", "d": "![[e#Part two]] | ![[e#^id1]] | ![[f]]", "d1": "![[e#^id1]]", "d2": "![[e#^id2|x]] ![[#One]]", "d3": "![[e#gone]] ![[e]]",
        "e": "# One\nx\n## Part two\ny ![[a]]\n### Sub\nz ^id1\n```\n# code\n```\n## Three\nw\nv\n^id2", "f": None, "g": "![[h]]", "h": "![[i]]", "i": "![[j]]", "j": "![[k]]", "k": "![[l]]", "l": "deep", "m": "",
    }
    got = expanded(spark, rows)
    assert got["a"] == "A(B(![[a]]))" and got["b"] == "B(A(![[b]]))" and got["c"] == "C A(B(![[a]])) ![[none]] ![[a|shown]]"
    assert got["d"] == "## Part two\ny A(B(![[a]]))\n### Sub\nz ^id1\n```\n# code\n``` | ![[e#^id1]] | ![[f]]"
    assert got["d1"] == "z" and got["d2"] == "w\nv ![[#One]]"
    assert got["d3"] == "![[e#gone]] ![[e]]"  # the page counts as shown though its part is not there
    assert got["g"] == "deep" and got["f"] == "" and got["m"] == ""
    assert pages.transclude(spark.createDataFrame([], "slug string, content string")).count() == 0


def test_transclusion_follows_reading_order(spark):
    # the first embed of c stands deep inside b, though the page's own is one step away; x and y retract what they had shown
    some = {"a": "a ![[b]] ![[c]] ![[e]]", "b": "b ![[d]]", "d": "d ![[c]]", "c": "c ![[e]] ![[a]]", "e": "e ![[b]]"}
    assert expanded(spark, some) == shown_by_hand(some)
    r = random.Random(7)
    for n, k in ((9, 2), (14, 3)):
        graph_ = {f"p{i}": " ".join([f"<{i}", *[f"![[p{r.randrange(n + 1)}]]" for _ in range(r.randint(0, k))], ">"]) for i in range(n)}
        assert expanded(spark, graph_) == shown_by_hand(graph_)


def test_transclusion_of_a_clique_is_linear(spark):
    n = 12
    clique = {f"p{i}": f"<{i} " + " ".join(f"![[p{j}]]" for j in range(n) if j != i) + ">" for i in range(n)}
    got = expanded(spark, clique)
    assert got == shown_by_hand(clique)
    assert all(t.count("<") == n and len(t) < 20 * n * n for t in got.values())


def test_prefix_dictionary_opens_few_blocks(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdef") for _ in range(5)) for _ in range(400)] + ["same"] * 200
    p = spark.createDataFrame([(i, " ".join(r.sample(words, 12)), "same"[: i % 5]) for i in range(200)], "id int, content string, title string")
    plain = search.postings(p, "id", {"title": "title", "content": "content"})
    ix = search.prefix_index(plain, "id", 100)
    blocks = ix.dictionary.count()
    assert blocks > 15 and ix.rows.count() == plain.count()
    for q in (["ab"], ["same"], ["fed", "a"], ["zzz"], ["abc", "sam"], ["f"]):
        want = {tuple(x) for x in search.matches(plain, "id", q, ("title", "content")).collect()}
        assert {tuple(x) for x in search.matches(ix, "id", q, ("title", "content")).collect()} == want
        held = {x["block"] for x in ix.rows.filter(" or ".join(f"startswith(term, '{w}')" for w in q)).select("block").distinct().collect()}
        assert held <= set(ix.opened(q))
    assert len(ix.opened(["abc"])) <= 2 and len(ix.opened(["same"])) > 1 and not ix.opened(["zzz"])
    plan = search.matches(ix, "id", ["abc"], ("content",))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,abc)" in plan and "PartitionFilters: [isnotnull(block" in plan
    assert search.search_tag(ix, spark.createDataFrame([(0, "t"), (1, "t")], "id int, tag string"), "id", "t", ["zzz"]).count() == 0
    assert search.prefix_index(plain.filter("false"), "id").opened(["a"]) == []


def test_made_pages(spark):
    rows = [("x/one", "One", "see @sam/home and `@code`"), ("x/y/two", "Two", "@sam"), ("x/index", "Ex", ""), ("ats/sam", "Sam's page", "")]
    p = spark.createDataFrame(rows, "slug string, title string, content string")
    assert {r["folder"]: (r["n_pages"], r["title"], r["made"]) for r in pages.folder_pages(p).collect()} == {"x": (3, "Ex", False), "x/y": (1, "Folder: x/y", True), "ats": (1, "Folder: ats", True)}
    assert {r["token"]: (r["n_pages"], r["title"], r["made"]) for r in pages.at_pages(p).collect()} == {"sam": (2, "Sam's page", False), "sam/home": (1, "@sam/home", True)}
    d = p.withColumns({"created": F.lit("2024-01-01").cast("date"), "modified": F.when(F.col("slug") == "x/y/two", F.lit("2024-03-01").cast("date"))})
    assert {r["folder"]: (str(r["created"]), str(r["modified"])) for r in pages.folder_rollup(d, ("created", "modified")).collect()}["x"] == ("2024-01-01", "2024-03-01")


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "gone")], "source string, target string")
    s = spark.createDataFrame([(x,) for x in "abcdx"], "slug string")
    assert graph.valid_links(e, s).count() == 3 and graph.broken_links(e, s).count() == 1
    near = graph.neighborhood(e, spark.createDataFrame([("b",)], "node string"), 1)
    assert {(r["node"], r["hop"]) for r in near.collect()} == {("b", 0), ("a", 1), ("c", 1)}
    assert graph.induced(e, near).count() == 2
    everything = graph.neighborhood(e, spark.createDataFrame([("b",)], "node string"), -1)
    assert {(r["node"], r["hop"]) for r in everything.collect()} == {("b", 0), ("a", 1), ("c", 1), ("d", 2)}
    assert {r["node"]: r["degree"] for r in graph.node_degree(e).collect()}["b"] == 2


def test_search(spark):
    p = spark.createDataFrame([(1, "Hello world", "", "x"), (2, "other", "hello there world", "x"), (3, "none", "helloing", "hello")], "id int, title string, content string, tags string")
    i = search.postings(p, "id", {"title": "title", "content": "content", "tags": "tags"})
    assert {(r["id"], r["rank"]) for r in search.search(i, "id", ["hello"]).collect()} == {(1, 0), (2, 1), (3, 1)}
    assert {(r["id"], r["rank"]) for r in search.search(i, "id", ["hel", "wor"]).collect()} == {(1, 0), (2, 1)}
    tags = spark.createDataFrame([(2, "t")], "id int, tag string")
    assert [r["id"] for r in search.search_tag(i, tags, "id", "t", ["hello"]).collect()] == [2]
    assert [r["id"] for r in search.search_tag(i, tags, "id", "t", []).collect()] == [2]
    d = spark.createDataFrame([(1, "x " * 50 + "hit hit " + "x " * 50)], "id int, t string")
    r = search.excerpt(d, "id", "t", ["hit"]).first()
    assert (r["hits"], r["start"], len(r["excerpt"].split())) == (2, 20, 60)
    assert spark.range(1).select(search.highlight(F.lit("a Cat"), ["cat"])).first()[0] == "a <mark>Cat</mark>"


def test_changes(spark):
    state = spark.createDataFrame([("p", "x/y"), ("q", "z")], "key string, tag string")
    ch = spark.createDataFrame([("p", 1, "change", "w"), ("p", 2, "change", "v/u"), ("q", 1, "delete", "z"), ("r", 1, "add", "n")], "key string, seq int, type string, tag string")
    assert {tuple(r) for r in inc.apply_changes(state, ch, "key", "seq").collect()} == {("p", "v/u"), ("r", "n")}
    assert {r[0] for r in inc.affected_keys(state, ch, "key", "seq", lambda d: d.select("tag")).collect()} == {"x/y", "z", "v/u", "n"}
    assert {r[0] for r in inc.affected_keys(state, ch, "key", "seq", lambda d: d.select("tag"), ("index",)).collect()} == {"x/y", "z", "v/u", "n", "index"}
    assert inc.affected_keys(state, ch.limit(0), "key", "seq", lambda d: d.select("tag"), ("index",)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from corvane.operators import gates

    for i in range(3):
        spark.createDataFrame([(i * 10 + j, "north" if j % 2 else "south") for j in range(4)], "doc_id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    f = lambda d: gates.lexical_gate(d, ["north"])
    out = inc.stream_extract(spark, str(tmp_path), "documents", f, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, f(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()))


def test_files_become_changes(spark, tmp_path):
    for name, text in (("a.md", "1"), ("sub/b.md", "2"), ("c.txt", "3"), (".private/d.md", "4")):
        path = tmp_path / "w" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    scan = lambda: inc.scan_files(spark, str(tmp_path / "w"), "*.md", (r"(^|/)\.private/",))
    before = spark.createDataFrame(scan().collect(), scan().schema)
    assert {r["path"] for r in before.collect()} == {"a.md", "sub/b.md"}
    (tmp_path / "w" / "a.md").write_text("longer")
    (tmp_path / "w" / "sub" / "b.md").unlink()
    (tmp_path / "w" / "n.md").write_text("new")
    changes = inc.file_changes(before, scan())
    assert {(r["path"], r["type"]) for r in changes.collect()} == {("a.md", "change"), ("sub/b.md", "delete"), ("n.md", "add")}
    assert {r["path"] for r in inc.partial_emit(changes).collect()} == {"a.md", "n.md"}
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "tag string, x int")
    count = lambda d: d.groupBy("tag").count()
    assert [tuple(r) for r in inc.emit(count, rows, spark.createDataFrame([("b",)], "k string"), "tag").collect()] == [("b", 2)]
    assert inc.emit(count, rows).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# c\n\nrelevant | one | two\nIRRELEVANT|x\nOTHER | y\nnobar\n")
    assert {tuple(r) for r in readers.load_labels(spark, str(tmp_path / "l.txt")).collect()} == {("RELEVANT", "one | two"), ("IRRELEVANT", "x")}
    (tmp_path / "e.txt").write_text("# c\n")
    with pytest.raises(ValueError):
        readers.load_labels(spark, str(tmp_path / "e.txt"))
    s = spark.createDataFrame([("a \"q\" b", 0.5), ("", 1.0)], "text string, score double")
    path = sinks.write_tsv(s, str(tmp_path), "sheet")
    assert [tuple(r) for r in readers.load_sentences_tsv(spark, path).collect()] == [("FILTERED", 'a "q" b')]
    assert spark.read.csv(path, sep="\t", header=True).collect()[0]["score"] == " 0.5"
    (tmp_path / "p.txt").write_text("CAT|text | more\n#x|y\nnone\n")
    assert [tuple(r) for r in readers.load_pipe_text(spark, str(tmp_path / "p.txt")).collect()] == [("CAT", "text | more")]
    (tmp_path / "inv.json").write_text('{"seed_negative_terms": ["bad"], "auto_positive_terms": ["fine"]}')
    got = {(r["term"], r["sign"], r["origin"]) for r in readers.load_frame_inventory(spark, str(tmp_path / "inv.json"), {"negative": [], "positive": ["good"]}).collect()}
    assert got == {("bad", -1, "seed"), ("good", 1, "seed"), ("fine", 1, "auto")}
    (tmp_path / "broken.json").write_text("{nope")
    assert [r["term"] for r in readers.load_frame_inventory(spark, str(tmp_path / "broken.json"), {"negative": ["n"], "positive": []}).collect()] == ["n"]
    (tmp_path / "b.bib").write_text('@article{k1,\n  title = {A {B} C},\n  year = "2020"\n}\n@book{k2,\n author = {X}\n}\n')
    got = {r["key"]: (r["kind"], r["fields"].get("year")) for r in readers.load_bibliography(spark, str(tmp_path / "b.bib")).collect()}
    assert got == {"k1": ("article", "2020"), "k2": ("book", None)}
    for i in range(3):
        spark.createDataFrame([(f"t{i}",)], "text string").coalesce(1).write.parquet(str(tmp_path / f"train-{i}.parquet"))
    assert {r[0] for r in readers.corpus_shards(spark, str(tmp_path), 2).collect()} == {"t0", "t1"}
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("  body ")
    (tmp_path / "md" / "b.txt").write_text("no")
    assert [(r["file_path"], r["text"]) for r in readers.markdown_files(spark, str(tmp_path / "md")).collect()] == [("a.md", "body")]


def test_sinks(spark, tmp_path):
    inv = spark.createDataFrame([("b", -1, "seed"), ("a", -1, "seed"), ("c", 1, "auto")], "term string, sign int, origin string")
    import json

    j = json.loads(sinks.inventory_json(inv, "note", F.lit("2024-01-01").cast("date")).first()[0])
    assert j["seed_negative_terms"] == ["a", "b"] and j["auto_positive_terms"] == ["c"] and j["last_updated"] == "2024-01-01"
    n = []

    def build():
        n.append(1)
        return spark.range(3)

    key = sinks.inputs_key("path", "v1")
    for _ in range(2):
        assert sinks.snapshot(spark, str(tmp_path), key, build).count() == 3
    assert len(n) == 1 and sinks.inputs_key("path", "v2") != key


def test_markdown_transforms(spark, tmp_path):
    (tmp_path / "n.md").write_text(" {{x}} ==hot== %%gone%%\n")
    got = readers.markdown_files(spark, str(tmp_path), transforms=(markup.strip_comments, markup.hugo_rewrite, markup.rewrite_inline)).first()
    assert got["text"] == "x <mark>hot</mark> "


def test_inventory_with_candidates(spark):
    import json

    inv = spark.createDataFrame([("b", -1, "seed")], "term string, sign int, origin string")
    cand = spark.createDataFrame([("y", 2.5, ["m"]), ("x", 1.5, [])], "term string, score double, found_with array<string>")
    doc = json.loads(sinks.inventory_json(inv, "note", candidates=cand).first()[0])
    assert doc["seed_negative_terms"] == ["b"] and doc["candidates"] == [{"term": "x", "score": 1.5, "found_with": []}, {"term": "y", "score": 2.5, "found_with": ["m"]}]


def test_partitioned_sink(spark, tmp_path):
    sinks.write_by(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, x int"), str(tmp_path / "by"), "k")
    assert {p.name for p in (tmp_path / "by").iterdir() if p.is_dir()} == {"k=a", "k=b"}
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3


def test_extraction_run_writes_sheets_and_report(spark, tmp_path):
    import json

    from corvane.operators import models
    from corvane.operators import vectors as vec
    from corvane.plans import extract as ex

    enc = vec.HashEncoder(16)
    labelled = spark.createDataFrame([("north wind blows cold", "RELEVANT"), ("north sea is cold", "RELEVANT"), ("a recipe for soup", "IRRELEVANT"), ("a list of names", "IRRELEVANT")], "sentence string, label string")
    model = models.train_classifier(vec.encode(labelled, enc, "sentence"))
    docs = spark.createDataFrame([(1, "The north wind blows cold over all the houses today. Nothing of note happened here in the south at all."), (2, "No such word here."), (3, None)], "doc_id long, text string")
    paths = ex.run(docs, ["north"], ["wind"], enc, ["north wind blows cold"], ["soup recipe"], model, str(tmp_path))
    report = json.loads(spark.read.text(paths["report"]).first()[0])
    assert (report["documents_total"], report["documents_lexical"], report["total_sentences"], report["lexical_hits"], report["hits"]) == (3, 1, 2, 1, 1)
    assert [r[0] for r in spark.read.text(paths["lexical_hits"]).collect()] == ["The north wind blows cold over all the houses today."]
    sheets = [spark.read.csv(paths[x], sep="\t", header=True) for x in ("kept", "review")]
    assert sum(s.count() for s in sheets) == report["kept"] + report["review"] and "semantic_margin" in sheets[0].columns + sheets[1].columns


def test_extraction_run_scans_the_documents_once(spark, tmp_path):
    import json

    from corvane.operators import gates, models
    from corvane.operators import vectors as vec
    from corvane.plans import extract as ex

    enc = vec.HashEncoder(16)
    labelled = spark.createDataFrame([("north wind blows cold", "RELEVANT"), ("north sea is cold", "RELEVANT"), ("a recipe for soup", "IRRELEVANT"), ("a list of names", "IRRELEVANT")], "sentence string, label string")
    model = models.train_classifier(vec.encode(labelled, enc, "sentence"))
    rows = [(i, None if i % 9 == 0 else f"The north wind number {i} blows cold over all the houses. Nothing of note happened here in the south today. The northern sea is not the north of {i} at all, they say." if i % 2 else "no term") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs, passed = spark.read.parquet(str(tmp_path / "docs")), spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            passed.add(len(f))
            yield f

    paths = ex.run(docs.mapInPandas(count, docs.schema), ["north"], ["wind"], enc, ["north wind blows cold"], ["soup recipe"], model, str(tmp_path / "run"))
    assert passed.value == len(rows)
    report = json.loads(spark.read.text(paths["report"]).first()[0])
    want = gates.scan_counters(docs, ["north"]).first().asDict()
    assert {k: report[k] for k in want} == want and report["hits"] == want["lexical_hits"] > 0
    none = ex.run(docs.limit(0), ["north"], ["wind"], enc, ["a"], ["b"], model, str(tmp_path / "none"))
    assert json.loads(spark.read.text(none["report"]).first()[0])["documents_total"] == 0

import pytest
from pyspark.sql import functions as F

from corvane.functions import paths

# A small garden of notes: two folders with an index page, a file, and a name that occurs twice.
SLUGS = ["herbs/mint", "herbs/sage", "herbs/index", "trees/oak", "trees/old/yew", "index", "herbs/leaf.jpg", "trees/sage"]


@pytest.mark.parametrize("path,slug", [
    ("herbs/mint.md", "herbs/mint"), ("/herbs/mint.md", "herbs/mint"), ("herbs/_index.md", "herbs/index"), ("_index.html", "index"), ("herbs/leaf.jpg", "herbs/leaf.jpg"),
    ("two words\tand tab.md", "two-words-and-tab"), ("v1.2 notes.md", "v1.2-notes"), ("why? because #1.md", "why-because-1"), ("salt & pepper/50%.md", "salt--and--pepper/50-percent"), ("plain", "plain"),
])
def test_slugify(one, path, slug):
    assert one(paths.slugify, [path]) == [slug]


def test_slugs_are_stable(one):
    """A slug of a slug is itself, and holds nothing that an address would have to escape."""
    made = one(paths.slugify, ["A b/c d.md", "x & y.md", "100 %/z?.md", "ünï/ç.md", "a/_index.md"])
    assert one(paths.slugify, made) == made
    assert not any(c in s for s in made for c in " &%?#")


def test_simplify(one):
    assert one(paths.simplify_slug, ["herbs/index", "index", "herbs/mint", "/mint", "indexes/mint"]) == ["herbs/", "/", "herbs/mint", "mint", "indexes/mint"]


def test_canonical_link(one):
    """Every link becomes relative to where it stands, without page extension, and keeps a folder's slash and its anchor as a slug."""
    files = ["herbs/mint.md", "./herbs/mint.html", "../trees/oak.md", "herbs/leaf.jpg"]
    assert one(paths.canonical_link, files) == ["./herbs/mint", "./herbs/mint", "../trees/oak", "./herbs/leaf.jpg"]
    folders = ["herbs/", "/herbs/", "herbs/index.md", "./index", ""]
    assert one(paths.canonical_link, folders) == ["./herbs/", "./herbs/", "./herbs/", "./", "."]
    anchored = ["herbs/mint.md#Growing In Pots!", "old%20trees/yew#Age", "./index#Top"]
    assert one(paths.canonical_link, anchored) == ["./herbs/mint#growing-in-pots", "./old-trees/yew#age", "./#top"]


def test_path_to_root(one):
    slugs = ["index", "mint", "herbs/mint", "trees/old/yew", "trees/old/index"]
    assert one(paths.path_to_root, slugs) == [".", ".", "..", "../..", "../.."]


def test_join_segments(one):
    pairs = [("herbs", "mint"), ("/herbs/", "/mint/"), ("", "mint"), ("herbs", "/"), ("..", "../oak")]
    assert one(paths.join_segments, pairs, "a string, b string") == ["herbs/mint", "/herbs/mint/", "mint", "herbs/", "../../oak"]


def test_prefixes_and_tags(one):
    assert one(paths.segment_prefixes, ["food/sour/lemon", "food"]) == [["food", "food/sour", "food/sour/lemon"], ["food"]]
    assert one(paths.slug_tag, ["sweet & sour/lime juice?"]) == ["sweet--and--sour/lime-juice"]


KINDS = {
    "full_slug": (["mint", "herbs/mint", "site.map", "herbs/leaf.jpg"], ["./mint", "../mint", "mint#top", "two words", "herbs/"]),
    "file_path": (["herbs/mint.md", "leaf.jpg"], ["./mint.md", "../leaf.jpg", "mint"]),
    "simple_slug": (["", "mint", "herbs/", "indexed", "reindex/mint"], ["//", "index", "http://site.example?q", "/mint", "herbs/index", "mint#top", "mint.html"]),
    "relative_url": ([".", "..", "./herbs/mint", "../oak#age"], ["mint", "/mint", "", "./mint.md", "./mint.html"]),
}


@pytest.mark.parametrize("name", KINDS)
def test_slug_kinds(one, name):
    yes, no = KINDS[name]
    assert one(lambda c: paths.slug_kinds(c)[name], yes + no) == [True] * len(yes) + [False] * len(no)


def resolved(spark, strategy, source, targets):
    from corvane.operators.graph import resolve_links

    slugs = spark.createDataFrame([(s,) for s in SLUGS], "slug string")
    links = spark.createDataFrame([(source, t) for t in targets], "source string, target string")
    got = {r["target"]: r["resolved"] for r in resolve_links(links, slugs, strategy).collect()}
    return [got[t] for t in targets]


def test_shortest_links(spark):
    """A name that one page has is enough; a name that two have, or none, is read from the root."""
    targets = ["mint", "oak", "yew", "sage", "herbs/sage", "leaf.jpg", "index", "mint#Tea", "nowhere"]
    want = ["../herbs/mint", "../trees/oak", "../trees/old/yew", "../sage", "../herbs/sage", "../herbs/leaf.jpg", "../", "../herbs/mint#tea", "../nowhere"]
    assert resolved(spark, "shortest", "herbs/mint", targets) == want
    assert resolved(spark, "shortest", "index", ["oak", "herbs/index"]) == ["./trees/oak", "./herbs/"]


def test_absolute_and_relative_links(spark):
    assert resolved(spark, "absolute", "trees/old/yew", ["trees/oak", "herbs/index", "index", "index#Top"]) == ["../../trees/oak", "../../herbs/", "../../", "../../#top"]
    assert resolved(spark, "relative", "trees/old/yew", ["elm", "../oak", "index", "../../index#Top"]) == ["./elm", "../oak", "./", "../../#top"]


def test_trie(spark):
    from corvane.operators.graph import hide, path_trie

    t = {r["path"]: r for r in path_trie(spark.createDataFrame([(s,) for s in [*SLUGS, "tags/x"]], "slug string")).collect()}
    assert t["herbs"]["is_folder"] and t["herbs"]["n_pages"] == 4 and t["trees/old"]["parent"] == "trees" and not t["trees/oak"]["is_folder"] and t["trees/old/yew"]["depth"] == 3
    assert {r["path"] for r in hide(path_trie(spark.createDataFrame([("tags/x",), ("b",)], "slug string"))).collect()} == {"b"}


def test_natural_order(one):
    from corvane.operators.pages import natural_key

    names = ["p10", "P2", "a", "p1b", "p1"]
    keys = one(natural_key, names)
    assert [n for _, n in sorted(zip(keys, names))] == ["a", "p1", "p1b", "P2", "p10"]


def test_natural_order_of_long_numbers_and_accents(spark):
    from corvane.operators import pages

    names = ["a" + "9" * 30, "a1" + "0" * 30, "a2", "A10", "É3", "e1", "é2", "b", "a02x", "a"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(3).withColumn("key", pages.natural_key(F.col("name")))
    ranked = pages.ranked_by(df, "key", "i")
    got = [r["name"] for r in sorted(ranked.collect(), key=lambda r: r["place"])]
    assert got == ["a", "a2", "a02x", "A10", "a" + "9" * 30, "a1" + "0" * 30, "b", "e1", "é2", "É3"]
    assert sorted(r["place"] for r in ranked.collect()) == list(range(1, len(names) + 1))
    assert "SinglePartition" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_small_tables_are_dealt_over_the_cores(spark):
    from corvane.sources import readers

    for sf, parts in (("sf0.001", None), ("sf0.1", spark.sparkContext.defaultParallelism)):
        docs = readers.documents(spark, f"/root/testdata/{sf}")
        plan = docs._jdf.queryExecution().executedPlan().toString()
        assert ("RoundRobinPartitioning" in plan) == (parts is not None)
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan  # the columns are chosen below the exchange
        assert docs.columns == ["doc_id", "text"]

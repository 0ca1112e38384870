"""Link extraction and the link graph as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.sources.scratch import settle


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, url: distinct targets of anchors."""
    found = F.regexp_extract_all(F.col(html), F.lit('<a [^>]*href="([^"]+)"'), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(found)).alias("url"))


def link_classes(links: DataFrame) -> DataFrame:
    """links with class (external, anchor, internal) and slug of internal targets."""
    kind = F.when(paths.is_external(F.col("url")), "external").when(F.startswith("url", F.lit("#")), "anchor").otherwise("internal")
    path = F.regexp_replace(F.split("url", "[#?]")[0], r"^(\.{1,2}/)+", "")
    return links.withColumn("class", kind).withColumn("slug", F.when(F.col("class") == "internal", paths.simplify_slug(paths.slugify(path))))


def valid_links(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    """Edges (source, target) whose target exists."""
    return edges.join(slugs.select(F.col("slug").alias("target")), "target", "left_semi").select("source", "target")


def broken_links(edges: DataFrame, slugs: DataFrame) -> DataFrame:
    return edges.join(slugs.select(F.col("slug").alias("target")), "target", "left_anti").select("source", "target")


def resolve_links(links: DataFrame, slugs: DataFrame, strategy: str = "shortest") -> DataFrame:
    """source, target, resolved, by strategy (absolute, relative, shortest)."""
    if strategy != "shortest":
        return links.select("source", "target", paths.resolve_link(F.col("source"), F.col("target"), strategy).alias("resolved"))
    names = slugs.groupBy(F.element_at(F.split("slug", "/"), -1).alias("__name")).agg(F.count("*").alias("__n"), F.min("slug").alias("__only")).filter("__n = 1")
    j = links.withColumn("__name", paths.link_name(F.col("target"))).join(names, "__name", "left")
    return j.select("source", "target", paths.resolve_link(F.col("source"), F.col("target"), strategy, F.col("__only")).alias("resolved"))


def resolve_shortest(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """A name that one slug alone ends in is that slug, any other is a path from the root."""
    return resolve_links(links, slugs, "shortest")


def backlinks(edges: DataFrame) -> DataFrame:
    """slug, n: pages that link to it."""
    return edges.distinct().groupBy(F.col("target").alias("slug")).agg(F.count("*").alias("n"))


def link_graph(edges: DataFrame, tags: DataFrame, removed: list[str] = ()) -> DataFrame:
    """source, target of page links and page-tag links, without the removed tags."""
    t = tags.filter(~F.col("tag").isin(list(removed))) if removed else tags
    return edges.select("source", "target").union(t.select("slug", F.concat(F.lit("tags/"), F.col("tag")))).distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    """node, degree, radius."""
    both = edges.select("source").union(edges.select("target")).toDF("node")
    return both.groupBy("node").agg(F.count("*").alias("degree")).withColumn("radius", F.round(2 + F.sqrt("degree"), 4))


def neighborhood(edges: DataFrame, start: DataFrame, hops: int = 1) -> DataFrame:
    """node, hop: nodes within `hops` links of the start nodes, either way; all that can be reached for hops = -1. One join a hop, with the frontier alone."""
    both = edges.select("source", "target").union(edges.select("target", "source")).toDF("a", "b").distinct()
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    if hops < 0 or hops > 2:
        both, seen = settle(both), settle(seen)
    frontier, h = seen, 0
    while h != hops:
        h += 1
        step = both.join(frontier.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(h).alias("hop"))
        if hops < 0 or hops > 2:
            frontier = settle(frontier)
            if frontier.isEmpty():
                break
        seen = seen.union(frontier)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").select("source", "target")


def path_trie(slugs: DataFrame) -> DataFrame:
    """path, depth, parent, is_folder, n_pages below: every prefix of every slug."""
    p = slugs.select("slug", F.explode(paths.segment_prefixes(F.col("slug"))).alias("path"))
    t = p.groupBy("path").agg(F.bool_or(F.col("path") != F.col("slug")).alias("is_folder"), F.count("*").alias("n_pages"))
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*\z", "")).otherwise(F.lit(""))
    return t.select("path", F.size(F.split("path", "/")).alias("depth"), parent.alias("parent"), "is_folder", "n_pages")


def hide(trie: DataFrame, folder: str = "tags") -> DataFrame:
    return trie.filter((F.col("path") != folder) & ~F.startswith("path", F.lit(f"{folder}/")))

"""Site index: front matter, dates, descriptions, listings, tags, folders, sitemap, feed, redirects, transclusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import markup, paths
from corvane.functions import text as tx
from corvane.sources.scratch import settle

FRONT = "struct<title:string,tags:array<string>,aliases:array<string>,created:string,modified:string,published:string,draft:string,publish:string,description:string,permalink:string,extra:map<string,string>>"
ALIASES = {"tags": ("tags", "tag"), "aliases": ("aliases", "alias"), "created": ("created", "date"), "modified": ("modified", "lastmod", "updated", "last-modified"), "published": ("published", "publishDate", "date")}


def _as_list(v) -> list[str]:
    if v is None:
        return []
    items = v if isinstance(v, list) else str(v).split(",")
    return [str(x).strip() for x in items if x is not None and str(x).strip()]


def parse_front(text: str) -> tuple[dict, str]:
    """Front matter between --- (YAML) or +++ (TOML) lines, and the rest."""
    import tomllib

    import yaml

    for mark, load in (("---", yaml.safe_load), ("+++", tomllib.loads)):
        if text.startswith(mark + "\n"):
            end = text.find(f"\n{mark}", len(mark))
            if end > 0:
                try:
                    data = load(text[len(mark) + 1 : end + 1])
                except (yaml.YAMLError, tomllib.TOMLDecodeError):
                    return {}, text
                return data if isinstance(data, dict) else {}, text[end + 1 + len(mark) :].lstrip("\n")
    return {}, text


def front_record(text: str, fallback_title: str) -> tuple[dict, str]:
    raw, body = parse_front(text or "")
    pick = lambda names: next((raw[n] for n in names if raw.get(n) is not None), None)
    one = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    known = {"title", "draft", "publish", "description", "permalink"} | {n for v in ALIASES.values() for n in v}
    from corvane.operators.site_slugs import slug_tag

    rec = {k: one(pick(ALIASES[k])) for k in ("created", "modified", "published")} | {k: one(raw.get(k)) for k in ("draft", "publish", "description", "permalink")}
    rec |= {"title": one(raw.get("title")) or fallback_title, "tags": list(dict.fromkeys(slug_tag(t) for t in _as_list(pick(ALIASES["tags"])))), "aliases": list(dict.fromkeys(_as_list(pick(ALIASES["aliases"]))))}
    rec["extra"] = {str(k): str(v) for k, v in raw.items() if k not in known}
    return rec, body


def front_matter(pages: DataFrame, text: str = "text", title: str = "slug") -> DataFrame:
    """pages with `front` (fixed fields, other keys in `extra`) and `body`."""
    names = pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.copy()
            got = [front_record(t, s) for t, s in zip(f[text], f[title])]
            f["front"], f["body"] = [g[0] for g in got], [g[1] for g in got]
            yield f

    fields = ", ".join(f"`{n}` {t}" for n, t in pages.dtypes)
    return pages.select(names).mapInPandas(run, f"{fields}, front {FRONT}, body string")


def remove_drafts(pages: DataFrame, draft: str = "draft") -> DataFrame:
    return pages.filter(F.coalesce(F.lower(F.col(draft).cast("string")), F.lit("")) != "true")


def explicit_publish(pages: DataFrame, publish: str = "publish") -> DataFrame:
    return pages.filter(F.lower(F.col(publish).cast("string")) == "true")


def run_filters(pages: DataFrame, filters: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The filter plugins in order; Catalyst merges what are column predicates."""
    return reduce(lambda d, f: f(d), filters, pages)


def coerce_date(value: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(value), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")), F.try_to_timestamp(value, F.lit("dd MMM yyyy")))


def page_dates(front: list[Column], git: list[Column], disk: list[Column], now: Column) -> list[Column]:
    """created, modified, published: first known of front matter, version control, file system; unreadable front matter counts as now."""
    out = []
    for f, g, d in zip(front, git, disk):
        out.append(F.coalesce(F.when(f.isNotNull() & (f != ""), F.coalesce(coerce_date(f), now)), g, d))
    return out


def format_date(c: Column) -> Column:
    return F.date_format(c, "dd MMM yyyy")


def description(text: Column, given: Column | None = None, most: int = 150, cut: int = 300) -> Column:
    """Given description, or whole sentences up to `most` characters, one at least, cut at `cut`."""
    url = r"(https?://)?(([\da-z.-]+)\.([a-z.]{2,6})(:\d+)?)([/\w.-]*)(\?[/\w.=&;-]*)?"
    body = F.regexp_replace(tx.html_escape(text), url, "$2$6")
    parts = F.split(F.regexp_replace(body, r"(?U)\s+", " "), r"\.\s", -1)
    start = F.struct(F.lit("").alias("d"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        s2 = F.when(F.endswith(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(".")))
        joined = F.when(acc["d"] == "", s2).otherwise(F.concat(acc["d"], F.lit(" "), s2))
        fits = ~acc["full"] & (s != "") & ((F.length(joined) <= most) | (acc["d"] == ""))
        return F.struct(F.when(fits, joined).otherwise(acc["d"]).alias("d"), ~fits)

    d = F.aggregate(parts, start, step)["d"]
    own = F.when(F.length(d) > cut, F.concat(F.substring(d, 1, cut), F.lit("..."))).otherwise(d)
    return own if given is None else F.coalesce(F.nullif(F.regexp_replace(given, url, "$2$6"), F.lit("")), own)


def html_text(html: Column) -> Column:
    """Text of well-formed markup: scripts, styles and tags dropped, entities of escaping resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(tx.html_unescape(t), r"(?U)\s+", " "))


def by_date(folder_first: bool = False) -> list[Column]:
    order = [F.col("date").desc_nulls_last(), F.lower("title"), F.col("slug")]
    return [F.col("is_folder").desc(), *order] if folder_first else order


def natural_key(name: Column) -> Column:
    """Sort key that compares runs of digits as numbers, of any length, and letters by their base: without case and accents."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    sized = lambda p: F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))
    return F.collate(F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), sized(p)).otherwise(p)), ""), "UNICODE_CI_AI")


def ranked_by(df: DataFrame, *order: str, out: str = "place") -> DataFrame:
    """df with each row's place, from 1, by columns that tell all rows apart. Rows are dealt over ranges and numbered there; only the ranges' sizes are summed up."""
    dealt = settle(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = sorted((r["__range"], r["count"]) for r in dealt.groupBy("__range").count().collect())  # one row a partition
    before, total = [], 0
    for range_, n in sizes:
        before.append((range_, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return dealt.join(F.broadcast(offsets), "__range").withColumn(out, place).drop("__range", "__before")


def page_list(pages: DataFrame, limit: int | None = None, folder_first: bool = False) -> DataFrame:
    out = pages.orderBy(*by_date(folder_first))
    return out.limit(limit) if limit else out


def recent_pages(pages: DataFrame, limit: int = 3) -> DataFrame:
    """The latest pages and how many more there are."""
    more = pages.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))
    return page_list(pages, limit).join(F.broadcast(more))  # one row


def page_tags(pages: DataFrame) -> DataFrame:
    """slug, tag with every prefix of a tag."""
    t = pages.select("slug", F.explode("tags").alias("t"))
    return t.select("slug", F.explode(paths.segment_prefixes(F.col("t"))).alias("tag")).distinct()


def tag_counts(pages: DataFrame) -> DataFrame:
    return page_tags(pages).groupBy("tag").agg(F.count("*").alias("n_pages"))


def made_pages(counts: DataFrame, pages: DataFrame, key: str, prefix: str, label: str) -> DataFrame:
    """key, n_pages, slug, title, made: one page a key, the one written for it if there is one, a made one otherwise."""
    own = pages.filter(F.startswith("slug", F.lit(prefix))).select(F.substring("slug", F.lit(len(prefix) + 1), F.length("slug")).alias(key), F.col("title").alias("own_title"))
    t = counts.join(own, key, "left")
    return t.select(key, "n_pages", F.concat(F.lit(prefix), F.col(key)).alias("slug"), F.coalesce("own_title", F.concat(F.lit(label), F.col(key))).alias("title"), F.col("own_title").isNull().alias("made"))


def tag_pages(pages: DataFrame) -> DataFrame:
    """One row a tag."""
    return made_pages(tag_counts(pages), pages, "tag", "tags/", "Tag: ")


def folder_pages(pages: DataFrame) -> DataFrame:
    """One row a folder; its own page is the folder's index."""
    own = pages.filter(F.endswith("slug", F.lit("/index"))).withColumn("slug", F.regexp_replace("slug", r"/index\z", ""))
    return made_pages(folder_rollup(pages.withColumn("date", F.lit(None).cast("date"))).select("folder", "n_pages"), own, "folder", "", "Folder: ")


def at_pages(pages: DataFrame, text: str = "content") -> DataFrame:
    """One row an @token, and one for every token above it."""
    each = pages.select("slug", F.explode(markup.at_mentions(F.col(text))).alias("t"))
    each = each.select("slug", F.explode(paths.segment_prefixes(F.col("t"))).alias("token")).distinct()
    return made_pages(each.groupBy("token").agg(F.count("*").alias("n_pages")), pages, "token", "ats/", "@")


def folders_of(slug: Column) -> Column:
    """Every folder above a slug, outermost first."""
    segs = F.split(slug, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segs) - 1, F.lit(1))), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))
    return F.when(F.size(segs) > 1, up).otherwise(F.array().cast("array<string>"))


def folder_rollup(pages: DataFrame, kinds: tuple[str, ...] = ("date",)) -> DataFrame:
    """folder, n_pages, the latest date of each kind."""
    f = pages.select(F.explode(folders_of(F.col("slug"))).alias("folder"), *kinds)
    return f.groupBy("folder").agg(F.count("*").alias("n_pages"), *[F.max(k).alias(k) for k in kinds])


def breadcrumbs(pages: DataFrame, root: str = "Home") -> DataFrame:
    """slug, depth, path, name: the chain from the root; a folder page's title names its step."""
    steps = pages.select("slug", F.posexplode(F.concat(F.array(F.lit("")), paths.segment_prefixes(F.col("slug")))).alias("depth", "path"))
    titles = pages.select(F.col("slug").alias("path"), F.col("title").alias("own"))
    s = steps.join(titles, "path", "left")
    plain = F.replace(F.element_at(F.split("path", "/"), -1), F.lit("-"), F.lit(" "))
    return s.select("slug", "depth", "path", F.when(F.col("path") == "", F.lit(root)).otherwise(F.coalesce("own", plain)).alias("name"))


def content_index(pages: DataFrame, keep_empty: bool = True) -> DataFrame:
    """slug and one JSON document a page; dates and descriptions stay out of it."""
    p = pages if keep_empty else pages.filter(F.length("content") > 0)
    return p.select("slug", F.to_json(F.struct(F.col("slug"), F.col("file_path").alias("filePath"), "title", "links", "tags", "content")).alias("document"))


def sitemap(pages: DataFrame, base: str) -> DataFrame:
    """slug, one XML element a page."""
    loc = F.concat(F.lit(f"https://{base}/"), paths.simplify_slug(F.col("slug")))
    mod = F.when(F.col("date").isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format("date", "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise(F.lit(""))
    return pages.select("slug", F.concat(F.lit("<url><loc>"), loc, F.lit("</loc>"), mod, F.lit("</url>")).alias("element"))


def feed(pages: DataFrame, limit: int = 10) -> DataFrame:
    return page_list(pages, limit).select("slug", "title", "date")


def alias_redirects(pages: DataFrame) -> DataFrame:
    """alias_slug, target: one row a (page, alias); a relative alias starts at the page's folder."""
    a = pages.select("slug", F.explode("aliases").alias("alias"))
    folder = F.regexp_replace("slug", r"[^/]*\z", "")
    here = F.when(F.startswith("alias", F.lit("./")), F.concat(folder, F.expr("substring(alias, 3)"))).when(F.startswith("alias", F.lit("../")), F.concat(F.regexp_replace(folder, r"[^/]+/\z", ""), F.expr("substring(alias, 4)"))).otherwise(F.col("alias"))
    s = paths.slugify(here)
    return a.select(s.alias("alias_slug"), F.col("slug").alias("target"), paths.resolve_relative(s, F.col("slug")).alias("redirect"))


def toc(pages: DataFrame, key: str, text: str, depth: int = 3, least: int = 1) -> DataFrame:
    """key, pos, level from the shallowest heading, title, anchor (repeats numbered); pages with more than `least` entries."""
    h = pages.select(key, F.posexplode(markup.headings(F.col(text), depth)).alias("pos", "h")).select(key, "pos", "h.level", "h.title")
    w = Window.partitionBy(key)
    h = h.withColumn("n", F.count("*").over(w)).withColumn("depth", F.col("level") - F.min("level").over(w)).withColumn("base", paths.slug_anchor(F.col("title")))
    k = F.row_number().over(Window.partitionBy(key, "base").orderBy("pos"))
    return h.withColumn("k", k).filter(F.col("n") > least).select(key, "pos", "depth", "title", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("k") - 1).cast("string"))).alias("anchor"))


EMBED = r"!\[\[([^\[\]]+)\]\]"


def section(text: Column, anchor: Column) -> Column:
    """A heading's part of a text: from the first heading of that anchor to the next one of its level or above; null without one."""
    lines = F.split(text, "\n")
    blanked = F.split(markup.each(text, markup.FENCED, lambda code: F.regexp_replace(code, r"[^\n]", " ")), "\n")
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6}) ", 1))
    heads = F.filter(F.transform(blanked, lambda x, i: F.struct(i.alias("i"), level(x).alias("level"), paths.slug_anchor(F.trim(F.regexp_extract(x, r"^#{1,6} +(.*?) *$", 1))).alias("anchor"))), lambda h: h["level"] > 0)

    def part(hs: Column) -> Column:
        first = F.get(F.filter(hs, lambda h: h["anchor"] == anchor), F.lit(0))
        after = F.get(F.filter(hs, lambda h: (h["i"] > first["i"]) & (h["level"] <= first["level"])), F.lit(0))
        count = F.coalesce(after["i"], F.size(lines)) - first["i"]
        return F.when(first.isNotNull(), F.array_join(F.slice(lines, first["i"] + 1, count), "\n"))

    return tx.let(heads, part)


def embedded(text: Column, ref: Column) -> Column:
    """What an embed shows of a page's text: all of it, a heading's section (#heading) or a block (#^id); null where there is none."""
    found = F.get(F.filter(markup.blocks(text), lambda b: b["id"] == F.substring(ref, F.lit(3), F.length(ref))), F.lit(0))["block"]
    return F.when(ref == "", text).when(F.startswith(ref, F.lit("#^")), found).otherwise(section(text, paths.slug_anchor(F.regexp_replace(ref, "^#+", ""))))


def _embed(text: Column) -> Column:
    """What stands between the brackets of an embed, as page and ref (what follows the first #, with it)."""
    target = F.substring_index(text, "|", 1)
    page = F.substring_index(target, "#", 1)
    return F.struct(F.trim(page).alias("page"), F.trim(F.substring(target, F.length(page) + 1, F.length(target))).alias("ref"))


def _fragments(pages: DataFrame) -> DataFrame:
    """page, ref, pieces: all that embeds can show, the pages themselves (an empty ref) included, cut into literals and embeds: k, text, embed (null for a literal)."""
    embeds = F.array_distinct(F.regexp_extract_all("content", F.lit(EMBED), F.lit(1)))
    named = pages.select(F.explode(embeds).alias("e")).select(_embed(F.col("e")).alias("e")).select("e.*").filter("ref <> ''").distinct()
    source = pages.filter("content is not null").select(F.col("slug").alias("page"), F.col("content").alias("text"))
    parts = named.join(source, "page").select("page", "ref", embedded(F.col("text"), F.col("ref")).alias("text")).filter("text is not null")
    every = source.select("page", F.lit("").alias("ref"), "text").unionByName(parts)
    words = F.transform(F.split("text", EMBED, -1), lambda w, i: F.struct((i * 2).alias("k"), w.alias("text"), F.lit(None).cast("struct<page:string,ref:string>").alias("embed")))
    names = F.transform(F.regexp_extract_all("text", F.lit(EMBED), F.lit(1)), lambda e, i: F.struct((i * 2 + 1).alias("k"), F.concat(F.lit("![["), e, F.lit("]]")).alias("text"), _embed(e).alias("embed")))
    return every.select("page", "ref", F.concat(words, names).alias("pieces"))


def _shown(slugs: DataFrame, children: DataFrame) -> DataFrame:
    """slug, page, ord, ref: of each page and each page that it comes to show, itself (an empty ord) included, the embed that shows it: the first one in reading order.

    An embed stands only if the one around it shows its page, and an earlier one may turn up deep inside another; so each round takes the
    embeds that those shown by the round before give, and keeps the first of each pair, until a round changes nothing. Only pages that
    changed go on. A round is one join and one shuffle, by the page that shows.
    """
    none, ints = F.lit(None), F.array().cast("array<int>")
    done, last = [], slugs.select("slug", F.col("slug").alias("page"), ints.alias("ord"), F.lit("").alias("ref"))
    while True:
        inner = last.join(children, ["page", "ref"]).select("slug", F.inline("embeds"), "ord")
        inner = inner.select("slug", "embed.page", F.struct(F.array_append("ord", F.col("k")).alias("ord"), "embed.ref").alias("at"), none.cast("array<int>").alias("old")).filter("page <> slug")
        old = last.select("slug", "page", F.when(F.col("page") == F.col("slug"), F.struct("ord", "ref")).alias("at"), F.col("ord").alias("old"))
        both = inner.unionByName(old).repartition("slug").groupBy("slug", "page").agg(F.min("at").alias("at"), F.max("old").alias("old"))
        moved = F.max(~F.col("at.ord").eqNullSafe(F.col("old"))).over(Window.partitionBy("slug"))
        now = settle(both.withColumn("moved", moved).filter("at is not null").select("slug", "page", "at.ord", "at.ref", "moved"))
        done.append(now.filter("not moved").drop("moved"))
        last = now.filter("moved").drop("moved")
        if last.isEmpty():
            return reduce(DataFrame.unionByName, done)


def transclude(pages: DataFrame) -> DataFrame:
    """slug, content with the embeds of pages, heading sections and blocks expanded, however deep.

    pages: slug (one row each), content. An embed reads `![[page]]`, `![[page#heading]]` or `![[page#^block]]`, each with an alias or
    without. A page shows another at most once, whole or in part: at the first embed of it in reading order, what embeds show
    included. Later ones, those of the page itself and those of nothing stay as they are. So a page's content is
    linear in the pages that it reaches. Texts are cut once for all; the rounds move names and positions only.
    """
    fragments = settle(_fragments(pages))
    embeds = F.transform(F.filter("pieces", lambda x: x["embed"].isNotNull()), lambda x: F.struct(x["k"].alias("k"), x["embed"].alias("embed")))
    children = settle(fragments.select("page", "ref", embeds.alias("embeds")).filter("size(embeds) > 0"))
    shown = settle(_shown(pages.select("slug"), children))
    units = shown.join(fragments, ["page", "ref"])
    parts = units.select("slug", "ord", F.inline("pieces")).select("slug", F.array_append("ord", F.col("k")).alias("ord"), "text", "embed.page", "embed.ref")
    open_ = shown.join(fragments.select("page", "ref"), ["page", "ref"], "left_semi").select("slug", "ord")  # embeds that something takes the place of
    left = parts.filter("text <> ''").join(open_, ["slug", "ord"], "left_anti")
    content = left.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    out = pages.select("slug").join(content, "slug", "left")
    return out.select("slug", F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), ""), F.lit("")).alias("content"))

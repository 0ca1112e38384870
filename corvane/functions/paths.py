"""Slugs, relative links and path prefixes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_slashes(s: Column) -> Column:
    return F.regexp_replace(s, r"^/|/\z", "")


def _segment(s: Column) -> Column:
    for a, b in ((r"(?U)\s", "-"), ("&", "-and-"), ("%", "-percent"), (r"[?#]", "")):
        s = F.regexp_replace(s, a, b)
    return s


def slugify(path: Column, drop_extension: bool = False) -> Column:
    """Slug of a file path: no outer slashes, no page extension, no blanks; `_index` is `index`."""
    p = strip_slashes(path)
    ext = F.regexp_extract(p, r"(\.[A-Za-z0-9]+)\z", 1)
    body = F.regexp_replace(p, r"\.[A-Za-z0-9]+\z", "")
    body = F.regexp_replace(_segment(body), r"/\z", "")
    body = F.regexp_replace(body, r"(^|/)_index\z", "$1index")
    return body if drop_extension else F.concat(body, F.when(ext.isin("", ".md", ".html"), F.lit("")).otherwise(ext))


def slug_tag(tag: Column) -> Column:
    return F.array_join(F.transform(F.split(tag, "/"), lambda s: _segment(s)), "/")


def simplify_slug(slug: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(slug, r"(^|/)index\z", "$1"), r"^/", "")
    return F.when(s == "", F.lit("/")).otherwise(s)


def is_folder(path: Column) -> Column:
    return path.rlike(r"(/|(^|/)index(\.md|\.html)?)\z")


def slug_anchor(anchor: Column) -> Column:
    """Heading anchor: lower case, punctuation dropped, blanks as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(anchor), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), " ", "-")


def split_anchor(link: Column) -> tuple[Column, Column]:
    """Path and anchor (with its #, or empty) of a link."""
    parts = F.split(link, "#")
    path, raw = parts[0], F.get(parts, F.lit(1))
    anchor = F.when(raw.isNull(), F.lit("")).when(F.endswith(path, F.lit(".pdf")), F.concat(F.lit("#"), raw)).otherwise(F.concat(F.lit("#"), slug_anchor(raw)))
    return path, anchor


def canonical_link(link: Column) -> Column:
    """Relative form of an internal link: decoded, slugified, anchored, with its trailing slash kept."""
    decoded = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
    path, anchor = split_anchor(decoded)
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    dots = F.array_join(F.filter(segs, lambda s: s.rlike(r"^\.{1,2}\z")), "/")
    rest = F.array_join(F.filter(segs, lambda s: ~s.rlike(r"^\.{1,2}\z")), "/")
    simple = strip_slashes(simplify_slug(slugify(rest)))
    joined = F.array_join(F.filter(F.array(dots, simple), lambda s: s != ""), "/")
    start = F.when(joined == "", F.lit(".")).when(F.startswith(joined, F.lit(".")), joined).otherwise(F.concat(F.lit("./"), joined))
    return F.concat(start, F.when(is_folder(path), F.lit("/")).otherwise(F.lit("")), anchor)


def path_to_root(slug: Column) -> Column:
    depth = F.size(F.filter(F.split(slug, "/"), lambda s: s != "")) - 1
    return F.when(depth <= 0, F.lit(".")).otherwise(F.array_join(F.array_repeat(F.lit(".."), depth.cast("int")), "/"))


def join_segments(a: Column, b: Column) -> Column:
    """Two segments with one slash between; an outer slash on either side is kept."""
    body = F.array_join(F.transform(F.filter(F.array(a, b), lambda s: (s != "") & (s != "/")), strip_slashes), "/")
    return F.concat(F.when(F.startswith(a, F.lit("/")), F.lit("/")).otherwise(F.lit("")), body, F.when(F.endswith(b, F.lit("/")), F.lit("/")).otherwise(F.lit("")))


def resolve_relative(current: Column, target: Column) -> Column:
    return join_segments(path_to_root(current), simplify_slug(target))


def segment_prefixes(path: Column) -> Column:
    """a/b/c -> [a, a/b, a/b/c]"""
    segs = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, F.lit(1), i), "/"))


def is_external(url: Column) -> Column:
    return url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:|^//")


def slug_kinds(s: Column) -> dict[str, Column]:
    """What kinds of path a string may be."""
    ext = s.rlike(r"\.[A-Za-z0-9]+\z")
    relative_start = s.rlike(r"^\.{1,2}(/|\z)|^\.{1,2}#")
    bad = s.rlike(r"[ #?&]")
    folder = s.rlike(r"(^|/)index\z")
    return {
        "file_path": ~F.startswith(s, F.lit(".")) & ext,
        "full_slug": ~(F.startswith(s, F.lit(".")) | F.startswith(s, F.lit("/"))) & ~F.endswith(s, F.lit("/")) & ~bad,
        "simple_slug": ~(F.startswith(s, F.lit(".")) | ((F.length(s) > 1) & F.startswith(s, F.lit("/")))) & ~folder & ~bad & ~s.rlike(r"\.(md|html)\z"),
        "relative_url": relative_start & ~folder & ~s.rlike(r"\.(md|html)\z"),
        "absolute_url": s.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"),
    }


def resolve_link(source: Column, target: Column, strategy: str, only: Column | None = None) -> Column:
    """Link from a page to a target. relative: as written; absolute: from the root; shortest: `only`, the one slug that ends in the target's name, if there is one."""
    canonical = canonical_link(target)
    if strategy == "relative":
        return canonical
    slug = strip_slashes(F.substring(canonical, F.lit(2), F.length(canonical)))
    absolute = F.concat(join_segments(path_to_root(source), slug), F.when(is_folder(canonical) & ~F.endswith(slug, F.lit("/")), F.lit("/")).otherwise(F.lit("")))
    if strategy == "absolute" or only is None:
        return absolute
    return F.when(only.isNotNull(), F.concat(resolve_relative(source, only), split_anchor(slug)[1])).otherwise(absolute)


def link_name(target: Column) -> Column:
    """The slug, without anchor, that a link names."""
    canonical = canonical_link(target)
    return split_anchor(strip_slashes(F.substring(canonical, F.lit(2), F.length(canonical))))[0]

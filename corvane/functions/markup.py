"""Markdown dialects as column rewrites and extractions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.paths import slug_tag

# Callout aliases, arrows.
CALLOUTS = {
    "note": "note", "abstract": "abstract", "summary": "abstract", "tldr": "abstract", "info": "info", "todo": "todo", "tip": "tip", "hint": "tip", "important": "tip",
    "success": "success", "check": "success", "done": "success", "question": "question", "help": "question", "faq": "question", "warning": "warning", "attention": "warning",
    "caution": "warning", "failure": "failure", "missing": "failure", "fail": "failure", "danger": "danger", "error": "danger", "bug": "bug", "example": "example",
    "quote": "quote", "cite": "quote",
}
ARROWS = [("<--", "&lArr;"), ("-->", "&rArr;"), ("<==", "&lArr;"), ("==>", "&rArr;"), ("<-", "&larr;"), ("->", "&rarr;"), ("<=", "&lArr;"), ("=>", "&rArr;")]
LINK = r"(!?)\[\[([^\[\]]*)\]\]"
TAG_RUN = r"[\p{L}\p{M}\p{So}\p{Nd}_-]+"
TAG = rf"(?<!\S)#({TAG_RUN}(?:/{TAG_RUN})*)"  # a tag begins a word
AT = r"(?<![\w/])@([A-Za-z][\w/-]*)"
VIDEOS = "mp4 webm ogg avi mov flv wmv mkv mpg mpeg 3gp m4v".split()
IMAGES = "png jpg jpeg gif bmp svg webp".split()
FENCED = r"(?s)```.*?```"
CODE = rf"{FENCED}|`[^`]*`"


def each(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Every match of the pattern becomes new(match). Matches are replaced as they read, so equal ones alike."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, new(m)))


def wikilinks(text: Column) -> Column:
    """Array of embed, page, heading, alias. A link reads page, then # and a heading, then | and an alias; a table escapes that bar."""
    found = F.regexp_extract_all(text, F.lit(LINK), F.lit(0))

    def parts(link: Column) -> Column:
        body = F.replace(F.regexp_extract(link, LINK, 2), F.lit("\\|"), F.lit("|"))
        target = F.substring_index(body, "|", 1)
        page = F.substring_index(target, "#", 1)
        after = lambda whole, part: F.substring(whole, F.length(part) + 2, F.length(whole))
        return F.struct(
            F.startswith(link, F.lit("!")).alias("embed"),
            F.trim(page).alias("page"),
            F.trim(F.regexp_replace(after(target, page), "^#+", "")).alias("heading"),
            F.trim(after(body, target)).alias("alias"),
        )

    return F.filter(F.transform(found, parts), lambda x: (x["page"] != "") | (x["heading"] != ""))


TABLE = r"(?m)^\|[^\n]*\n\|?[ :|-]*-[ :|-]*(?:\n\|[^\n]*)*"  # a row, a line of dashes, further rows


def escape_table_links(text: Column) -> Column:
    """Bars inside links are escaped in tables, where a bare one would end the cell; escaped ones and all other text stay."""
    escaped = lambda link: F.regexp_replace(link, r"(?<!\\)\|", r"\\|")
    return each(text, TABLE, lambda t: each(t, LINK, escaped))


def inline_tags(text: Column) -> Column:
    """Tags that hold more than digits and slashes, as slugs, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda t: F.length(F.translate(t, "0123456789/", "")) > 0), slug_tag))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)%%.*?%%", "")


def rewrite_inline(text: Column) -> Column:
    """Highlights, then arrows, longest first."""
    t = F.regexp_replace(text, r"==([^=]+)==", "<mark>$1</mark>")
    for a, b in ARROWS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def callout_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CALLOUTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(name)), name)


def callouts(text: Column) -> Column:
    """Array of type, meta, title, fold (+ open, - closed, empty for none) of callout headers."""
    head = r"(?m)^> *\[!([\w-]+)\|?(.+?)?\]([+-]?)(.*)$"
    lines = F.regexp_extract_all(text, F.lit(head), F.lit(0))
    part = lambda x, g: F.regexp_extract(x, head, g)
    return F.transform(lines, lambda x: F.struct(callout_type(part(x, 1)).alias("type"), part(x, 2).alias("meta"), part(x, 3).alias("fold"), F.trim(part(x, 4)).alias("title")))


BLOCK_END = r"\^([-_A-Za-z0-9]+)[ \t]*\z"


def blocks(text: Column) -> Column:
    """Array of id, block: what an id names, the first time it ends a line. An id alone on its line names the lines above, up to a blank line or a heading."""
    lines = F.split(text, "\n")
    at = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.regexp_extract(line, BLOCK_END, 1).alias("id"), F.trim(F.regexp_replace(line, BLOCK_END, "")).alias("own"))), lambda x: x["id"] != "")
    firsts = F.transform(F.array_distinct(F.transform(at, lambda x: x["id"])), lambda k: F.filter(at, lambda x: x["id"] == k)[0])

    def paragraph(i: Column) -> Column:
        above = F.slice(lines, F.lit(1), i)
        blank = F.array_max(F.transform(above, lambda line, k: F.when((F.trim(line) == "") | line.rlike("^#{1,6} "), k)))
        start = F.coalesce(blank + 1, F.lit(0))
        return F.array_join(F.slice(lines, start + 1, F.greatest(i - start, F.lit(0))), "\n")

    return F.transform(firsts, lambda x: F.struct(x["id"].alias("id"), F.when(x["own"] != "", x["own"]).otherwise(paragraph(x["i"])).alias("block")))


def block_refs(text: Column) -> Column:
    """Ids that end a line, each once."""
    return F.transform(blocks(text), lambda x: x["id"])


def embed_refs(text: Column) -> Column:
    """Array of target, kind (video, youtube, image, page) of embedded links."""
    wiki = F.transform(F.filter(wikilinks(text), lambda w: w["embed"]), lambda w: w["page"])
    plain = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    ending = lambda u: F.lower(F.substring_index(u, ".", -1))
    host = lambda u: F.regexp_extract(F.lower(u), r"^https?://(?:www\.)?([^/:?#]+)", 1)
    kind = lambda u: F.when(host(u).isin("youtu.be", "youtube.com", "m.youtube.com"), "youtube").when(ending(u).isin(VIDEOS), "video").when(ending(u).isin(IMAGES), "image").otherwise("page")
    return F.transform(F.concat(wiki, plain), lambda u: F.struct(u.alias("target"), kind(u).alias("kind")))


def youtube_id(url: Column) -> Column:
    """The 11 characters that name a video, from a short, watch or embed address."""
    i = F.regexp_extract(url, r"(?:youtu\.be/|[?&]v=|/(?:embed|v|u/\w)/)([\w-]{11})(?![\w-])", 1)
    return F.nullif(i, F.lit(""))


def checkboxes(text: Column) -> Column:
    """Array of done, item."""
    pat = r"(?m)^\s*[-*+] \[([ xX])\] (.*)$"
    lines = F.regexp_extract_all(text, F.lit(pat), F.lit(0))
    return F.transform(lines, lambda x: F.struct((F.lower(F.regexp_extract(x, pat, 1)) == "x").alias("done"), F.regexp_extract(x, pat, 2).alias("item")))


def has_mermaid(text: Column) -> Column:
    return text.rlike(r"(?m)^```mermaid\b")


def strip_code(text: Column) -> Column:
    return F.regexp_replace(text, CODE, "")


def at_mentions(text: Column) -> Column:
    """Distinct @tokens outside code, as slugs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(strip_code(text), F.lit(AT), F.lit(1)), slug_tag))


def linkify_at(text: Column) -> Column:
    """Links @tokens, leaving fenced and inline code as it is."""
    prose, code = F.split(text, CODE, -1), F.regexp_extract_all(text, F.lit(CODE), F.lit(0))
    linked = F.transform(prose, lambda p: F.regexp_replace(p, AT, "[[ats/$1|@$1]]"))
    return F.array_join(F.transform(linked, lambda p, i: F.concat(p, F.coalesce(F.get(code, i), F.lit("")))), "")


def at_lines(text: Column) -> Column:
    """Array of token, line: for each token the lines that hold it, outside code, without a leading date, its links and itself."""
    lines = F.split(strip_code(text), "\n")

    def dateless(line: Column) -> Column:
        first = F.substring_index(line, ":", 1)
        is_date = F.contains(line, F.lit(":")) & F.try_to_date(F.trim(first), "yyyy-MM-dd").isNotNull()
        return F.when(is_date, F.substring(line, F.length(first) + 2, F.length(line))).otherwise(line)

    def without(line: Column, token: Column) -> Column:
        shown = F.regexp_replace(dateless(line), r"\[\[ats/[^\]|]+\|([^\]]+)\]\]", "$1")
        words = F.filter(F.split(shown, r"\s+"), lambda w: (w != "") & (w != F.concat(F.lit("@"), token)))
        return F.array_join(words, " ")

    rows = F.flatten(F.transform(lines, lambda line: F.transform(at_mentions(line), lambda t: F.struct(t.alias("token"), without(line, t).alias("line")))))
    return F.array_distinct(F.filter(rows, lambda r: r["line"] != ""))


def headings(text: Column, depth: int = 3) -> Column:
    """Array of level, title of headings outside fences."""
    pat = rf"(?m)^(#{{1,{depth}}}) +(.*?) *$"
    lines = F.regexp_extract_all(F.regexp_replace(text, r"(?s)```.*?```", ""), F.lit(pat), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, pat, 1)).alias("level"), F.regexp_extract(x, pat, 2).alias("title")))


# The pairs of delimiters that org exports put around equations, and what takes their place.
EQUATIONS = [(r"\\(", r"\\)", "$"), (r"\\[", r"\\]", "$$"), (r"\begin{equation}", r"\end{equation}", "$$")]


def hugo_rewrite(text: Column) -> Column:
    """Exported org files: references become links, heading ids and shortcode braces go, figures become images, equations get dollars."""
    text = F.regexp_replace(text, r'\(\{\{<\s*relref\s+"([^"]*)"\s*>\}\}\)', "($1)")
    text = F.regexp_replace(text, r"(?m)[ \t]+\{#[^}]*\}[ \t]*$", "")
    text = F.regexp_replace(text, r"\{\{([^{}]*)\}\}", "$1")
    text = F.regexp_replace(text, r'<\s*figure\s+src="([^"]*)"\s*>', "![]($1)")
    for opening, closing, dollars in EQUATIONS:

        def with_dollars(m: Column, cut: tuple[int, int] = (len(opening), len(closing)), d: str = dollars) -> Column:
            inner = F.substring(m, F.lit(cut[0] + 1), F.length(m) - sum(cut))
            return F.concat(F.lit(d), F.replace(inner, F.lit(r"\_"), F.lit("_")), F.lit(d))

        text = each(text, rf"(?s)\Q{opening}\E.*?\Q{closing}\E", with_dollars)
    return text


# Tags that a media component of an outliner becomes.
MEDIA = {"video": "video", "audio": "audio", "pdf": "embed"}


def roam_rewrite(text: Column) -> Column:
    """Block outliners: choices become options, task marks checkboxes; highlights, italics, quotes and media embeds their HTML."""
    options = lambda m: F.array_join(F.transform(F.split(F.substring(m, F.lit(6), F.length(m) - 7), r"\|"), lambda o: F.concat(F.lit("<option>"), F.trim(o), F.lit("</option>"))), "")
    text = each(text, r"\{\{or:[^{}]*\}\}", lambda m: F.concat(F.lit("<select>"), options(m), F.lit("</select>")))
    for mark, state in (("TODO", ""), ("DONE", " checked")):
        text = F.regexp_replace(text, rf"\{{\{{[^{{}}]*\b{mark}\b[^{{}}]*\}}\}}", f'<input type="checkbox"{state} disabled>')
    for name, tag in MEDIA.items():
        text = F.regexp_replace(text, rf"\{{\{{\[\[{name}\]\]:\s*([^\s{{}}]+)\s*\}}\}}", f'<{tag} src="$1">')
    text = F.regexp_replace(text, r"\[\[>\]\]\s*", "> ")
    for mark, tag in ((r"\^\^", "mark"), ("__", "i")):
        text = F.regexp_replace(text, rf"{mark}(.+?){mark}", f"<{tag}>$1</{tag}>")
    return text

"""Slug of a tag outside Spark, for front matter."""

from __future__ import annotations

import re


def slug_tag(tag: str) -> str:
    return "/".join(re.sub(r"[?#]", "", re.sub(r"\s", "-", s).replace("&", "-and-").replace("%", "-percent")) for s in tag.split("/"))

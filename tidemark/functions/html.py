"""Features of an HTML text by bounded patterns: SQL expressions that run within codegen."""

from __future__ import annotations

LANDMARKS = ("main", "nav", "header", "footer", "article", "aside")


def strip_to_text(c: str, every: str = "") -> str:
    """Visible text: scripts, styles, comments, tags and entities removed in that order, white space collapsed.

    ``every``: what a dialect needs to replace all matches.
    """
    for tag in ("script", "style", "noscript"):
        c = f"regexp_replace({c}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' '{every})"
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', ' '{every})"
    c = f"regexp_replace({c}, '<[^>]+>', ' '{every})"
    c = f"regexp_replace({c}, '(?i)&[a-z]+;|&#[0-9]+;', ' '{every})"
    return f"trim(regexp_replace({c}, '[ \\t\\n\\r]+', ' '{every}))"


def count_tag(c: str, tag: str) -> str:
    return f"array_size(regexp_extract_all({c}, '(?i)<{tag}[ >]', 0))"


def has(c: str, pattern: str) -> str:
    return f"regexp_like({c}, '{pattern}')"

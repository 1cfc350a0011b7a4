"""Canonical spellings shared by all operators: domains, token lists, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_domain(c: Column) -> Column:
    """Trimmed, lower case, without one trailing dot and then one leading ``www.``; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\.$", ""), r"^www\.", "")


def normal_host(c: Column) -> Column:
    """The host of an address as people write it: trimmed, lower case, without scheme, path, port, ``www.`` and trailing dot, dropped in this order."""
    c = F.regexp_replace(F.lower(F.trim(c)), "^[a-z][a-z0-9+.-]*://", "")
    for pattern in ("[/?#].*$", ":[0-9]*$", r"^www\.", r"\.$"):
        c = F.regexp_replace(c, pattern, "")
    return c


def valid_host(c: Column) -> Column:
    """At most 253 characters, two or more labels of 1 to 63 letters, digits and inner hyphens."""
    return (F.length(c) <= 253) & c.rlike("^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$")


#: Names of infrastructure rather than sites, as patterns on the host; more can be passed.
INFRASTRUCTURE = (
    "(^|[.])(cdn|api|static|assets|cache|img|images|media|fonts|edge|ads|track|telemetry|dl|update)[0-9]*[.]",
    "(^|[.])(ns|dns|mx|smtp|imap|pop|ntp)[0-9]*[.]",
    "-(dns|cdn)[.]",
    "^(localhost|invalid|test)[.]",
    "[.](arpa|local|internal|onion)$",
)


def is_indexable(host: Column, pinned: Column | None = None, patterns: Sequence[str] = INFRASTRUCTURE, most_labels: int = 3) -> Column:
    """Whether a host may enter the index: valid; if pinned always; else with at most ``most_labels`` labels and no infrastructure name."""
    plain = (F.size(F.split(host, "[.]")) <= most_labels) & ~host.rlike("|".join(patterns))
    return F.coalesce(valid_host(host) & (plain if pinned is None else F.coalesce(pinned, F.lit(False)) | plain), F.lit(False))


def token_set(c: Column) -> Column:
    """A token list without regard to case, order, repetition and null elements; a null list stays null."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull()), F.lower)))


def plain_label(c: Column) -> Column:
    """Trimmed, lower case."""
    return F.lower(F.trim(c))


def set_hash(c: Column) -> Column:
    """64-bit hash of a list's elements in the order given; null has a hash of its own."""
    return F.xxhash64(F.coalesce(F.array_join(c, "\x01", "\x02"), F.lit("\x00")))


def utc_text(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; the session's time zone is UTC in every query."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

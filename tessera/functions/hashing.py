"""Fingerprints and content ids, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part: Column | str) -> Column:
    return F.lit(part) if isinstance(part, str) else F.coalesce(part.cast("string"), F.lit(""))


def fingerprint(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by NUL. A null part counts as an empty one. Strings are literals."""
    return F.substring(F.sha2(F.concat_ws("\0", *map(_text, parts)), 256), 1, 16)


def edge_fingerprint(rule: Column | str, from_: Column, target: Column, kind: Column) -> Column:
    return fingerprint("edge", rule, from_, target, kind)


def cycle_fingerprint(rule: Column | str, members: Column) -> Column:
    """members: an array; its order doesn't matter."""
    return fingerprint("cycle", rule, F.array_join(F.array_sort(members), "\0"))


def key_fingerprint(rule: Column | str, *key: Column | str) -> Column:
    return fingerprint("key", rule, *key)


def content_id(text: Column) -> Column:
    """The id git gives a blob of the text."""
    raw = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(raw).cast("string"), F.lit("\0")), "UTF-8"), raw))


def target_key(to: Column, workspace: Column, package: Column, specifier: Column) -> Column:
    """What an edge points at, as one string."""
    return F.coalesce(to, F.concat(F.lit("workspace:"), workspace), F.concat(F.lit("pkg:"), package), F.concat(F.lit("unresolved:"), specifier))

"""Selectors of rules as Columns over an endpoint struct (file, component, package, external)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .globs import glob_match


def selects(raw: str, end: Column) -> Column:
    """* takes all that is not external, path:<glob> files, pkg:<glob> packages, anything else the component of that id."""
    if raw == "*":
        return ~end["external"]
    if raw.startswith("path:"):
        return glob_match(end["file"], [raw[5:]])
    if raw.startswith("pkg:"):
        return glob_match(end["package"], [raw[4:]])
    return F.coalesce(end["component"] == raw, F.lit(False))


def any_selects(raws: Iterable[str], end: Column) -> Column:
    out = F.lit(False)
    for raw in raws:
        out = out | selects(raw, end)
    return out


def first_selecting(groups: Sequence[Iterable[str]], end: Column) -> Column:
    """The number of the first group with a selector that takes the endpoint; null if none has."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(groups))):
        out = F.when(any_selects(groups[k], end), F.lit(k)).otherwise(out)
    return out

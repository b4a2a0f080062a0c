"""Ignore files of a working tree: ordered patterns of nested folders, as git reads them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = "scope string, nth int, pattern string, negated boolean, folder boolean"


def ignore_rules(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """scope (the folder), nth (the line), pattern, negated and folder (only folders match) of the ignore files among files(path, text). Blank lines and comments say nothing; blanks at the end count only behind a backslash."""
    own = files.where((F.col("path") == name) | F.endswith("path", F.lit(f"/{name}")))
    lines = own.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("scope"), F.posexplode(F.split("text", r"\r?\n")).alias("nth", "raw"))
    line = F.regexp_replace(F.regexp_replace("raw", r"(?<!\\) +$", ""), r"\\ ", " ")
    said = lines.withColumn("line", line).where("line <> '' and not startswith(line, '#')")
    negated = F.startswith("line", F.lit("!"))
    bare = F.when(negated, F.substring("line", 2, 2**31 - 1)).otherwise(F.col("line"))
    return said.select("scope", "nth", F.regexp_replace(bare, "/$", "").alias("pattern"), negated.alias("negated"), F.endswith(bare, F.lit("/")).alias("folder")).where("pattern <> ''")


def ignore_regex(pattern: str) -> str:
    """The expression for paths below the pattern's folder. A slash within ties the pattern to it, else it may stand at any depth; ** crosses folders."""
    tied = "/" in pattern
    p = pattern.removeprefix("/")
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if p[i:] == "**" and i and p[i - 1] == "/":
            out, i = out + ".+", i + 2
            continue
        if c == "*":
            while p.startswith("*", i + 1):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end]
            out += "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", r"\[") + "]"
            i = end
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out += re.escape(p[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def _matches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether each pattern takes its path; a pattern is compiled once in a task."""
    known: dict[str, re.Pattern] = {}
    for patterns, paths in batches:
        out = pd.Series(False, index=patterns.index)
        for p, own in paths.groupby(patterns):
            if p not in known:
                known[p] = re.compile(ignore_regex(p), re.DOTALL)
            match = known[p].fullmatch
            out[own.index] = [match(x) is not None for x in own]
        yield out


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct paths of paths(path) that ignore rules exclude.

    A path, and each folder above it, meets the rules of the folders above these by equality. Of the rules that match the
    last one of the deepest folder decides; a folder that is excluded takes all below it along, whatever other rules say.
    """
    parts = F.split(F.col("path"), "/")
    join = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    every = paths.select("path").where("path is not null").distinct()
    entries = every.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), join)).alias("k", "entry"))
    entry = entries.select("entry", (F.col("entry") != F.col("path")).alias("is_folder")).groupBy("entry").agg(F.max("is_folder").alias("is_folder"))
    own = F.split(F.col("entry"), "/")
    above = entry.select("entry", "is_folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda k: F.array_join(F.slice(own, F.lit(1), k), "/"))).alias("depth", "scope"))
    met = above.join(rules, "scope").where("not folder or is_folder").withColumn("below", F.when(F.col("scope") == "", F.col("entry")).otherwise(F.substring("entry", F.length("scope") + 2, F.length("entry"))))
    last = met.where(F.pandas_udf(_matches, "boolean")("pattern", "below")).groupBy("entry").agg(F.max_by("negated", F.struct("depth", "nth")).alias("negated"))
    return entries.join(last.where("not negated"), "entry", "left_semi").select("path").distinct()


def not_ignored(files: DataFrame, tracked: DataFrame | None = None) -> DataFrame:
    """files(path, text, ...) without those that the ignore files among them exclude; tracked(path) stay, as ignore rules say nothing of them."""
    out = ignored(files, ignore_rules(files))
    if tracked is not None:
        out = out.join(tracked.select("path"), "path", "left_anti")
    return files.join(out, "path", "left_anti")

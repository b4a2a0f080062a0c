"""Many globs against many paths by equality joins: a glob meets the paths that share its literal part, and only these are tested."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import patterns_regex

_WILD = r"[*?\[{]"


def glob_key(glob: Column) -> Column:
    """What every path that a glob takes has: kind and value of its literal part.

    path: a glob without wildcards takes the path itself and all below it. dir: the folders before the first wildcard.
    name or ext: for globs with a wildcard in front, the literal last part, or what stands behind its last dot. dir with an
    empty value, which all paths have, is left for the rest.
    """
    plain = F.regexp_replace(F.regexp_replace(glob, r"^\./", ""), "/$", "")
    folder = F.regexp_replace(F.regexp_extract(glob, r"^(?:\./)?((?:[^*?\[{/]+/)*)", 1), "/$", "")
    last = F.regexp_extract(glob, r"([^/]*)$", 1)
    ext = F.regexp_extract(last, r"^[^\[{]*\.([^.*?\[\]{}]+)$", 1)
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    return F.when(~glob.rlike(_WILD), key("path", plain)).when(folder != "", key("dir", folder)).when((last != "") & ~last.rlike(_WILD), key("name", last)).when(ext != "", key("ext", ext)).otherwise(key("dir", F.lit("")))


def path_keys(path: Column) -> Column:
    """All keys under which a glob that takes the path can stand: its folders, itself, its name and its extension."""
    parts = F.split(path, "/")
    upto = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    key = lambda kind: lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    name = F.element_at(parts, -1)
    return F.array_distinct(F.concat(F.transform(F.slice(upto, F.lit(1), F.size(parts)), key("dir")), F.transform(F.slice(upto, F.lit(2), F.size(parts)), key("path")), F.array(key("name")(name), key("ext")(F.regexp_extract(name, r"([^.]*)$", 1)))))


def _takes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Whether each glob takes its path; a glob is compiled once in a task."""
    known: dict[str, re.Pattern] = {}
    for globs, paths in batches:
        out = pd.Series(False, index=globs.index)
        for g, own in paths.groupby(globs):
            if g not in known:
                known[g] = re.compile(patterns_regex([g]))
            match = known[g].match
            out[own.index] = [match(p) is not None for p in own]
        yield out


def matches(globs: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct (glob, path) of globs(glob) that take paths(path); see functions.globs for the language.

    A glob stands under one key, a path under as many as its depth; where a literal path is all of the glob no pattern is
    tested. Other pairs of a key go through the pattern in Arrow batches.
    """
    asked = globs.select("glob").where("glob is not null").distinct().withColumn("k", glob_key(F.col("glob")))
    held = paths.select("path").where("path is not null").distinct().withColumn("k", F.explode(path_keys(F.col("path"))))
    met = asked.join(held, "k").select("glob", "path", (F.col("k.kind") == "path").alias("sure"))
    sure = met.where("sure").select("glob", "path")
    takes = F.pandas_udf(_takes, "boolean")
    return sure.union(met.where("not sure").where(takes("glob", "path")).select("glob", "path"))

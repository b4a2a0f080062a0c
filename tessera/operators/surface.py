"""Public surfaces: what files export, through named re-exports and stars, in the order in which stars are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import release, settle
from .extract import without_comments

_STAR = r"""(?m)^[ \t]*export\s+(?:type\s+)?\*\s*from\s*["']([^"']+)["']"""


def star_exports(files: DataFrame) -> DataFrame:
    """file, at (its place among the file's stars, from 0) and specifier of the stars of script files(path, text)."""
    found = F.regexp_extract_all(without_comments(F.col("text")), F.lit(_STAR), 1)
    return files.select(F.col("path").alias("file"), F.posexplode(found).alias("at", "specifier"))


def linked(rows: DataFrame, edges: DataFrame, specifier: str) -> DataFrame:
    """rows(file, ...) with target: the file that the specifier leads to from there by edges(from_, specifier, kind, line, to_), of several edges a re-export's before others, then the first line's; null where there is none or it leads outside."""
    first = F.min(F.struct(F.col("kind") != "reexport", "line", "to_")).alias("_first")
    to = edges.groupBy(F.col("from_").alias("file"), F.col("specifier").alias("_said")).agg(first).select("file", "_said", F.col("_first.to_").alias("_to"))
    return rows.join(to.withColumnRenamed("_said", specifier), ["file", specifier], "left").drop("target").withColumnRenamed("_to", "target")


def star_paths(stars: DataFrame, depth: int = 10) -> DataFrame:
    """file, at, path (and seen, the files on it): for each file that stars(file, at, target) lead to from a file, the least of the ways there, as an array of the stars' places; ways visit no file twice and have depth steps at most.

    A file is searched before its stars and these in their order, so the least way is the one that a search finds first.
    Each round extends the ways that the last one bettered, and keeps the least to each file: the way to the file before is
    a least one too.
    """
    step = settle(stars.where("target is not null and file <> target").groupBy("file", "target").agg(F.min("at").alias("nth")), "star-steps")
    least = lambda d: d.groupBy("file", "at").agg(F.min(F.struct("path", "seen")).alias("m")).select("file", "at", "m.path", "m.seen")
    now = front = settle(step.select("file", F.col("target").alias("at"), F.array("nth").alias("path"), F.array("file", "target").alias("seen")), "star-paths")
    for _ in range(depth - 1):
        on = step.select(F.col("file").alias("at"), "target", "nth")
        more = front.join(on, "at").where(~F.array_contains("seen", F.col("target"))).select("file", F.col("target").alias("at"), F.concat("path", F.array("nth")).alias("path"), F.concat("seen", F.array("target")).alias("seen"))
        after = settle(least(now.union(more)), "star-paths")
        bettered = settle(after.join(now.select("file", "at", F.col("path").alias("was")), ["file", "at"], "left").where("was is null or path <> was").drop("was"), "star-front")
        release(now, *([front] if front is not now else []))
        now, front = after, bettered
        if not front.head(1):
            break
    release(step, *([front] if front is not now else []))
    return now


def public_surface(files: DataFrame, exports: DataFrame, stars: DataFrame, depth: int = 10) -> DataFrame:
    """file, name, origin (the file that declares it, or that a re-export leads to in vain) and signature of what files(file) export, through re-exports and stars.

    exports: file, name, signature, target and original (both null for an own declaration; target null too where a
    re-export leads outside). stars: file, at, specifier, target, at being the place in the file's list. An explicit name
    comes before those of stars, and of two stars the one listed first, with all that it reaches; default never comes
    through a star. A star without a target gives the name "* from <specifier>". A re-export has what its target gives for
    the original name, through that one's stars too; one that leads to nothing, or back to a file on the way, stands for
    itself. depth bounds the stars and the re-exports that are followed. Each file's surface is that of a search from it.
    """
    outside = stars.where("target is null")
    note = outside.select("file", F.concat(F.lit("* from "), "specifier").alias("name"), F.concat(F.lit('export * from "'), "specifier", F.lit('"')).alias("signature"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("original"))
    said = exports.select("file", "name", "signature", "target", "original").union(note).groupBy("file", "name").agg(F.min(F.struct("signature", "target", "original")).alias("e"))
    said = settle(said, "surface-said")
    paths = star_paths(stars, depth)
    direct = said.select("file", "name", F.col("file").alias("at"), F.array().cast("array<int>").alias("path"), "e")
    through = paths.select("file", "at", "path").join(said.select(F.col("file").alias("at"), "name", "e"), "at").where("name <> 'default'").select("file", "name", "at", F.col("path").cast("array<int>"), "e")
    first = direct.union(through).groupBy("file", "name").agg(F.min_by(F.struct("at", "e"), "path").alias("f"))
    first = settle(first.select("file", "name", F.col("f.at").alias("at"), "f.e.*"), "surface-first")
    release(said, paths)

    own = first.join(files.select("file").distinct(), "file", "left_semi")
    now = settle(own.select("file", "name", "at", "signature", "target", F.coalesce("original", "name").alias("wanted"), F.array("file", "at").alias("seen")), "surface")
    following = first.select(F.col("file").alias("target"), F.col("name").alias("wanted"), F.col("at").alias("n_at"), F.col("signature").alias("n_signature"), F.col("target").alias("n_target"), F.coalesce("original", "name").alias("n_wanted"))
    done = None
    for _ in range(depth):
        closed = now.where("target is null").select("file", "name", F.col("at").alias("origin"), "signature")
        done = closed if done is None else done.union(closed)
        open_ = now.where("target is not null")
        if not open_.head(1):
            now = open_
            break
        step = open_.join(following, ["target", "wanted"], "left")
        go = F.col("n_signature").isNotNull() & ~F.array_contains("seen", F.col("target"))
        pick = lambda a, b: F.when(go, F.col(a)).otherwise(F.col(b) if b else F.lit(None))  # noqa: E731, B023
        now = settle(step.select("file", "name", pick("n_at", "target").alias("at"), pick("n_signature", "signature").alias("signature"), F.when(go, F.col("n_target")).alias("target"), pick("n_wanted", "wanted").alias("wanted"), F.concat("seen", F.array("target", F.coalesce("n_at", "target"))).alias("seen")), "surface")
    rest = now.select("file", "name", F.col("at").alias("origin"), "signature")
    return rest if done is None else done.union(rest)

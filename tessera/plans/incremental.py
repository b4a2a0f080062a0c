"""A version that is kept between edits: edges in parts, and what cycle rules need of them.

Edges lie in parts by a hash of the importing file. An edit reads and replaces the parts of the files that it resolves again;
the others stay as they are, and a new version names both. Each part keeps the least place of each pair of components, so
that cycles of components come from these summaries. Cycles of files keep their strong components; an edit searches the
region that it can have changed.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, graph, resolve, rules
from ..schemas import Contract, Rule
from ..scratch import folder, release, settle
from ..sources.files import language_of
from . import check

PARTS = 64
_PYTHON_ENDS = (".py", "/__init__.py")


@dataclass(frozen=True)
class Kept:
    """One version: where its tables are, and for each part the version in which it was written last."""

    at: str
    contract: Contract
    workspaces: DataFrame
    aliases: tuple = ()
    roots: tuple = ("", "src")
    parts: int = PARTS
    written: tuple[int, ...] = ()
    schema: object = None
    cycles: tuple[tuple[str, DataFrame], ...] = ()

    def _paths(self, table: str, wanted: Sequence[int] | None = None) -> list[str]:
        return [f"{self.at}/{table}/v={v}/part={k}" for k, v in enumerate(self.written) if v >= 0 and (wanted is None or k in wanted)]

    def _read(self, spark: SparkSession, table: str, schema, wanted: Sequence[int] | None = None) -> DataFrame:
        paths = self._paths(table, wanted)
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def edges(self, spark: SparkSession, wanted: Sequence[int] | None = None) -> DataFrame:
        return self._read(spark, "edges", self.schema, wanted)

    def links(self, spark: SparkSession) -> DataFrame:
        """As edges, one for each part, pair of components and kind of import (types or others): the first by file and line."""
        end = lambda c: F.struct(F.lit(None).cast("string").alias("file"), F.col(c).alias("component"), F.lit(None).cast("string").alias("package"), F.lit(False).alias("external"))
        rows = self._read(spark, "links", "ca string, cb string, kind string, from_ string, line int")
        return rows.select(end("ca").alias("src"), end("cb").alias("dst"), "kind", "from_", "line")


def _part(path: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(parts)).cast("int")


def _write(kept: Kept, edges: DataFrame, version: int, touched: Sequence[int]) -> Kept:
    """A version whose touched parts are those of edges. A part without edges is no folder."""
    placed = edges.withColumn("part", _part(F.col("from_"), kept.parts))
    placed.repartition("part").write.partitionBy("part").parquet(f"{kept.at}/edges/v={version}")
    spark = edges.sparkSession
    there = spark.read.schema(placed.schema).parquet(f"{kept.at}/edges/v={version}")
    pair = there.where("src.component is not null and dst.component is not null and src.component <> dst.component")
    kind = F.when(F.col("kind") == "type", "type").otherwise("static").alias("kind")
    links = pair.groupBy("part", F.col("src.component").alias("ca"), F.col("dst.component").alias("cb"), kind).agg(F.min(F.struct("from_", "line")).alias("at")).select("ca", "cb", "kind", "at.from_", "at.line", "part")
    links.repartition("part").write.partitionBy("part").parquet(f"{kept.at}/links/v={version}")
    full = {r.part for r in there.select("part").distinct().collect()}  # no more than there are parts
    had = {r.part for r in spark.read.schema("ca string, part int").parquet(f"{kept.at}/links/v={version}").select("part").distinct().collect()}
    for k in full - had:  # a part that links no components: an empty file, so that its folder is there
        spark.createDataFrame([], "ca string, cb string, kind string, from_ string, line int").coalesce(1).write.mode("append").parquet(f"{kept.at}/links/v={version}/part={k}")
    written = list(kept.written) or [-1] * kept.parts
    for k in touched:
        written[k] = version if k in full else -1
    return replace(kept, written=tuple(written))


def _file_rules(contract: Contract) -> list[Rule]:
    return [r for r in contract.rules if r.kind == "acyclic" and r.level != "off" and (r.scope or "components") != "components"]


def start(files: DataFrame, workspaces: DataFrame, contract: Contract, aliases=(), roots=("", "src"), parts: int = PARTS) -> Kept:
    """The version of files(path, text), read whole."""
    spark = files.sparkSession
    edges = settle(check.code_graph(files, workspaces, contract, aliases, roots), "kept-edges")
    kept = Kept(folder(spark, "kept"), contract, workspaces, tuple(aliases), tuple(roots), parts, schema=edges.schema)
    kept = _write(kept, edges, 0, range(parts))
    cycles = tuple((r.id, settle(graph.strong_components(rules.cycle_pairs(edges, r).select("a", "b")), "kept-scc")) for r in _file_rules(contract))
    release(edges)
    return replace(kept, cycles=cycles)


def siblings(paths: DataFrame) -> DataFrame:
    """Paths that an import may lead to in place of one of paths(path): of the same name with another ending, and the package that a Python module is in."""
    p = F.col("path")
    ends = (*resolve.SCRIPT_ENDS, *_PYTHON_ENDS)
    bases = F.array_distinct(F.array_compact(F.array(p, *(F.when(F.endswith(p, F.lit(e)), F.substring(p, F.lit(1), F.length(p) - len(e))) for e in ends))))
    module = F.regexp_replace(F.regexp_replace(p, r"(/__init__)?\.py$", ""), r"/?[^/]*$", "")
    every = F.concat(bases, F.flatten(F.transform(bases, lambda b: F.array(*(F.concat(b, F.lit(e)) for e in ends)))), F.array(*(F.concat(module, F.lit(e)) for e in _PYTHON_ENDS)))
    return paths.select(F.explode(every).alias("path")).distinct()


def to_read_again(edges: DataFrame, new: DataFrame, deleted: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Files with an import that an edit can lead elsewhere: to a file that is gone, nowhere so far, to a file that a new one may stand before, or to a package of a new one's name."""
    gone = deleted.select(F.col("path").alias("to_")).union(siblings(new).select(F.col("path").alias("to_"))).distinct()
    tops = new.select(F.explode(F.array(*(F.regexp_extract("path", rf"^{r + '/' if r else ''}([^/]+?)(?:\.py$|/)", 1) for r in roots))).alias("package")).where("package <> ''").distinct()
    lost = edges.where("unresolved or (workspace is not null and to_ is null)")
    return edges.join(gone, "to_", "left_semi").select("from_").union(lost.select("from_")).union(edges.join(tops, "package", "left_semi").select("from_")).distinct().select(F.col("from_").alias("path"))


def edit(kept: Kept, files: DataFrame, edited: DataFrame, deleted: DataFrame, today: dt.date, baseline: DataFrame | None = None) -> tuple[Kept, DataFrame]:
    """The version after an edit, and its findings: all rules over what the edited files import and write, cycles over the whole graph.

    files: path and text of all files after the edit; edited(path): those of them that are changed or new; deleted(path). The
    findings are those of a check of the whole with changed set to the edited files, and the edges are those of a full one.
    """
    spark, contract, version = files.sparkSession, kept.contract, uuid.uuid4().int >> 65  # several edits may start from one version
    before = kept.edges(spark)
    edited = settle(edited.select("path").distinct(), "edited")
    known = before.select(F.col("from_").alias("path")).union(before.select(F.col("to_").alias("path")))
    new = edited.join(known.distinct(), "path", "left_anti")  # or without any import so far: read again for nothing
    again = to_read_again(before, new, deleted, kept.roots).join(deleted, "path", "left_anti") if new.head(1) or deleted.head(1) else edited.limit(0)
    redo = settle(edited.union(again).distinct(), "edit-redo")
    languages = [r[0] for r in redo.select(language_of(F.col("path"))).distinct().collect()]  # those that there are
    fresh = settle(check.code_graph(files.join(redo, "path", "left_semi"), kept.workspaces, contract, kept.aliases, kept.roots, files.select("path"), languages), "edit-edges")
    gone = redo.union(deleted.select("path")).distinct()
    touched = sorted(r.part for r in gone.select(_part(F.col("path"), kept.parts).alias("part")).distinct().collect())  # no more than there are parts
    old = kept.edges(spark, touched)
    rest = old.join(gone.select(F.col("path").alias("from_")), "from_", "left_anti")
    after = _write(kept, rest.select(*fresh.columns).unionByName(fresh), version, touched)

    made = [rules.edge_findings(fresh.join(edited.select(F.col("path").alias("from_")), "from_", "left_semi"), contract.rules, contract.components, contract.waivers, today)]
    cycles = []
    for r in contract.rules:
        if r.level == "off":
            continue
        if r.kind == "acyclic" and (r.scope or "components") == "components":
            made.append(rules.acyclic_findings(after.links(spark), r, contract.components, contract.waivers, today))
        elif r.kind == "acyclic":
            pairs = lambda e: rules.cycle_pairs(e, r).select("a", "b").distinct()  # noqa: B023, E731
            was, now = pairs(old), pairs(after.edges(spark, touched))
            scc = graph.updated_components(settle(pairs(after.edges(spark)), "edit-pairs"), dict(kept.cycles)[r.id], now.exceptAll(was), was.exceptAll(now))
            cycles.append((r.id, scc))
            made.append(rules.acyclic_findings(after.edges(spark), r, contract.components, contract.waivers, today, scc))
        elif r.kind == "state-owner":
            writes = extract.write_sites(files.join(edited, "path", "left_semi"), contract.resources)
            made.append(rules.state_findings(writes, r, contract.resources, contract.components, contract.waivers, today))
    found = reduce(DataFrame.unionByName, made)
    return replace(after, cycles=tuple(cycles)), rules.apply_baseline(found, baseline) if baseline is not None else found

"""Files, packages and edges in terms of components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..schemas import Component


def component_of(path: Column, components: Sequence[Component]) -> Column:
    """The first component, in declared order, whose patterns match the path; null if none does."""
    out = F.lit(None).cast("string")
    for c in reversed(components):
        out = F.when(glob_match(path, c.paths), F.lit(c.id)).otherwise(out)
    return out


def component_of_package(package: Column, dir_: Column, components: Sequence[Component]) -> Column:
    """The component declared for a package, else the owner of its package.json."""
    out = component_of(F.concat_ws("/", F.when(dir_ != "", dir_), F.lit("package.json")), components)
    for c in reversed(components):
        if c.package:
            out = F.when(package == c.package, F.lit(c.id)).otherwise(out)
    return out


def innermost_workspace(files: DataFrame, workspaces: DataFrame, path: str = "path") -> DataFrame:
    """Adds the column owner_workspace: the package whose folder is the longest prefix of the path.

    Every folder above a file is a key, so that this is an equality join of (depth of a path) rows a file.
    """
    parts = F.split(F.col("_path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    keyed = files.select(F.col(path).alias("_path")).distinct().select("_path", F.posexplode(above).alias("_depth", "_dir"))
    best = keyed.join(workspaces.select(F.col("dir").alias("_dir"), F.col("name").alias("_name")), "_dir").groupBy("_path").agg(F.max_by("_name", F.struct("_depth", "_name")).alias("owner_workspace"))
    return files.join(best, files[path] == best["_path"], "left").drop("_path")


def with_endpoints(edges: DataFrame, components: Sequence[Component], owners: DataFrame | None = None) -> DataFrame:
    """Adds src and dst (structs of file, component, package, external); dst is null where the target is missing.

    owners: name and component of the packages of the repository. A target file has only the edge's own workspace as its
    package; a package outside has no component. Edges that bring from_component and to_component, as their files have
    them, keep these: patterns are matched once a file then, not for every edge.
    """
    if owners is not None:
        edges = edges.join(owners.select(F.col("name").alias("workspace"), F.col("component").alias("_owner")), "workspace", "left")
    else:
        edges = edges.withColumn("_owner", F.lit(None).cast("string"))
    end = lambda file, comp, pkg, ext: F.struct(file.alias("file"), comp.alias("component"), pkg.alias("package"), ext.alias("external"))
    none = F.lit(None).cast("string")
    of = lambda file: F.col(f"{file}component") if f"{file}component" in edges.columns else component_of(F.col(file), components)
    src = end(F.col("from_"), of("from_"), none, F.lit(False))
    dst = (
        F.when(F.col("to_").isNotNull(), end(F.col("to_"), of("to_"), F.col("workspace"), F.lit(False)))
        .when(F.col("workspace").isNotNull(), end(none, F.col("_owner"), F.col("workspace"), F.lit(False)))
        .when(F.col("package").isNotNull(), end(none, none, F.col("package"), F.lit(True)))
    )
    return edges.withColumns({"src": src, "dst": dst}).drop("_owner", "from_component", "to_component")


def missing_target(unresolved: Column, workspace: Column, to: Column) -> Column:
    return F.coalesce(unresolved, F.lit(False)) | (workspace.isNotNull() & to.isNull())

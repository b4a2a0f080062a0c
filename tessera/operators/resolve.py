"""Imports resolved to files, packages or built-ins: every import becomes a few ranked candidates, one equality join finds those that exist."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modules that the JavaScript runtime brings along.
NODE = ("assert", "async_hooks", "buffer", "child_process", "cluster", "console", "constants", "crypto", "dgram", "diagnostics_channel", "dns", "domain", "events", "fs", "http", "http2", "https", "inspector", "module", "net", "os", "path", "perf_hooks", "process", "punycode", "querystring", "readline", "repl", "stream", "string_decoder", "sys", "timers", "tls", "trace_events", "tty", "url", "util", "v8", "vm", "wasi", "worker_threads", "zlib")
SCRIPT_ENDS = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def normalized(path: Column) -> Column:
    """A path without . and .. parts; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array(F.lit("\0"))))
    return F.when(~F.array_contains(done, "\0"), F.array_join(done, "/"))


def _first_existing(imports: DataFrame, candidates: Column, files: DataFrame) -> DataFrame:
    """Distinct imports with to_: the candidate of least rank that is a file; null if none is."""
    columns = imports.columns
    there = files.select(F.col("path").alias("_at"), F.lit(True).alias("_there")).distinct()
    ranked = imports.withColumn("_candidates", candidates).select(*columns, F.posexplode_outer("_candidates").alias("_rank", "_at"))
    best = F.min(F.when(F.col("_there"), F.struct("_rank", "_at")))
    return ranked.join(there, "_at", "left").groupBy(*columns).agg(best.alias("_best")).select(*columns, F.col("_best._at").alias("to_"))


def resolve_scripts(imports: DataFrame, files: DataFrame, workspaces: DataFrame, aliases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Edges of script imports: a relative path with its extension and index forms, an alias (prefix, folder), what a pattern leads to (a column stems of imports, see patterns.mapped), a workspace package, a built-in, else a package. A path, alias or subpath import (#...) that leads nowhere is unresolved."""
    spec = F.col("specifier")
    relative = spec.rlike(r"^\.\.?(/|$)")
    target = F.when(relative, normalized(F.concat_ws("/", F.regexp_replace("path", r"/?[^/]*$", ""), spec)))
    aliased = F.lit(False)
    for prefix, folder in aliases:
        target = F.when(target.isNull() & spec.startswith(prefix), normalized(F.concat(F.lit(folder), spec.substr(F.lit(len(prefix) + 1), F.length(spec))))).otherwise(target)
        aliased = aliased | spec.startswith(prefix)
    # columns of their own, so that the plan computes them once for all candidates
    aimed = imports.withColumn("_target", target).withColumn("_bare", F.regexp_replace("_target", r"\.(?:js|jsx|mjs|cjs)$", ""))
    stems = F.array(F.col("_target"), *(F.concat("_bare", F.lit(e)) for e in SCRIPT_ENDS), *(F.concat("_target", F.lit(e)) for e in SCRIPT_ENDS))
    aliased = aliased | spec.startswith("#")
    if "stems" in imports.columns:
        ends = lambda t: F.concat(F.array(t), *(F.array(F.concat(F.regexp_replace(t, r"\.(?:js|jsx|mjs|cjs)$", ""), F.lit(e))) for e in SCRIPT_ENDS), *(F.array(F.concat(t, F.lit(e))) for e in SCRIPT_ENDS))
        stems = F.when(F.col("_target").isNotNull(), stems).otherwise(F.flatten(F.transform("stems", lambda t: ends(t))))
    found = _first_existing(aimed, stems, files)
    package = F.when(spec.startswith("@"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(spec, r"^([^/]+)", 1))
    node = F.regexp_replace(spec, "^node:", "")
    builtin = spec.startswith("node:") | F.regexp_extract(node, r"^([^/]+)", 1).isin(*NODE)
    known = found.withColumn("_package", F.when(~relative & ~aliased, package)).join(workspaces.select(F.col("name").alias("_package"), F.col("name").alias("workspace"), "dir"), "_package", "left")
    inside = normalized(F.concat_ws("/", "dir", F.lit("src"), F.coalesce(F.nullif(F.regexp_replace(spec.substr(F.length("_package") + 2, F.length(spec)), r"\.js$", ""), F.lit("")), F.lit("index"))))
    entry = F.array(*(F.concat("_inside", F.lit(e)) for e in SCRIPT_ENDS))
    again = _first_existing(known.withColumn("_inside", F.when(F.col("workspace").isNotNull(), inside)).withColumnRenamed("to_", "_to"), entry, files).withColumn("to_", F.coalesce("_to", "to_"))
    named = F.coalesce("named", F.lit(False)) if "named" in imports.columns else F.lit(False)
    outside = F.col("to_").isNull() & F.col("workspace").isNull() & ~relative & ~aliased & ~named
    return again.select(
        F.col("path").alias("from_"), "to_", "workspace", F.when(outside, F.when(builtin, F.concat(F.lit("node:"), node)).otherwise(F.col("_package"))).alias("package"), F.when(outside, builtin).alias("builtin"), "specifier", "kind", "line",
        F.lit("script").alias("analyzer"), (F.col("to_").isNull() & (relative | aliased | (named & F.col("workspace").isNull()))).alias("unresolved"),
    )


def resolve_python(imports: DataFrame, files: DataFrame, roots: Sequence[str] = ("", "src")) -> DataFrame:
    """Edges of Python imports: each imported name first as a submodule, then the module itself, as package or file, below each root; the rest are packages or of the standard library. A relative import or a module of a package at a root that leads nowhere is unresolved."""
    spec, path = F.col("specifier"), F.col("path")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    folder = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    up = F.array_join(F.slice(folder, F.lit(1), F.greatest(F.lit(0), F.size(folder) - dots + 1)), "/")
    named = imports.where("kind <> 'error'").withColumn("_name", F.explode(F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("")))))
    bases = F.when(dots > 0, F.array(F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(module, F.lit(""))))).otherwise(F.array(*(F.concat_ws("/", F.nullif(F.lit(r), F.lit("")), module) for r in roots)))
    name = F.nullif(F.col("_name"), F.lit(""))
    forms = F.flatten(F.transform(bases, lambda b: F.array(F.concat(b, F.lit("/"), name, F.lit("/__init__.py")), F.concat(b, F.lit("/"), name, F.lit(".py")), F.concat(b, F.lit("/__init__.py")), F.concat(b, F.lit(".py")))))
    one = named.withColumns({"_forms": forms, "_dots": dots}).withColumn("specifier", F.when(name.isNotNull(), F.concat(spec, F.lit(":"), name)).otherwise(spec))
    found = _first_existing(one, F.col("_forms"), files)
    top = F.regexp_extract("specifier", r"^([^.:]+)", 1)
    own = files.select(F.explode(F.array(*(F.regexp_extract("path", rf"^{r + '/' if r else ''}([^/]+?)(?:\.py$|/)", 1) for r in roots))).alias("_top")).where("_top <> ''").distinct().withColumn("_own", F.lit(True))
    joined = found.withColumn("_top", top).join(own, "_top", "left")
    outside = F.col("to_").isNull() & (F.col("_dots") == 0) & F.col("_own").isNull()
    return joined.select(
        F.col("path").alias("from_"), "to_", F.lit(None).cast("string").alias("workspace"), F.when(outside, F.col("_top")).alias("package"), F.when(outside, F.col("_top").isin(*sorted(sys.stdlib_module_names))).alias("builtin"),
        F.regexp_replace("specifier", ":.*$", "").alias("specifier"), "kind", "line", F.lit("python").alias("analyzer"), (F.col("to_").isNull() & ~outside).alias("unresolved"),
    ).distinct()


def resolve_cargo(imports: DataFrame, manifests: DataFrame) -> DataFrame:
    """Edges of Cargo imports: a crate of manifests(path, text) by its package name, else a package from outside."""
    name = F.regexp_extract("text", r'(?m)^\[package\][^\[]*?^name\s*=\s*"([^"]+)"', 1)
    crates = manifests.select(name.alias("specifier"), F.col("path").alias("to_")).where("specifier <> ''").groupBy("specifier").agg(F.min("to_").alias("to_"))
    found = imports.where("kind <> 'error'").join(crates, "specifier", "left")
    return found.select(F.col("path").alias("from_"), "to_", F.lit(None).cast("string").alias("workspace"), F.when(F.col("to_").isNull(), F.col("specifier")).alias("package"), F.when(F.col("to_").isNull(), F.lit(False)).alias("builtin"), "specifier", "kind", "line", F.lit("cargo").alias("analyzer"), F.lit(False).alias("unresolved"))

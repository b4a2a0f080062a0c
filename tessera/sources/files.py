"""Source files, their text and facts, as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.globs import glob_match, to_regex
from ..functions.hashing import content_id

#: Folders that no analysis looks into.
EXCLUDED = (
    "**/node_modules/**", "**/dist/**", "**/build/**", "**/.next/**", "**/out/**", "**/coverage/**", "**/vendor/**", "**/.venv/**", "**/venv/**", "**/__pycache__/**", "**/.tox/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.ruff_cache/**", "**/.eggs/**", "**/*.egg-info/**", "**/site-packages/**", "**/*.d.ts", "**/*.min.js",
)

#: Languages and their file extensions.
EXTENSIONS = {
    "c": ("c", "h"), "clojure": ("clj", "cljs", "cljc"), "cpp": ("cc", "cpp", "cxx", "hh", "hpp", "hxx"), "csharp": ("cs",), "dart": ("dart",), "elixir": ("ex", "exs"), "erlang": ("erl",), "fsharp": ("fs",), "go": ("go",), "haskell": ("hs",), "java": ("java",), "javascript": ("js", "jsx", "mjs", "cjs"), "julia": ("jl",), "kotlin": ("kt", "kts"), "lua": ("lua",), "objc": ("m", "mm"), "ocaml": ("ml", "mli"), "php": ("php",), "python": ("py", "pyi"), "ruby": ("rb",), "rust": ("rs",), "scala": ("scala",), "svelte": ("svelte",), "swift": ("swift",), "typescript": ("ts", "tsx", "mts", "cts"), "vue": ("vue",), "zig": ("zig",),
}
LANGUAGES = {e: language for language, ends in EXTENSIONS.items() for e in ends}
ANALYZED = ("typescript", "javascript", "python")


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), text, stamp and content_id of the text files below a folder of any store Spark reads.

    Files with a NUL among their first 8000 bytes are binary and left out; .git and node_modules aren't looked into.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    relative = F.expr("substring(path, instr(path, :top) + length(:top))".replace(":top", "'" + top.replace("'", "\\'") + "'"))
    text = F.decode("content", "UTF-8")
    binary = F.hex(F.substring("content", 1, 8000)).rlike("^(..)*00")
    kept = raw.withColumn("path", relative).where(~glob_match(F.col("path"), ["**/.git/**", "**/node_modules/**"]) & ~binary)
    return kept.select("path", text.alias("text"), F.concat_ws(":", F.col("length").cast("string"), F.unix_millis("modificationTime").cast("string")).alias("stamp"), content_id(text).alias("content_id"))


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(names, extension)


def source_files(files: DataFrame, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """files(path, text, ...) of a known language that include takes and neither exclude nor EXCLUDED does, with language and loc (lines that aren't blank)."""
    path = F.col("path")
    loc = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"\S")))
    return files.where(glob_match(path, include) & ~glob_match(path, (*EXCLUDED, *exclude))).withColumn("language", language_of(path)).where("language is not null").withColumn("loc", loc)


def not_analyzed(files: DataFrame) -> DataFrame:
    """language and files of source files that no analyzer reads."""
    return files.where(~F.col("language").isin(*ANALYZED)).groupBy("language").agg(F.count("*").alias("files"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """path and deleted of files(path, content_id) that differ between two versions; a rename is a deletion and an addition."""
    both = base.select("path", F.col("content_id").alias("old")).join(head.select("path", F.col("content_id").alias("new")), "path", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", F.col("new").isNull().alias("deleted"))


def patch_paths(patches: DataFrame) -> DataFrame:
    """id, path and deleted for the files that patches(id, text) add, update, delete or move; of several headers for a path the last one holds."""
    line = patches.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    header = r"^\*\*\* (Add File|Update File|Delete File|Move to): (.+?)\s*$"
    said = line.select("id", "pos", F.regexp_extract("line", header, 1).alias("what"), F.regexp_extract("line", header, 2).alias("path")).where("what <> ''")
    said = said.withColumn("moved", F.lead("what").over(W.partitionBy("id").orderBy("pos")) == "Move to")
    state = F.when(F.col("what") == "Delete File", True).when((F.col("what") == "Update File") & F.coalesce("moved", F.lit(False)), True).otherwise(False)
    return said.groupBy("id", "path").agg(F.max_by(state, "pos").alias("deleted"))


def workspace_patterns(root: str | None, pnpm: str | None = None) -> tuple[list[str], list[str]]:
    """The folders that the root's package.json (workspaces, a list or its packages) and pnpm-workspace.yaml (packages) name as packages, and those they except with !."""
    said: list = []
    try:
        given = json.loads(root or "{}").get("workspaces")
        said += (given.get("packages") if isinstance(given, dict) else given) or []
    except (ValueError, AttributeError):
        pass
    block = re.search(r"(?m)^packages:[ \t]*(\[[^\]]*\]|(?:\r?\n[ \t]*(?:-.*|#.*)?)+)", pnpm or "")
    if block:
        said += [x.group(1) or x.group(2) or x.group(3) for x in re.finditer(r"""(?:-|[\[,])[ \t]*(?:"([^"]*)"|'([^']*)'|([^\s,\]#"']+))""", block.group(1))]
    clean = lambda x: re.sub(r"^(?:\./)+|/+$", "", x.strip())
    texts = [x for x in said if isinstance(x, str)]
    return [p for x in texts if not x.startswith("!") and (p := clean(x))], [p for x in texts if x.startswith("!") and (p := clean(x[1:]))]


def workspaces(manifests: DataFrame) -> DataFrame:
    """name and dir of the packages of a repository. manifests(path, text): its package.json files and pnpm-workspace.yaml.

    Packages are the folders that the root's patterns take and no pattern with ! excepts, with a named package.json of
    their own; the root isn't one, nor is anything in node_modules. Only the two files of the root reach the driver.
    """
    root = {r.path: r.text for r in manifests.where(F.col("path").isin("package.json", "pnpm-workspace.yaml")).select("path", "text").collect()}
    taken, excepted = workspace_patterns(root.get("package.json"), root.get("pnpm-workspace.yaml"))
    matches = lambda globs: F.lit(False) if not globs else F.col("dir").rlike("^(?s:" + "|".join(map(to_regex, globs)) + ")$")
    own = manifests.where(F.endswith("path", F.lit("/package.json"))).select(F.get_json_object("text", "$.name").alias("name"), F.regexp_replace("path", "/package\\.json$", "").alias("dir"))
    return own.where(~F.array_contains(F.split("dir", "/"), "node_modules") & matches(taken) & ~matches(excepted) & (F.coalesce("name", F.lit("")) != ""))

"""Proposals for a code base without a contract: components from its layout, layers from their names and dependencies, quoted guardrails."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..scratch import settle
from .graph import heights
from .mapping import innermost_workspace

#: Tests and fixtures, which a first map leaves out.
TESTS = ("**/*.test.*", "**/*.spec.*", "**/__tests__/**", "**/__mocks__/**", "**/test/**", "**/tests/**", "**/Tests/**", "**/e2e/**", "**/fixtures/**", "**/Fixtures/**")
#: Folders that hold one unit for each child.
CONTAINERS = ("apps", "components", "crates", "domains", "features", "libs", "modules", "packages", "plugins", "services", "sources", "targets")
#: The ends of component names and the folders that stand for a layer, the top layer first.
SUFFIX_TIERS = (("adapter", "adapters", "infrastructure", "ui"), ("feature", "features", "application"), ("core", "domain"))
FOLDER_TIERS = (("adapters", "adapter", "infrastructure", "infra", "presentation"), ("application", "usecases", "use_cases", "use-cases", "features", "feature"), ("domain", "core"))
#: Files that state rules for contributors and agents, folders whose documents do if named after structure, and scripts that check it.
GUIDES = ("agents.md", "claude.md", "contributing.md", "architecture.md")
GUIDE_FOLDERS = ("doc", "docs", ".github")
GUIDE_WORDS = ("architecture", "boundar", "layer", "convention", "guideline")
SCRIPT_WORDS = ("boundar", "layer", "architecture", "importlint", "import-lint", "import_lint", "dependencycheck", "dependency-check", "dependency_check", "checkimports", "check-imports", "check_imports")
SCRIPT_ENDS = (".py", ".sh", ".ts", ".js", ".mjs", ".rb")
#: What a line forbids with, what it then forbids, and the beginnings of words that a checking script forbids with.
FORBIDDING = ("never", "must not", "mustn't", "do not", "don't", "may not", "cannot", "can't", "only", "forbidden", "not allowed")
FORBIDDEN = ("import", "depend", "call", "reference", "reach into")
SCRIPT_FORBIDDING = ("forbid", "disallow", "not allowed", "must not", "boundar", "layer")


def _folders(files: DataFrame) -> DataFrame:
    """folder, direct (holds files itself), subs and only (a subfolder) of every folder with files(path) below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder"), F.when(k < F.size(parts) - 1, F.element_at(parts, (k + 1).cast("int"))).alias("child")))
    each = files.where(F.size(parts) > 1).select(F.explode(above).alias("f")).select("f.*")
    return each.groupBy("folder").agg(F.max(F.col("child").isNull()).alias("direct"), F.count_distinct("child").alias("subs"), F.max("child").alias("only"))


def source_root(files: DataFrame, share: float = 0.8, depth: int = 3) -> str:
    """The folder, depth levels down at most, that holds at least the share of the files above it and two subfolders; without a slash at its end."""
    root = ""
    for _ in range(depth):
        rest = F.split(F.col("path").substr(F.lit(len(root) + 1), F.length("path")), "/")
        below = files.where(F.col("path").startswith(root)).select(F.when(F.size(rest) > 1, rest[0]).alias("top"), F.when(F.size(rest) > 2, rest[1]).alias("sub"))
        best = below.groupBy("top").agg(F.count("*").alias("n"), F.count_distinct("sub").alias("subs")).withColumn("all", F.sum("n").over(W.partitionBy())).where("top is not null").orderBy(F.desc("n"), "top").first()  # a row for each folder of one level
        if best is None or best["n"] < share * best["all"] or best.subs < 2:
            break
        root += best.top + "/"
    return root.removesuffix("/")


def infer_components(files: DataFrame, packages: DataFrame | None = None, share: float = 0.8, depth: int = 3) -> DataFrame:
    """ord, id, folder and files of proposed components of files(path); tests and fixtures don't count.

    First the packages(name, dir) that hold files, then of the other files one component for each folder of the source
    root (see source_root), for the root's own files, and for each other folder at the top. A folder that only wraps
    another gives way to it, and the children of a container within three levels are components of their own, before
    what holds them. A file belongs to the innermost.
    """
    spark = files.sparkSession
    own = files.where(~glob_match(F.col("path"), TESTS)).select("path")
    packages = (spark.createDataFrame([], "name string, dir string") if packages is None else packages).where("dir <> ''").select("name", "dir")
    owned = settle(innermost_workspace(own, packages), "infer-files")
    used = owned.join(packages.select(F.col("name").alias("owner_workspace"), "dir"), "owner_workspace").select("dir", "owner_workspace").distinct()
    made = [used.select(F.lit(0).alias("stage"), F.lit("").alias("top"), F.lit(False).alias("last"), F.regexp_replace("owner_workspace", "^@[^/]+/", "").alias("name"), F.col("dir").alias("folder"))]

    loose = owned.where("owner_workspace is null").select("path")
    root = source_root(loose, share, depth)
    inside = F.col("folder").startswith(root + "/") if root else F.lit(True)
    level = F.size(F.split("folder", "/"))
    folders = settle(_folders(loose), "infer-folders")
    at = root.count("/") + 1 if root else 0
    beside = folders.where(~inside & (level == 1)).join(loose.where(~F.col("path").startswith(root + "/")).select(F.split("path", "/")[0].alias("folder")).distinct(), "folder", "left_semi")
    tops = folders.where(inside & (level == at + 1)).union(beside).select(F.when(inside, 1).otherwise(3).alias("stage"), F.col("folder").alias("top"), F.col("folder").alias("dir"))
    for _ in range(4):  # through folders that only wrap one
        one = tops.join(folders.withColumnRenamed("folder", "dir"), "dir")
        tops = one.select("stage", "top", F.when(~F.col("direct") & (F.col("subs") == 1), F.concat_ws("/", "dir", "only")).otherwise(F.col("dir")).alias("dir"))
    tops = settle(tops, "infer-tops")
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    holds = folders.where(F.lower(base("folder")).isin(*CONTAINERS) & (F.col("subs") >= 2)).select(F.col("folder").alias("container"))
    near = tops.join(holds, (F.col("container") == F.col("dir")) | F.col("container").startswith(F.concat("dir", F.lit("/"))))  # folders of a tree, in pairs of one below the other
    far = F.size(F.split("container", "/")) - F.size(F.split("dir", "/"))
    near = near.withColumn("far", far).where("far <= 3")
    outer = near.select(F.col("dir").alias("d"), F.col("container").alias("outer"))
    first = near.join(outer, (F.col("d") == F.col("dir")) & F.col("container").startswith(F.concat("outer", F.lit("/"))), "left_anti")
    children = first.join(folders.select("folder", F.regexp_extract("folder", "^(.*)/[^/]+$", 1).alias("container")), "container")
    made.append(children.select("stage", "top", F.lit(False), base("folder"), "folder"))
    split = first.where("far = 0").select("dir").distinct().withColumn("split", F.lit(True))
    rest = tops.join(split, "dir", "left").join(folders.select(F.col("folder").alias("dir"), "direct"), "dir").where("split is null or direct")
    made.append(rest.select("stage", "top", F.lit(True), base("top"), "dir"))
    if root:
        made.append(folders.where((F.col("folder") == root) & F.col("direct")).select(F.lit(2), F.lit(""), F.lit(True), base("folder"), "folder"))

    once = F.row_number().over(W.partitionBy("folder").orderBy("stage", "top", "last"))
    units = reduce(DataFrame.union, made).withColumn("once", once).where("once = 1").withColumn("ord", F.row_number().over(W.orderBy("stage", "top", "last", F.concat("folder", F.lit("/\uffff")))))  # a row for each component
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("name"), "^[.]", "dot-"), "[^a-z0-9._-]+", "-"), "^[^a-z0-9]+", ""), "-+$", "")
    again = F.row_number().over(W.partitionBy("base").orderBy("ord"))
    named = units.withColumn("base", F.when(clean == "", "component").otherwise(clean)).withColumn("nth", again).withColumn("id", F.when(F.col("nth") > 1, F.concat("base", F.lit("-"), F.col("nth").cast("string"))).otherwise(F.col("base")))
    named = settle(named.select("ord", "id", "folder"), "infer-units")
    held = innermost_workspace(own, named.select(F.col("id").alias("name"), F.col("folder").alias("dir"))).where("owner_workspace is not null").groupBy(F.col("owner_workspace").alias("id")).agg(F.count("*").alias("files"))
    return named.join(held, "id", "left").select("ord", "id", "folder", F.coalesce("files", F.lit(0).cast("long")).alias("files"))


def inferred_layers(graph: DataFrame) -> DataFrame:
    """node and height of connected components, the highest first: what depends on others stands above them."""
    return heights(graph.select(F.col("from_c").alias("a"), F.col("to_c").alias("b"))).orderBy(F.desc("height"), "node")


def _tier(word: Column, tiers: tuple[tuple[str, ...], ...]) -> Column:
    return F.coalesce(*(F.when(word.isin(*names), k) for k, names in enumerate(tiers)))


def layer_names(components: DataFrame, least: int = 3) -> DataFrame:
    """tier (0 is the top) and ids of components(id, name) whose names, as written, end in a layer's word after a separator
    or at a capital (chat-core, ChatCore, not score); none if fewer than least components or two tiers are named."""
    last = F.regexp_extract("name", "(?:[-_.]|(?=[A-Z]))([A-Za-z]+)$", 1)  # the longest such end; shorter ones begin at its last capital
    short = F.regexp_extract("name", "([A-Z][a-z]*)$", 1)
    inside = lambda c: F.when(F.length(c) < F.length("name"), F.lower(c))
    named = components.withColumn("tier", F.coalesce(_tier(inside(last), SUFFIX_TIERS), _tier(inside(short), SUFFIX_TIERS))).where("tier is not null")
    total = named.agg(F.count("*").alias("n"), F.count_distinct("tier").alias("tiers"))
    return named.crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("tiers") >= 2)).groupBy("tier").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # total: one row


def layer_folders(files: DataFrame, least: int = 2) -> DataFrame:
    """tier (0 is the top) and selectors of the layer folders that files(path, component) lie in, if at least so many components have
    folders of two tiers each."""
    found = files.where("component is not null").select("component", F.explode(F.slice(F.reverse(F.split("path", "/")), 2, 1000)).alias("word")).distinct()
    found = found.withColumn("tier", _tier(F.lower("word"), FOLDER_TIERS)).where("tier is not null")
    layered = found.groupBy("component").agg(F.count_distinct("tier").alias("tiers")).where("tiers >= 2").agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(layered)).where(F.col("n") >= least).groupBy("tier").agg(F.transform(F.array_sort(F.collect_set("word")), lambda w: F.concat(F.lit("path:**/"), w, F.lit("/**"))).alias("selectors"))  # layered: one row


def _says(text: Column, words: tuple[str, ...], whole: bool) -> Column:
    return text.rlike(rf"(?i)\b(?:{'|'.join(map(re.escape, words))}){r'\b' if whole else ''}")


def guardrails(files: DataFrame, by_file: int = 5, total: int = 15, managed: tuple[str, str] | None = None, left_out: tuple[str, ...] = ()) -> DataFrame:
    """file, line, text and note of lines that restrict imports or dependencies: of guides for contributors and agents, of
    documents on structure, and of scripts that check it; in the order of paths, of a file the first few different ones.

    managed: the lines that open and close a block which a tool keeps up, left out. left_out: folders that don't count.
    """
    path, name = F.lower("path"), F.lower(F.regexp_extract("path", "([^/]+)$", 1))
    holds = lambda words: F.greatest(*(F.contains(name, F.lit(w)) for w in words))
    document = F.split(path, "/")[0].isin(*GUIDE_FOLDERS) & F.contains(path, F.lit("/")) & F.endswith(name, F.lit(".md")) & holds(GUIDE_WORDS)
    script = holds(SCRIPT_WORDS) & F.greatest(*(F.endswith(name, F.lit(e)) for e in SCRIPT_ENDS))
    counted = ~F.arrays_overlap(F.split("path", "/"), F.array(F.lit("node_modules"), *map(F.lit, left_out)))
    given = files.where(counted & (name.isin(*GUIDES) | document | script)).select(F.col("path").alias("file"), script.alias("script"), F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw"))
    lines = given.select("file", "script", (F.col("at") + 1).alias("line"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("text"))
    if managed:
        mark = F.when(F.col("text").isin(*managed), F.col("text"))
        lines = lines.withColumn("_in", F.last(mark, True).over(W.partitionBy("file").orderBy("line"))).where(F.col("script") | ~F.col("_in").eqNullSafe(managed[0])).drop("_in")
    after = F.regexp_extract("text", rf"(?i)\b(?:{'|'.join(map(re.escape, FORBIDDING))})\b(.*)", 1)
    said = F.when(F.col("script"), _says(F.col("text"), SCRIPT_FORBIDDING, False)).otherwise(_says(after, FORBIDDEN, False))
    kept = lines.where(said & F.length("text").between(12, 300)).groupBy("file", "script", "text").agg(F.min("line").alias("line"))
    few = kept.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy("line"))).where(F.col("_n") <= by_file)
    note = F.when(F.col("script"), F.concat(F.lit("boundary check script "), F.regexp_extract("file", "([^/]+)$", 1)))
    return few.select("file", "line", "text", note.alias("note")).orderBy("file", "line").limit(total)

"""Specifier patterns with one star: path mappings of compiler settings, subpath imports and exports of packages, by equality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import normalized

#: Conditions of a package's imports and exports, in the order in which they count.
CONDITIONS = ("types", "bun", "import", "module", "node", "require", "default")
PATTERNS = "kind string, scope string, nth int, pattern string, targets array<string>"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _below(*parts: Column) -> Column:
    """Parts of a path put together; a star in it stays."""
    return normalized(F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts)))


def _entries(json: Column, at: str) -> Column:
    """The fields of an object in a JSON text, in order, as structs of key and variant; null where there is none."""
    return F.try_variant_get(F.try_parse_json(json), at, "map<string,variant>")


def path_mappings(files: DataFrame) -> DataFrame:
    """Patterns of the mappings (compilerOptions.paths) of compiler settings among files(path, text), for the files of their folder. Comments are allowed; settings that aren't JSON have none."""
    plain = F.regexp_replace(F.regexp_replace("text", r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1"), r",(\s*[}\]])", "$1")
    own = files.where(F.col("path").rlike(r"(^|/)(tsconfig[^/]*|jsconfig)\.json$") & ~F.col("path").rlike(r"(^|/)node_modules/"))
    read = own.select("path", F.from_json(plain, "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>").alias("j"))
    each = read.select(_folder(F.col("path")).alias("scope"), F.coalesce("j.compilerOptions.baseUrl", F.lit("")).alias("base"), F.posexplode("j.compilerOptions.paths").alias("nth", "pattern", "to"))
    return each.select(F.lit("paths").alias("kind"), "scope", F.col("nth").cast("int"), "pattern", F.array_compact(F.transform("to", lambda t: _below(F.col("scope"), F.col("base"), t))).alias("targets"))


def _targets(value: Column) -> Column:
    """Targets of an entry: a path, a list of them, or an object of conditions, by their order; one level of conditions in a condition is read."""
    text = lambda v, at="$": F.when(F.schema_of_variant(F.try_variant_get(v, at, "variant")) == "STRING", F.array(F.try_variant_get(v, at, "string")))
    of = [F.coalesce(text(value, f"$.{c}"), F.flatten(F.array_compact(F.array(*(text(value, f"$.{c}.{d}") for d in CONDITIONS))))) for c in CONDITIONS]
    listed = F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.try_variant_get(value, "$", "array<string>"))
    return F.coalesce(text(value), listed, F.flatten(F.array_compact(F.array(*of))))


def package_patterns(files: DataFrame) -> DataFrame:
    """Patterns of the subpath imports (#...) of package.json files, for the files of their folder, and of the exports of named ones, for all files: the name with the subpath."""
    own = files.where(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").rlike(r"(^|/)node_modules/")).select(_folder(F.col("path")).alias("dir"), "text")
    inside = lambda: F.array_compact(F.transform(_targets(F.col("v")), lambda t: _below(F.col("dir"), F.when(F.startswith(t, F.lit("./")), t))))
    imports = own.select("dir", F.posexplode(_entries(F.col("text"), "$.imports")).alias("nth", "pattern", "v")).where(F.startswith("pattern", F.lit("#")))
    imports = imports.select(F.lit("imports").alias("kind"), F.col("dir").alias("scope"), F.col("nth").cast("int"), "pattern", inside().alias("targets"))
    parsed = F.try_parse_json("text")
    whole = F.try_variant_get(parsed, "$.exports", "variant")
    named = own.select("dir", "text", F.try_variant_get(parsed, "$.name", "string").alias("name"), whole.alias("v")).where("name is not null and v is not null")
    subpaths = _entries(F.col("text"), "$.exports")
    by_path = F.coalesce(F.exists(F.map_keys(subpaths), lambda k: F.startswith(k, F.lit("."))), F.lit(False))
    one = named.where(~by_path).select("dir", F.lit(0).alias("nth"), F.col("name").alias("pattern"), "v")
    many = named.where(by_path).select("dir", "name", F.posexplode(subpaths).alias("nth", "key", "v")).select("dir", "nth", F.concat("name", F.substring("key", 2, 2**31 - 1)).alias("pattern"), "v")
    exports = one.union(many).select(F.lit("exports").alias("kind"), F.lit("").alias("scope"), F.col("nth").cast("int"), "pattern", inside().alias("targets"))
    return imports.union(exports)


def mapped(imports: DataFrame, patterns: DataFrame) -> DataFrame:
    """imports(path, specifier, ...) with stems: where the best pattern leads, its targets in order with the star's text in them; null without one. named: whether it is a mapping that doesn't start with its star, so that a miss is no package.

    Of each kind the patterns of the innermost folder that has any count. A pattern without a star comes before those with
    one, then the longest part before the star, then (of packages) the longer one, then the one listed first; kinds in the order paths, imports, exports.
    Every start of a specifier is a key, so that the longest is found by an equality join; what stands behind the star is
    tested on what meets.
    """
    star = F.instr("pattern", "*")
    held = patterns.withColumns({"start": F.when(star > 0, F.substring("pattern", F.lit(1), star - 1)).otherwise(F.col("pattern")), "behind": F.when(star > 0, F.substring("pattern", star + 1, F.length("pattern")))})
    asks = imports.select("path", "specifier").where(~F.col("specifier").rlike(r"^\.{0,2}(/|$)")).distinct()
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    folders = asks.select("path", F.posexplode(above).alias("depth", "scope")).distinct().join(held.select("kind", "scope").distinct(), "scope")
    nearest = asks.join(folders.groupBy("path", "kind").agg(F.max_by("scope", "depth").alias("scope")), "path")
    keys = nearest.select("kind", "scope", "specifier").distinct().withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda k: F.substring(F.col("specifier"), F.lit(1), k))))
    met = keys.join(held, ["kind", "scope", "start"])
    exact = F.col("behind").isNull()
    fits = F.when(exact, F.col("start") == F.col("specifier")).otherwise((F.length("specifier") >= F.length("start") + F.length("behind")) & F.endswith("specifier", F.col("behind")))
    text = F.substring(F.col("specifier"), F.length("start") + 1, F.length("specifier") - F.length("start") - F.length("behind"))
    longer = F.when(F.col("kind") == "paths", 0).otherwise(-F.length("pattern"))  # of one start; mappings go by their order
    rank = F.struct(F.when(exact, 0).otherwise(1).alias("exact"), (-F.length("start")).alias("length"), longer.alias("longer"), "nth")
    stems = F.when(exact, F.col("targets")).otherwise(F.transform("targets", lambda t: F.replace(t, F.lit("*"), text)))
    best = met.where(fits).groupBy("kind", "scope", "specifier").agg(F.min_by(F.struct(stems.alias("stems"), ((F.col("kind") == "paths") & ~F.startswith("pattern", F.lit("*"))).alias("named")), rank).alias("b")).select("kind", "scope", "specifier", "b.*")
    order = F.when(F.col("kind") == "paths", 0).when(F.col("kind") == "imports", 1).otherwise(2)
    of = nearest.join(best, ["kind", "scope", "specifier"]).where(F.size("stems") > 0).groupBy("path", "specifier").agg(F.min_by("stems", order).alias("stems"), F.max("named").alias("named"))
    return imports.join(of, ["path", "specifier"], "left")

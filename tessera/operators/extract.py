"""Imports, exports and write sites of source texts, with regular expressions in the JVM and, for Python files, its own parser."""

from __future__ import annotations

import ast
import re
import tomllib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Resource

IMPORTS = "path string, specifier string, kind string, line int, names array<string>"

_QUOTED = r"""["']([^"'\n]+)["']"""
#: Statement forms, by the kind of edge they make; the last group is the module.
_FORMS = (
    ("type", rf"(?m)^[ \t]*(?:import|export)\s+type\s[^;'\"]*?from\s*{_QUOTED}"),
    ("reexport", rf"(?m)^[ \t]*export\s+(?!type\s)(?:\*|\{{)[^;'\"]*?from\s*{_QUOTED}"),
    ("static", rf"(?m)^[ \t]*import\s+(?!type\s)[^;'\"(]*?from\s*{_QUOTED}"),
    ("side-effect", rf"(?m)^[ \t]*import\s*{_QUOTED}"),
    ("require", rf"(?<![\w.])require\s*\(\s*{_QUOTED}\s*\)"),
    ("dynamic", rf"(?<![\w.])import\s*\(\s*{_QUOTED}\s*\)"),
)


def without_comments(text: Column) -> Column:
    """Comments blanked; their line breaks stay, so that places keep their lines. Comment marks within quotes stay."""
    line = F.regexp_replace(text, r"""(?m)(^|[^:"'`\\/])//(?![^\n]*["'`][ \t]*[;,)]*[ \t]*$)[^\n]*$""", "$1")
    block = F.transform(F.split(line, r"/\*"), lambda part, k: F.when((k > 0) & part.contains("*/"), F.concat(F.regexp_replace(F.substring_index(part, "*/", 1), r"[^\n]", ""), F.regexp_replace(part, r"(?s)^.*?\*/", ""))).otherwise(part))
    return F.array_join(block, "")


def script_imports(files: DataFrame) -> DataFrame:
    """IMPORTS of TypeScript and JavaScript files(path, text)."""
    text = without_comments(F.col("text"))
    found = F.flatten(F.array(*(_form(text, kind, form) for kind, form in _FORMS)))
    rows = files.withColumn("_text", text).select("path", "_text", F.explode(found).alias("m"))
    module = F.regexp_extract("m.statement", r"""["']([^"'\n]+)["']\s*\)?$""", 1)
    before = F.call_function("substring_index", F.col("_text"), F.col("m.statement"), F.lit(1))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    line = breaks(before) + breaks(F.regexp_extract("m.statement", r"^(\s*)", 1)) + 1
    names = F.filter(F.transform(F.split(F.regexp_extract("m.statement", r"\{([^}]*)\}", 1), ","), lambda x: F.regexp_extract(x, r"([\w$]+)", 1)), lambda x: x != "")
    return rows.select("path", module.alias("specifier"), F.col("m.kind").alias("kind"), line.cast("int").alias("line"), names.alias("names")).distinct()


def _form(text: Column, kind: str, form: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({form})"), 1), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("statement")))


def script_exports(files: DataFrame) -> DataFrame:
    """file, name, signature, target, original of the declarations and named re-exports of script files; signatures end before the body."""
    text = without_comments(F.col("text"))
    declared = r"(?m)^[ \t]*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|const|let|var|interface|type|enum|namespace)\s+[\w$]+[^{;=\n]*"
    own = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(text, F.lit(f"({declared})"), 1)).alias("signature"))
    name = F.when(F.col("signature").rlike(r"export\s+default\s"), F.lit("default")).otherwise(F.regexp_extract("signature", r"(?:function\*?|class|const|let|var|interface|type|enum|namespace)\s+([\w$]+)", 1))
    own = own.select("file", name.alias("name"), F.trim("signature").alias("signature"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("original"))
    listed = r"(?m)^[ \t]*export\s+(?:type\s+)?\{[^}]*\}(?:\s*from\s*[\"'][^\"']+[\"'])?"
    lists = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all(text, F.lit(f"({listed})"), 1)).alias("s"))
    part = lists.select("file", F.nullif(F.regexp_extract("s", r"""from\s*["']([^"']+)["']""", 1), F.lit("")).alias("target"), F.explode(F.split(F.regexp_extract("s", r"\{([^}]*)\}", 1), ",")).alias("x"))
    original, alias = F.regexp_extract("x", r"^\s*(?:type\s+)?([\w$]+)", 1), F.regexp_extract("x", r"\bas\s+([\w$]+)", 1)
    return own.union(part.where(original != "").select("file", F.coalesce(F.nullif(alias, F.lit("")), original).alias("name"), F.trim("x").alias("signature"), "target", original.alias("original")))


def _python(text: str) -> list[tuple]:
    out = []

    def visit(node: ast.AST, typed: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.Import):
                out.extend((a.name, "type" if typed else "static", child.lineno, []) for a in child.names)
            elif isinstance(child, ast.ImportFrom) and child.module != "__future__":
                out.append(("." * child.level + (child.module or ""), "type" if typed else "static", child.lineno, [a.name for a in child.names]))
            elif isinstance(child, ast.Call) and child.args and isinstance(child.args[0], ast.Constant) and isinstance(child.args[0].value, str) and ast.unparse(child.func) in ("importlib.import_module", "import_module", "__import__"):
                out.append((child.args[0].value, "dynamic", child.lineno, []))
            if isinstance(child, ast.If) and ast.unparse(child.test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING"):
                for part in child.body:
                    visit(ast.Module([part], []), True)
                for part in child.orelse:
                    visit(ast.Module([part], []), typed)
            else:
                visit(child, typed)

    visit(ast.parse(text), False)
    return out


def python_imports(files: DataFrame) -> DataFrame:
    """IMPORTS of Python files(path, text) and, for a file that doesn't parse, one row with the kind error and the message as specifier."""

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    rows += [(path, *r) for r in _python(text or "")]
                except (SyntaxError, ValueError) as e:
                    rows.append((path, str(e), "error", getattr(e, "lineno", 0) or 0, []))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "specifier", "kind", "line", "names"])

    return files.select("path", "text").mapInArrow(run, IMPORTS)


#: The client methods that the documentation of Prisma lists as writes, and the queryset methods that Django's lists.
PRISMA_WRITES = ("create", "createMany", "createManyAndReturn", "update", "updateMany", "updateManyAndReturn", "upsert", "delete", "deleteMany")
DJANGO_WRITES = ("create", "bulk_create", "update", "bulk_update", "update_or_create", "get_or_create", "delete")
#: Statements of SQL that name the table they write right after these words; an update is one only with its set.
SQL_WRITES = ("insert into", "insert or abort into", "insert or fail into", "insert or ignore into", "insert or replace into", "insert or rollback into", "delete from", "merge into", "truncate", "truncate table")
#: Verbs that query builders share.
BUILDER_WRITES = ("insert", "update", "delete")


def _calls(line: Column) -> Column:
    """The calls of a line, nested ones too: the parts of the name called (the first is empty where the call goes on a chain) and the start of the first argument."""
    call = F.lit(r"([\w$.]+)\s*\((?=\s*([^(),]*))")
    pairs = F.arrays_zip(F.regexp_extract_all(line, call, 1).alias("name"), F.regexp_extract_all(line, call, 2).alias("first"))
    return F.transform(pairs, lambda c: F.struct(F.split(c["name"], r"\.").alias("name"), F.trim(c["first"]).alias("first")))


def _end(parts: Column, k: int) -> Column:
    return F.try_element_at(parts, F.lit(-k))


def _prisma(line: Column, model: str) -> Column:
    """<client>.<model>.<write>(...), where the client's property begins with a small letter."""
    of = (model[0].lower() + model[1:], model[0].upper() + model[1:])
    return F.exists(_calls(line), lambda c: (F.size(c["name"]) > 2) & _end(c["name"], 2).isin(*of) & _end(c["name"], 1).isin(*PRISMA_WRITES))


def _drizzle(line: Column, table: str) -> Column:
    """<database>.<verb>(<table>), the table perhaps as a member of its schema."""
    return F.exists(_calls(line), lambda c: (F.size(c["name"]) > 1) & _end(c["name"], 1).isin(*BUILDER_WRITES) & (F.substring_index(c["first"], ".", -1) == table))


def _sqlalchemy(line: Column, model: str) -> Column:
    """<verb>(<model>), session.add(<model>(...)) or merge, and <model>.__table__.<verb>()."""

    def write(c: Column) -> Column:
        verb, on = _end(c["name"], 1), _end(c["name"], 2)
        built = verb.isin(*BUILDER_WRITES) & ((c["first"] == model) | ((on == "__table__") & (_end(c["name"], 3) == model)))
        return F.coalesce(built, F.lit(False)) | F.coalesce(verb.isin("add", "merge") & (on == "session") & (c["first"] == model), F.lit(False))

    return F.exists(_calls(line), write)


def _django(line: Column, model: str) -> Column:
    """A write on <model>.objects, at once or later in the chain."""
    calls = _calls(line)
    write = lambda c: _end(c["name"], 1).isin(*DJANGO_WRITES)
    manager = lambda c: F.contains(F.concat(F.lit("."), F.array_join(c["name"], ".")), F.lit(f".{model}.objects."))
    return F.exists(calls, lambda c: manager(c) & write(c)) | (F.exists(calls, manager) & F.exists(calls, lambda c: (c["name"][0] == "") & write(c)))


def _convex(line: Column, table: str) -> Column:
    """ctx.db.<verb>("<table>", ...); all but insert also take an id alone, which is then named after the row: messageId, message._id."""
    rows = {table.lower(), table.lower().removesuffix("s")} - {""}

    def write(c: Column) -> Column:
        verb, first = _end(c["name"], 1), c["first"]
        named = F.regexp_extract(first, "^([\"'`])(.*)\\1$", 2) == table
        path = F.split(F.lower(first), r"\.")
        own = _end(path, 1).isin(*(f"{r}id" for r in rows)) | (_end(path, 1).isin("id", "_id") & F.coalesce(_end(path, 2).isin(*rows), F.lit(False)))
        on = (_end(c["name"], 3) == "ctx") & (_end(c["name"], 2) == "db")
        return F.coalesce(on & ((verb.isin("insert", "patch", "replace", "delete") & named) | (verb.isin("patch", "replace", "delete") & own)), F.lit(False))

    return F.exists(_calls(line), write)


def _sql(line: Column, table: str) -> Column:
    """A statement that writes the table, with or without its schema; quotes and brackets around names don't matter."""
    plain = F.regexp_replace(F.lower(line), r'[\s"`\[\]\\]+', " ")
    name = rf"(?:[\w$]+ ?\. ?)?{re.escape(table.lower())}(?![\w$])"
    return plain.rlike(rf"\b(?:{'|'.join(SQL_WRITES)}) {name}") | plain.rlike(rf"\bupdate {name} (?:(?:as )?\w+ )?set\b")


LIBRARIES = {"prisma": _prisma, "drizzle": _drizzle, "sqlalchemy": _sqlalchemy, "django": _django, "convex": _convex, "sql": _sql}


def writes(line: Column, pattern: str) -> Column:
    """Whether a line writes what a resource's pattern names: <library>:<table> for the calls of a library that write a table or model, anything else is an expression."""
    library, _, name = pattern.partition(":")
    return LIBRARIES[library](line, name) if name and library in LIBRARIES else line.rlike(pattern)


def write_sites(files: DataFrame, resources: Sequence[Resource]) -> DataFrame:
    """file, line, resource, text of the lines that match a resource's patterns (see writes), comment lines left out, each line once a resource."""
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "raw")).where(~F.col("raw").rlike(r"^\s*(?://|#|\*|/\*)"))
    hit = F.array(*(F.when(F.coalesce(*(F.nullif(writes(F.col("raw"), p), F.lit(False)) for p in r.patterns), F.lit(False)), F.lit(r.id)) for r in resources if r.patterns))
    return lines.withColumn("resource", F.explode(F.array_distinct(F.array_compact(hit)))).select("file", (F.col("at") + 1).alias("line"), "resource", F.substring(F.trim("raw"), 1, 200).alias("text"))


def cargo_imports(files: DataFrame) -> DataFrame:
    """IMPORTS of Cargo manifests(path, text): a crate for each dependency, those of the build and of targets too, by its real name, at the line that declares it; development ones aren't imports."""

    def crates(text: str) -> dict[str, str]:
        data = tomllib.loads(text)
        tables = [data, *data.get("target", {}).values()]
        found = {}
        for t in tables:
            for kind in ("dependencies", "build-dependencies"):
                for name, v in t.get(kind, {}).items():
                    found[name] = v.get("package", name) if isinstance(v, dict) else name
        return found

    def run(batches):
        for b in batches:
            rows = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    lines = (text or "").split("\n")
                    for name, crate in crates(text or "").items():
                        at = next((k for k, x in enumerate(lines) if x.strip().startswith((f"{name} ", f"{name}=", f"{name}.", f'"{name}"')) or x.strip().endswith(f".{name}]")), 0)
                        rows.append((path, crate, "static", at + 1, []))
                except tomllib.TOMLDecodeError as e:
                    rows.append((path, str(e), "error", 0, []))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "specifier", "kind", "line", "names"])

    return files.select("path", "text").mapInArrow(run, IMPORTS)

"""What commands show: JSON, text, Markdown, SARIF and graph drawings, built as Columns; only the finished, bounded lists reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import key_fingerprint


def order() -> list[Column]:
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "warn", 1).otherwise(2)
    return [rank, F.col("rule"), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.col("message"), F.col("fingerprint")]


def exit_code(summary: DataFrame, config_errors: int = 0, unapproved: int = 0) -> int:
    """2 for a broken contract, 1 for a new error or an unapproved weakening, else 0."""
    return 2 if config_errors else int(summary.first()["new_errors"] > 0 or unapproved > 0)


def json_lines(findings: DataFrame) -> DataFrame:
    """One JSON object a finding, in the order of findings; write it with .write.text."""
    return findings.orderBy(*order()).select(F.to_json(F.struct(*findings.columns)).alias("value"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), r"\|", r"\\|"), r"\s+", " ")


def text_lines(findings: DataFrame) -> DataFrame:
    """value: a line for each finding in the order of findings, its status where that isn't new, and its place on a line of its own; write it with .write.text."""
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    head = F.concat(F.rpad("level", 5, " "), F.lit("  "), "rule", F.lit("  "), "message", F.when(F.col("status") != "new", F.concat(F.lit("  ["), "status", F.lit("]"))).otherwise(""))
    return findings.orderBy(*order()).select(F.explode(F.array_compact(F.array(head, F.when(F.col("file").isNotNull(), F.concat(F.lit("  at "), place))))).alias("value"))


#: Sections of a report: heading, and which findings it lists.
SECTIONS = (("New errors", "status = 'new' and level = 'error'"), ("New warnings", "status = 'new' and level = 'warn'"), ("Notes", "status = 'new' and level = 'info'"), ("Existing", "status = 'existing'"), ("Baselined", "status = 'baselined'"), ("Waived", "status = 'waived'"))


def markdown(findings: DataFrame, rows: int = 50) -> str:
    """A section for each kind of findings that there is: a table of the first ones and a line that counts the others."""
    section = F.coalesce(*(F.when(F.expr(w), k) for k, (_, w) in enumerate(SECTIONS)))
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "level", "rule", _escaped(place), _escaped(F.col("message"))), F.lit(" |"))
    told = findings.withColumn("section", section).where("section is not null")
    counts = {r.section: r.n for r in told.groupBy("section").agg(F.count("*").alias("n")).collect()}
    first = told.withColumn("nth", F.row_number().over(W.partitionBy("section").orderBy(*order()))).where(F.col("nth") <= rows)
    lines = first.orderBy("section", "nth").select("section", line.alias("value")).collect()  # rows for each section
    out = []
    for k, (name, _) in enumerate(SECTIONS):
        if k in counts:
            out += [f"### {name}: {counts[k]}", "", "| Level | Rule | Place | Message |", "|-|-|-|-|", *(r.value for r in lines if r.section == k), *([f"\n{counts[k] - rows} more."] if counts[k] > rows else []), ""]
    return "\n".join(out)


def sarif_results(findings: DataFrame, weakenings: DataFrame | None = None, tool: str = "tessera", contract: str = "contract.yaml", baseline: str = "baseline.json") -> DataFrame:
    """rule, level and value (one SARIF result as JSON) of all new findings, of approved ones (with the column approved_by), which
    count as suppressed notes, and of weakenings(rule, type, message, approved_by) that no decision approved, at the contract's file.

    A weakening's fingerprint is that of its rule and type; several of one pair get an ordinal.
    """
    level = F.create_map(F.lit("error"), F.lit("error"), F.lit("warn"), F.lit("warning"), F.lit("info"), F.lit("note"))[F.col("level")]
    approved = F.col("approved_by") if "approved_by" in findings.columns else F.lit(None).cast("string")
    reason = F.concat(F.lit("Approved by decision "), approved, F.lit("."))
    place = lambda file, line: F.array(F.struct(F.struct(F.struct(file.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.when(line.isNotNull(), F.struct(line.alias("startLine"))).alias("region")).alias("physicalLocation")))

    def result(rule: Column, lv: Column, text: Column, at: Column, mark: Column, *more: Column) -> Column:
        return F.to_json(F.struct(rule.alias("ruleId"), lv.alias("level"), F.struct(text.alias("text")).alias("message"), at.alias("locations"), F.create_map(F.lit(f"{tool}/v1"), mark).alias("partialFingerprints"), F.lit("new").alias("baselineState"), *more))

    excuse = F.when(approved.isNotNull(), F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), reason.alias("justification")))).alias("suppressions")
    lv = F.when(approved.isNotNull(), F.lit("note")).otherwise(level)
    text = F.when(approved.isNotNull(), F.concat("message", F.lit(" "), reason)).otherwise(F.col("message"))
    out = findings.where((F.col("status") == "new") | approved.isNotNull()).select(
        *(c.alias(f"o{k}") for k, c in enumerate(order())), "rule", lv.alias("level"), result(F.col("rule"), lv, text, place(F.coalesce("file", F.lit(contract)), F.col("line").cast("int")), F.col("fingerprint"), excuse).alias("value")
    ).orderBy(*(f"o{k}" for k in range(6))).select("rule", "level", "value")
    if weakenings is None:
        return out
    open_ = weakenings.where("approved_by is null").withColumn("nth", F.row_number().over(W.partitionBy("rule", "type").orderBy("message")) - 1)
    kind = F.lit("unapproved-weakening")
    mark = F.when(F.col("nth") == 0, key_fingerprint("unapproved-weakening", F.col("rule"), F.col("type"))).otherwise(key_fingerprint("unapproved-weakening", F.col("rule"), F.col("type"), F.col("nth").cast("string")))
    at = place(F.when(F.col("type") == "baseline-grown", F.lit(baseline)).otherwise(F.lit(contract)), F.lit(None).cast("int"))
    return out.union(open_.orderBy("rule", "type", "nth").select(kind, F.lit("error"), result(kind, F.lit("error"), F.col("message"), at, mark)))


def sarif(findings: DataFrame, weakenings: DataFrame | None = None, tool: str = "tessera") -> str:
    """SARIF 2.1.0 of sarif_results; the results come to the driver one after another, as the one document that a reader takes."""
    levels: dict[str, str] = {}
    values = []
    for r in sarif_results(findings, weakenings, tool).toLocalIterator():
        levels.setdefault(r.rule, r.level)
        values.append(json.loads(r.value))
    rules = [{"id": x, "shortDescription": {"text": x}, "defaultConfiguration": {"level": levels[x]}} for x in sorted(levels)]
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": values}]}, indent=2) + "\n"


def _nodes(graph: DataFrame, components: DataFrame | None, cycles: DataFrame | None) -> DataFrame:
    """name, id (letters, digits and _, different for different names) and cyclic of every component of a graph or of components(component)."""
    names = graph.select(F.explode(F.array("from_c", "to_c")).alias("name"))
    if components is not None:
        names = names.union(components.select("component"))
    base = F.concat(F.lit("c_"), F.regexp_replace("name", "[^A-Za-z0-9_]", "_"))
    nth = F.row_number().over(W.partitionBy("base").orderBy("name"))
    named = names.distinct().withColumn("base", base).withColumn("nth", nth).withColumn("id", F.when(F.col("nth") > 1, F.concat("base", F.lit("__"), F.col("nth").cast("string"))).otherwise(F.col("base")))
    if cycles is None:
        return named.select("name", "id", F.lit(False).alias("cyclic"))
    return named.join(cycles.select(F.col("node").alias("name"), F.lit(True).alias("cyclic")).distinct(), "name", "left").select("name", "id", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))



def mermaid(graph: DataFrame, cycles: DataFrame | None = None, components: DataFrame | None = None) -> str:
    """A flow chart of a component graph: a line for each component, edges of types alone dashed, members of cycles(node, scc) coloured."""
    nodes = _nodes(graph, components, cycles)
    arrow = F.when(F.col("kinds") == F.array(F.lit("type")), "-.->").otherwise("-->")
    end = lambda c: nodes.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    drawn = graph.select("from_c", "to_c", "cnt", arrow.alias("arrow")).join(end("from_c"), "from_c").join(end("to_c"), "to_c")
    edges = [r.value for r in drawn.orderBy("from_c", "to_c").select(F.concat(F.lit("  "), "from_c_id", F.lit(" "), "arrow", F.lit("|"), "cnt", F.lit("| "), "to_c_id").alias("value")).collect()]  # a line for each pair of components
    named = nodes.orderBy("name").select("id", F.replace("name", F.lit('"'), F.lit("#quot;")).alias("name"), "cyclic").collect()
    lines = ["flowchart LR", *(f'  {r.id}["{r.name}"]' for r in named), *edges]
    if members := [r.id for r in named if r.cyclic]:
        lines += ["  classDef cycle stroke:#c00,stroke-width:2px", f"  class {','.join(members)} cycle"]
    return "\n".join(lines) + "\n"


def dot(graph: DataFrame, cycles: DataFrame | None = None, components: DataFrame | None = None) -> str:
    """The same for Graphviz."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    style = F.when(F.col("kinds") == F.array(F.lit("type")), ", style=dashed").otherwise("")
    nodes = _nodes(graph, components, cycles).orderBy("name").select(F.concat(F.lit("  "), quoted(F.col("name")), F.when(F.col("cyclic"), " [color=red]").otherwise(""), F.lit(";")).alias("value"))
    edges = graph.orderBy("from_c", "to_c").select(F.concat(F.lit("  "), quoted(F.col("from_c")), F.lit(" -> "), quoted(F.col("to_c")), F.lit(" [label="), "cnt", style, F.lit("];")).alias("value"))
    return "\n".join(["digraph components {", "  rankdir=LR;", *(r.value for d in (nodes, edges) for r in d.collect()), "}"]) + "\n"

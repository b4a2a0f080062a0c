"""Findings that no edge rule makes: from metrics, change history, decisions and the comparison of two versions. All have the columns of schemas.FINDINGS."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import cycle_fingerprint, edge_fingerprint, key_fingerprint, target_key
from ..functions.selectors import any_selects
from ..schemas import Component, Rule
from . import diff, history, metrics, search
from .graph import mutual_components

#: Share of the source files that were analyzed below which shares of size say nothing, and the rise of the propagation cost that is told.
LOW_COVERAGE, COST_RISE = 0.5, 0.02
#: Hotspots that are told.
HOTSPOTS = 10


def finding(rows: DataFrame, rule: Column | str, kind: str, message: Column, fingerprint: Column, level: Column | str = "info", from_: Column | None = None, to_: Column | None = None, file: Column | None = None, line: Column | None = None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else F.lit(c) if isinstance(c, str) else c).cast("string")
    fields = {
        "rule": text(rule), "kind": F.lit(kind), "level": text(level), "message": message, "from_": text(from_), "to_": text(to_), "file": text(file), "line": F.lit(None).cast("int") if line is None else line.cast("int"),
        "fingerprint": fingerprint, "status": F.lit("new"), "heuristic": F.lit(False),
    }
    return rows.select(*(c.alias(k) for k, c in fields.items()))


def _percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def metric_findings(edges: DataFrame, files: DataFrame, components: Sequence[Component], analyzed: int | None = None, sources: int | None = None) -> DataFrame:
    """Hubs, gods and unstable dependencies. files: path, loc, component.

    analyzed and sources: how many of how many source files the edges stand for; a message says so where some are missing,
    and shares of size are left out where most are.
    """
    spark = edges.sparkSession
    names = spark.createDataFrame([(c.id,) for c in components], "component string")
    graph = metrics.component_graph(edges)
    coupling = metrics.coupling(names, files, graph)
    part = analyzed is not None and sources is not None and sources > analyzed
    basis = F.lit(f" Based on {analyzed} of {sources} source files." if part else "")
    hubs = metrics.hubs(coupling)
    c = F.col("component")
    made = [finding(hubs, "hub-component", "metric", F.concat(c, F.lit(" is a hub: "), "fan_in", F.lit(" components depend on it, it depends on "), "fan_out", F.lit(", from "), "least", F.lit(" on."), basis), key_fingerprint("hub-component", c), from_=c)]
    if not part or analyzed >= LOW_COVERAGE * sources:
        own = files.where(~history.is_non_production(F.col("path")))
        whole = own.agg(F.count("*").alias("all_files"), F.sum("loc").alias("all_loc"))
        gods = metrics.gods(metrics.coupling(names, own, graph), total=whole)
        share = F.concat(F.lit(" holds "), "files", F.lit(" of "), "all_files", F.lit(" production files ("), _percent(F.col("files") / F.col("all_files")), F.lit(") and "), "loc", F.lit(" of "), "all_loc", F.lit(" lines ("), _percent(F.col("loc") / F.col("all_loc")), F.lit(")."))
        made.append(finding(gods.crossJoin(F.broadcast(whole)), "god-component", "metric", F.concat(c, share, basis), key_fingerprint("god-component", c), from_=c))  # whole: one row
    lax = metrics.unstable(graph, coupling)
    a, b = F.col("from_c"), F.col("to_c")
    said = F.concat(a, F.lit(" (instability "), F.round("i_from", 2).cast("string"), F.lit(") depends on "), b, F.lit(", which is less stable ("), F.round("i_to", 2).cast("string"), F.lit(")."), basis)
    made.append(finding(lax, "unstable-dependency", "metric", said, key_fingerprint("unstable-dependency", a, b), from_=a, to_=b))
    return reduce(DataFrame.union, made)


def history_findings(edges: DataFrame, files: DataFrame, commit_files: DataFrame, top: int = HOTSPOTS) -> DataFrame:
    """Components that change together though neither imports the other, and the first hotspots. files: path, loc, component; commit_files: see history.usable."""
    changed = history.usable(commit_files)
    items = changed.join(files.select("path", F.col("component").alias("item")), "path").where("item is not null").select("sha", "item")
    pairs = history.hidden_coupling(history.cochange(items), metrics.component_graph(edges))
    a, b = F.col("a"), F.col("b")
    said = F.concat(a, F.lit(" and "), b, F.lit(" changed together in "), "support", F.lit(" commits (confidence "), _percent(F.col("confidence")), F.lit("), but neither imports the other."))
    hidden = finding(pairs, "hidden-change-coupling", "history", said, key_fingerprint("hidden-change-coupling", a, b), from_=a, to_=b)
    spots = history.hotspots(changed, files, top).join(files.select("path", "component"), "path")
    said = F.concat("path", F.lit(" is a hotspot: "), "churn", F.lit(" changed lines in "), "commits", F.lit(" commits, in a file of "), "loc", F.lit(" lines."))
    return hidden.union(finding(spots, "hotspot", "history", said, key_fingerprint("hotspot", F.col("path")), from_=F.col("component"), file=F.col("path")))


def decision_findings(decisions: DataFrame, rules: DataFrame, components: DataFrame, files: DataFrame, today: str, rules_file: str = "rules.yaml") -> DataFrame:
    """Overdue assumptions and lost governs entries of accepted decisions, assumptions whose rule is unknown, and rules that rest on a retired decision.

    decisions: id, file, title, status, governs, assumptions (text, check, review_by); rules: rule, because; components: component; files: path.
    """
    place = decisions.select("id", "file", "title")
    name = F.concat(F.lit("Decision "), "id", F.lit(" ("), F.coalesce("title", F.lit("")), F.lit(")"))
    each = decisions.select("id", "file", "title", "status", F.explode("assumptions").alias("s")).select("id", "file", "title", "status", "s.*")
    due = each.where((F.col("status") == "accepted") & (F.col("review_by") < today))
    made = [finding(due, "stale-decision", "decision", F.concat(name, F.lit(" has an assumption due for review on "), "review_by", F.lit(": "), "text"), key_fingerprint("stale-decision", F.col("id"), "assumption", F.col("text")), file=F.col("file"))]
    lost = search.stale_governs(decisions, components, files).join(place, "id")
    made.append(finding(lost, "stale-decision", "decision", F.concat(name, F.lit(" governs "), "target", F.lit(", which is no component and takes no file.")), key_fingerprint("stale-decision", F.col("id"), "governs", F.col("target")), file=F.col("file")))
    open_ = each.where(F.col("status").isin("accepted", "proposed") & F.col("check").isNotNull()).join(rules.select(F.col("rule").alias("check")), "check", "left_anti")
    made.append(finding(open_, "unchecked-assumption", "decision", F.concat(name, F.lit(" says that rule "), "check", F.lit(" checks an assumption, but there is no such rule: "), "text"), key_fingerprint("unchecked-assumption", F.col("id"), F.col("check"), F.col("text")), file=F.col("file")))
    cited = search.retired_citations(rules, decisions)
    made.append(finding(cited, "superseded-citation", "decision", F.concat(F.lit("Rule "), "rule", F.lit(" rests on decision "), "decision", F.lit(", which is "), "status", F.lit(".")), key_fingerprint("superseded-citation", F.col("rule"), F.col("decision")), from_=F.col("rule"), file=F.lit(rules_file)))
    return reduce(DataFrame.union, made)


def structure_findings(base: DataFrame, head: DataFrame, components: Sequence[Component], cycles: bool = True) -> DataFrame:
    """Component edges and cycles that head has and base hasn't, and a rise of the propagation cost. base, head: edges in terms of head's components; cycles: False where a rule of head reports them."""
    spark = head.sparkSession
    names = spark.createDataFrame([(c.id,) for c in components], "component string")
    old, new = (metrics.component_graph(e) for e in (base, head))
    a, b, at = F.col("from_c"), F.col("to_c"), F.col("samples")[0]
    added = diff.edge_delta(old, new).where("change = 'added'").select("from_c", "to_c").join(new, ["from_c", "to_c"])
    made = [finding(added, "new-component-edge", "diff", F.concat(a, F.lit(" now depends on "), b, F.lit(", imports: "), "cnt", F.lit(".")), key_fingerprint("new-component-edge", a, b), from_=a, to_=b, file=at["file"], line=at["line"])]
    if cycles:
        scc = [mutual_components(g.select(a.alias("a"), b.alias("b"))) for g in (old, new)]
        made.append(finding(diff.new_cycles(*scc), "new-cycle", "diff", F.concat(F.lit("Components now form a cycle: "), "members"), cycle_fingerprint("new-cycle", F.split("members", ","))))
    cost = [metrics.propagation_cost(names, g).select(F.col("cost").alias(c)) for g, c in ((old, "was"), (new, "now"))]
    risen = cost[0].crossJoin(cost[1]).where(F.round(F.col("now") - F.col("was"), 9) > COST_RISE)  # one row each
    made.append(finding(risen, "propagation-cost-rise", "diff", F.concat(F.lit("The propagation cost rose from "), F.format_number("was", 2), F.lit(" to "), F.format_number("now", 2), F.lit(".")), key_fingerprint("propagation-cost-rise")))
    return reduce(DataFrame.union, made)


def deprecated_findings(base: DataFrame, head: DataFrame, rules: Sequence[Rule], components: Sequence[Component]) -> DataFrame:
    """Edges of head into deprecated components from files that had none into them at base, for each deprecated rule; without any rule as warnings of deprecated-dependency.

    A rule without components of its own means those that the contract marks. base, head: edges in terms of head's components.
    """
    marked = [c.id for c in components if c.deprecated]
    given = [r for r in rules if r.kind == "deprecated"]
    checks = given or [Rule("deprecated-dependency", "deprecated", "warn")]
    dst = F.col("dst")
    hit = [
        F.when((any_selects(r.components, dst) if r.components else dst["component"].isin(*marked) if marked else F.lit(False)) & (F.lit(True) if r.include_type_imports else F.col("kind") != "type"), F.struct(F.lit(r.id).alias("rule"), F.lit("warn" if r.level == "warn" else "error").alias("level")))
        for r in checks if r.level != "off"
    ] or [F.lit(None).cast("struct<rule:string,level:string>")]
    known = head.where(F.col("dst.component").isNotNull() & ~F.coalesce("unresolved", F.lit(False)) & ~F.col("dst.component").eqNullSafe(F.col("src.component")))
    found = known.withColumn("hit", F.explode(F.array_compact(F.array(*hit)))).withColumn("to_c", F.col("dst.component"))
    had = base.where("dst.component is not null").select("from_", F.col("dst.component").alias("to_c")).distinct()
    fresh = found.join(had, ["from_", "to_c"], "left_anti")
    target = target_key(F.col("to_"), F.col("workspace"), F.col("package"), F.col("specifier"))
    return finding(fresh, F.col("hit.rule"), "deprecated", F.concat("from_", F.lit(" now depends on "), "to_c", F.lit(", which is deprecated.")), edge_fingerprint(F.col("hit.rule"), F.col("from_"), target, F.col("kind")), F.col("hit.level"), F.coalesce(F.col("src.component"), F.col("from_")), F.col("to_c"), F.col("from_"), F.col("line"))


def api_findings(changes: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """What the api-stability rules say to changes(component, file, name, change): losses and changed signatures at the rule's level, growth as warnings where a rule doesn't allow it."""
    end = F.struct(F.col("file"), F.col("component"), F.lit(None).cast("string").alias("package"), F.lit(False).alias("external"))
    growth = F.col("change") == "added"
    hit = [
        F.when(any_selects(r.components, end) & (~growth if r.allow_growth else F.lit(True)), F.struct(F.lit(r.id).alias("rule"), F.when(growth | F.lit(r.level == "warn"), F.lit("warn")).otherwise(F.lit("error")).alias("level")))
        for r in rules if r.kind == "api-stability" and r.level != "off"
    ] or [F.lit(None).cast("struct<rule:string,level:string>")]
    found = changes.withColumn("hit", F.explode(F.array_compact(F.array(*hit))))
    said = F.concat(F.lit("Public API of "), "component", F.lit(": "), "name", F.lit(" in "), "file", F.lit(" was "), "change", F.lit("."))
    return finding(found, F.col("hit.rule"), "api-stability", said, key_fingerprint(F.col("hit.rule"), F.col("file"), F.col("name"), F.col("change")), F.col("hit.level"), F.col("component"), file=F.col("file"))


def contract_findings(base: DataFrame, head: DataFrame) -> DataFrame:
    """One finding for each contract file (path, content_id) that was added, removed or modified."""
    changed = diff.file_changes(base, head)
    return finding(changed, "contract-changed", "diff", F.concat("path", F.lit(" was "), "change", F.lit(".")), key_fingerprint("contract-changed", F.col("path"), F.col("change")), file=F.col("path"))

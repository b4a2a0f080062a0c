"""The rule contract over enriched edges and write sites: one pass over the edges for all rules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..functions.hashing import cycle_fingerprint, edge_fingerprint, key_fingerprint, target_key
from ..functions.selectors import any_selects, first_selecting, selects
from ..schemas import Component, Resource, Rule, Waiver
from ..scratch import settle
from .graph import mutual_components, strong_components
from .mapping import component_of, missing_target

def violates(rule: Rule, components: Sequence[Component]) -> Column:
    """Whether an enriched edge with a known target breaks the rule."""
    src, dst = F.col("src"), F.col("dst")
    same = F.coalesce(src["component"] == dst["component"], F.lit(False))
    match rule.kind:
        case "forbid":
            return any_selects(rule.from_, src) & any_selects(rule.to_, dst)
        case "allow-only":
            outside = dst["external"] if (rule.scope or "internal") == "internal" else F.lit(False)
            return any_selects(rule.from_, src) & ~outside & ~(~dst["external"] & same) & ~any_selects(rule.to_, dst)
        case "layers":
            i, j = first_selecting(rule.layers, src), first_selecting(rule.layers, dst)
            return F.coalesce((j < i) if rule.allow_skip else (j < i) | (j > i + 1), F.lit(False))
        case "independent":
            groups = [(m,) for m in rule.members]
            return F.coalesce(first_selecting(groups, src) != first_selecting(groups, dst), F.lit(False))
        case "entrypoints":
            entry = F.lit(False)
            for c in components:
                globs = rule.entrypoints or c.entrypoints
                entry = F.when(dst["component"] == c.id, glob_match(F.col("to_"), globs) if globs else F.lit(True)).otherwise(entry)
            named = [t for t in rule.targets if not t.startswith(("path:", "pkg:"))]  # the target is looked at as a component, without its file
            aimed = F.lit(False)
            for t in named:
                aimed = aimed | (F.lit(True) if t == "*" else dst["component"] == t)
            return F.col("to_").isNotNull() & dst["component"].isNotNull() & ~same & aimed & ~entry
        case "external-imports":
            bare = dst["external"]
            if rule.packages:
                return bare & glob_match(dst["package"], rule.packages) & ~any_selects(rule.allow_from, src)
            excused = F.coalesce(F.col("builtin"), F.lit(False)) & F.lit(rule.allow_builtins)
            refused = (~glob_match(dst["package"], rule.allow) if rule.allow is not None else F.lit(False)) | glob_match(dst["package"], rule.forbid)
            return bare & any_selects(rule.from_, src) & ~excused & refused
    return F.lit(False)


def waived(rule: Rule, waivers: Sequence[Waiver], today: dt.date) -> Column:
    """A waiver holds on the day it expires and covers the edges its selectors take."""
    src, dst = F.col("src"), F.col("dst")
    out = F.lit(False)
    for w in waivers:
        if w.rule == rule.id and w.expires >= today:
            out = out | (selects(w.from_, src) & (selects(w.to_, dst) if w.to_ else F.lit(True)))
    return out


def edge_findings(edges: DataFrame, rules: Sequence[Rule], components: Sequence[Component], waivers: Sequence[Waiver] = (), today: dt.date = dt.date(1970, 1, 1), changed: DataFrame | None = None) -> DataFrame:
    """Findings of all edge rules, new or waived. edges: see with_endpoints. changed: paths; then only edges from these count."""
    src, dst = F.col("src"), F.col("dst")
    known = edges.where(dst.isNotNull() & ~missing_target(F.col("unresolved"), F.col("workspace"), F.col("to_")) | F.col("package").isNotNull() & ~F.coalesce("unresolved", F.lit(False)))
    if changed is not None:
        known = known.join(changed.select(F.col("path").alias("from_")).distinct(), "from_", "left_semi")
    target = target_key(F.col("to_"), F.col("workspace"), F.col("package"), F.col("specifier"))
    made = []
    for r in rules:
        if r.level == "off" or r.kind in ("acyclic", "state-owner", "api-stability", "deprecated"):
            continue
        hit = violates(r, components)
        if not r.include_type_imports:
            hit = hit & (F.col("kind") != "type")
        fields = {"rule": F.lit(r.id), "kind": F.lit(r.kind), "level": F.lit(r.level), "status": F.when(waived(r, waivers, today), F.lit("waived")).otherwise(F.lit("new"))}
        made.append(F.when(hit, F.struct(*(v.alias(k) for k, v in fields.items()))))
    if not made:
        made = [F.lit(None).cast("struct<rule:string,kind:string,level:string,status:string>")]
    hits = known.withColumn("hit", F.explode(F.filter(F.array(*made), lambda h: h.isNotNull())))
    source = F.coalesce(src["component"], src["file"])
    aim = F.coalesce(dst["component"], dst["package"], dst["file"])
    return hits.select(
        "hit.rule", F.col("hit.kind").alias("kind"), "hit.level", F.concat(source, F.lit(" must not import "), aim).alias("message"), source.alias("from_"), aim.alias("to_"),
        F.col("from_").alias("file"), "line", edge_fingerprint(F.col("hit.rule"), F.col("from_"), target, F.col("kind")).alias("fingerprint"), "hit.status", F.lit(False).alias("heuristic"),
    )


def _in_force(rule: Rule, waivers: Sequence[Waiver], today: dt.date) -> list[Waiver]:
    return [w for w in waivers if w.rule == rule.id and w.expires >= today]


def _end(file: Column, component: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(file.alias("file"), component.alias("component"), none.alias("package"), F.lit(False).alias("external"))


def state_findings(writes: DataFrame, rule: Rule, resources: Sequence[Resource], components: Sequence[Component], waivers: Sequence[Waiver] = (), today: dt.date = dt.date(1970, 1, 1), changed: DataFrame | None = None) -> DataFrame:
    """Writes (file, line, resource) to a resource from outside its owner; a file without a component is outside. changed: paths; then only writes in these count."""
    spark = writes.sparkSession
    owned = spark.createDataFrame([(r.id, r.owner) for r in resources if not rule.resources or r.id in rule.resources], "resource string, owner string")
    if changed is not None:
        writes = writes.join(changed.select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    found = writes.join(F.broadcast(owned), "resource").withColumn("component", component_of(F.col("file"), components)).where(~F.col("component").eqNullSafe(F.col("owner")))
    ends = found.withColumns({"src": _end(F.col("file"), F.col("component")), "dst": _end(F.lit(None).cast("string"), F.col("owner"))})
    status = F.when(waived(rule, waivers, today), F.lit("waived")).otherwise(F.lit("new"))
    return ends.select(
        F.lit(rule.id).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.level).alias("level"), F.concat(F.lit("writes "), F.col("resource"), F.lit(", which belongs to "), F.col("owner")).alias("message"), F.coalesce("component", "file").alias("from_"), F.col("owner").alias("to_"),
        "file", "line", key_fingerprint(rule.id, F.col("file"), F.col("resource")).alias("fingerprint"), status.alias("status"), F.lit(True).alias("heuristic"),
    )


def cycle_pairs(edges: DataFrame, rule: Rule) -> DataFrame:
    """a, b, ca, cb (components), file and line of the edges that an acyclic rule looks at."""
    by_component = (rule.scope or "components") == "components"
    by = "component" if by_component else "file"
    known = edges.where(F.col("dst").isNotNull())
    if not rule.include_type_imports:
        known = known.where("kind <> 'type'")
    end = lambda node, owner: _end(F.lit(None).cast("string") if by_component else node, node if by_component else owner)
    pairs = known.select(F.col("src")[by].alias("a"), F.col("dst")[by].alias("b"), F.col("src.component").alias("ca"), F.col("dst.component").alias("cb"), F.col("from_").alias("file"), "line").where("a is not null and b is not null and a <> b")
    if rule.within:
        pairs = pairs.where(any_selects(rule.within, end(F.col("a"), F.col("ca"))) & any_selects(rule.within, end(F.col("b"), F.col("cb"))))
    return pairs


def acyclic_findings(edges: DataFrame, rule: Rule, components: Sequence[Component] = (), waivers: Sequence[Waiver] = (), today: dt.date = dt.date(1970, 1, 1), members: DataFrame | None = None) -> DataFrame:
    """One finding for each strongly connected component of two or more members, over files or components; within limits the members. members: node and scc, where the components are known already.

    A waiver covers a cycle when its sides each take some member. Members of a graph of components have no file that a
    selector could take.
    """
    by_component = (rule.scope or "components") == "components"
    end = lambda node, owner: _end(F.lit(None).cast("string") if by_component else node, node if by_component else owner)
    pairs = cycle_pairs(edges, rule)
    pairs = settle(pairs.groupBy("a", "b").agg(F.min(F.struct("file", "line")).alias("at")), "cycle-pairs")
    if members is None:
        members = (mutual_components if by_component else strong_components)(pairs.select("a", "b"))
    m = members.select(F.col("node").alias("a"), "scc")
    inside = pairs.join(m, "a").join(members.select(F.col("node").alias("b"), F.col("scc").alias("other")), "b").where("scc = other")
    at = inside.groupBy("scc").agg(F.min("at").alias("at"))
    held = _in_force(rule, waivers, today)
    node = end(F.col("node"), component_of(F.col("node"), components))
    takes = {f"w{k}{side}": F.max(selects(raw, node) if raw else F.lit(True)) for k, w in enumerate(held) for side, raw in (("a", w.from_), ("b", w.to_))}
    cycles = members.groupBy("scc").agg(F.array_sort(F.collect_set("node")).alias("members"), *(v.alias(k) for k, v in takes.items())).join(at, "scc")
    excused = F.lit(False)
    for k in range(len(held)):
        excused = excused | (F.col(f"w{k}a") & F.col(f"w{k}b"))
    return cycles.select(
        F.lit(rule.id).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.level).alias("level"), F.concat(F.lit("cycle: "), F.array_join("members", ", ")).alias("message"), F.col("members")[0].alias("from_"), F.lit(None).cast("string").alias("to_"),
        F.col("at.file").alias("file"), F.col("at.line").alias("line"), cycle_fingerprint(rule.id, F.col("members")).alias("fingerprint"), F.when(excused, F.lit("waived")).otherwise(F.lit("new")).alias("status"), F.lit(False).alias("heuristic"),
    )


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """The first count new findings of a baseline fingerprint, by file and line, become baselined; info findings never do. Several entries of one fingerprint: the largest count."""
    most = baseline.groupBy("fingerprint").agg(F.max("count").alias("_most"))
    candidate = (F.col("level") != "info") & (F.col("status") == "new")
    nth = F.row_number().over(W.partitionBy("fingerprint", candidate).orderBy(F.asc_nulls_first("file"), "line", "message"))
    marked = findings.withColumn("_nth", F.when(candidate, nth)).join(most, "fingerprint", "left")
    return marked.withColumn("status", F.when(F.col("_nth") <= F.col("_most"), F.lit("baselined")).otherwise(F.col("status"))).drop("_nth", "_most").select(*findings.columns)


def baseline_fixed(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline entries whose count is above what is found: fingerprint, rule, fixed."""
    found = findings.where("level <> 'info'").groupBy("fingerprint").agg(F.count("*").alias("found"))
    return baseline.join(found, "fingerprint", "left").select("fingerprint", "rule", F.greatest(F.lit(0), F.col("count") - F.coalesce("found", F.lit(0))).cast("long").alias("fixed")).where("fixed > 0")


def baseline_update(findings: DataFrame, baseline: DataFrame, grow: bool = False) -> DataFrame:
    """The baseline rewritten: entries shrink to what is found, those without any go; grow takes the found counts and new fingerprints too."""
    found = findings.where("level <> 'info' and status <> 'waived'").groupBy("fingerprint", "rule").agg(F.count("*").alias("found"))
    both = baseline.select("fingerprint", F.col("rule").alias("_rule"), "count").join(found, "fingerprint", "full_outer" if grow else "inner")
    size = F.coalesce("found", F.lit(0)) if grow else F.least("count", "found")
    return both.select("fingerprint", F.coalesce("_rule", "rule").alias("rule"), size.cast("long").alias("count")).where("count > 0")


def summary(findings: DataFrame) -> DataFrame:
    """One row of counts by status and level."""
    n = lambda c: F.count_if(c).alias
    s, lv = F.col("status"), F.col("level")
    return findings.agg(n((s == "new") & (lv == "error"))("new_errors"), n((s == "new") & (lv == "warn"))("new_warnings"), n((s == "new") & (lv == "info"))("infos"), n(s == "existing")("existing"), n(s == "baselined")("baselined"), n(s == "waived")("waived"))


def _code_selectors(rule: Rule) -> list[str]:
    """What a rule says about code, not about packages."""
    said = {
        "forbid": (*rule.from_, *rule.to_), "allow-only": (*rule.from_, *rule.to_), "layers": tuple(x for g in rule.layers for x in g), "acyclic": rule.within,
        "independent": rule.members, "entrypoints": rule.targets, "external-imports": (*rule.from_, *rule.allow_from),
    }
    return sorted({x for x in said.get(rule.kind, ()) if x != "*" and not x.startswith("pkg:")})


def _in_scope(rule: Rule) -> Column:
    """Whether an edge is one that the rule judges, whatever it finds."""
    src, dst = F.col("src"), F.col("dst")
    match rule.kind:
        case "acyclic" if (rule.scope or "components") == "files":
            return F.col("to_").isNotNull() & (F.col("to_") != F.col("from_"))
        case "acyclic":
            member = lambda e: F.lit(True) if not rule.within else any_selects(rule.within, _end(F.lit(None).cast("string"), e["component"]))
            return (src["component"] != dst["component"]) & member(src) & member(dst)
        case "layers":
            return any_selects([x for g in rule.layers for x in g], src)
        case "independent":
            return any_selects(rule.members, src)
        case "entrypoints":
            return ~dst["external"] & dst["component"].isNotNull() & ~dst["component"].eqNullSafe(src["component"]) & any_selects(rule.targets, _end(F.lit(None).cast("string"), dst["component"]))
        case "external-imports" if rule.packages:
            return F.lit(True)
    return any_selects(rule.from_, src)


def inert_rules(edges: DataFrame, files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, in_scope (edges that it judges) and empty (its selectors that take no file) of rules that judge no edge or have such a selector.

    edges: see with_endpoints; files: path, component. One pass over each: every rule and every selector is a count.
    """
    spark = edges.sparkSession
    active = [r for r in rules if r.level != "off" and r.kind not in ("state-owner", "api-stability", "deprecated")]
    if not active:
        return spark.createDataFrame([], "rule string, in_scope long, empty array<string>")
    known = edges.where(F.col("dst").isNotNull() & ~F.coalesce("unresolved", F.lit(False)))
    typed = lambda r: (F.lit(True) if r.include_type_imports or (r.kind == "acyclic" and r.scope == "files") else F.col("kind") != "type")
    judged = known.agg(*(F.count_if(_in_scope(r) & typed(r)).alias(f"c{k}") for k, r in enumerate(active)))
    raws = sorted({x for r in active for x in _code_selectors(r)})
    end = _end(F.col("path"), F.col("component"))
    taken = files.agg(*(F.count_if(selects(x, end)).alias(f"s{k}") for k, x in enumerate(raws)), F.lit(0).alias("_"))
    both = judged.crossJoin(taken)  # one row each
    none = lambda r: F.array_compact(F.array(*(F.when(F.col(f"s{raws.index(x)}") == 0, F.lit(x)) for x in _code_selectors(r)))) if _code_selectors(r) else F.array().cast("array<string>")
    rows = F.array(*(F.struct(F.lit(r.id).alias("rule"), F.col(f"c{k}").alias("in_scope"), none(r).alias("empty")) for k, r in enumerate(active)))
    return both.select(F.inline(rows)).where((F.col("in_scope") == 0) | (F.size("empty") > 0))

"""The commands: check one version against its contract, compare two versions, rank what a task should know."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.globs import glob_match
from ..functions.text import token_estimate
from ..operators import contract as W
from ..operators import diff as D
from ..operators import extract, mapping, patterns, resolve, rules, status, surface
from ..operators import findings as FN
from ..schemas import Component, Contract
from ..scratch import settle
from ..sources.files import ANALYZED, language_of, source_files


def code_graph(files: DataFrame, workspaces: DataFrame, contract: Contract, aliases=(), roots=("", "src"), known: DataFrame | None = None, languages: Collection[str] = ANALYZED, settings: DataFrame | None = None) -> DataFrame:
    """Enriched edges of files(path, text): imports extracted, resolved and put in terms of components. known: all files there are, where only some are looked at; languages: those that files has, where that is known; settings: specifier patterns, see operators.patterns."""
    own = source_files(files).select("path", "text", "language")
    known = (files if known is None else known).select("path")
    made = []
    if {"typescript", "javascript"} & set(languages):
        imports = extract.script_imports(own.where("language in ('typescript', 'javascript')"))
        made.append(resolve.resolve_scripts(imports if settings is None else patterns.mapped(imports, settings), known, workspaces, aliases))
    if "python" in languages or not made:
        made.append(resolve.resolve_python(extract.python_imports(own.where("language = 'python'")), known, roots))
    owners = workspaces.select("name", mapping.component_of_package(F.col("name"), F.col("dir"), contract.components).alias("component"))
    return mapping.with_endpoints(reduce(DataFrame.unionByName, made), contract.components, owners)


def check(edges: DataFrame, contract: Contract, today: dt.date, baseline: DataFrame | None = None, writes: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """All findings of a version: edge rules, cycles, state owners; then the baseline."""
    made = [rules.edge_findings(edges, contract.rules, contract.components, contract.waivers, today, changed)]
    made += [rules.acyclic_findings(edges, r, contract.components, contract.waivers, today) for r in contract.rules if r.kind == "acyclic" and r.level != "off"]
    if writes is not None:
        made += [rules.state_findings(writes, r, contract.resources, contract.components, contract.waivers, today, changed) for r in contract.rules if r.kind == "state-owner" and r.level != "off"]
    found = reduce(DataFrame.unionByName, made)
    return rules.apply_baseline(found, baseline) if baseline is not None else found


def check_edited(kept: DataFrame, edited: DataFrame, workspaces: DataFrame, contract: Contract, today: dt.date, known: DataFrame, aliases=(), roots=("", "src"), baseline: DataFrame | None = None) -> DataFrame:
    """The findings that concern edited files(path, text), as check with changed gives them: the rules over their own imports, cycles over the whole graph.

    kept: enriched edges of the version before; known: the paths of all files. Only the edited files are read and resolved;
    of the kept edges the cycles need no more than which members depend on each other and where first.
    """
    languages = [r[0] for r in edited.select(language_of(F.col("path"))).distinct().collect()]  # those that there are
    fresh = settle(code_graph(edited, workspaces, contract, aliases, roots, known, languages), "edited-edges")
    made = [rules.edge_findings(fresh, contract.rules, contract.components, contract.waivers, today)]
    acyclic = [r for r in contract.rules if r.kind == "acyclic" and r.level != "off"]
    if acyclic:
        now = status.refreshed(kept, edited, fresh)
        made += [rules.acyclic_findings(now, r, contract.components, contract.waivers, today) for r in acyclic]
    found = reduce(DataFrame.unionByName, made)
    return rules.apply_baseline(found, baseline) if baseline is not None else found


def compare(base: DataFrame, head: DataFrame, contract: Contract, today: dt.date, baseline: DataFrame | None = None) -> DataFrame:
    """The head's findings, existing as far as the base had them already."""
    found = check(head, contract, today, baseline)
    before = check(base, contract, today, baseline).groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.count_if(F.col("status") == "baselined").alias("baselined"))
    return D.diff_budget(found, before)


def built_in(edges: DataFrame, files: DataFrame, components: Sequence[Component], commit_files: DataFrame | None = None) -> DataFrame:
    """The findings that need no rule: hubs, gods, unstable dependencies, and with a history hotspots and hidden coupling. files: path, loc, component."""
    found = FN.metric_findings(edges, files, components)
    return found if commit_files is None else found.union(FN.history_findings(edges, files, commit_files))


@dataclass(frozen=True)
class Version:
    """One version of a code base. edges: see schemas.EDGES; files: path, loc; exports and stars: see surface.public_surface;
    decisions: see findings.decision_findings, with weakens; contract_files: path, content_id. What is None is left out."""

    contract: Contract
    edges: DataFrame
    files: DataFrame
    workspaces: DataFrame | None = None
    exports: DataFrame | None = None
    stars: DataFrame | None = None
    decisions: DataFrame | None = None
    baseline: DataFrame | None = None
    contract_files: DataFrame | None = None

    def seen_by(self, contract: Contract) -> DataFrame:
        """The edges in terms of a contract's components."""
        owners = None if self.workspaces is None else self.workspaces.select("name", mapping.component_of_package(F.col("name"), F.col("dir"), contract.components).alias("component"))
        return mapping.with_endpoints(self.edges, contract.components, owners)


class Difference(NamedTuple):
    findings: DataFrame
    fixed: DataFrame | None
    weakenings: DataFrame
    api_changes: DataFrame | None


def _entry_files(files: DataFrame, components: Sequence[Component]) -> DataFrame:
    """file and component of the declared entry files."""
    owned = files.select(F.col("path").alias("file"), mapping.component_of(F.col("path"), components).alias("component"))
    entry = F.lit(False)
    for c in components:
        if c.entrypoints:
            entry = entry | ((F.col("component") == c.id) & glob_match(F.col("file"), c.entrypoints))
    return owned.where(F.coalesce(entry, F.lit(False)))


def api_changes(base: Version, head: Version) -> DataFrame:
    """component, file, name, change of the public surfaces, both in terms of head's components; entry files that head no longer declares are compared under base's, without growth. A change seen through several files of a component counts once."""

    def shown(v: Version, entries: DataFrame) -> DataFrame:
        return surface.public_surface(entries, v.exports, v.stars).join(entries, "file").select("component", "file", "name", "signature")

    now, was = head.contract.components, base.contract.components
    changes = D.api_changes(shown(base, _entry_files(base.files, now)), shown(head, _entry_files(head.files, now)))
    lost = _entry_files(base.files, was).join(_entry_files(base.files, now).select("file"), "file", "left_anti")
    still = _entry_files(head.files, was).join(lost.select("file"), "file", "left_semi")
    dropped = D.api_changes(shown(base, lost), shown(head, still)).where("change <> 'added'")
    return D.first_seen_change(changes.union(dropped).distinct())


def diff(base: Version, head: Version, today: dt.date) -> Difference:
    """Two versions compared: head's findings, new only as far as the base lacked them, findings of what changed, what the contract lost, and the public surface.

    Findings of api-stability and deprecated rules that an accepted decision newly lists in weakens are waived.
    """
    spark, rules_of = head.edges.sparkSession, head.contract.rules
    # each graph is put in terms of a contract once, and checked once without its baseline
    edges, old_edges = settle(head.seen_by(head.contract), "diff-head"), settle(base.seen_by(head.contract), "diff-base")
    plain = settle(check(edges, head.contract, today), "diff-found")
    found = plain if head.baseline is None else rules.apply_baseline(plain, head.baseline)
    fixed = None if head.baseline is None else rules.baseline_fixed(plain, head.baseline)
    was = check(base.seen_by(base.contract), base.contract, today)
    before = was.groupBy("fingerprint").agg(F.count("*").alias("occurrences")).withColumn("baselined", F.lit(0).cast("long"))
    if head.baseline is not None:
        before = before.unionByName(head.baseline.groupBy("fingerprint").agg(F.lit(0).cast("long").alias("occurrences"), F.sum("count").cast("long").alias("baselined")))
    made = [D.diff_budget(found, before).withColumn("approved_by", F.lit(None).cast("string"))]

    changes = api_changes(base, head) if base.exports is not None and head.exports is not None else None
    ruled = FN.deprecated_findings(old_edges, edges, rules_of, head.contract.components)
    if changes is not None:
        ruled = ruled.union(FN.api_findings(changes, rules_of))
    weak = W.weakenings(spark, base.contract, head.contract, today).withColumnRenamed("detail", "message")
    if base.baseline is not None and head.baseline is not None:
        enforced = spark.createDataFrame([(r.id,) for r in base.contract.rules if r.level != "off"], "rule string")
        grown = D.baseline_growth(base.baseline, head.baseline, enforced)
        weak = weak.union(grown.select(F.lit("baseline-grown"), "rule", F.concat(F.lit("accepts more findings: "), "grown")))
    # what the base contract finds in head's code and head's contract no longer does, waivers aside as they are told of
    # themselves; a rule counts once, with what loosened it
    bare = lambda c: replace(c, waivers=())
    now = check(edges, bare(head.contract), today) if head.contract.waivers else plain
    less = D.lost_findings(check(head.seen_by(base.contract), bare(base.contract), today).where("status = 'new'"), now.where("status = 'new'"))
    less = less.groupBy("rule").agg(F.sum("lost").alias("lost")).join(weak.select("rule").distinct(), "rule", "left_anti")
    weak = weak.union(less.select(F.lit("findings-lost"), "rule", F.concat(F.lit("no longer finds: "), "lost")))
    if base.decisions is not None and head.decisions is not None:
        ruled, weak = (D.approvals(x, base.decisions, head.decisions) for x in (ruled, weak))
        ruled = ruled.withColumn("status", F.when(F.col("approved_by").isNotNull(), F.lit("waived")).otherwise(F.col("status")))
        told = [FN.decision_findings(v.decisions, _because(spark, v.contract), _names(spark, v.contract), v.files, str(today)) for v in (base, head)]
        made.append(told[1].join(told[0].select("fingerprint").distinct(), "fingerprint", "left_anti").withColumn("approved_by", F.lit(None).cast("string")))
    else:
        ruled, weak = (x.withColumn("approved_by", F.lit(None).cast("string")) for x in (ruled, weak))
    cycles = not any(r.kind == "acyclic" and (r.scope or "components") == "components" and r.level != "off" for r in rules_of)
    told = FN.structure_findings(old_edges, edges, head.contract.components, cycles)
    if base.contract_files is not None and head.contract_files is not None:
        told = told.union(FN.contract_findings(base.contract_files, head.contract_files))
    made += [ruled, told.withColumn("approved_by", F.lit(None).cast("string"))]
    return Difference(reduce(DataFrame.unionByName, made), fixed, weak, changes)


def _because(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([(r.id, list(r.because)) for r in contract.rules], "rule string, because array<string>")


def _names(spark: SparkSession, contract: Contract) -> DataFrame:
    return spark.createDataFrame([(c.id,) for c in contract.components], "component string")


def brief(items: DataFrame, budget: int) -> DataFrame:
    """items(rank, id, markdown) that fit a token budget: in the order of rank each whole item that still fits. The list is short by nature (a few of each kind), and the choice is one after another, so it is made in one group."""

    def choose(t):
        left, kept = budget, []
        for row in t.sort_values(["rank", "id"]).itertuples():
            if row.tokens <= left:
                left -= row.tokens
                kept.append(row.Index)
        return t.loc[kept, ["rank", "id", "markdown", "tokens"]]

    sized = items.select("rank", "id", "markdown", token_estimate(F.col("markdown")).alias("tokens"), F.lit(0).alias("group"))
    return sized.groupBy("group").applyInPandas(choose, "rank long, id string, markdown string, tokens long")

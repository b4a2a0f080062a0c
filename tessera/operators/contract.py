"""A contract compared with an older one: what was loosened. Contracts are a few hundred lines written by people, so they are compared as they are; what has to be counted in the code goes through diff.lost_findings and diff.baseline_growth."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LEVELS, Component, Contract, Rule

#: Fields of each kind whose entries make a rule stricter the more there are, and those that make it laxer.
_STRICT = {"forbid": ("from_", "to_"), "allow-only": ("from_",), "independent": ("members",), "entrypoints": ("targets",), "external-imports": ("from_", "forbid", "packages"), "state-owner": ("resources",), "api-stability": ("components",), "deprecated": ("components",)}
_LAX = {"allow-only": ("to_",), "entrypoints": ("entrypoints",), "external-imports": ("allow_from",), "acyclic": ()}


def _rank(level: str) -> int:
    return LEVELS.index(level)


def _forbidden(rule: Rule) -> set[tuple[str, str]]:
    """Pairs of selectors that a layers rule forbids from depending on each other."""
    return {(a, b) for i, low in enumerate(rule.layers) for j, high in enumerate(rule.layers) for a in low for b in high if j < i or (not rule.allow_skip and j > i + 1)}


def _narrowed(old: Rule, new: Rule) -> list[str]:
    out = [f"{f} lost {x}" for f in _STRICT.get(old.kind, ()) for x in sorted(set(getattr(old, f)) - set(getattr(new, f)))]
    out += [f"{f} gained {x}" for f in _LAX.get(old.kind, ()) for x in sorted(set(getattr(new, f)) - set(getattr(old, f)))]
    if old.kind == "layers":
        out += [f"{a} may import {b}" for a, b in sorted(_forbidden(old) - _forbidden(new))]
    if old.kind == "acyclic" and new.within and (not old.within or set(old.within) - set(new.within)):
        out.append("within covers less")
    if old.kind == "external-imports" and old.allow is not None:
        out += ["allow is gone"] if new.allow is None else [f"allow gained {x}" for x in sorted(set(new.allow) - set(old.allow))]
        if new.allow_builtins and not old.allow_builtins:
            out.append("built-ins are allowed")
    if old.kind == "allow-only" and (old.scope, new.scope) == ("all", "internal"):
        out.append("scope is internal")
    if old.kind == "api-stability" and new.allow_growth and not old.allow_growth:
        out.append("growth is allowed")
    return out


def rule_weakenings(base: Sequence[Rule], head: Sequence[Rule]) -> list[tuple[str, str, str]]:
    """(type, rule, detail) of base rules that head dropped, lowered, changed in kind or narrowed; rules that were off count for nothing."""
    now, out = {r.id: r for r in head}, []
    for old in base:
        if old.level == "off":
            continue
        new = now.get(old.id)
        if new is None:
            out.append(("rule-removed", old.id, ""))
            continue
        if _rank(new.level) < _rank(old.level):
            out.append(("level-lowered", old.id, f"{old.level} to {new.level}"))
        if old.include_type_imports and not new.include_type_imports:
            out.append(("type-imports-excluded", old.id, ""))
        if new.kind != old.kind or bool(new.packages) != bool(old.packages) or (old.kind == "acyclic" and (old.scope or "components") != (new.scope or "components")):
            out.append(("rule-changed", old.id, f"{old.kind} to {new.kind}"))
            continue
        out += [("selector-narrowed", old.id, d) for d in _narrowed(old, new)]
    return out


def component_weakenings(base: Iterable[Component], head: Iterable[Component]) -> list[tuple[str, str, str]]:
    now = {c.id: c for c in head}
    out = []
    for old in base:
        if (new := now.get(old.id)) is None:
            continue
        if old.deprecated and not new.deprecated:
            out.append(("component-changed", old.id, "no longer deprecated"))
        if old.entrypoints and not new.entrypoints:
            out.append(("component-changed", old.id, "everything is an entry point"))
        elif extra := sorted(set(new.entrypoints) - set(old.entrypoints)) if old.entrypoints else []:
            out.append(("component-changed", old.id, f"entry points gained {', '.join(extra)}"))
    return out


def waiver_weakenings(base: Contract, head: Contract, today: dt.date) -> list[tuple[str, str, str]]:
    """Head waivers that hold and are new or last longer."""
    was: dict[tuple, dt.date] = {}
    for w in base.waivers:
        key = (w.rule, w.from_, w.to_)
        was[key] = max(was.get(key, w.expires), w.expires)
    return [("waiver-added", w.rule, f"{w.from_} to {w.to_ or 'anything'} until {w.expires}") for w in head.waivers if w.expires >= today and w.expires > was.get((w.rule, w.from_, w.to_), dt.date.min)]


def weakenings(spark: SparkSession, base: Contract, head: Contract, today: dt.date) -> DataFrame:
    """type, rule and detail of all that head loosens."""
    rows = rule_weakenings(base.rules, head.rules) + component_weakenings(base.components, head.components) + waiver_weakenings(base, head, today)
    return spark.createDataFrame(sorted(rows), "type string, rule string, detail string")


def contract_issues(contract: Contract, today: dt.date) -> list[tuple[str, str]]:
    """(where, problem): repeated ids, unknown components, resources and rules, error rules without a reason, waivers that have expired."""
    out = []
    for what, ids in (("component", [c.id for c in contract.components]), ("resource", [r.id for r in contract.resources]), ("rule", [r.id for r in contract.rules])):
        out += [(f"{what} {i}", "is there more than once") for i in sorted({i for i in ids if ids.count(i) > 1})]
    known, resources = {c.id for c in contract.components}, {r.id for r in contract.resources}
    for r in contract.rules:
        named = [*r.from_, *r.to_, *r.members, *r.targets, *r.components, *r.within, *r.allow_from, *(s for g in r.layers for s in g)]
        out += [(f"rule {r.id}", f"names the unknown component {s}") for s in sorted(set(named)) if s != "*" and not s.startswith(("path:", "pkg:")) and s not in known]
        out += [(f"rule {r.id}", f"names the unknown resource {s}") for s in sorted(set(r.resources) - resources)]
        if r.level == "error" and not r.because:
            out.append((f"rule {r.id}", "is an error without a reason"))
    out += [(f"resource {r.id}", f"has the unknown owner {r.owner}") for r in contract.resources if r.owner not in known]
    ids = {r.id for r in contract.rules}
    for w in contract.waivers:
        if w.rule not in ids:
            out.append((f"waiver of {w.rule}", "names an unknown rule"))
        elif w.expires < today:
            out.append((f"waiver of {w.rule}", "has expired"))
    return out

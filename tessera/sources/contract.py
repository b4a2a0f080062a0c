"""A contract from plain data, as YAML or JSON files hold it: what is wrong becomes an issue, the rest is used."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Mapping
from typing import Any

from ..operators.contract import contract_issues
from ..schemas import LEVELS, Component, Contract, Resource, Rule, Waiver

_KINDS = ("forbid", "allow-only", "layers", "acyclic", "independent", "entrypoints", "external-imports", "state-owner", "api-stability", "deprecated")
_NAMES = {"from": "from_", "to": "to_"}


def _plain(v: Any) -> Any:
    return tuple(_plain(x) for x in v) if isinstance(v, list) else v


def _built(kind: type, data: Any, where: str, issues: list[tuple[str, str]]) -> Any:
    """A contract object, without the keys it doesn't know; None where a needed one is missing or of the wrong type."""
    if not isinstance(data, Mapping):
        issues.append((where, "is no mapping"))
        return None
    fields = {f.name: f for f in dataclasses.fields(kind)}
    values = {}
    for key, v in data.items():
        name = _NAMES.get(key, key)
        if name not in fields:
            issues.append((where, f"has the unknown key {key}"))
        elif "tuple" in str(fields[name].type) and not isinstance(v, list | str):
            issues.append((where, f"{key} is no list"))
        else:
            values[name] = ((v,) if isinstance(v, str) else tuple((x,) if name == "layers" and isinstance(x, str) else _plain(x) for x in v)) if "tuple" in str(fields[name].type) else v
    missing = [f.name for f in fields.values() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING and f.name not in values and f.name != "to_"]
    if missing:
        issues.append((where, f"lacks {', '.join(missing)}"))
        return None
    if kind is Waiver:
        values.setdefault("to_", None)
        try:
            values["expires"] = values["expires"] if isinstance(values["expires"], dt.date) else dt.date.fromisoformat(values["expires"])
        except (TypeError, ValueError):
            issues.append((where, "expires is no date"))
            return None
    if kind is Rule and (values["kind"] not in _KINDS or values.get("level", "error") not in LEVELS):
        issues.append((where, "has an unknown kind or level"))
        return None
    return kind(**values)


def load(data: Mapping[str, Any], today: dt.date) -> tuple[Contract, list[tuple[str, str]]]:
    """The contract and its issues (where, problem); waivers that have expired are left out."""
    issues: list[tuple[str, str]] = []
    parts = {}
    for name, kind in (("components", Component), ("resources", Resource), ("rules", Rule), ("waivers", Waiver)):
        given = data.get(name) or []
        made = [_built(kind, x, f"{name}[{k}]", issues) for k, x in enumerate(given)]
        parts[name] = tuple(x for x in made if x is not None)
    contract = Contract(**parts)
    issues += contract_issues(contract, today)
    return dataclasses.replace(contract, waivers=tuple(w for w in contract.waivers if w.expires >= today)), issues


def load_text(text: str, today: dt.date) -> tuple[Contract, list[tuple[str, str]]]:
    """load() of a YAML or JSON text."""
    try:
        import yaml
    except ImportError:
        import json

        return load(json.loads(text), today)
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return Contract(), [("contract", str(e))]
    data = {} if data is None else data
    return load(data, today) if isinstance(data, Mapping) else (Contract(), [("contract", "is no mapping")])

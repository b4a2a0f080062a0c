"""Tables and contract types. Everything optional is nullable; ids are strings."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

FILES = "path string, language string, content_id string, loc int, parse_error string"
EDGES = "from_ string, to_ string, workspace string, package string, builtin boolean, specifier string, kind string, line int, analyzer string, unresolved boolean"
WORKSPACES = "name string, dir string"
COMMITS = "seq long, sha string, ts timestamp"
COMMIT_FILES = "seq long, sha string, path string, added long, deleted long"
FINDINGS = "rule string, kind string, level string, message string, from_ string, to_ string, file string, line int, fingerprint string, status string, heuristic boolean"
BASELINE = "fingerprint string, rule string, count int"
EDGE_KINDS = ("static", "type", "dynamic", "require", "reexport", "side-effect")
LEVELS = ("off", "info", "warn", "error")


@dataclass(frozen=True)
class Component:
    """A named part of the code base; the first component in order whose patterns match a file owns it."""

    id: str
    paths: tuple[str, ...]
    entrypoints: tuple[str, ...] = ()
    package: str | None = None
    deprecated: bool = False


@dataclass(frozen=True)
class Resource:
    id: str
    owner: str
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Rule:
    """kind: forbid, allow-only, layers, acyclic, independent, entrypoints, external-imports, state-owner, api-stability or deprecated. The other fields belong to some kinds each."""

    id: str
    kind: str
    level: str = "error"
    because: tuple[str, ...] = ()
    include_type_imports: bool = True
    from_: tuple[str, ...] = ()
    to_: tuple[str, ...] = ()
    scope: str | None = None
    layers: tuple[tuple[str, ...], ...] = ()
    allow_skip: bool = True
    within: tuple[str, ...] = ()
    members: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    entrypoints: tuple[str, ...] = ()
    allow: tuple[str, ...] | None = None
    forbid: tuple[str, ...] = ()
    packages: tuple[str, ...] = ()
    allow_from: tuple[str, ...] = ()
    allow_builtins: bool = False
    resources: tuple[str, ...] = ()
    components: tuple[str, ...] = ()
    allow_growth: bool = True


@dataclass(frozen=True)
class Waiver:
    rule: str
    from_: str
    to_: str | None
    expires: dt.date


@dataclass(frozen=True)
class Contract:
    components: tuple[Component, ...] = ()
    resources: tuple[Resource, ...] = ()
    rules: tuple[Rule, ...] = ()
    waivers: tuple[Waiver, ...] = field(default=())

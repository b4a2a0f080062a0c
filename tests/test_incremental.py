"""Edits of a kept version against checks of the whole, and graph searches against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract, graph
from tessera.plans import check, incremental
from tessera.schemas import Component, Contract, Resource, Rule, Waiver

TODAY = dt.date(2026, 9, 26)
PARTS = ("a", "b", "c", "d")
CONTRACT = Contract(
    tuple(Component(p, (f"src/{p}",)) for p in PARTS),
    (Resource("orders", "b", ("prisma:order",)),),
    (
        Rule("no-cycles", "acyclic"), Rule("no-file-cycles", "acyclic", scope="files", include_type_imports=False), Rule("some-cycles", "acyclic", "warn", within=("a", "b")), Rule("layers", "layers", layers=(("a",), ("b",), ("c",), ("d",))),
        Rule("no-packages", "external-imports", from_=("d",), allow=("react",)), Rule("owner", "state-owner"),
    ),
    (Waiver("layers", "c", "a", dt.date(2027, 1, 1)),),
)
FINDING = ("rule", "from_", "to_", "file", "line", "fingerprint", "status", "level", "message")


class Code:
    """A made-up code base: scripts that import each other with and without endings, folders with an index, packages, type imports, some paths that lead nowhere, Python modules, and writes."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.files: dict[str, str] = {}
        for p in PARTS:
            for k in range(5):
                self.write(f"src/{p}/m{k}.ts")
        for k in range(4):
            self.write(f"py/m{k}.py")

    def write(self, path: str) -> None:
        r, lines = self.r, []
        for _ in range(r.randrange(4)):
            if path.endswith(".py"):
                lines.append(r.choice([f"import py.m{r.randrange(6)}", f"from py import m{r.randrange(6)}", "import numpy", f"from .m{r.randrange(6)} import x"]))
                continue
            to = f"../{r.choice(PARTS)}/{r.choice(['m', 'n'])}{r.randrange(6)}{r.choice(['', '', '.js'])}"
            lines.append(r.choice([f'import {{ x }} from "{to}";', f'import {{ x }} from "{to}";', f'import type {{ X }} from "{to}";', 'import { y } from "react";', 'import z from "lodash";', f'export * from "{to}";', "prisma.order.create({});"]))
        self.files[path] = "\n".join(lines)

    def edit(self) -> tuple[set[str], set[str]]:
        r, edited, deleted = self.r, set(), set()
        for _ in range(r.randrange(1, 4)):
            path = r.choice(sorted(self.files))
            self.write(path)
            edited.add(path)
        for _ in range(r.randrange(3)):
            new = r.choice([f"src/{r.choice(PARTS)}/{r.choice(['m', 'n'])}{r.randrange(6)}{r.choice(['.ts', '/index.ts', '.d.ts', '.js'])}", f"py/m{r.randrange(6)}.py", f"py/m{r.randrange(6)}/__init__.py"])
            self.write(new)
            edited.add(new)
        for _ in range(r.randrange(2)):
            path = r.choice(sorted(self.files))
            del self.files[path]
            deleted.add(path)
        return {p for p in edited if p in self.files}, deleted - set(self.files)


@pytest.mark.parametrize("seed", range(2))
def test_edits_like_a_full_check(spark, seed):
    code = Code(seed)
    none = spark.createDataFrame([], "name string, dir string")
    table = lambda: spark.createDataFrame(sorted(code.files.items()), "path string, text string")
    paths = lambda names: spark.createDataFrame([(n,) for n in sorted(names)], "path string")
    kept = incremental.start(table(), none, CONTRACT, parts=8)
    for _ in range(2):
        edited, deleted = code.edit()
        kept, found = incremental.edit(kept, table(), paths(edited), paths(deleted), TODAY)
        whole = check.code_graph(table(), none, CONTRACT)
        columns = [c for c in whole.columns if c not in ("src", "dst")]
        rows = lambda d: sorted(map(tuple, d.select(*columns, F.col("src.component"), F.col("dst.component")).distinct().collect()), key=repr)  # noqa: B023, E731
        assert rows(kept.edges(spark)) == rows(whole)
        want = check.check(whole, CONTRACT, TODAY, None, extract.write_sites(table(), CONTRACT.resources), paths(edited))
        told = lambda d: sorted(set(map(tuple, d.select(*FINDING).collect())), key=repr)
        assert told(found) == told(want)


def brute_components(nodes, pairs):
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
    out = {}
    for n in nodes:
        own = {m for m in reach[n] if n in reach[m]}
        if len(own) > 1:
            out[n] = min(own)
    return out


def test_updated_components(spark):
    r = random.Random(4)
    nodes = [f"n{k:02}" for k in range(24)]
    pairs = {(r.choice(nodes), r.choice(nodes)) for _ in range(30)}
    df = lambda p: spark.createDataFrame(sorted(p), "a string, b string")
    kept = graph.strong_components(df(pairs))
    for _ in range(3):
        removed = set(r.sample(sorted(pairs), r.randrange(4)))
        added = {(r.choice(nodes), r.choice(nodes)) for _ in range(r.randrange(5))} - pairs
        pairs = (pairs - removed) | added
        kept = graph.updated_components(df(pairs), kept, df(added), df(removed))
        assert {x.node: x.scc for x in kept.collect()} == brute_components(nodes, pairs)


def test_clusters_in_few_rounds(spark, monkeypatch):
    """A chain of 10,000 nodes, a ring, a star, a loop and a pair: no more than 20 rounds."""
    rounds = []
    kept = graph.settle
    monkeypatch.setattr(graph, "settle", lambda d, tag: rounds.append(tag) or kept(d, tag))
    r = random.Random(1)
    names = r.sample(range(100_000), 10_000)
    pairs = list(zip(names, names[1:], strict=False)) + [(200_000 + k, 200_000 + (k + 1) % 50) for k in range(50)] + [(300_000, 300_001 + k) for k in range(300)] + [(400_000, 400_000), (500_001, 500_000)]
    got = {x.node: x.root for x in graph.clusters(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: min(names) for n in names} | {200_000 + k: 200_000 for k in range(50)} | {300_000 + k: 300_000 for k in range(301)} | {400_000: 400_000, 500_000: 500_000, 500_001: 500_000}
    assert got == want and rounds.count("cluster-large") <= 20

"""Specifier patterns of compiler settings and packages, from files to edges."""

import json

from tessera.operators import patterns
from tessera.plans import check
from tessera.schemas import Component, Contract

CONTRACT = Contract((Component("all", ("**",)),))
TEXTS = {
    "tsconfig.json": '{ // mappings\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "@/ui/*": ["ui/*", "old/*"], "@/ui/exact": ["special.ts"], "*.css": ["styles/*.ts"], "lib-*-v2": ["libs/*/index"], /* more */ "@/gone/*": ["none/*"],}}}',
    "packages/p/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./own/*"]}}}',
    "packages/p/package.json": json.dumps({"name": "@x/p", "imports": {"#int/*": "./src/*.ts", "#cond": {"browser": "./src/b.ts", "default": "./src/c.ts", "import": {"types": "./src/t.ts", "default": "./src/c.ts"}}, "#out": "lodash", "#lost": "./src/none.ts"}, "exports": {".": "./src/index.ts", "./*": {"import": "./src/*.ts"}, "./feature/*/deep": "./src/deep/*.ts", "./feature/*": "./src/f/*.ts"}}),
    "packages/q/package.json": json.dumps({"name": "q", "exports": {"require": "./r.ts", "import": "./i.ts"}}),
    "bad/tsconfig.json": "{", "bad/package.json": "[1]",
}
FILES = ["src/a.ts", "src/ui/b.ts", "src/old/c.tsx", "src/special.ts", "src/styles/x.ts", "src/libs/z/index.ts", "packages/p/own/a.ts", "packages/p/src/k.ts", "packages/p/src/c.ts", "packages/p/src/t.ts", "packages/p/src/index.ts", "packages/p/src/m.ts", "packages/p/src/deep/d.ts", "packages/p/src/f/g.ts", "packages/q/i.ts", "packages/q/r.ts"]
#: From where, what, and where it leads: a file, a package (pkg:) or nowhere.
CASES = [
    ("src/main.ts", "@/a", "src/a.ts"), ("src/main.ts", "@/ui/b", "src/ui/b.ts"), ("src/main.ts", "@/ui/c.js", "src/old/c.tsx"), ("src/main.ts", "@/ui/exact", "src/special.ts"), ("src/main.ts", "x.css", "src/styles/x.ts"), ("src/main.ts", "lib-z-v2", "src/libs/z/index.ts"),
    ("src/main.ts", "lib-z-v3", "pkg:lib-z-v3"), ("src/main.ts", "@/gone/x", None), ("src/main.ts", "@x/p", "packages/p/src/index.ts"), ("src/main.ts", "@x/p/m", "packages/p/src/m.ts"), ("src/main.ts", "@x/p/feature/d/deep", "packages/p/src/deep/d.ts"), ("src/main.ts", "@x/p/feature/g", "packages/p/src/f/g.ts"), ("src/main.ts", "q", "packages/q/i.ts"),
    ("src/main.ts", "#int/k", None), ("packages/p/main.ts", "@/a", "packages/p/own/a.ts"), ("packages/p/main.ts", "#int/k", "packages/p/src/k.ts"), ("packages/p/main.ts", "#cond", "packages/p/src/t.ts"), ("packages/p/main.ts", "#lost", None), ("packages/p/main.ts", "react", "pkg:react"), ("packages/p/main.ts", "./own/a", "packages/p/own/a.ts"),
]


def test_patterns(spark):
    mains = {}
    for at, specifier, _ in CASES:
        mains.setdefault(at, []).append(f'import "{specifier}";')
    rows = [*TEXTS.items(), *((f, "") for f in FILES), *((p, "\n".join(x)) for p, x in mains.items())]
    files = spark.createDataFrame(rows, "path string, text string").repartition(3)
    settings = patterns.path_mappings(files).union(patterns.package_patterns(files))
    edges = check.code_graph(files, spark.createDataFrame([], "name string, dir string"), CONTRACT, settings=settings)
    got = {(r.from_, r.specifier): r.to_ if r.to_ else f"pkg:{r.package}" if r.package else None for r in edges.collect()}
    assert got == {(a, b): c for a, b, c in CASES}
    assert {r.specifier for r in edges.where("unresolved").collect()} == {"#int/k", "#lost", "@/gone/x"}


def test_no_patterns(spark):
    files = spark.createDataFrame([("a.ts", 'import "./b";\nimport "x";'), ("b.ts", "")], "path string, text string")
    none = spark.createDataFrame([], patterns.PATTERNS)
    edges = check.code_graph(files, spark.createDataFrame([], "name string, dir string"), CONTRACT, settings=none)
    assert {(r.to_, r.package) for r in edges.collect()} == {("b.ts", None), (None, "x")}
    assert patterns.path_mappings(files.limit(0)).union(patterns.package_patterns(files.limit(0))).count() == 0

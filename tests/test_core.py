"""Literal cases of the structural operators."""

import datetime as dt
import json
import random
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions.globs import patterns_regex, to_regex
from tessera.functions.hashing import content_id, cycle_fingerprint, edge_fingerprint, fingerprint
from tessera.functions.text import collapse, decision_id, normalize_signature, slug, token_estimate, tokens
from tessera.operators import diff, extract, graph, history, mapping, metrics, report, resolve, rules, search, surface
from tessera.operators import findings as FN
from tessera.plans import check as plans
from tessera.schemas import EDGES, Component, Contract, Resource, Rule, Waiver
from tessera.sources import documents, files, git
from tessera.streaming import sessions

TODAY = dt.date(2026, 9, 26)
STARS = "file string, at int, specifier string, target string"
SHOP = (Component("app", ("src/app",)), Component("domain", ("src/domain",), ("src/domain/index.ts",)), Component("infra", ("src/infra",)))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def edges(spark, rows, components=SHOP, owners=None):
    """rows: from, to (or pkg:name, or node:name), kind, line."""
    full = [(a, None if b.startswith(("pkg:", "node:")) else b, None, b.removeprefix("pkg:") if b.startswith(("pkg:", "node:")) else None, b.startswith("node:"), b, k, n, "test", False) for a, b, k, n in rows]
    return mapping.with_endpoints(spark.createDataFrame(full, EDGES), components, owners)


@pytest.mark.parametrize("pattern, path, want", [
    ("src/app", "src/app/a/b.ts", True), ("src/app", "src/apps/a.ts", False), ("src/app/", "src/app/x", True), ("./src/*.ts", "src/a.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/**/*.ts", "src/b.ts", True), ("src/**/*.ts", "src/a/c/b.ts", True),
    ("**/x", "x", True), ("**/*.{ts,tsx}", "a/.hid.tsx", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("src/a.ts", "src/a.ts", True), ("src/a+b", "src/a+b/c", True),
])
def test_globs(spark, pattern, path, want):
    assert one(spark, F.lit(path).rlike(patterns_regex([pattern])))[0] is want


def test_globs_refuse():
    assert patterns_regex([]) is None
    for bad in ("+(a|b)", "!x", "{a,b"):
        with pytest.raises(ValueError):
            to_regex(bad)


def test_fingerprints(spark):
    row = one(spark, edge_fingerprint("domain-is-pure", F.lit("src/domain/order.ts"), F.lit("src/infra/db.ts"), F.lit("static")), edge_fingerprint("layering", F.lit("src/domain/order.ts"), F.lit("src/infra/db.ts"), F.lit("static")), cycle_fingerprint("no-cycles", F.array(F.lit("infra"), F.lit("domain"))), fingerprint("a", F.lit(None).cast("string"), "b"), content_id(F.lit("hello\n")))
    assert row[:3] == ("7077b3adbec19633", "05025bbefc0ff413", "a9aedfe53d11dac6")
    assert row[3] == one(spark, F.substring(F.sha2(F.lit("a\0\0b"), 256), 1, 16))[0]
    assert row[4] == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_shop(spark):
    e = edges(spark, [
        ("src/app/checkout.ts", "pkg:lodash", "static", 1), ("src/app/checkout.ts", "src/domain/index.ts", "static", 2), ("src/domain/index.ts", "src/domain/order.ts", "reexport", 1), ("src/domain/index.ts", "src/domain/money.ts", "reexport", 2),
        ("src/domain/order.ts", "src/infra/db.ts", "static", 1), ("src/domain/order.ts", "src/domain/money.ts", "type", 2), ("src/infra/db.ts", "src/domain/order.ts", "type", 1),
    ])
    contract = Contract(SHOP, rules=(
        Rule("domain-is-pure", "forbid", from_=("domain",), to_=("infra",)), Rule("layering", "layers", layers=(("app",), ("infra",), ("domain",))), Rule("no-cycles", "acyclic"), Rule("domain-entrypoint", "entrypoints", "warn", targets=("domain",)),
        Rule("domain-no-packages", "external-imports", from_=("domain",), allow=()), Rule("silent", "forbid", "off", from_=("*",), to_=("*",)),
    ))
    baseline = spark.createDataFrame([("a9aedfe53d11dac6", "no-cycles", 1)], "fingerprint string, rule string, count int")
    got = plans.check(e, contract, TODAY, baseline)
    assert {(r.rule, r.status, r.level, r.from_, r.to_, r.file, r.line, r.fingerprint) for r in got.collect()} == {
        ("domain-is-pure", "new", "error", "domain", "infra", "src/domain/order.ts", 1, "7077b3adbec19633"), ("layering", "new", "error", "domain", "infra", "src/domain/order.ts", 1, "05025bbefc0ff413"),
        ("no-cycles", "baselined", "error", "domain", None, "src/domain/order.ts", 1, "a9aedfe53d11dac6"), ("domain-entrypoint", "new", "warn", "infra", "domain", "src/infra/db.ts", 1, "e23cf1e30d963b29"),
    }
    s = rules.summary(got)
    assert tuple(s.first()) == (2, 1, 0, 0, 1, 0) and report.exit_code(s) == 1
    head = edges(spark, [("src/domain/order.ts", "src/infra/db.ts", "static", 1), ("src/domain/tax.ts", "pkg:lodash", "static", 1), ("src/domain/tax.ts", "src/infra/db.ts", "static", 2), ("src/infra/db.ts", "src/domain/order.ts", "type", 1)])
    delta = plans.compare(e, head, contract, TODAY, baseline)
    assert {(r.fingerprint, r.status) for r in delta.collect() if r.status == "new"} == {(f, "new") for f in ("d370805b231eb738", "d407830f0852c187", "372f88439cdb617f")}
    assert delta.where("status = 'existing'").count() == 3


def found(spark, e, *rule, **more):
    return sorted((r.rule, r.file, r.to_, r.line, r.status) for r in rules.edge_findings(e, rule, more.pop("components", SHOP), **more).collect())


def test_rules(spark):
    e = edges(spark, [("src/domain/order.ts", "src/infra/db.ts", "static", 3), ("src/domain/order.ts", "src/infra/db.ts", "static", 9), ("src/app/a.ts", "src/infra/db.ts", "type", 1), ("src/domain/a.ts", "src/domain/b.ts", "static", 1), ("src/domain/a.ts", "lib/x.ts", "static", 2), ("src/domain/a.ts", "pkg:zod", "static", 3), ("src/domain/a.ts", "node:fs", "static", 4), ("src/infra/x.ts", "src/domain/y.ts", "static", 5)])
    to = lambda *r: [(x[1], x[2]) for x in found(spark, e, *r)]
    assert to(Rule("f", "forbid", from_=("domain",), to_=("infra",))) == [("src/domain/order.ts", "infra")] * 2
    assert to(Rule("f", "forbid", from_=("app",), to_=("infra",), include_type_imports=False)) == []
    assert to(Rule("a", "allow-only", from_=("domain",), to_=("pkg:zod",))) == [("src/domain/a.ts", "lib/x.ts"), ("src/domain/order.ts", "infra"), ("src/domain/order.ts", "infra")]
    assert ("src/domain/a.ts", "node:fs") in to(Rule("a", "allow-only", from_=("domain",), to_=("pkg:zod",), scope="all"))
    layers = (("app",), ("domain",), ("infra",))
    assert to(Rule("l", "layers", layers=layers)) == [("src/infra/x.ts", "domain")]
    assert to(Rule("l", "layers", layers=layers, allow_skip=False)) == [("src/app/a.ts", "infra"), ("src/infra/x.ts", "domain")]
    assert to(Rule("i", "independent", members=("app", "infra"))) == [("src/app/a.ts", "infra")]
    assert to(Rule("e", "entrypoints", targets=("domain",))) == [("src/infra/x.ts", "domain")]
    assert to(Rule("e", "entrypoints", targets=("domain",), entrypoints=("src/domain/y.ts",))) == []
    assert to(Rule("x", "external-imports", from_=("domain",), allow=("zod",))) == [("src/domain/a.ts", "node:fs")]
    assert to(Rule("x", "external-imports", from_=("domain",), allow=(), allow_builtins=True)) == [("src/domain/a.ts", "zod")]
    assert to(Rule("x", "external-imports", packages=("node:*",), allow_from=("app",), allow_builtins=True)) == [("src/domain/a.ts", "node:fs")]
    assert found(spark, e) == []
    only = spark.createDataFrame([("src/app/a.ts",)], "path string")
    assert found(spark, e, Rule("f", "forbid", from_=("*",), to_=("infra",)), changed=only) == [("f", "src/app/a.ts", "infra", 1, "new")]


def test_waivers(spark):
    e = edges(spark, [("src/domain/order.ts", "src/infra/db.ts", "static", 3)])
    rule, held = Rule("f", "forbid", from_=("domain",), to_=("infra",)), [Waiver("f", "path:src/domain/**", None, dt.date(2026, 12, 1))]
    for day, status in ((dt.date(2026, 12, 1), "waived"), (dt.date(2026, 12, 2), "new")):
        assert found(spark, e, rule, waivers=held, today=day)[0][4] == status


def test_state_owner(spark):
    writes = extract.write_sites(spark.createDataFrame([("src/app/a.ts", "x = ctx.db.insert('users')\n// ctx.db.insert('users')\nsql`INSERT INTO users (a)`\nctx.db.insert('usersOld')"), ("lib/b.ts", "await ctx.db.patch(userId, x)"), ("src/infra/c.ts", "ctx.db.delete(user._id)")], "path string, text string"), [Resource("store", "infra", ("convex:users", "sql:users"))])
    assert sorted((r.file, r.line) for r in writes.collect()) == [("lib/b.ts", 1), ("src/app/a.ts", 1), ("src/app/a.ts", 3), ("src/infra/c.ts", 1)]
    got = rules.state_findings(writes, Rule("s", "state-owner", "warn"), [Resource("store", "infra")], SHOP)
    assert sorted((r.file, r.heuristic) for r in got.collect()) == [("lib/b.ts", True), ("src/app/a.ts", True), ("src/app/a.ts", True)]


def test_baseline(spark):
    f = spark.createDataFrame([("r", "k", lv, "m", "a", "b", file, n, fp, st, False) for lv, file, n, fp, st in (("error", "b", 1, "x", "new"), ("error", "a", 9, "x", "new"), ("error", "a", 2, "x", "new"), ("info", "a", 1, "x", "new"), ("error", "a", 1, "y", "waived"), ("warn", None, None, "z", "new"))], "rule string, kind string, level string, message string, from_ string, to_ string, file string, line int, fingerprint string, status string, heuristic boolean")
    base = spark.createDataFrame([("x", "r", 2), ("x", "r", 1), ("y", "r", 3), ("q", "r", 1)], "fingerprint string, rule string, count int")
    assert {(r.file, r.line, r.level): r.status for r in rules.apply_baseline(f, base).collect()} == {("a", 2, "error"): "baselined", ("a", 9, "error"): "baselined", ("b", 1, "error"): "new", ("a", 1, "info"): "new", ("a", 1, "error"): "waived", (None, None, "warn"): "new"}
    assert {(r.fingerprint, r.fixed) for r in rules.baseline_fixed(f, base).collect()} == {("y", 2), ("q", 1)}
    assert {(r.fingerprint, r["count"]) for r in rules.baseline_update(f, base.limit(1), grow=True).collect()} == {("x", 3), ("z", 1)}


def pairs(spark, *p):
    return spark.createDataFrame([tuple(x) for x in p], "a string, b string")


def test_graph(spark):
    scc = graph.strong_components(pairs(spark, "ca", "ac", "de", "ed", "bb", "ad", "ef", (None, "a")))
    assert sorted(map(tuple, scc.collect())) == [("a", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert graph.strong_components(pairs(spark, "ab", "bc")).count() == 0
    assert graph.strong_components(pairs(spark, "ab").limit(0)).count() == 0
    reach = {tuple(r) for r in graph.reachable(pairs(spark, "ab", "bc", "ca", "cd"), reflexive=True).collect()}
    assert len(reach) == 13 and ("d", "d") in reach and ("d", "a") not in reach
    assert {tuple(r) for r in graph.heights(pairs(spark, "ab", "bc", "cb", "cd", "ad")).collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 0)}
    assert {tuple(r) for r in graph.clusters(pairs(spark, "ab", "cb", "xy")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_graph_random(spark):
    import random

    r = random.Random(4)
    links = {(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(80)}
    nodes, reach = {x for p in links for x in p}, set(links)
    while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= more
    want = {(n, min(m for m in nodes if m == n or (n, m) in reach and (m, n) in reach)) for n in nodes if any(m != n and (n, m) in reach and (m, n) in reach for m in nodes)}
    assert {tuple(x) for x in graph.strong_components(pairs(spark, *links)).collect()} == want
    assert {tuple(x) for x in graph.mutual_components(pairs(spark, *links)).collect()} == want


def test_metrics(spark):
    e = edges(spark, [("src/app/a.ts", "src/domain/b.ts", "static", 1), ("src/app/a.ts", "src/domain/c.ts", "type", 2), ("src/domain/b.ts", "src/infra/c.ts", "static", 1)])
    g = metrics.component_graph(e)
    assert {(r.from_c, r.to_c, r.cnt, tuple(r.kinds), len(r.samples)) for r in g.collect()} == {("app", "domain", 2, ("static", "type"), 2), ("domain", "infra", 1, ("static",), 1)}
    own = spark.createDataFrame([("app", 10), ("domain", 20), ("infra", None)], "component string, loc int")
    m = metrics.coupling(spark.createDataFrame([("app",), ("domain",), ("infra",), ("alone",)], "component string"), own, g)
    assert {(r.component, r.fan_in, r.fan_out, r.instability) for r in m.collect()} == {("app", 0, 1, 1.0), ("domain", 1, 1, 0.5), ("infra", 1, 0, 0.0), ("alone", 0, 0, None)}
    assert metrics.propagation_cost(own, g).first().cost == pytest.approx(6 / 9)
    assert "c_app -->|2| c_domain" in report.mermaid(g) and '"domain" -> "infra" [label=1];' in report.dot(g)
    cycle = spark.createDataFrame([("domain", "domain"), ("infra", "domain")], "node string, scc string")
    assert "class c_domain,c_infra cycle" in report.mermaid(g, cycle) and '"infra" [color=red];' in report.dot(g, cycle)
    alone = spark.createDataFrame([("in-fra",), ("in.fra",)], "component string")
    assert {'  c_in_fra["in-fra"]', '  c_in_fra__2["in.fra"]'} <= set(report.mermaid(g, None, alone).split("\n"))


def test_history(spark):
    commits = [(s, i) for s, own in enumerate(["ab", "ab", "ab", "a", "a", "a", "xc", "xc"]) for i in own]
    got = history.cochange(spark.createDataFrame(commits, "sha long, item string"), 3, 0.5).collect()
    assert [tuple(r) for r in got] == [("a", "b", 3, 1.0)]
    lines = ["3\t1\tsrc/{ => sub}/f.ts", "1\t1\t{old => new}/f.ts", "-\t-\ta.png", "2\t0\ta.ts => b/c.ts", "5\t5\tplain.ts", ""]
    rows = history.numstat(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(r.added, r.deleted, r.old, r.path) for r in rows] == [(3, 1, "src/f.ts", "src/sub/f.ts"), (1, 1, "old/f.ts", "new/f.ts"), (0, 0, None, "a.png"), (2, 0, "a.ts", "b/c.ts"), (5, 5, None, "plain.ts")]
    changed = spark.createDataFrame([(0, "c"), (1, "c"), (2, "b"), (3, "b"), (4, "a"), (5, "a"), (5, "z")], "seq long, path string")
    renames = spark.createDataFrame([(1, "b", "c"), (3, "a", "b")], "seq long, old string, new string")
    assert sorted(map(tuple, history.renamed(changed, renames).collect())) == [(0, "c"), (1, "c"), (2, "c"), (3, "c"), (4, "c"), (5, "c"), (5, "z")]
    row = one(spark, history.months_before(F.lit("2026-03-31").cast("date"), 1), history.is_non_production(F.lit("src/Tests/a.ts")), history.is_non_production(F.lit("src/a.ts")))
    assert row[0] == dt.date(2026, 3, 3) and row[1] and not row[2]


def test_versions(spark):
    x = lambda rows: spark.createDataFrame(rows, "file string, name string, signature string, target string, original string")
    s = x([("i", "a", "a", "m", "a"), ("i", "own", "fn own()", None, None), ("m", "a", "fn a()", None, None), ("m", "own", "fn other()", None, None), ("m", "default", "fn d()", None, None), ("n", "b", "fn b()", None, None), ("i", "gone", "gone", "nowhere", "gone")])
    stars = spark.createDataFrame([("i", 0, "./m", "m"), ("m", 0, "./n", "n"), ("n", 0, "./i", "i")], STARS)
    got = {(r.name, r.origin, r.signature) for r in surface.public_surface(spark.createDataFrame([("i",)], "file string"), s, stars).collect()}
    assert got == {("a", "m", "fn a()"), ("own", "i", "fn own()"), ("b", "n", "fn b()"), ("gone", "nowhere", "gone")}
    y = lambda rows: spark.createDataFrame(rows, "component string, file string, name string, signature string")
    changes = diff.api_changes(y([("c", "f", "a", "fn( x: A , )"), ("c", "f", "b", "1"), ("c", "f", "d", "1")]), y([("c", "f", "a", "fn(x:A)"), ("c", "f", "b", "2"), ("c", "f", "e", "1"), ("c", "g", "e", "1")]))
    assert {(r.file, r.name, r.change) for r in diff.first_seen_change(changes).collect()} == {("f", "b", "changed"), ("f", "d", "removed"), ("f", "e", "added")}
    w = lambda rows: spark.createDataFrame([(r, a, b, dt.date.fromisoformat(d)) for r, a, b, d in rows], "rule string, from_ string, to_ string, expires date")
    got = diff.waiver_changes(w([("r", "a", None, "2026-01-01"), ("r", "b", "c", "2027-01-01")]), w([("r", "a", None, "2026-12-01"), ("r", "b", "c", "2026-12-01"), ("r", "n", None, "2026-12-01"), ("r", "o", None, "2026-01-01")]), "2026-09-26")
    assert {(r.from_, r.change) for r in got.collect()} == {("a", "extended"), ("n", "added")}
    d = lambda rows: spark.createDataFrame(rows, "id string, status string, weakens array<string>")
    got = diff.approvals(spark.createDataFrame([("r",), ("s",), ("t",)], "rule string"), d([("0001", "accepted", ["s"])]), d([("0001", "accepted", ["s", "r"]), ("0002", "accepted", ["r"]), ("0003", "proposed", ["t"])]))
    assert {(r.rule, r.approved_by) for r in got.collect()} == {("r", "0001"), ("s", None), ("t", None)}


def test_text(spark):
    row = one(spark, tokens(F.lit("The classes of a Boss, and 2 x routers: routers!")), collapse(F.lit("  a \n b ")), normalize_signature(F.lit("fn( a : A,\n b: B, ): { x: C; }")), slug(F.lit("Keep the Domain pure!")), decision_id(F.lit("ADR-7")), decision_id(F.lit("none")), token_estimate(F.lit("12345")))
    assert row[0] == ["classe", "boss", "router", "router"] and row[1] == "a b" and row[2] == "fn(a:A,b:B):{x:C;}" and row[3] == "keep-the-domain-pure" and row[4] == "0007" and row[5] is None and row[6] == 2
    docs = spark.createDataFrame([("a", "cat cat dog"), ("b", "dog"), ("c", "bird dog cat"), ("d", None)], "id string, text string")
    assert [r.id for r in search.bm25(docs, "the cat", 10).collect()] == ["a", "c"]
    assert search.bm25(docs, "the", 10).count() == 0
    quotes = spark.createDataFrame([("q", "a", "cat\n dog"), ("p", "a", "dog cat"), ("r", "x", "cat")], "id string, source string, quote string")
    assert {(r.id, r.found) for r in search.evidence(quotes, docs.withColumnRenamed("id", "source")).collect()} == {("q", True), ("p", False), ("r", False)}
    rows = spark.createDataFrame([(f"{k:03}",) for k in range(50)], "key string")
    page, mark = search.page(rows, 10, 5)
    assert [r.key for r in page.collect()] == ["010", "011", "012", "013", "014"]
    with pytest.raises(ValueError):
        search.page(rows.limit(49), 10, 5, mark)


def test_decisions(spark):
    text = "---\ntitle: Keep it\nstatus: superseded by 0004\ngoverns: [domain, app]\nweakens:\n  - rule-a\n  - 'rule-b'\nassumptions:\n  - check: no-cycles\n---\nBody"
    got = documents.decisions(spark.createDataFrame([("d/0002-keep.md", text), ("d/3.md", "# Plain\n\nStatus: Accepted\n"), ("d/readme.md", "x")], "path string, text string")).collect()
    by = {r.id: r for r in got}
    assert set(by) == {"0002", "0003"} and by["0002"].status == "superseded" and by["0002"].superseded_by == "0004" and by["0002"].governs == ["domain", "app"] and by["0002"].weakens == ["rule-a", "rule-b"] and by["0002"].checks == ["no-cycles"] and by["0002"].body == "Body"
    assert by["0003"].title == "Plain" and by["0003"].status == "accepted"
    d = spark.createDataFrame([("0001", "accepted", ["gone"], ["no-rule"]), ("0002", "superseded", ["app"], []), ("0003", "accepted", ["app", "gone"], ["r"])], "id string, status string, governs array<string>, checks array<string>")
    d2 = d.union(spark.createDataFrame([("0004", "accepted", ["*", "src/domain/**", "src/none/**", "src/app"], []), ("0005", "proposed", ["gone"], ["lost"]), ("0006", "rejected", [], ["lost"])], d.schema))
    paths = spark.createDataFrame([("src/domain/a.ts",), ("src/app/b.ts",)], "path string")
    assert {tuple(r) for r in search.stale_governs(d2, spark.createDataFrame([("app",)], "component string"), paths).collect()} == {("0001", "gone"), ("0003", "gone"), ("0004", "src/none/**")}
    r = spark.createDataFrame([("r", ["0002", "ADR 1"])], "rule string, because array<string>")
    assert [(x.rule, x.decision) for x in search.retired_citations(r, d).collect()] == [("r", "0002")]
    assert {x.id for x in search.unchecked_assumptions(d2, r).collect()} == {"0001", "0005"}


def test_extract_and_resolve(spark):
    texts = [
        ("src/app/a.ts", "import x from '../lib/b.js';\nimport type { T } from './t';\n// import no from 'no';\nimport 'side';\n/* import q from 'q'; */ export * from \"../lib\";\nconst y = require('node:fs');\nawait import('@acme/util/deep');\nimport { a,\n  b as c } from '@/lib/b';\nimport z from './missing';"),
        ("src/lib/b.ts", "export const b = 1;"), ("src/lib/index.ts", "export function f(a: A): B {\n}\nexport default class K extends L {}\nexport { x as y, z } from './b';"), ("src/app/t.ts", "export type T = 1"), ("packages/util/src/deep.ts", "export {}"), ("packages/util/package.json", '{"name": "@acme/util"}'), ("package.json", '{"name": "root", "workspaces": {"packages": ["./packages/*/", "!packages/old"]}}'), ("packages/old/package.json", '{"name": "old"}'), ("packages/util/node_modules/x/package.json", '{"name": "x"}'), ("tools/package.json", '{"name": "tools"}'), ("packages/noname/package.json", "{}"),
        ("py/shop/order.py", "from __future__ import annotations\nimport os, shop.db\nfrom . import money\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    from .infra import db\nimport importlib\nimportlib.import_module('shop.lost')\nimport numpy.linalg"), ("py/shop/__init__.py", ""), ("py/shop/db.py", ""), ("py/shop/money.py", ""), ("py/shop/infra/__init__.py", ""), ("py/bad.py", "def ("),
    ]
    f = spark.createDataFrame(texts, "path string, text string")
    imports = extract.script_imports(f.where("path like '%.ts'"))
    assert {(r.specifier, r.kind, r.line) for r in imports.where("path = 'src/app/a.ts'").collect()} == {("../lib/b.js", "static", 1), ("./t", "type", 2), ("side", "side-effect", 4), ("../lib", "reexport", 5), ("node:fs", "require", 6), ("@acme/util/deep", "dynamic", 7), ("@/lib/b", "static", 8), ("./missing", "static", 10)}
    spaces = files.workspaces(f)
    assert [tuple(r) for r in spaces.collect()] == [("@acme/util", "packages/util")]
    assert files.workspace_patterns('{"workspaces": ["a/*"]}', "packages:\n  - 'b/**'\n  # c\n  - \"!b/x\"\n  - d/\nother:\n  - e\n") == (["a/*", "b/**", "d"], ["b/x"])
    assert files.workspace_patterns("not json", "packages: [a, 'b/*']") == (["a", "b/*"], [])
    got = {r.specifier: (r.to_, r.workspace, r.package, r.builtin, r.unresolved) for r in resolve.resolve_scripts(imports, f, spaces, [("@/", "src/")]).where("from_ = 'src/app/a.ts'").collect()}
    assert got == {"../lib/b.js": ("src/lib/b.ts", None, None, None, False), "./t": ("src/app/t.ts", None, None, None, False), "side": (None, None, "side", False, False), "../lib": ("src/lib/index.ts", None, None, None, False), "node:fs": (None, None, "node:fs", True, False), "@acme/util/deep": ("packages/util/src/deep.ts", "@acme/util", None, None, False), "@/lib/b": ("src/lib/b.ts", None, None, None, False), "./missing": (None, None, None, None, True)}
    ex = {(r.name, r.target, r.original) for r in extract.script_exports(f.where("path = 'src/lib/index.ts'")).collect()}
    assert ex == {("f", None, None), ("default", None, None), ("y", "./b", "x"), ("z", "./b", "z")}
    py = extract.python_imports(f.where("path like '%.py'"))
    assert py.where("kind = 'error'").select("path").first()[0] == "py/bad.py"
    got = {(r.specifier, r.kind): (r.to_, r.package, r.builtin, r.unresolved) for r in resolve.resolve_python(py, f, ("py",)).collect()}
    assert got[("shop.db", "static")] == ("py/shop/db.py", None, None, False) and got[("os", "static")] == (None, "os", True, False) and got[(".", "static")] == ("py/shop/money.py", None, None, False)
    assert got[(".infra", "type")] == ("py/shop/infra/__init__.py", None, None, False) and got[("shop.lost", "dynamic")] == (None, None, None, True) and got[("numpy.linalg", "static")] == (None, "numpy", False, False)
    contract = Contract((Component("app", ("src/app",)), Component("lib", ("src/lib",)), Component("util", ("packages/util",))), rules=(Rule("r", "forbid", from_=("app",), to_=("util",)),))
    e = plans.code_graph(f, spaces, contract, [("@/", "src/")], ("py",))
    assert [r.to_ for r in plans.check(e, contract, TODAY).collect()] == ["util"]


def test_sources(spark, tmp_path):
    repo = tmp_path / "r"
    (repo / "src").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(repo), *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "src/a.ts").write_text("one\n")
    (repo / "b.bin").write_bytes(b"a\0b")
    run("add", ".")
    run("commit", "-qm", "one")
    (repo / "src/a.ts").rename(repo / "src/c.ts")
    run("add", "-A")
    run("commit", "-qm", "two")
    git.register(spark)
    tree = spark.read.format("git_tree").option("path", str(repo)).load().collect()
    assert [(r.path, r.text) for r in tree] == [("src/c.ts", "one\n")]
    log = history.numstat(spark.read.format("git_log").option("path", str(repo)).load()).collect()
    assert {(r.seq, r.old, r.path) for r in log} == {(0, "src/a.ts", "src/c.ts"), (1, None, "b.bin"), (1, None, "src/a.ts")}
    (repo / "node_modules").mkdir()
    (repo / "node_modules/x.ts").write_text("x")
    got = files.read_folder(spark, str(repo)).collect()
    assert [(r.path, r.text, r.content_id == tree[0].content_id) for r in got] == [("src/c.ts", "one\n", True)]
    f = spark.createDataFrame([("src/a.TS", "a\n\n b", "1"), ("x/dist/a.ts", "", "2"), ("m.rs", "x", "3"), ("readme", "", "4")], "path string, text string, content_id string")
    own = files.source_files(f)
    assert {(r.path, r.language, r.loc) for r in own.collect()} == {("src/a.TS", "typescript", 2), ("m.rs", "rust", 1)}
    assert [tuple(r) for r in files.not_analyzed(own).collect()] == [("rust", 1)]
    assert {tuple(r) for r in files.changed_files(f, f.where("path <> 'm.rs'").withColumn("content_id", F.lit("1"))).collect()} == {("m.rs", True), ("x/dist/a.ts", False), ("readme", False)}
    patch = "*** Begin\n*** Add File: a\n+x\n*** Update File: b\n*** Move to: c\n*** Delete File: d\n*** Add File: d\n"
    assert {(r.path, r.deleted) for r in files.patch_paths(spark.createDataFrame([(1, patch)], "id long, text string")).collect()} == {("a", False), ("b", True), ("c", False), ("d", False)}


def test_report(spark):
    f = spark.createDataFrame([("r", "k", "warn", "a | <b>", "a", "b", "f.ts", 2, "x", "new", False), ("r", "k", "error", "m", "a", "b", "f.ts", 1, "y", "new", False), ("r", "k", "error", "m", "a", "b", "f.ts", 1, "z", "waived", False)], "rule string, kind string, level string, message string, from_ string, to_ string, file string, line int, fingerprint string, status string, heuristic boolean")
    assert [json.loads(r.value)["fingerprint"] for r in report.json_lines(f).collect()] == ["y", "z", "x"]
    assert "a \\| &lt;b> |" in report.markdown(f) and "### Waived: 1" in report.markdown(f)
    many = f.union(f).union(f)
    assert report.markdown(many, 2).count("1 more.") == 3 and [r.value for r in report.text_lines(f.where("status = 'waived'")).collect()] == ["error  r  m  [waived]", "  at f.ts:1"]
    run = json.loads(report.sarif(f))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "warning"] and run["results"][0]["partialFingerprints"] == {"tessera/v1": "y"}


def test_sarif_weakenings(spark):
    f = spark.createDataFrame([("r", "k", "error", "m", "a", "b", "f.ts", 1, "x", "waived", False, "0003"), ("q", "k", "info", "n", "a", "b", None, None, "y", "new", False, None)], "rule string, kind string, level string, message string, from_ string, to_ string, file string, line int, fingerprint string, status string, heuristic boolean, approved_by string")
    w = spark.createDataFrame([("r", "baseline-grown", "one", None), ("r", "baseline-grown", "two", None), ("q", "rule-removed", "gone", None), ("s", "rule-removed", "gone", "0001")], "rule string, type string, message string, approved_by string")
    run = json.loads(report.sarif(f, w))["runs"][0]
    by = [(x["ruleId"], x["level"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], "suppressions" in x) for x in run["results"]]
    assert by == [("r", "note", "f.ts", True), ("q", "note", "contract.yaml", False)] + [("unapproved-weakening", "error", u, False) for u in ("contract.yaml", "baseline.json", "baseline.json")]
    assert len({x["partialFingerprints"]["tessera/v1"] for x in run["results"]}) == 5
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1} and run["results"][0]["message"]["text"] == "m Approved by decision 0003."


def test_brief(spark):
    items = spark.createDataFrame([(1, "a", "x" * 40), (2, "b", "x" * 400), (3, "c", "x" * 20)], "rank long, id string, markdown string")
    assert [r.id for r in plans.brief(items, 20).orderBy("rank").collect()] == ["a", "c"]


def test_built_in(spark):
    e = edges(spark, [("src/app/a.ts", "src/domain/b.ts", "static", 1)])
    f = spark.createDataFrame([("src/app/a.ts", 10, "app"), ("src/domain/b.ts", 10, "domain"), ("src/infra/c.ts", 5, "infra")], "path string, loc int, component string")
    changed = spark.createDataFrame([(str(k), p, 5, 1) for k in range(6) for p in ("src/app/a.ts", "src/infra/c.ts")], "sha string, path string, added long, deleted long")
    got = {(r.rule, r.from_, r.to_, r.file, r.level) for r in plans.built_in(e, f, SHOP, changed).collect()}
    assert got == {("hotspot", "app", None, "src/app/a.ts", "info"), ("hidden-change-coupling", "app", "infra", None, "info")}


def test_metric_findings(spark):
    parts = tuple(Component(c, (f"src/{c}",)) for c in "abcd")
    e = plans.mapping.with_endpoints(spark.createDataFrame([(f"src/{a}/x.ts", f"src/{b}/x.ts") for a, b in ("ab", "ac", "ba", "cd", "bd")], "from_ string, to_ string").selectExpr("from_", "to_", "cast(null as string) workspace", "cast(null as string) package", "false builtin", "to_ specifier", "'static' kind", "1 line", "false unresolved"), parts)
    f = spark.createDataFrame([("src/a/x.ts", 80, "a"), ("src/a/y.ts", 10, "a"), ("src/b/x.ts", 5, "b"), ("lost.ts", 40, None), ("src/c/x.test.ts", 999, "c")], "path string, loc int, component string")
    told = lambda *n: {(r.rule, r.from_, r.to_): r.message for r in FN.metric_findings(e, f, parts, *n).collect()}
    assert set(told()) == {("god-component", "a", None)} | {("unstable-dependency", a, b) for a, b in ()}
    assert "2 of 4 production files (50%) and 90 of 135 lines (67%)" in told()["god-component", "a", None]
    assert set(told(4, 9)) == set() and "Based on 4 of 5 source files." in told(4, 5)["god-component", "a", None]


def test_diff(spark):
    """The shop's comparison: three new errors, three existing ones, one in the baseline, one name more in the public surface, and what the structure and the contract say."""
    say = lambda rows: spark.createDataFrame(rows, "from_ string, to_ string, package string, specifier string, kind string, line int").selectExpr("from_", "to_", "cast(null as string) workspace", "package", "false builtin", "specifier", "kind", "line", "false unresolved")
    old = [("src/app/checkout.ts", None, "lodash", "lodash/chunk", "static", 1), ("src/app/checkout.ts", "src/domain/index.ts", None, "../domain/index.ts", "static", 2), ("src/domain/order.ts", "src/infra/db.ts", None, "../infra/db.ts", "static", 1), ("src/domain/order.ts", "src/domain/money.ts", None, "./money.ts", "type", 2), ("src/infra/db.ts", "src/domain/order.ts", None, "../domain/order.ts", "type", 1)]
    new = [*old, ("src/domain/tax.ts", None, "lodash", "lodash/chunk", "static", 1), ("src/domain/tax.ts", "src/infra/db.ts", None, "../infra/db.ts", "static", 2)]
    rules_ = (
        Rule("domain-is-pure", "forbid", from_=("domain",), to_=("infra",)), Rule("layering", "layers", layers=(("app",), ("infra",), ("domain",))), Rule("no-cycles", "acyclic"), Rule("domain-entrypoint", "entrypoints", "warn", targets=("domain",)),
        Rule("domain-no-packages", "external-imports", from_=("domain",), allow=()), Rule("stable", "api-stability", components=("domain",), allow_growth=False),
    )
    contract = Contract(SHOP, rules=rules_)
    base_files = [(p, 10) for p in ("src/app/checkout.ts", "src/domain/index.ts", "src/domain/order.ts", "src/domain/money.ts", "src/infra/db.ts")]
    files_ = lambda rows: spark.createDataFrame(rows, "path string, loc int")
    exports = lambda rows: spark.createDataFrame(rows, "file string, name string, signature string, target string, original string")
    was = [("src/domain/index.ts", "Order", "Order", "src/domain/order.ts", "Order"), ("src/domain/order.ts", "Order", "class Order", None, None)]
    now = [*was, ("src/domain/index.ts", "taxBatches", "taxBatches", "src/domain/tax.ts", "taxBatches"), ("src/domain/tax.ts", "taxBatches", "function taxBatches()", None, None)]
    stars = spark.createDataFrame([], STARS)
    held = spark.createDataFrame([("a9aedfe53d11dac6", "no-cycles", 1)], "fingerprint string, rule string, count int")
    said = "id string, file string, title string, status string, governs array<string>, weakens array<string>, assumptions array<struct<text:string,check:string,review_by:string>>"
    d1 = [("0002", "d/2.md", "Keep the domain pure", "accepted", ["domain"], [], [("it is small", "gone", "2020-01-01")])]
    texts = lambda x: spark.createDataFrame([("rules.yaml", x)], "path string, content_id string")
    base = plans.Version(contract, say(old), files_(base_files), None, exports(was), stars, spark.createDataFrame(d1, said), held, texts("1"))
    head = plans.Version(contract, say(new), files_([*base_files, ("src/domain/tax.ts", 4)]), None, exports(now), stars, spark.createDataFrame([*d1, ("0003", "d/3.md", "More", "accepted", ["lost"], ["stable"], [])], said), held, texts("2"))
    got = plans.diff(base, head, TODAY)
    rows_ = {(r.rule, r.status, r.file, r.fingerprint, r.approved_by) for r in got.findings.collect()}
    assert {r[3] for r in rows_ if r[1] == "new" and r[0] in {x.id for x in rules_}} == {"d370805b231eb738", "d407830f0852c187", "372f88439cdb617f"}
    assert {r[3] for r in rows_ if r[1] == "existing"} == {"7077b3adbec19633", "05025bbefc0ff413", "e23cf1e30d963b29"} and {r[3] for r in rows_ if r[1] == "baselined"} == {"a9aedfe53d11dac6"}
    assert {(r[0], r[2], r[4]) for r in rows_ if r[1] == "waived"} == {("stable", "src/domain/index.ts", "0003")}
    assert {(r[0], r[2]) for r in rows_ if r[1] == "new" and r[0] not in {x.id for x in rules_}} == {("stale-decision", "d/3.md"), ("contract-changed", "rules.yaml")}
    assert [(r.name, r.change) for r in got.api_changes.collect()] == [("taxBatches", "added")] and got.weakenings.count() == 0 and got.fixed.count() == 0
    # without the rules: the cycle was there before, and a new edge between components is told
    laxer = Contract(SHOP, rules=rules_[4:])
    more = plans.Version(laxer, say([*new, ("src/infra/db.ts", "src/app/checkout.ts", None, "../app/checkout.ts", "static", 3)]), head.files)
    told = plans.diff(plans.Version(laxer, base.edges, base.files), more, TODAY)
    assert {(r.rule, r.from_, r.to_) for r in told.findings.collect() if r.level == "info"} == {("new-component-edge", "infra", "app"), ("new-cycle", None, None), ("propagation-cost-rise", None, None)}
    # a waiver that comes, or goes, loses no findings: it is told of itself
    held = Waiver("domain-is-pure", "domain", None, dt.date(2027, 1, 1))
    waived = plans.Version(Contract(SHOP, rules=rules_, waivers=(held,)), base.edges, base.files)
    bare = plans.Version(contract, base.edges, base.files)
    assert "findings-lost" not in {r.type for r in plans.diff(bare, waived, TODAY).weakenings.collect()} and plans.diff(waived, bare, TODAY).weakenings.count() == 0
    held = spark.createDataFrame([("a9aedfe53d11dac6", "no-cycles", 1)], "fingerprint string, rule string, count int")
    loose = plans.diff(base, plans.Version(laxer, base.edges, base.files, baseline=held.withColumn("count", F.lit(3))), TODAY).weakenings
    assert {(r.type, r.rule) for r in loose.collect()} == {("rule-removed", x) for x in ("domain-is-pure", "layering", "no-cycles", "domain-entrypoint")} | {("baseline-grown", "no-cycles")}


def test_propagation_rise(spark):
    """One edge more: 0.25 to 0.31 of 4 components is told, the same edge among 8 is not."""
    for n, want in ((4, 1), (8, 0)):
        parts = tuple(Component(f"c{k}", (f"c{k}",)) for k in range(n))
        of = lambda *pairs: plans.mapping.with_endpoints(spark.createDataFrame([(f"{a}/x", f"{b}/x") for a, b in pairs], "from_ string, to_ string").selectExpr("from_", "to_", "cast(null as string) workspace", "cast(null as string) package", "false builtin", "to_ specifier", "'static' kind", "1 line", "false unresolved"), parts)  # noqa: B023, E731
        got = FN.structure_findings(of(("c0", "c0")), of(("c0", "c1")), parts).where("rule = 'propagation-cost-rise'").collect()
        assert len(got) == want and all(r.message == "The propagation cost rose from 0.25 to 0.31." for r in got)


def test_deprecated_and_api(spark):
    parts = (Component("a", ("a",)), Component("b", ("b",), deprecated=True), Component("c", ("c",)))
    of = lambda *rows: plans.mapping.with_endpoints(spark.createDataFrame(rows, "from_ string, to_ string, kind string").selectExpr("from_", "to_", "cast(null as string) workspace", "cast(null as string) package", "false builtin", "to_ specifier", "kind", "1 line", "false unresolved"), parts)
    base, head = of(("a/1", "b/1", "static")), of(("a/1", "b/2", "static"), ("a/2", "b/1", "type"), ("b/1", "b/2", "static"), ("x", "b/1", "static"), ("a/2", "c/1", "static"))
    told = lambda *r: {(x.rule, x.level, x.file, x.from_, x.to_) for x in FN.deprecated_findings(base, head, r, parts).collect()}
    assert told() == {("deprecated-dependency", "warn", "a/2", "a", "b"), ("deprecated-dependency", "warn", "x", "x", "b")}
    assert told(Rule("d", "deprecated", include_type_imports=False)) == {("d", "error", "x", "x", "b")} and told(Rule("d", "deprecated", "off")) == set()
    assert told(Rule("d", "deprecated", "warn", components=("c",))) == {("d", "warn", "a/2", "a", "c")}
    changes = spark.createDataFrame([("a", "a/i", "f", "removed"), ("a", "a/i", "g", "added"), ("c", "c/i", "f", "changed")], "component string, file string, name string, change string")
    said = {(x.rule, x.level, x.file, x.fingerprint) for x in FN.api_findings(changes, [Rule("s", "api-stability", components=("a", "path:c/**")), Rule("t", "api-stability", "warn", components=("a",), allow_growth=False), Rule("u", "api-stability", "off", components=("*",))]).collect()}
    assert {x[:3] for x in said} == {("s", "error", "a/i"), ("s", "error", "c/i"), ("t", "warn", "a/i")} and len(said) == 4


def session_rows():
    """s: the old error x stays allowed at each check, a resume changes nothing, a startup without findings takes its place. t never started."""
    ev = lambda session, event, id_, seq, fp=None, level=None, source=None: {"session_id": session, "event": event, "event_id": id_, "source": source, "fingerprint": fp, "level": level, "seq": seq}
    rows = [
        ev("s", "start", "1", 1, "x", "error", "startup"), ev("s", "start", "1", 2, "x", "error", "startup"), ev("s", "start", "1", 3, "w", "warn", "startup"), ev("s", "check", "2", 4, "x", "error"), ev("s", "check", "2", 5, "x", "error"), ev("s", "start", "3", 6, "y", "error", "resume"),
        ev("s", "check", "4", 7, "x", "error"), ev("s", "check", "4", 8, "x", "error"), ev("s", "check", "4", 9, "x", "error"), ev("s", "check", "4", 10, "w", "warn"), ev("s", "check", "4", 11, "y", "error"), ev("s", "start", "5", 12, None, None, "startup"), ev("s", "check", "6", 13, "x", "error"),
        ev("t", "check", "7", 14, "x", "error"), ev("u", "start", "8", 15, None, None, "resume"), ev("u", "start", "9", 16, "x", "error", "resume"), ev("u", "check", "10", 17, "x", "error"),
        ev("s", "stop", "11", 18, "x", "error"), ev("s", "stop", "11", 19, "w", "warn"),
    ]
    want = {("s", "4", "x", 9, "block"), ("s", "4", "w", 10, "context"), ("s", "4", "y", 11, "block"), ("s", "6", "x", 13, "block"), ("t", "7", "x", 14, "block"), ("u", "10", "x", 17, "block"), ("s", "11", "x", 18, "block")}
    return rows, want


def test_sessions(spark, tmp_path):
    rows, want = session_rows()
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, rows), "not json", '{"event": "check"}']))
    batch, bad = sessions.parse_events(spark.read.text(str(tmp_path)))
    assert bad.count() == 2 and {tuple(r) for r in sessions.session_checks(batch).collect()} == want
    # a stop that follows from a stop only tells; messages list five findings
    checks = sessions.session_checks(batch).union(spark.createDataFrame([("v", "12", f"f{k}", 20 + k, "block") for k in range(8)], sessions.RESULT))
    texts = spark.createDataFrame([(r["event_id"], r["seq"], f"m{r['seq']}") for r in rows] + [("12", 20 + k, f"n{k}") for k in range(8)], "event_id string, seq long, message string")
    stops = spark.createDataFrame([("s", "11", True)], "session_id string, event_id string, again boolean")
    got = {(r.session_id, r.event_id, r.action): (r.n, r.listed) for r in sessions.told(checks, texts, stops).collect()}
    assert got["s", "4", "block"] == (2, ["m9", "m11"]) and got["s", "11", "message"] == (1, ["m18"]) and ("s", "11", "block") not in got
    assert got["v", "12", "block"] == (8, [*(f"n{k}" for k in range(5)), "+3 more"])


def run_stream(spark, tmp_path, name, batches, wanted, **more):
    """Rows of a session stream over files that come one a batch, until the wanted number is there."""
    for k, rows in enumerate(batches):
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / f"{k}.json").write_text("\n".join([*map(json.dumps, rows), "not json"]))
    good, _ = sessions.parse_events(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / name)))
    q = sessions.session_stream(good, "8 seconds", **more).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and q.isActive and spark.table(name).count() < wanted:
            time.sleep(0.5)
        assert q.exception() is None
        return [tuple(r) for r in spark.table(name).collect()]
    finally:
        q.stop()


def test_session_stream(spark, tmp_path):
    """Whatever the order in which rows come, the stream says what the batch says; a later run goes on with the snapshots of an earlier one."""
    pytest.importorskip("google.protobuf")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STATE_STORE)
    try:
        rows, want = session_rows()
        mixed = list(rows)
        random.Random(3).shuffle(mixed)
        got = run_stream(spark, tmp_path, "mixed", [mixed[k::3] for k in range(3)], len(want))
        assert sorted(got) == sorted(want)
        events = spark.createDataFrame([tuple(r.values()) for r in rows], "session_id string, event string, event_id string, source string, fingerprint string, level string, seq long")
        held = sessions.snapshots(events)
        assert {tuple(r) for r in held.collect()} == {("s", "5", None, None), ("u", "8", None, None)}
        first = sessions.snapshots(events.where("seq < 12"))
        assert {tuple(r) for r in first.collect()} == {("s", "1", "x", 2)}
        more = [dict(rows[6], event_id="20", seq=30 + k) for k in range(3)]
        assert run_stream(spark, tmp_path, "later", [more], 1, snapshots=first) == [("s", "20", "x", 32, "block")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_cycles_waived(spark):
    e = edges(spark, [("src/app/a.ts", "src/domain/b.ts", "static", 1), ("src/domain/b.ts", "src/app/a.ts", "static", 2), ("src/infra/c.ts", "src/infra/d.ts", "static", 1), ("src/infra/d.ts", "src/infra/c.ts", "type", 1)])
    status = lambda rule, *w: {r.from_: r.status for r in rules.acyclic_findings(e, rule, SHOP, w, TODAY).collect()}
    held = lambda a, b, expires=TODAY: Waiver("c", a, b, expires)
    assert status(Rule("c", "acyclic")) == {"app": "new"} and status(Rule("c", "acyclic"), held("domain", "app")) == {"app": "waived"}
    assert status(Rule("c", "acyclic"), held("domain", "infra")) == {"app": "new"} and status(Rule("c", "acyclic"), held("domain", None)) == {"app": "waived"}
    assert status(Rule("c", "acyclic"), held("domain", None, dt.date(2020, 1, 1))) == {"app": "new"} and status(Rule("c", "acyclic"), held("path:src/app/**", None)) == {"app": "new"}
    assert status(Rule("c", "acyclic", scope="files"), held("path:src/app/**", "domain")) == {"src/app/a.ts": "waived", "src/infra/c.ts": "new"}
    assert status(Rule("c", "acyclic", within=("path:src/app/**", "domain"))) == {}


def test_inert(spark):
    e = edges(spark, [("src/app/a.ts", "src/domain/b.ts", "static", 1), ("src/app/a.ts", "src/domain/b.ts", "type", 2)])
    f = spark.createDataFrame([("src/app/a.ts", "app"), ("src/domain/b.ts", "domain")], "path string, component string")
    given = [
        Rule("works", "forbid", from_=("app",), to_=("domain",)), Rule("idle", "forbid", from_=("domain",), to_=("app",)), Rule("lost", "layers", layers=(("app",), ("gone", "path:x/**"), ("domain",))), Rule("off", "forbid", "off", from_=("gone",)),
        Rule("loops", "acyclic"), Rule("within", "acyclic", within=("app",)), Rule("doors", "entrypoints", targets=("domain",)), Rule("shut", "entrypoints", targets=("app",)), Rule("types", "independent", members=("domain", "infra"), include_type_imports=False), Rule("pkgs", "external-imports", packages=("x",)),
    ]
    got = {(r.rule, r.in_scope, tuple(r.empty)) for r in rules.inert_rules(e, f, given).collect()}
    assert got == {("idle", 0, ()), ("lost", 2, ("gone", "path:x/**")), ("within", 0, ()), ("shut", 0, ()), ("types", 0, ("infra",))}


def test_weakenings(spark):
    from tessera.operators.contract import contract_issues, weakenings

    rules_ = (Rule("gone", "forbid"), Rule("low", "forbid", "error"), Rule("types", "forbid"), Rule("kind", "forbid"), Rule("less", "forbid", from_=("a", "b"), to_=("c",)), Rule("layers", "layers", layers=(("a",), ("b",), ("c",)), allow_skip=False), Rule("wide", "allow-only", from_=("a",), to_=("b",), scope="all"), Rule("ext", "external-imports", from_=("a",), allow=()), Rule("off", "forbid", "off"), Rule("same", "acyclic"))
    head = (Rule("low", "forbid", "warn"), Rule("types", "forbid", include_type_imports=False), Rule("kind", "acyclic"), Rule("less", "forbid", from_=("a",), to_=("c",)), Rule("layers", "layers", layers=(("a",), ("b",), ("c",))), Rule("wide", "allow-only", from_=("a",), to_=("b", "c"), scope="internal"), Rule("ext", "external-imports", from_=("a",), allow=("zod",)), Rule("same", "acyclic"))
    base = Contract((Component("a", ("a",), ("a/i",)), Component("b", ("b",), deprecated=True)), (), rules_, (Waiver("low", "a", None, dt.date(2026, 1, 1)),))
    new = Contract((Component("a", ("a",)), Component("b", ("b",))), (), head, (Waiver("low", "a", None, dt.date(2026, 12, 1)), Waiver("low", "b", None, dt.date(2026, 1, 1))))
    got = {(r.type, r.rule) for r in weakenings(spark, base, new, TODAY).collect()}
    assert got == {("rule-removed", "gone"), ("level-lowered", "low"), ("type-imports-excluded", "types"), ("rule-changed", "kind"), ("selector-narrowed", "less"), ("selector-narrowed", "layers"), ("selector-narrowed", "wide"), ("selector-narrowed", "ext"), ("component-changed", "a"), ("component-changed", "b"), ("waiver-added", "low")}
    assert weakenings(spark, base, base, TODAY).count() == 0
    issues = set(contract_issues(Contract((Component("a", ()), Component("a", ())), (Resource("s", "x"),), (Rule("r", "forbid", because=(), from_=("b", "*", "pkg:z")),), (Waiver("q", "a", None, TODAY), Waiver("r", "a", None, dt.date(2020, 1, 1)))), TODAY))
    assert issues == {("component a", "is there more than once"), ("rule r", "names the unknown component b"), ("rule r", "is an error without a reason"), ("resource s", "has the unknown owner x"), ("waiver of q", "names an unknown rule"), ("waiver of r", "has expired")}


def test_inference(spark):
    from tessera.operators import inference

    f = spark.createDataFrame([(f"src/{d}/f{k}.ts", "") for d in ("domain", "Web UI", "packages/one", "packages/two", "lib/one") for k in range(3)] + [("AGENTS.md", "Hello\nThe domain must not import the web.\nonly import")], "path string, text string")
    told = lambda *x: [(r.id, r.folder, r.files) for r in inference.infer_components(*x).orderBy("ord").collect()]
    assert told(f) == [("web-ui", "src/Web UI", 3), ("domain", "src/domain", 3), ("lib", "src/lib/one", 3), ("one", "src/packages/one", 3), ("two", "src/packages/two", 3)]
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    more = paths(*(f"api/modules/{m}/{k}.ts" for m in ("chats", "users") for k in range(6)), "api/core/a.ts", "api/main.ts", "web/index.ts", "web/a/b.ts", "tool.ts", "api/modules/chats/x.test.ts", "packages/one/i.ts", "packages/one/sub/j.ts")
    pkgs = spark.createDataFrame([("@acme/one", "packages/one"), ("sub", "packages/one/sub"), ("none", "packages/none"), ("root", "")], "name string, dir string")
    assert told(more, pkgs) == [("sub", "packages/one/sub", 1), ("one", "packages/one", 1), ("chats", "api/modules/chats", 6), ("users", "api/modules/users", 6), ("api", "api", 2), ("web", "web", 2)]
    assert told(paths()) == [] and told(paths("a.ts")) == []
    named = spark.createDataFrame([("chat-ui", "chat-ui"), ("chatcore", "ChatCore"), ("shop-domain", "shop_domain"), ("score", "score"), ("core", "core"), ("ChatUI", "ChatUi")], "id string, name string")
    assert {(r.tier, tuple(r.ids)) for r in inference.layer_names(named).collect()} == {(0, ("ChatUI", "chat-ui")), (2, ("chatcore", "shop-domain"))}
    inside = spark.createDataFrame([("a/Domain/x.ts", "a"), ("a/infra/y.ts", "a"), ("b/core/z.ts", "b"), ("b/features/f/z.ts", "b"), ("c/core/z.ts", "c"), ("infra", None)], "path string, component string")
    assert {(r.tier, tuple(r.selectors)) for r in inference.layer_folders(inside).collect()} == {(0, ("path:**/infra/**",)), (1, ("path:**/features/**",)), (2, ("path:**/Domain/**", "path:**/core/**"))}
    assert inference.layer_folders(inside.where("component <> 'b'")).count() == 0
    assert inference.layer_names(named.limit(2)).count() == 0
    g = spark.createDataFrame([("a", "b"), ("b", "c")], "from_c string, to_c string")
    assert [tuple(r) for r in inference.inferred_layers(g).collect()] == [("a", 2), ("b", 1), ("c", 0)]
    assert [(r.line, r.text) for r in inference.guardrails(f).collect()] == [(2, "The domain must not import the web.")]
    more = spark.createDataFrame([("docs/our-layers.md", "<!-- b -->\nNever import the core here.\n<!-- e -->\n  Views may not depend on rows.  \nNever import the core here."), ("tools/check-imports.py", "x = 1\nraise Exception('layer not allowed')"), ("node_modules/AGENTS.md", "never import anything"), ("docs/other.md", "never import anything")], "path string, text string")
    got = [(r.file, r.line, r.note) for r in inference.guardrails(more, managed=("<!-- b -->", "<!-- e -->")).collect()]
    assert got == [("docs/our-layers.md", 4, None), ("docs/our-layers.md", 5, None), ("tools/check-imports.py", 2, "boundary check script check-imports.py")]


def test_context(spark):
    from tessera.operators import context

    p = spark.createDataFrame([("a", "b", 5, 0.9), ("c", "a", 7, 0.5), ("x", "y", 9, 1.0)], "a string, b string, support long, confidence double")
    assert [(r.item, r.partner) for r in context.change_partners(p, spark.createDataFrame([("a",)], "item string")).collect()] == [("a", "c"), ("a", "b")]
    touched = spark.createDataFrame([("domain", "src/domain/a.ts"), (None, "lib/x.ts")], "component string, path string")
    given = [Rule("f", "forbid", from_=("domain",), to_=("infra",)), Rule("p", "forbid", from_=("path:lib/**",)), Rule("n", "forbid", from_=("app",)), Rule("l", "layers", layers=(("app",), ("domain",))), Rule("i", "independent", members=("domain", "app")), Rule("e", "entrypoints", targets=("domain",)), Rule("o", "allow-only", from_=("domain",))]
    assert {r.rule for r in context.rules_touching(touched, given).collect()} == {"f", "p", "l", "i", "e", "o"}
    assert context.constraints(given, "domain") == [("f", "must not import infra"), ("l", "must not import app"), ("i", "must not import app"), ("e", "is imported through its entry points only"), ("o", "may only import itself")]
    d = spark.createDataFrame([("1", "t", "accepted", ["domain"]), ("2", "t", "superseded", ["domain"]), ("3", "t", "proposed", ["app"])], "id string, title string, status string, governs array<string>")
    assert [r.id for r in context.governing(d, touched, SHOP).collect()] == ["1"]
    q = spark.createDataFrame([(1, "move Domain-x and `src/app/a.ts`, infra."), (2, "domain")], "prompt_id long, text string")
    assert {tuple(r) for r in context.mentioned_components(q, SHOP).collect()} == {(1, "app"), (1, "infra"), (2, "domain")}
    assert [tuple(r) for r in context.mentioned_paths(q, spark.createDataFrame([("src/app/a.ts",)], "path string")).collect()] == [(1, "src/app/a.ts")]


def test_status(spark, tmp_path):
    from tessera.operators import status

    r = spark.createDataFrame([("a", "error"), ("b", "error"), ("c", "off")], "rule string, level string")
    d = spark.createDataFrame([("1", "accepted", "2020-01-01", "", None), ("1", "superseded", None, "t", "9"), ("2", "superseded", None, "t", "1")], "id string, status string, review_by string, title string, superseded_by string")
    b = spark.createDataFrame([("x", "a", 3)], "fingerprint string, rule string, count int")
    assert {tuple(x) for x in status.rollup(r, d, b).collect()} == {("rules", "error", 2), ("rules", "off", 1), ("decisions", "accepted", 1), ("decisions", "superseded", 2), ("baseline", "findings", 3)}
    assert [x.id for x in status.overdue(d, "2026-01-01").collect()] == ["1"]
    assert {tuple(x) for x in status.decision_problems(d).collect()} == {("1", "id is used more than once"), ("1", "names no known successor"), ("1", "has no title")}
    assert tuple(one(spark, status.coverage_text(F.lit(1), F.lit(1000)), status.coverage_text(F.lit(6), F.lit(48)), status.coverage_text(F.lit(0), F.lit(0)))) == ("<1%", "12%", "100%")
    f = spark.createDataFrame([("a", "t1", "1"), ("b", "t1", "1"), ("c", "t2", "2")], "path string, text string, content_id string")
    calls = []

    def facts(x):
        calls.append(x.count())
        return x.select("content_id", F.length("text").alias("n"))

    for n in (2, 3):
        assert status.with_cache(spark, f.limit(n), str(tmp_path / "c"), facts, "v1").count() == n
    assert calls == [1, 1]
    e = spark.createDataFrame([("a", "b", False), ("c", "d", False), ("e", None, True)], "from_ string, to_ string, unresolved boolean")
    ch = spark.createDataFrame([("d", True), ("a", False)], "path string, deleted boolean")
    assert {x.path for x in status.to_resolve_again(e, ch).collect()} == {"a", "c", "e"}
    assert {x.from_ for x in status.refreshed(e, ch, e.limit(0)).collect()} == {"c", "e"}
    paths = graph.cycle_paths(pairs(spark, "ab", "bc", "ca", "ac", "de", "ed", "cb"), graph.strong_components(pairs(spark, "ab", "bc", "ca", "ac", "de", "ed", "cb")))
    assert {x.scc: x.path for x in paths.collect()} == {"a": ["a", "c", "a"], "d": ["d", "e", "d"]}


def test_cargo_and_contract(spark):
    from tessera.sources.contract import load_text

    toml = '[package]\nname = "chats"\n\n[dependencies]\nserde = "1"\nproxy = { path = "../p", package = "real-proxy" }\n\n[dev-dependencies]\nno = "1"\n\n[target.x.dependencies.win]\nversion = "1"\n'
    f = spark.createDataFrame([("c/Cargo.toml", toml), ("p/Cargo.toml", '[package]\nname = "real-proxy"\n'), ("bad/Cargo.toml", "[")], "path string, text string")
    got = {(r.specifier, r.line, r.to_, r.package) for r in resolve.resolve_cargo(extract.cargo_imports(f), f).collect()}
    assert got == {("serde", 5, None, "serde"), ("real-proxy", 6, "p/Cargo.toml", None), ("win", 11, None, "win")}
    text = "components:\n  - {id: a, paths: [src/a], odd: 1}\n  - {paths: [x]}\nrules:\n  - {id: r, kind: forbid, from: [a], to: a, because: ['1']}\n  - {id: s, kind: none}\n  - {id: l, kind: layers, level: warn, layers: [a, [a]]}\nwaivers:\n  - {rule: r, from: a, reason: x, expires: 2020-01-01}\n  - {rule: r, from: a, expires: soon}\n"
    contract, issues = load_text(text, TODAY)
    assert [c.id for c in contract.components] == ["a"] and [(r.id, r.to_, r.layers) for r in contract.rules] == [("r", ("a",), ()), ("l", (), (("a",), ("a",)))] and contract.waivers == ()
    assert {w for w, _ in issues} == {"components[0]", "components[1]", "rules[1]", "waivers[0]", "waivers[1]", "waiver of r"}
    assert load_text("a: [", TODAY)[1] and load_text("[]", TODAY)[1]


@pytest.mark.parametrize("pattern, line, want", [
    ("prisma:User", "await prisma.user.create({", True), ("prisma:User", "prisma.user.findMany()", False), ("prisma:User", "prisma.userLog.create()", False), ("drizzle:users", "db.insert(schema.users)", True), ("drizzle:users", "db.select(users)", False),
    ("sql:users", 'UPDATE "public"."users" AS u SET a', True), ("sql:users", "truncate table users", True), ("sql:users", "INSERT OR REPLACE INTO users", True), ("sql:users", "insert into users_old", False), ("sql:users", "select * from users", False),
    ("sqlalchemy:User", "session.add(User(name))", True), ("sqlalchemy:User", "update(User)", True), ("sqlalchemy:User", "sa.delete(User).where(x)", True), ("sqlalchemy:User", "session.execute(insert(User).values(a=1))", True), ("sqlalchemy:User", "User.__table__.update().values(x=1)", True), ("sqlalchemy:User", "insert(UserLine)", False), ("sqlalchemy:User", "session.add(user)", False), ("django:User", "User.objects.filter(a=1).update(b=2)", True), ("django:User", "User.objects.get(1)", False),
    ("convex:users", "ctx.db.replace(args.userId, x)", True), ("convex:users", "ctx.db.patch(superuserId, x)", False), ("convex:users", 'ctx.db.delete("users")', True), ("convex:messages", "await ctx.db.delete(message._id);", True), ("convex:messages", 'await ctx.db.patch("users", messageId, {});', False), ("convex:messages", "ctx.db.delete(userId)", False), ("sql:orders", "UPDATE orders", False), ("sql:orders", "MERGE INTO dbo.[orders] AS t", True), ("sql:orders", "INSERT INTO line_orders VALUES (1)", False), ("django:Order", "LineOrder.objects.create(x=1)", False), ("drizzle:users", "db.delete( users ).where(x)", True), (r"store\.set\(", "store.set(1)", True),
])
def test_write_patterns(spark, pattern, line, want):
    assert one(spark, extract.writes(F.lit(line), pattern))[0] is want


def test_workload(spark):
    from tessera.plans import workload

    made = list(workload.texts())
    assert len(made) == 5000 and made[0][0] == "src/c00/f0/m0.ts"
    assert workload.contract().rules[1].layers[0] == ("c19",)
    some = spark.createDataFrame(made[:500], "path string, text string")
    e = plans.code_graph(some, spark.createDataFrame([], "name string, dir string"), workload.contract(), [("@/", "src/")])
    assert e.where("unresolved").count() == 0 and e.where("kind = 'type'").count() == 250
    assert plans.check(e, workload.contract(), TODAY).where("rule = 'layering'").count() == 0

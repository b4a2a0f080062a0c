"""Decision records from files to findings, many globs, first few of groups, and counts of history kept between runs."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions.bounded import count_and_first
from tessera.functions.globs import patterns_regex
from tessera.operators import context, findings, globindex, history, search
from tessera.schemas import Component
from tessera.sources import documents, markdown

FILES = "path string, text string"

FIRST = """---
title: Keep the domain pure
status: accepted
date: 2026-01-02
decision-makers: [ann, bo]
governs:
  - domain
  - src/lost/**
assumptions:
  - text: "the domain is small: 20 files"
    check: no-such-rule
    review_by: 2026-03-01   # soon
  - check: no-cycles
    text: nobody needs it
weakens: []
evidence:
- source: README.md
  quote: 'a domain'
---

# ADR-0001: Something else

## Context

```
## Status
rejected
```

Text.
"""

SECOND = """# 7. Use queues

## Status

* Superseded by [0009](9.md)

## Date
2025-05-05

## Deciders ##
ann, , cy
### Not a section
## Empty
"""


def test_sections(spark):
    text = "before\n## One ##\n a\n\n~~~ x\n## Not one\n```\n## Two\nb\n## Three\n"
    got = markdown.sections(spark.createDataFrame([("f", text), ("g", "no"), ("h", None)], "path string, body string"))
    assert {tuple(r) for r in got.collect()} == {("f", 1, "One", "a\n\n~~~ x\n## Not one\n```"), ("f", 2, "Two", "b"), ("f", 3, "Three", "")}


def test_decisions_to_findings(spark):
    """Files in, findings out."""
    files = spark.createDataFrame([("d/0001-domain.md", FIRST), ("d/7-queues.md", SECOND.replace("\n", "\r\n")), ("d/8-plain-name.md", "- **Status**: Approved ✅\n- Date: 2024-01-01\nDecision-makers: dee"), ("d/index.md", "x"), ("d/9.md", "")], FILES)
    d = {r.id: r for r in documents.decisions(files).collect()}
    assert set(d) == {"0001", "0007", "0008", "0009"}
    one = d["0001"]
    assert (one.title, one.status, one.date, one.makers, one.governs, one.weakens) == ("Keep the domain pure", "accepted", "2026-01-02", ["ann", "bo"], ["domain", "src/lost/**"], [])
    assert [tuple(a) for a in one.assumptions] == [("the domain is small: 20 files", "no-such-rule", "2026-03-01"), ("nobody needs it", "no-cycles", None)]
    assert [tuple(e) for e in one.evidence] == [("README.md", "a domain", None)] and one.checks == ["no-such-rule", "no-cycles"]
    two = d["0007"]
    assert (two.title, two.status, two.superseded_by, two.date, two.makers, two.assumptions) == ("Use queues", "superseded", "0009", "2025-05-05", ["ann", "cy"], [])
    assert (d["0008"].title, d["0008"].status, d["0008"].date, d["0008"].makers) == ("plain-name", "accepted", "2024-01-01", ["dee"])
    assert (d["0009"].title, d["0009"].status, d["0009"].makers, d["0009"].body) == ("9", "proposed", [], "")
    rules = spark.createDataFrame([("no-cycles", ["7"]), ("other", ["ADR 1"])], "rule string, because array<string>")
    components = spark.createDataFrame([("domain",)], "component string")
    paths = spark.createDataFrame([("src/domain/a.ts",)], "path string")
    told = findings.decision_findings(documents.decisions(files), rules, components, paths, "2026-09-26").collect()
    assert {(r.rule, r.file, r.from_) for r in told} == {("stale-decision", "d/0001-domain.md", None), ("unchecked-assumption", "d/0001-domain.md", None), ("superseded-citation", "rules.yaml", "no-cycles")}
    assert len([r for r in told if r.rule == "stale-decision"]) == 2


GLOBS = ["src/app", "src/app/", "./src/app/a.ts", "src/*.ts", "src/**", "**/*.ts", "**/x.ts", "**", "*", "*.{ts,js}", "src/[ab]/*.d.ts", "{src,lib}/**/x.ts", "**/test/**", "src/**/b?.js", "lib/.hidden/*", "a", "src/app/**/*.test.ts", "*.test.ts", "**/*.test.*"]
PATHS = ["src/app/a.ts", "src/app/b/x.ts", "src/apps.ts", "src/a/q.d.ts", "a", "a/b", "x.ts", "lib/x.ts", "lib/.hidden/f", "test/t.js", "src/test/b1.js", "q.test.ts", "src/app/q.test.ts", "noext", "src/b1.js"]


def test_globs_by_key(spark):
    want = {(g, p) for g in GLOBS for p in PATHS if re.match(patterns_regex([g]), p)}
    one = lambda rows, name: spark.createDataFrame([(r,) for r in [*rows, rows[0], None]], f"{name} string")
    assert {tuple(r) for r in globindex.matches(one(GLOBS, "glob"), one(PATHS, "path")).collect()} == want
    assert globindex.matches(one(GLOBS, "glob").limit(0), one(PATHS, "path")).count() == 0


def test_many_globs(spark):
    """100,000 globs and 20,000 files meet by their literal parts: no cross join in the plan, and the pairs that are tested stay few."""
    globs = spark.range(100_000).select(F.concat(F.lit("g"), F.col("id")).alias("id"), F.lit("accepted").alias("status"), F.array(F.concat(F.lit("src/c"), F.col("id") % 40_000, F.lit("/**/*.ts"))).alias("governs"))
    files = spark.range(20_000).select(F.concat(F.lit("src/c"), F.col("id"), F.lit("/a/b.ts")).alias("path"))
    got = search.stale_governs(globs, spark.createDataFrame([("x",)], "component string"), files)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert got.count() == sum(k % 40_000 >= 20_000 for k in range(100_000))


def test_governing(spark):
    d = spark.createDataFrame([("1", "A", "accepted", ["domain"]), ("2", "B", "proposed", ["src/app/**"]), ("3", "C", "rejected", ["*"]), ("4", "D", "accepted", ["*"]), ("5", "E", "superseded", ["*"]), ("6", "F", "rejected", ["src/app/a.ts"]), ("7", "G", "accepted", ["lib/**"])], "id string, title string, status string, governs array<string>")
    own = (Component("domain", ("src/domain",)), Component("app", ("src/app",)))
    touched = spark.createDataFrame([("app", "src/app/a.ts")], "component string, path string")
    assert {r.id for r in context.governing(d, touched, own).collect()} == {"2", "4", "6"}
    assert {r.id for r in context.governing(d, spark.createDataFrame([("domain", None)], touched.schema), own).collect()} == {"1", "4"}
    assert context.governing(d, touched.limit(0), own).count() == 0


def test_count_and_first(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("a", 1, "y"), ("a", 2, None), (None, 5, "n"), ("b", 9, "z")]
    got = count_and_first(spark.createDataFrame(rows, "k string, o int, v string"), ["k"], ["o", "v"], 3).collect()
    assert {r.k: (r.n, [tuple(x) for x in r.first]) for r in got} == {"a": (4, [(1, "y"), (1, "y"), (2, None)]), None: (1, [(5, "n")]), "b": (1, [(9, "z")])}


def test_observed(spark):
    g = spark.createDataFrame([("a", f"c{k}", 9 - k // 2) for k in range(8)] + [("z", "a", 1)], "from_c string, to_c string, cnt long")
    got = {(r.component, r.side): r.listed for r in context.observed(g).collect()}
    assert got["a", "dependencies"] == "c0 (9), c1 (9), c2 (8), c3 (8), c4 (7), c5 (7), +2 more" and got["a", "dependents"] == "z (1)" and ("z", "dependents") not in got


@pytest.mark.parametrize("seed", range(2))
def test_kept_history(spark, tmp_path, seed):
    """Commits come, go and leave the window: kept counts stay those of a full count, and spans that didn't change aren't counted again."""
    r = random.Random(seed)
    day = lambda k: dt.datetime(2026, 1, 1) + dt.timedelta(days=k, hours=r.randrange(24))
    commits = {f"s{k}": (day(k), r.sample("abcdefgh", r.randrange(1, 4))) for k in range(60)}
    path = str(tmp_path / "kept")

    def full(lo, hi):
        rows = [(s, i, ts) for s, (ts, items) in commits.items() for i in items if lo <= int(s[1:]) < hi]
        df = spark.createDataFrame(rows, "sha string, item string, ts timestamp")
        pairs, items = history.kept_counts(df, path)
        same = lambda x, y: {tuple(v) for v in x.collect()} == {tuple(v) for v in y.collect()}
        assert same(pairs, history.pair_counts(df)) and same(items, history.item_counts(df))
        assert same(history.cochange_of(pairs, items, 2, 0.3), history.cochange(df, 2, 0.3))
        return {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "kept/items").iterdir() if p.is_dir()}

    before = full(0, 40)
    after = full(12, 60)  # appended and expired
    assert sum(after[s] == before[s] for s in before) >= 3
    commits["s30"] = (commits["s30"][0], ["a"])  # a rewritten commit
    commits["s31"] = (commits["s31"][0], ["a"])
    full(12, 60)
    for k in range(28, 36):
        commits[f"s{k}"] = (commits[f"s{k}"][0], [r.choice("abc")])  # spans without pairs
    full(12, 60)


def test_slug(spark):
    from tessera.functions.text import slug

    texts = ["Keep the Domain pure!", "Größe über Ünïcode", "ﬁne ½ Ⅳ", "日本", "", " - ", None, "a" * 59 + "-b" * 9, "Straße"]
    got = {r.t: r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", slug(F.col("t")).alias("s")).collect()}
    assert got == {"Keep the Domain pure!": "keep-the-domain-pure", "Größe über Ünïcode": "gro-e-uber-unicode", "ﬁne ½ Ⅳ": "fine-1-2-iv", "日本": "decision", "": "decision", " - ": "decision", None: None, "a" * 59 + "-b" * 9: "a" * 59, "Straße": "stra-e"}

"""Public surfaces in the order of stars, and hook payloads of several hosts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import extract, surface
from tessera.schemas import Component
from tessera.streaming import intake

EXPORTS = "file string, name string, signature string, target string, original string"
STARS = "file string, at int, specifier string, target string"
COMPONENTS = (Component("app", ("src/app",)), Component("domain", ("src/domain/**/*.ts",)), Component("ui", ("src/ui",)))


def searched(exports, stars, start, depth=10):
    """By depth-first search: explicit names, then stars in their order; what leads back to a file on the way gives nothing."""

    def of(file, visiting):
        if file in visiting or len(visiting) > depth:
            return {}
        out, inside = {}, visiting | {file}
        for f, name, signature, target, original in exports:
            if f == file:
                got = of(target, inside).get(original or name) if target else None
                out[name] = got or signature
        for f, _, specifier, target in sorted(stars, key=lambda s: s[1]):
            if f != file:
                continue
            if target is None:
                out.setdefault(f"* from {specifier}", f'export * from "{specifier}"')
                continue
            for name, signature in of(target, inside).items():
                if name != "default":
                    out.setdefault(name, signature)
        return out

    return of(start, frozenset())


def surfaces(spark, exports, stars, starts):
    got = surface.public_surface(spark.createDataFrame([(s,) for s in starts], "file string"), spark.createDataFrame(exports, EXPORTS), spark.createDataFrame(stars, STARS))
    out = {s: {} for s in starts}
    for r in got.collect():
        assert r.name not in out[r.file]
        out[r.file][r.name] = r.signature
    return out


def test_star_listed_first_wins(spark):
    """e stars far, which stars deep, then near and a package: x is deep's though near is nearer, and the package keeps its star."""
    exports = [("deep", "x", "deep x", None, None), ("near", "x", "near x", None, None), ("near", "y", "near y", None, None), ("near", "default", "d", None, None), ("r", "z", "z as such", "e", "x"), ("r", "lost", "lost as such", "e", "no"), ("a", "p", "p of a", "b", "p"), ("b", "p", "p of b", "a", "p")]
    stars = [("e", 0, "./far", "far"), ("e", 1, "./near", "near"), ("e", 2, "pkg", None), ("far", 0, "./deep", "deep"), ("deep", 0, "./e", "e"), ("r", 0, "./e", "e")]
    got = surfaces(spark, exports, stars, ["e", "r", "a"])
    assert got["e"] == {"x": "deep x", "y": "near y", "* from pkg": 'export * from "pkg"'}
    assert got["r"] == {"z": "deep x", "lost": "lost as such", "x": "deep x", "y": "near y", "* from pkg": 'export * from "pkg"'}
    assert got["a"] == {"p": "p of b"}


@pytest.mark.parametrize("seed", range(3))
def test_surface_random(spark, seed):
    """Trees of stars with cross links and re-exports, against depth-first search."""
    r = random.Random(seed)
    files = [f"f{k}" for k in range(14)]
    exports = [(f, f"n{r.randrange(8)}", f"{f} {k}", None, None) for f in files for k in range(r.randrange(2))]
    exports = list({(e[0], e[1]): e for e in exports}.values())
    named = {(e[0], e[1]) for e in exports}
    for f in files[:9]:  # re-exports lead to later files, so no search comes back through one
        name = f"m{r.randrange(8)}"
        if (f, name) not in named:
            named.add((f, name))
            exports.append((f, name, f"{f} again", r.choice(files[files.index(f) + 1 :]), f"n{r.randrange(8)}"))
    stars = [(f, k, f"./{k}", r.choice([*files[i + 1 :], None])) for i, f in enumerate(files) for k in range(r.randrange(4))]
    got = surfaces(spark, exports, stars, files)
    assert got == {f: searched(exports, stars, f) for f in files}


def test_star_cycles(spark):
    """Stars in rings: a way never comes back to a file."""
    r = random.Random(9)
    files = [f"f{k}" for k in range(7)]
    exports = [(f, name, f"{f} {name}", None, None) for f in files for name in r.sample("abcdef", 2)]
    stars = [(f, k, "./s", t) for f in files for k, t in enumerate(r.sample(files, 3))]
    assert surfaces(spark, exports, stars, files) == {f: searched(exports, stars, f) for f in files}


def test_surface_of_files(spark):
    """From texts to names: exports and stars extracted, led to files by the graph's edges."""
    texts = spark.createDataFrame([("i.ts", "export * from './m';\n// export * from './no'\nexport type * from \"pkg\";\nexport { own } from './m';\nexport * as ns from './m';"), ("m.ts", "export function own(): void {}\nexport default function f() {}\nexport const b = 1;")], "path string, text string")
    stars = surface.star_exports(texts)
    assert {tuple(x) for x in stars.collect()} == {("i.ts", 0, "./m"), ("i.ts", 1, "pkg")}
    edges = spark.createDataFrame([("i.ts", "./m", "static", 1, None), ("i.ts", "./m", "reexport", 3, "m.ts"), ("i.ts", "pkg", "reexport", 2, None)], "from_ string, specifier string, kind string, line int, to_ string")
    exports = extract.script_exports(texts)
    exports = surface.linked(exports.withColumn("specifier", F.col("target")), edges, "specifier").select("file", "name", "signature", "target", "original")
    got = surface.public_surface(texts.select(F.col("path").alias("file")), exports, surface.linked(stars, edges, "specifier"))
    found = {(r.name, r.origin) for r in got.where("file = 'i.ts'").collect()}
    assert found == {("own", "m.ts"), ("b", "m.ts"), ("* from pkg", "i.ts")}


def payload(**fields):
    return json.dumps({k: v for k, v in fields.items() if v is not ...})


PATCH = "*** Begin Patch\n*** Add File: src/a.ts\n+x\n*** Update File: src/b.ts\n*** Move to: src/c.ts\n@@\n*** Delete File: /w/d.ts\n*** Update File: e/../f.ts \n*** Move to: f.ts\n*** Move to: g.ts\n*** End Patch"


def test_intake(spark):
    base = {"cwd": "/w", "session_id": "s"}
    more = {"model": "m", "permission_mode": "p", "transcript_path": None, "turn_id": "t", "tool_use_id": "u", "tool_response": {}}
    stop = {"stop_hook_active": True, "last_assistant_message": None}
    of = lambda event, **f: payload(hook_event_name=event, **base | f)
    good = [
        ("claude", "SessionStart", of("SessionStart", source="startup"), ("startup", None, None, [], [], False)),
        ("claude", "UserPromptSubmit", of("UserPromptSubmit", prompt="change app", extra=[1]), (None, "change app", None, [], [], False)),
        ("claude", "PostToolUse", of("PostToolUse", tool_name="Edit", tool_input={"file_path": "src/../a.ts"}), (None, None, "Edit", ["/w/a.ts"], [], False)),
        ("claude", "PostToolUse", of("PostToolUse", tool_name="NotebookEdit", tool_input={"notebook_path": "/x/n.ipynb"}), (None, None, "NotebookEdit", ["/x/n.ipynb"], [], False)),
        ("claude", "PostToolUse", of("PostToolUse", tool_name="Read", tool_input={"file_path": "a"}), (None, None, "Read", [], [], False)),
        ("claude", "Stop", of("Stop", stop_hook_active=True), (None, None, None, [], [], True)),
        ("codex", "PostToolUse", of("PostToolUse", tool_name="apply_patch", tool_input={"command": PATCH}, **more), (None, None, "apply_patch", ["/w/f.ts", "/w/src/a.ts", "/w/src/c.ts"], ["/w/d.ts", "/w/src/b.ts"], False)),
        ("codex", "PostToolUse", of("PostToolUse", tool_name="apply_patch", tool_input={"command": ["apply_patch", PATCH]}, **more), (None, None, "apply_patch", ["/w/f.ts", "/w/src/a.ts", "/w/src/c.ts"], ["/w/d.ts", "/w/src/b.ts"], False)),
        ("codex", "Stop", of("Stop", **more, **stop), (None, None, None, [], [], True)),
    ]
    bad = [
        ("claude", "Stop", "{", "not a JSON object"), ("claude", "Stop", "[1]", "not a JSON object"), ("claude", "Stop", None, "not a JSON object"), ("other", "Stop", of("Stop"), "an unknown host"), ("claude", "Else", of("Else"), "an unknown event"), ("claude", "Stop", of("Stop", session_id=...), "session_id is missing"),
        ("claude", "Stop", of("Stop", stop_hook_active="yes"), "stop_hook_active must be a boolean"), ("claude", "Stop", of("Stop", session_id=None), "session_id must be a string"), ("claude", "Stop", of("SessionStart"), "a payload for another event"), ("claude", "Stop", of("Stop", cwd="w"), "cwd is not absolute"),
        ("claude", "Stop", of("Stop", session_id=""), "session_id is empty"), ("claude", "UserPromptSubmit", of("UserPromptSubmit"), "prompt is missing"), ("claude", "PostToolUse", of("PostToolUse", tool_name="Write", tool_input={"file_path": ""}), "no file in the tool's input"),
        ("claude", "PostToolUse", of("PostToolUse", tool_name="Write", tool_input="x"), "no file in the tool's input"), ("codex", "Stop", of("Stop", **stop), "model is missing"), ("codex", "PostToolUse", of("PostToolUse", tool_name="apply_patch", tool_input={"command": ["ls"]}, **more), "no file in the tool's input"),
        ("codex", "Stop", of("Stop", **{**more, "transcript_path": 3}, **stop), "transcript_path must be a string or null"),
    ]
    raw = spark.createDataFrame([(k, a, e, v) for k, (a, e, v, _) in enumerate([*good, *bad])], "n int, agent string, event string, value string")
    fine, odd = intake.intake(raw)
    got = {r.n: (r.source, r.prompt, r.tool, list(r.changed), list(r.deleted), r.again) for r in fine.collect()}
    assert got == {k: w for k, (_, _, _, w) in enumerate(good)}
    assert {r.n: r.problem for r in odd.collect()} == {len(good) + k: p for k, (_, _, _, p) in enumerate(bad)}
    inside = fine.select("n", F.explode("changed").alias("p")).select("n", intake.within(F.col("p"), F.lit("/w")).alias("p"))
    assert {(r.n, r.p) for r in inside.where("n in (2, 3)").collect()} == {(2, "a.ts"), (3, None)}


def prompts_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "prompt_id int, prompt string")


def test_prompt_matches(spark):
    titles = spark.createDataFrame([("0001", "Keep the domain model pure"), ("0002", "Use queues for exports"), ("0003", None)], "id string, title string")
    said = ["Fix the APP, please", "app-x and apps don't count", "look at `src/domain/order.ts`, ok?", "what is in src/ui/?", "src/domain", "https://x/src/app/a.ts /src/app/b.ts ../src/app/c.ts", "queue the exports", "a model", "", None]
    got = {}
    for r in intake.prompt_matches(prompts_of(spark, said), COMPONENTS, titles).collect():
        got.setdefault(r.prompt_id, set()).add((r.kind, r.id))
    assert got == {
        0: {("component", "app")}, 2: {("path", "src/domain/order.ts"), ("component", "domain")}, 3: {("path", "src/ui/"), ("path", "src/ui"), ("component", "ui")} - {("path", "src/ui/")}, 4: {("path", "src/domain"), ("component", "domain")}, 6: {("decision", "0002")},
        5: {("component", "app")},
    }


def test_prompts_as_stream(spark, tmp_path):
    """Prompts that come as payloads meet components and titles on the way; a batch gives the same."""
    titles = spark.createDataFrame([("0001", "Keep the domain model pure")], "id string, title string")
    (tmp_path / "in").mkdir()
    lines = [payload(n=k, agent="claude", event="UserPromptSubmit", value=payload(hook_event_name="UserPromptSubmit", cwd="/w", session_id="s", prompt=p)) for k, p in enumerate(["is the domain model pure?", "src/app/x.py", "nothing"])]
    (tmp_path / "in/a.json").write_text("\n".join(lines))

    def matched(df):
        good, _ = intake.intake(df)
        return intake.prompt_matches(good.select(F.col("n").alias("prompt_id"), "prompt"), COMPONENTS, titles)

    schema = "n int, agent string, event string, value string"
    said = []
    q = spark.readStream.schema(schema).json(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: said.extend(map(tuple, matched(df).collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = {tuple(r) for r in matched(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    assert set(said) == want == {(0, "component", "domain"), (0, "decision", "0001"), (1, "path", "src/app/x.py"), (1, "component", "app")}

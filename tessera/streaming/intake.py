"""Hook payloads of agent hosts as one form, and what prompts are about."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import once, shares, spread, tidied
from ..functions.text import tokens
from ..operators.mapping import component_of
from ..operators.resolve import normalized
from ..schemas import Component
from ..scratch import settle


@dataclass(frozen=True)
class Host:
    """What a host's payloads must hold, by event, and how its tools name the files that they write: as a field of the tool's input, or as a patch in its command."""

    common: tuple[str, ...]
    required: dict[str, tuple[str, ...]]
    types: dict[str, str]
    path_fields: dict[str, str] = field(default_factory=dict)
    patch_tool: str | None = None


#: The events, and the payload fields of two hosts as these document them.
EVENTS = ("SessionStart", "UserPromptSubmit", "PostToolUse", "Stop")
HOSTS = {
    "claude": Host(
        ("cwd", "hook_event_name", "session_id"),
        {"SessionStart": (), "UserPromptSubmit": ("prompt",), "PostToolUse": ("tool_name", "tool_input"), "Stop": ()},
        {"cwd": "string", "hook_event_name": "string", "prompt": "string", "session_id": "string", "source": "string", "stop_hook_active": "boolean", "tool_name": "string"},
        {"Edit": "file_path", "MultiEdit": "file_path", "NotebookEdit": "notebook_path", "Write": "file_path"},
    ),
    "codex": Host(
        ("cwd", "hook_event_name", "model", "permission_mode", "session_id", "transcript_path"),
        {"SessionStart": ("source",), "UserPromptSubmit": ("turn_id", "prompt"), "PostToolUse": ("turn_id", "tool_name", "tool_input", "tool_response", "tool_use_id"), "Stop": ("turn_id", "stop_hook_active", "last_assistant_message")},
        {
            "agent_id": "string", "agent_type": "string", "cwd": "string", "hook_event_name": "string", "last_assistant_message": "nullable", "model": "string", "permission_mode": "string", "prompt": "string", "session_id": "string", "source": "string", "stop_hook_active": "boolean", "tool_name": "string",
            "tool_use_id": "string", "transcript_path": "nullable", "turn_id": "string",
        },
        patch_tool="apply_patch",
    ),
}
#: Fields of which the texts are read.
_TEXTS = ("cwd", "hook_event_name", "prompt", "session_id", "source", "tool_name")
_FILE_LINE = r"^\*\*\* (Add File|Update File|Delete File|Move to): *(.*?)\s*$"


def _kind(payload: Column, name: str) -> Column:
    """The type of a field as the payload has it: VOID for a null, null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))


def _text(payload: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(payload, path, "variant")) == "STRING", F.try_variant_get(payload, path, "string"))


def _fields(payload: Column, hosts: Sequence[Host]) -> Column:
    """object (whether it is one), kinds of all fields that any host names, and texts of those that are strings."""
    names = sorted({n for h in hosts for n in (*h.types, *h.common, *(n for e in EVENTS for n in h.required[e]), *_TEXTS)})
    is_object = F.startswith(F.schema_of_variant(payload), F.lit("OBJECT")).alias("object")
    return F.struct(is_object, F.struct(*(_kind(payload, n).alias(n) for n in names)).alias("kinds"), F.struct(*(_text(payload, f"$.{n}").alias(n) for n in _TEXTS)).alias("texts"))


def _problem(fields: Column, event: Column, host: Host) -> Column:
    """The first thing wrong with a payload of _fields; null where it is fine."""
    kinds, texts = fields["kinds"], fields["texts"]
    checks = [F.when(F.coalesce(~fields["object"], F.lit(True)), F.lit("not a JSON object"))]
    for e in EVENTS:
        for name in (*host.common, *host.required[e]):
            checks.append(F.when((event == e) & kinds[name].isNull(), F.lit(f"{name} is missing")))
    for name, kind in host.types.items():
        has = kinds[name]
        fine = has == "BOOLEAN" if kind == "boolean" else has.isin("STRING", "VOID") if kind == "nullable" else has == "STRING"
        checks.append(F.when(has.isNotNull() & ~fine, F.lit(f"{name} must be a {'string or null' if kind == 'nullable' else kind}")))
    checks.append(F.when(texts["hook_event_name"] != event, F.lit("a payload for another event")))
    checks.append(F.when(~F.startswith(texts["cwd"], F.lit("/")), F.lit("cwd is not absolute")))
    checks.append(F.when(texts["session_id"] == "", F.lit("session_id is empty")))
    return F.coalesce(*checks)


def _absolute(cwd: Column, path: Column) -> Column:
    return F.concat(F.lit("/"), normalized(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(cwd, F.lit("/"), path))))


def _patched(patch: Column, cwd: Column) -> Column:
    """changed and deleted of a patch: the last word on a file counts; a file that an update moves away is deleted."""
    lines = F.filter(F.transform(F.split(patch, "\n"), lambda x: F.struct(F.regexp_extract(x, _FILE_LINE, 1).alias("what"), F.regexp_extract(x, _FILE_LINE, 2).alias("path"))), lambda x: x["what"] != "")
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<path:string,gone:boolean>>").alias("said"))
    say = lambda path, gone: F.array(F.struct(path.alias("path"), F.lit(gone).alias("gone")))

    def step(state: Column, line: Column) -> Column:
        what, path = line["what"], _absolute(cwd, line["path"])
        moves = (what == "Move to") & state["open"].isNotNull()
        more = (
            F.when(moves & (path != state["open"]), F.concat(say(state["open"], True), say(path, False)))
            .when(moves | what.isin("Add File", "Update File"), say(path, False))
            .when(what == "Delete File", say(path, True))
            .otherwise(F.array().cast("array<struct<path:string,gone:boolean>>"))
        )
        return F.struct(F.when(what == "Update File", path).when((what == "Move to") & state["open"].isNull(), state["open"]).alias("open"), F.concat(state["said"], more).alias("said"))

    said = F.aggregate(lines, start, step)["said"]
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(said, lambda x: x["path"])), lambda p: F.struct(p, F.element_at(F.filter(said, lambda x: x["path"] == p), -1)["gone"])))
    return last


def payloads(raw: DataFrame, value: str = "value", agent: str = "agent", event: str = "event", hosts: dict[str, Host] = HOSTS) -> DataFrame:
    """Payloads raw(value, agent, event, ...) of several hosts, all in one pass: with a problem (null where they are fine), the form of intake, which only counts without a problem, and the payload as _value. For batches and streams.

    A payload is parsed once, its fields are read once.
    """
    name = F.col(event)
    read = once(raw, F.try_parse_json(F.col(value).cast("string")), "_payload")
    read = once(read, _fields(F.col("_payload"), list(hosts.values())), "_fields")
    p, fields = F.col("_payload"), F.col("_fields")
    tool, cwd = fields["texts"]["tool_name"], fields["texts"]["cwd"]
    problem, changed, deleted, none = F.lit("an unknown host"), [], [], F.array().cast("array<string>")
    edits = F.lit(False)
    for key, host in hosts.items():
        mine = F.col(agent) == key
        problem = F.when(mine, _problem(fields, name, host)).otherwise(problem)
        for t, at in host.path_fields.items():
            edits = edits | (mine & (tool == t))
            changed.append(F.when(mine & (tool == t), F.array_compact(F.array(_absolute(cwd, F.nullif(_text(p, f"$.tool_input.{at}"), F.lit("")))))))
        if host.patch_tool:
            given = F.coalesce(_text(p, "$.tool_input.command"), F.get(F.filter(F.try_variant_get(p, "$.tool_input.command", "array<string>"), lambda x: F.contains(x, F.lit("*** Begin Patch"))), F.lit(0)))
            files = F.when(mine & (tool == host.patch_tool) & given.isNotNull(), _patched(given, cwd))
            edits = edits | (mine & (tool == host.patch_tool))
            changed.append(F.map_keys(F.map_filter(files, lambda _, gone: ~gone)))
            deleted.append(F.map_keys(F.map_filter(files, lambda _, gone: gone)))
    post, known = name == "PostToolUse", name.isin(*EVENTS)
    wrote, gone = F.coalesce(*changed, none), F.coalesce(*deleted, none)
    patched = F.coalesce(*(x.isNotNull() for x in deleted), F.lit(False))
    read = once(read, F.when(post & edits, F.struct(wrote.alias("changed"), gone.alias("deleted"), patched.alias("patched"))), "_files")
    w = F.col("_files")
    lost = F.when((F.size(w["changed"]) + F.size(w["deleted"]) == 0) & ~w["patched"], F.lit("no file in the tool's input"))
    read = once(read, F.coalesce(F.when(~F.coalesce(known, F.lit(False)), F.lit("an unknown event")), problem, lost), "_problem")
    kept = [c for c in raw.columns if c not in (value, agent, event)]
    text = lambda n, when: F.when(name == when, fields["texts"][n])
    return read.select(
        *kept, F.col(value).alias("_value"), F.col(agent).alias("agent"), name.alias("event"), fields["texts"]["session_id"].alias("session_id"), cwd.alias("cwd"), text("source", "SessionStart").alias("source"), text("prompt", "UserPromptSubmit").alias("prompt"), text("tool_name", "PostToolUse").alias("tool"),
        F.coalesce(F.array_sort(w["changed"]), none).alias("changed"), F.coalesce(F.array_sort(w["deleted"]), none).alias("deleted"), F.coalesce(F.when(name == "Stop", F.try_variant_get(p, "$.stop_hook_active", "boolean")), F.lit(False)).alias("again"),
        F.col("_problem").alias("problem"),
    )


_FORM = ("agent", "event", "session_id", "cwd", "source", "prompt", "tool", "changed", "deleted", "again")


def intake(raw: DataFrame, value: str = "value", agent: str = "agent", event: str = "event", hosts: dict[str, Host] = HOSTS) -> tuple[DataFrame, DataFrame]:
    """Payloads raw(value, agent, event, ...) of several hosts in one form, and those that are none with a problem; for batches and streams. What needs both at once reads payloads.

    Form: agent, event, session_id, cwd, source (of a start), prompt, tool, changed and deleted (absolute paths that an edit
    tool wrote, sorted) and again (a stop that follows from a stop); other columns of raw stay. Fields that a host adds are ignored. A payload that
    is not JSON, lacks a field that its event has, has one of another type, or names no file where its tool writes one goes
    aside and stops nothing.
    """
    form = payloads(raw, value, agent, event, hosts)
    kept = [c for c in raw.columns if c not in (value, agent, event)]
    return form.where("problem is null").select(*kept, *_FORM), form.where("problem is not null").select(*kept, F.col("_value").alias(value), F.col("agent").alias(agent), F.col("event").alias(event), "problem")


def within(path: Column, root: Column) -> Column:
    """A path's place below a root; null outside of it."""
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))


#: Names below a path that a component may take although it doesn't take the path itself: files of each language, and one in a folder.
PROBES = ("_probe_.ts", "_probe_.tsx", "_probe_.js", "_probe_.py", "_probe_/_probe_.ts")


def _paths(prompt: Column) -> Column:
    """What looks like a path or a file's name in a prompt."""
    words = F.split(prompt, r"\s+")
    strip = lambda w, tail: F.regexp_replace(F.regexp_replace(w, r"""^[`"'(\[{<]+""", ""), tail, "")
    pairs = F.transform(words, lambda w: F.struct(strip(w, r"""[`"')\]}>,;:!?.]+$""").alias("w"), F.endswith(F.regexp_replace(w, r"""[`"')\]}>,;:!?]+$""", ""), F.lit("/")).alias("folder")))
    fine = F.filter(pairs, lambda x: (x["w"] != "") & ~F.contains(x["w"], F.lit("://")) & ~F.startswith(x["w"], F.lit("/")) & (F.contains(x["w"], F.lit("/")) | x["w"].rlike(r"\.[A-Za-z0-9]{1,6}$") | x["folder"]))
    return F.array_distinct(F.filter(F.transform(fine, lambda x: normalized(F.replace(x["w"], F.lit("\\"), F.lit("/")))), lambda p: p.isNotNull() & (p != "")))


#: Titles of a class that a row lists, and prompts that a list meets in one group, at most, about; rows of the answer that a partition opens, about.
LISTED, MEETING, OPENED = 1 << 10, 1 << 15, 1 << 25


def _kept(rows: DataFrame, tag: str) -> DataFrame:
    """The rows settled, without the shuffles that made them."""
    with tidied(rows.sparkSession):
        return settle(rows, tag)


def _sharing(asked: DataFrame, titles: DataFrame, least: int) -> DataFrame:
    """prompt_id and id: of asked(prompt_id, terms), one row a prompt, and titles(id, terms) those that share at least so many terms.

    Titles of the same terms are one class, named by its least id, and so are prompts: classes meet classes, once for all
    their members. A prompt is then dealt to the lists of titles that it matches, by class and list, and opened into rows
    there. So only the answer and, about a thousandth of it, what is dealt grow with prompts x titles; its rows come list by list, which files hold in few bits,
    over as many partitions as it needs.
    """
    own = titles.select("id", F.explode("terms").alias("term")).groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    classes = own.groupBy("terms").agg(F.min("id").alias("class"), F.count("*").alias("titles"))
    sets = asked.groupBy("terms").agg(F.min("prompt_id").alias("set"), F.count("*").alias("prompts"))
    met = sets.select("set", F.explode("terms").alias("term")).join(classes.select("class", F.explode("terms").alias("term")), "term")
    met = spread(met, "set").groupBy("set", "class").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("set").alias("_set"), "class")
    links = _kept(met.join(sets, F.col("_set").eqNullSafe(F.col("set"))).select("terms", "class", "prompts").hint("rebalance"), "links")
    sizes = links.groupBy("class").agg(F.sum("prompts").alias("prompts")).join(classes.select("class", "titles"), "class")
    share = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    deal = _kept(sizes.select("class", share("titles", LISTED).alias("lists"), share("prompts", MEETING).alias("groups"), (F.col("titles") * F.col("prompts")).alias("rows")), "deal")
    n = max(shares(asked), -(-(deal.agg(F.sum("rows")).first()[0] or 0) // OPENED))
    deal, keys = deal.drop("rows"), ("class", "list", "group")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    at = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    left = asked.join(links.select("terms", "class"), "terms").join(deal, "class").select("prompt_id", "class", at("prompt_id", "groups").alias("group"), each("lists").alias("list"))
    listed = own.join(classes, "terms").join(deal, "class").select("class", "groups", at("id", "lists").alias("list"), "id")
    listed = listed.groupBy("class", "list", "groups").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("class", "list", each("groups").alias("group"), "ids")
    both = left.repartition(n, *keys).join(listed.repartition(n, *keys).hint("merge"), list(keys))
    return both.select("prompt_id", F.explode("ids").alias("id"))


def _about(prompts: DataFrame, components: Sequence[Component]) -> DataFrame:
    """One row a prompt_id: hits, the components and paths that its prompts name (structs of kind and id), and terms, theirs in order; each once."""
    said = F.col("prompt")
    named = [F.when(said.rlike(rf"(?i)(?<![A-Za-z0-9_-])\Q{c.id}\E(?![A-Za-z0-9_-])"), F.struct(F.lit("component").alias("kind"), F.lit(c.id).alias("id"))) for c in components if len(c.id) >= 3]
    none = F.array().cast("array<struct<kind:string,id:string>>")
    of = lambda path: F.coalesce(component_of(path, components), *(component_of(F.concat(path, F.lit(f"/{x}")), components) for x in PROBES))
    rows = spread(prompts.select("prompt_id", "prompt"), "prompt_id")
    found = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(_paths(said), F.array().cast("array<string>")))).alias("_path"))
    found = once(found, F.when(F.col("_path").isNotNull(), of(F.col("_path"))), "_own")
    hits = F.when(F.col("_path").isNull(), F.array_compact(F.array(*named)) if named else none).when(F.col("_own").isNotNull(), F.array(F.struct(F.lit("path").alias("kind"), F.col("_path").alias("id")), F.struct(F.lit("component").alias("kind"), F.col("_own").alias("id"))))
    found = found.select("prompt_id", hits.alias("hits"), F.when(F.col("_path").isNull(), _terms(said)).alias("terms"))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return found.groupBy("prompt_id").agg(every("hits").alias("hits"), every("terms").alias("terms"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: F.length(w) >= 3))


def prompt_matches(prompts: DataFrame, components: Sequence[Component], titles: DataFrame, least: int = 2) -> DataFrame:
    """prompt_id, kind (component, path or decision) and id: what prompts(prompt_id, prompt) are about; for batches, those of a stream of prompts too.

    A component whose id, of three letters or more, stands in the prompt; a path within a component, or one that a
    component takes the files of, with that component; a decision of titles(id, title) that shares at least so many
    different terms of three letters or more with the prompt. Prompts of one prompt_id are one. Each prompt is read once,
    what it is about is settled; terms are joined by equality. One row for each thing.
    """
    about = _kept(_about(prompts, components), "about")
    direct = about.select("prompt_id", F.explode("hits").alias("hit")).select("prompt_id", "hit.kind", "hit.id")
    shared = _sharing(about.select("prompt_id", "terms"), titles.select("id", _terms(F.col("title")).alias("terms")), least)
    return direct.union(shared.select("prompt_id", F.lit("decision").alias("kind"), "id"))

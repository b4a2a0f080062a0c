"""What a task should know: rules, decisions, partners and findings that touch its components and files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import count_and_first, more
from ..functions.globs import glob_match
from ..functions.text import tokens
from ..schemas import Component, Rule
from . import globindex


def change_partners(pairs: DataFrame, touched: DataFrame, top: int = 5) -> DataFrame:
    """item, partner, support, confidence: what changes together with touched(item), pairs(a, b, ...) taken both ways, the best first."""
    t = touched.select("item").distinct()
    both = pairs.select(F.col("a").alias("item"), F.col("b").alias("partner"), "support", "confidence").union(pairs.select(F.col("b").alias("item"), F.col("a").alias("partner"), "support", "confidence"))
    return both.join(t, "item", "left_semi").join(t.withColumnRenamed("item", "partner"), "partner", "left_anti").orderBy(F.desc("support"), F.desc("confidence"), "item", "partner").select("item", "partner", "support", "confidence").limit(top)


def observed(graph: DataFrame, most: int = 6) -> DataFrame:
    """component, side (dependencies or dependents) and listed: the components on that side by graph(from_c, to_c, cnt), those with the most imports first, and "+n more" behind the first ones."""
    end = lambda own, other, side: graph.select(F.col(own).alias("component"), F.lit(side).alias("side"), (-F.col("cnt")).alias("less"), F.col(other).alias("other"))
    few = count_and_first(end("from_c", "to_c", "dependencies").union(end("to_c", "from_c", "dependents")), ["component", "side"], ["less", "other"], most)
    texts = F.transform("first", lambda x: F.concat(x["other"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(")")))
    return few.select("component", "side", F.array_join(more(texts, F.col("n")), ", ").alias("listed"))


def rules_touching(touched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, kind, level and items: rules one of whose selectors takes a component or path of touched(component, path)."""
    made = []
    for r in rules:
        hit = F.lit(False)
        for s in (*r.from_, *r.to_, *r.members, *r.targets, *r.components, *r.within, *(x for g in r.layers for x in g)):
            hit = hit | (F.lit(True) if s == "*" else glob_match(F.col("path"), [s[5:]]) if s.startswith("path:") else F.lit(False) if s.startswith("pkg:") else F.coalesce(F.col("component") == s, F.lit(False)))
        made.append(F.when(hit, F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.level).alias("level"))))
    if not made:
        return touched.sparkSession.createDataFrame([], "rule string, kind string, level string, items long")
    return touched.select(F.explode(F.array_compact(F.array(*made))).alias("r")).groupBy("r.rule", "r.kind", "r.level").agg(F.count("*").alias("items"))


def constraints(rules: Sequence[Rule], component: str) -> list[tuple[str, str]]:
    """(rule, sentence) on what a component may and must not import."""
    out = []
    for r in rules:
        if r.level == "off":
            continue
        if r.kind == "forbid" and component in r.from_:
            out.append((r.id, f"must not import {', '.join(r.to_)}"))
        elif r.kind == "allow-only" and component in r.from_:
            out.append((r.id, f"may only import {', '.join(r.to_) or 'itself'}"))
        elif r.kind == "layers":
            at = next((k for k, g in enumerate(r.layers) if component in g), None)
            if at is not None and (above := [s for g in r.layers[:at] for s in g]):
                out.append((r.id, f"must not import {', '.join(above)}"))
        elif r.kind == "independent" and component in r.members:
            out.append((r.id, f"must not import {', '.join(m for m in r.members if m != component)}"))
        elif r.kind == "entrypoints" and component in r.targets:
            out.append((r.id, "is imported through its entry points only"))
    return out


def governing(decisions: DataFrame, touched: DataFrame, components: Sequence[Component]) -> DataFrame:
    """id, title, status of live decisions(id, title, status, governs) that govern everything (*, unless rejected), a component of touched(component, path), or by a glob one of its paths. A touched table without rows touches nothing."""
    live = decisions.where(F.col("status").isin("accepted", "proposed", "rejected"))
    g = live.select("id", "title", "status", F.explode("governs").alias("target"))
    known = [c.id for c in components]
    named = F.col("target").isin(*known) if known else F.lit(False)
    own = touched.select(F.col("component").alias("target")).where("target is not null").distinct()
    made = [g.where(named).join(own, "target", "left_semi"), g.where("target = '*' and status <> 'rejected'").join(touched.select(F.lit("*").alias("target")).limit(1), "target", "left_semi")]
    if "path" in touched.columns:
        globs = g.where(~named & (F.col("target") != "*"))
        taken = globindex.matches(globs.select(F.col("target").alias("glob")), touched).select(F.col("glob").alias("target"))
        made.append(globs.join(taken, "target", "left_semi"))
    return reduce(DataFrame.union, made).select("id", "title", "status").distinct()


def mentioned_components(prompts: DataFrame, components: Sequence[Component]) -> DataFrame:
    """prompt_id and component: ids of three letters or more that a prompt has as whole words."""
    ids = [c.id for c in components if len(c.id) >= 3]
    hit = F.array_compact(F.array(*(F.when(F.lower("text").rlike(rf"(?<![a-z0-9_-])\Q{i.lower()}\E(?![a-z0-9_-])"), F.lit(i)) for i in ids))) if ids else F.array().cast("array<string>")
    return prompts.select("prompt_id", F.explode(hit).alias("component"))


def mentioned_paths(prompts: DataFrame, files: DataFrame) -> DataFrame:
    """prompt_id and path: files whose path a prompt has as a word, quotes and punctuation around it aside."""
    words = F.transform(F.split("text", r"[\s\"'`(),;]+"), lambda w: F.regexp_replace(w, r"^\./|[.:]+$", ""))
    return prompts.select("prompt_id", F.explode(F.array_distinct(words)).alias("path")).where("path <> ''").join(files.select("path").distinct(), "path", "left_semi").select("prompt_id", "path")


def task_terms(text: str, spark) -> list[str]:
    return spark.range(1).select(F.array_distinct(tokens(F.lit(text)))).first()[0]

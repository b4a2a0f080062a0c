"""Counts that commands print, lookups that explain, and facts kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def rollup(rules: DataFrame, decisions: DataFrame, baseline: DataFrame) -> DataFrame:
    """what, name, n: rules by level, decisions by status, baseline entries."""
    by = lambda d, what, c: d.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count("*").alias("n"))
    held = baseline.agg(F.lit("baseline").alias("what"), F.lit("findings").alias("name"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"))
    return by(rules, "rules", "level").union(by(decisions, "decisions", "status")).union(held)


def status_counts(findings: DataFrame) -> DataFrame:
    """A row for each rule with a column for each status."""
    return findings.groupBy("rule").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "existing", "baselined", "waived")))


def error_counts(findings: DataFrame) -> DataFrame:
    """fingerprint and n of new errors: what a session's snapshot holds."""
    return findings.where("level = 'error' and status = 'new'").groupBy("fingerprint").agg(F.count("*").alias("n"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("component", "change").agg(F.count("*").alias("n"))


def coverage_text(analyzed: Column, sources: Column) -> Column:
    """The share of source files that were analyzed, in percent; less than one is said so, no sources are all."""
    share = F.when(sources == 0, 1.0).otherwise(analyzed / sources)
    return F.when((share > 0) & (share < 0.01), "<1%").otherwise(F.concat(F.floor(share * 100).cast("string"), F.lit("%")))


def explain_component(component: str, metrics: DataFrame, graph: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: a component's metrics, what it imports, what imports it and its open findings."""
    out = graph.where(F.col("from_c") == component).agg(F.array_sort(F.collect_set("to_c")).alias("imports"))
    into = graph.where(F.col("to_c") == component).agg(F.array_sort(F.collect_set("from_c")).alias("imported_by"))
    open_ = findings.where((F.col("from_") == component) & (F.col("status") != "waived") & (F.col("level") != "info")).agg(F.count("*").alias("findings"))
    return metrics.where(F.col("component") == component).crossJoin(out).crossJoin(into).crossJoin(open_)  # one row each


def overdue(decisions: DataFrame, today: str) -> DataFrame:
    """id and review_by of accepted decisions(id, status, review_by) whose review is due."""
    return decisions.where((F.col("status") == "accepted") & (F.to_date("review_by") < F.lit(today).cast("date"))).select("id", "review_by")


def decision_problems(decisions: DataFrame) -> DataFrame:
    """id and problem: ids used twice, superseded ones that name no or an unknown successor, titles that are missing."""
    n = F.count("*").over(W.partitionBy("id"))
    twice = decisions.withColumn("n", n).where("n > 1").select("id", F.lit("id is used more than once").alias("problem")).distinct()
    known = decisions.select(F.col("id").alias("superseded_by"), F.lit(True).alias("known")).distinct()
    lost = decisions.where("status = 'superseded'").join(known, "superseded_by", "left").where("known is null").select("id", F.lit("names no known successor").alias("problem"))
    untitled = decisions.where("coalesce(title, '') = ''").select("id", F.lit("has no title").alias("problem"))
    return twice.union(lost).union(untitled)


def with_cache(spark: SparkSession, files: DataFrame, path: str, extract: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """Facts of files(path, text, content_id) by extract, which keeps content_id: known contents come from the cache at path, new ones are read, appended and returned with them. Another version is another cache."""
    at = f"{path.rstrip('/')}/{version}"
    try:
        known = spark.read.parquet(at)
    except AnalysisException:
        known = None
    contents = files.select("content_id", "text").dropDuplicates(["content_id"])
    fresh = contents if known is None else contents.join(known.select("content_id").distinct(), "content_id", "left_anti")
    extract(fresh).write.mode("append").parquet(at)
    facts = spark.read.parquet(at)
    return files.select("path", "content_id").join(facts, "content_id")


def refreshed(edges: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges with those from changed(path) files replaced by fresh ones, as foreachBatch does for each batch of edits."""
    return edges.join(changed.select(F.col("path").alias("from_")).distinct(), "from_", "left_anti").unionByName(fresh)


def to_resolve_again(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files to look at after an edit: the changed(path, deleted) ones, those that import a deleted one, and those with an import that leads nowhere."""
    gone = changed.where("deleted").select(F.col("path").alias("to_"))
    asks = edges.join(gone, "to_", "left_semi").select(F.col("from_").alias("path")).union(edges.where("unresolved").select(F.col("from_").alias("path"))).union(changed.where("not deleted").select("path"))
    return asks.distinct()

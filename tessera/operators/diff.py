"""Two versions compared: structure, public surface, findings, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_signature


def edge_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """from_c, to_c, change (added or removed) of component edges."""
    keys = ["from_c", "to_c"]
    one = lambda a, b, what: a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").withColumn("change", F.lit(what))
    return one(head, base, "added").union(one(base, head, "removed"))


def new_cycles(base: DataFrame, head: DataFrame) -> DataFrame:
    """Member lists (joined by commas) of components of head(node, scc) that base hasn't."""
    key = lambda d: d.groupBy("scc").agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("members")).select("members")
    return key(head).join(key(base), "members", "left_anti")


def api_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """component, file, name, change (added, removed, changed) of exports(component, file, name, signature); formatting alone is no change."""
    keys = ["component", "file", "name"]
    side = lambda d, s: d.groupBy(*keys).agg(F.min(normalize_signature(F.col("signature"))).alias(s)).withColumn(f"has_{s}", F.lit(True))
    both = side(base, "old").join(side(head, "new"), keys, "full_outer")
    change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def first_seen_change(changes: DataFrame) -> DataFrame:
    """One change for each component, name and kind of change: that of the first file."""
    w = W.partitionBy("component", "name", "change").orderBy("file")
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_dependents(base: DataFrame, head: DataFrame, deprecated: DataFrame) -> DataFrame:
    """Head edges (file, from_c, to_c, line) into components of deprecated(component) from files that had no edge into them."""
    into = head.join(deprecated.select(F.col("component").alias("to_c")).distinct(), "to_c", "left_semi").where("not (from_c <=> to_c)")
    return into.join(base.select("file", "to_c").distinct(), ["file", "to_c"], "left_anti").select("file", "from_c", "to_c", "line")


def diff_budget(head: DataFrame, base: DataFrame) -> DataFrame:
    """head findings with the status existing for as many new ones of a fingerprint as the base holds beyond its baselined ones. base: fingerprint, occurrences, baselined."""
    budget = base.groupBy("fingerprint").agg(F.greatest(F.lit(0), F.sum("occurrences") - F.sum("baselined")).alias("_budget"))
    fresh = F.col("status") == "new"
    nth = F.when(fresh, F.row_number().over(W.partitionBy("fingerprint", fresh).orderBy("file", "line", "message")))
    return head.withColumn("_nth", nth).join(budget, "fingerprint", "left").withColumn("status", F.when(F.col("_nth") <= F.col("_budget"), F.lit("existing")).otherwise(F.col("status"))).select(*head.columns)


def lost_findings(base: DataFrame, head: DataFrame) -> DataFrame:
    """rule, fingerprint, lost: findings that the base contract yields more often than the head contract, on one graph."""
    keys = ["rule", "fingerprint"]
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    return n(base, "was").join(n(head, "now"), keys, "left").select(*keys, (F.col("was") - F.coalesce("now", F.lit(0))).alias("lost")).where("lost > 0")


def waiver_changes(base: DataFrame, head: DataFrame, today: str) -> DataFrame:
    """rule, from_, to_, expires, change (added or extended) of head waivers(rule, from_, to_, expires) that still hold."""
    old = base.groupBy("rule", "from_", F.coalesce("to_", F.lit("")).alias("_to")).agg(F.max("expires").alias("_was"))
    joined = head.where(F.col("expires") >= F.lit(today).cast("date")).withColumn("_to", F.coalesce("to_", F.lit(""))).join(old, ["rule", "from_", "_to"], "left")
    return joined.select("rule", "from_", "to_", "expires", F.when(F.col("_was").isNull(), "added").when(F.col("expires") > F.col("_was"), "extended").alias("change")).where("change is not null")


def baseline_growth(base: DataFrame, head: DataFrame, enforced: DataFrame) -> DataFrame:
    """rule, grown: how far counts of fingerprints rose in baselines(fingerprint, rule, count), for rules(rule) enforced at the base."""
    n = lambda d, c: d.groupBy("fingerprint", "rule").agg(F.sum("count").alias(c))
    both = n(base, "was").join(n(head, "now"), ["fingerprint", "rule"], "full_outer").withColumn("grown", F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))).where("grown > 0")
    return both.join(enforced.select("rule").distinct(), "rule", "left_semi").groupBy("rule").agg(F.sum("grown").alias("grown"))


def approvals(rows: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """rows(rule, ...) with approved_by: the first accepted head decision whose weakens list newly has the rule, or the word baseline where a row's type is baseline-grown.

    Decisions: id, status, weakens and, if there, title. A head decision's base version has its id, else its title; what an
    accepted one listed before is no news.
    """
    name = lambda d: F.trim(F.regexp_replace(F.lower("title"), r"\s+", " ")) if "title" in d.columns else F.lit(None).cast("string")
    known = base.select("id", name(base).alias("t"), F.when(F.col("status") == "accepted", F.col("weakens")).alias("w"))
    now = head.where("status = 'accepted'").select("id", name(head).alias("t"), F.explode("weakens").alias("listed")).distinct()
    by_id = known.groupBy("id").agg(F.lit(True).alias("same"), F.flatten(F.collect_list("w")).alias("w1"))
    by_title = known.where("t is not null").groupBy("t").agg(F.min_by("w", "id").alias("w2"))
    seen = F.when(F.col("same"), F.col("w1")).otherwise(F.col("w2"))
    news = now.join(by_id, "id", "left").join(by_title, "t", "left").where(~F.coalesce(F.array_contains(seen, F.col("listed")), F.lit(False)))
    first = news.groupBy("listed").agg(F.min("id").alias("approver"))
    out = rows.join(first.select(F.col("listed").alias("rule"), F.col("approver").alias("approved_by")), "rule", "left")
    if "type" in rows.columns:
        grown = first.where("listed = 'baseline'").agg(F.min("approver").alias("_any"))  # one row
        out = out.crossJoin(F.broadcast(grown)).withColumn("approved_by", F.when(F.col("type") == "baseline-grown", F.least("approved_by", "_any")).otherwise(F.col("approved_by"))).drop("_any")
    return out.select(*rows.columns, "approved_by")


def file_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) of files(path, content_id)."""
    both = base.select("path", F.col("content_id").alias("old")).join(head.select("path", F.col("content_id").alias("new")), "path", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")

"""Change history: co-change, churn, hotspots and hidden coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.bounded import parted, shares, spread
from ..functions.globs import patterns_regex
from ..scratch import release, settle
from .graph import clusters

#: Files that are not production code.
NON_PRODUCTION = (
    "**/*.test.*", "**/*.spec.*", "**/*_test.*", "**/test_*.py", "**/*Tests.swift", "**/test/**", "**/tests/**", "**/testdata/**", "**/__tests__/**", "**/__mocks__/**", "**/fixtures/**", "**/__fixtures__/**", "**/e2e/**", "**/examples/**", "**/benches/**", "**/benchmarks/**", "**/scripts/**",
)


def is_non_production(path: Column) -> Column:
    return path.rlike("(?i)" + patterns_regex(NON_PRODUCTION))


def months_before(at: Column, months: int) -> Column:
    """months earlier by the calendar, days that the month lacks running over into the next one."""
    first = F.add_months(F.date_trunc("month", at).cast("date"), -months)
    return F.date_add(first, F.dayofmonth(at) - 1)


def in_window(commits: DataFrame, months: int) -> DataFrame:
    """commits(seq, sha, ts) of the months up to the newest one's day."""
    newest = commits.agg(F.max("ts").alias("newest"))
    return commits.crossJoin(F.broadcast(newest)).where(F.col("ts").cast("date") >= months_before(F.col("newest"), months)).drop("newest")  # newest: one row


def usable(commit_files: DataFrame, most_files: int = 50) -> DataFrame:
    """Rows of commits that touch no more than most_files files; larger ones say nothing about what belongs together."""
    n = F.count("*").over(W.partitionBy("sha"))
    return spread(commit_files.where("sha is not null"), "sha").withColumn("_n", n).where(F.col("_n") <= most_files).drop("_n")


def _commits(changed: DataFrame, *by: str) -> DataFrame:
    """sha, by and items (different ones, in order). The commits are dealt over all partitions before they meet, so a task holds its share of them, whatever it reads."""
    return spread(changed.select(*by, "sha", "item").where("item is not null"), "sha").groupBy(*by, "sha").agg(F.sort_array(F.collect_set("item")).alias("items"))


def pair_counts(changed: DataFrame, *by: str) -> DataFrame:
    """a, b (in order) and n: in how many commits of changed(sha, item) both change; for each value of by, which a commit has one of. Pairs stay bounded because a commit's items are (see usable), and are opened from a commit's row, without a join."""
    firsts = _commits(changed, *by).where("sha is not null").select(*by, "items", F.posexplode("items").alias("at", "a"))
    both = firsts.select(*by, "a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b"))
    return both.groupBy(*by, "a", "b").agg(F.count("*").alias("n"))


def item_counts(changed: DataFrame, *by: str) -> DataFrame:
    return _commits(changed, *by).select(*by, F.explode("items").alias("item")).groupBy(*by, "item").agg(F.count("*").alias("n"))


def cochange_of(pairs: DataFrame, items: DataFrame, min_support: int = 5, min_confidence: float = 0.5) -> DataFrame:
    """a, b, support, confidence by pairs(a, b, n) and items(item, n). Confidence is the support over the rarer item's commits; it is compared before it is rounded."""
    often = pairs.where(F.col("n") >= min_support).select("a", "b", F.col("n").alias("support"))
    n = lambda c: items.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"))
    confidence = F.col("support") / F.least("n_a", "n_b")
    return often.join(n("a"), "a").join(n("b"), "b").where(confidence >= min_confidence).select("a", "b", "support", F.round(confidence, 3).alias("confidence"))


def cochange(changed: DataFrame, min_support: int = 5, min_confidence: float = 0.5) -> DataFrame:
    """a, b, support, confidence for pairs of items that change in the same commits of changed(sha, item).

    A commit's row is opened into its items (b is null) and its pairs at once, so changed is read once. Both are counted over
    as many partitions as its files need; the counts of items and of frequent pairs are settled, all that is left of them.
    """
    none = f"cast(array(null) as array<{changed.schema['item'].dataType.simpleString()}>)"
    at = _commits(changed).select("sha", "items", F.posexplode("items").alias("at", "a"))
    both = at.select("a", F.explode(F.expr(f"if(sha is null, {none}, concat({none}, slice(items, at + 2, size(items))))")).alias("b"))
    with parted(changed.sparkSession, shares(changed)):
        counts = settle(both.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("b").isNull() | (F.col("n") >= min_support)), "cochange")
    return cochange_of(counts.where("b is not null"), counts.where("b is null").select(F.col("a").alias("item"), "n"), min_support, min_confidence)


def kept_counts(changed: DataFrame, path: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """pair_counts and item_counts of changed(sha, item, ts), of which those of spans of so many days that are as they were come from the table at path; others are counted and replaced there.

    A span is known by the number and a sum of hashes of its rows. So commits that are new, gone or out of the window by
    now cost their spans alone: those at both ends of the window, as a rule. Spans outside of the window stay in the table
    and are not read. Marks are written last, so that a run that ends before counts anew.
    """
    spark = changed.sparkSession
    spans = changed.withColumn("span", F.floor(F.unix_timestamp("ts") / (86400 * days)).cast("int"))
    mark = F.concat_ws("-", F.count("*").cast("string"), F.sum(F.xxhash64("sha", "item").cast("decimal(38,0)")).cast("string"))
    now = settle(spans.groupBy("span").agg(mark.alias("mark")), "history-marks")
    tables = {name: f"{path.rstrip('/')}/{name}" for name in ("marks", "pairs", "items")}

    def read(name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(tables[name])
        except AnalysisException:
            return spark.createDataFrame([], schema)

    held = read("marks", "mark string, span int").groupBy("span").agg(F.max("mark").alias("mark"))
    stale = settle(now.join(held, ["span", "mark"], "left_anti"), "history-stale")
    if stale.head(1):
        again = spans.join(stale, "span")
        for name, counts in (("pairs", pair_counts), ("items", item_counts)):
            counts(again, "span", "mark").write.partitionBy("span").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(tables[name])
        stale.select("mark", "span").coalesce(1).write.partitionBy("span").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(tables["marks"])
    # a span that has no pairs any more leaves its old partition behind; its mark doesn't match
    own = lambda name, keys: read(name, f"{', '.join(f'{k} {changed.schema['item'].dataType.simpleString()}' for k in keys)}, n long, mark string, span int").join(now, ["span", "mark"], "left_semi").groupBy(*keys).agg(F.sum("n").alias("n"))
    return own("pairs", ["a", "b"]), own("items", ["item"])


def hidden_coupling(pairs: DataFrame, graph: DataFrame) -> DataFrame:
    """Pairs of components that change together without a dependency either way."""
    linked = graph.select(F.col("from_c").alias("a"), F.col("to_c").alias("b")).union(graph.select(F.col("to_c").alias("a"), F.col("from_c").alias("b"))).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti")


def change_clusters(pairs: DataFrame, files: DataFrame, top: int = 10) -> DataFrame:
    """components, files (both sorted) and support of the groups of files that co-change pairs(a, b, support) connect, as far as they lie in two components at least: those of the highest support of a pair first, then the larger, then by the first file. files: path, component."""
    root = clusters(pairs)
    support = pairs.join(root, pairs["a"] == root["node"]).groupBy("root").agg(F.max("support").alias("support"))
    members = settle(root.join(files.select(F.col("path").alias("node"), "component"), "node", "left"), "change-clusters")
    size = members.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("component").alias("parts"), F.min("node").alias("first")).where("parts > 1")
    best = size.join(support, "root").orderBy(F.desc("support"), F.desc("n"), "first").limit(top)
    told = members.join(F.broadcast(best), "root").groupBy("root", "support", "n", "first").agg(F.array_sort(F.collect_set("component")).alias("components"), F.array_sort(F.collect_set("node")).alias("files"))  # best: top rows
    return told.orderBy(F.desc("support"), F.desc("n"), "first").select("components", "files", "support")


def churn(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("path").agg(F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.count_distinct("sha").alias("commits"))


def hotspots(commit_files: DataFrame, files: DataFrame, top: int = 20) -> DataFrame:
    """path, churn, commits, loc, score: production files changed three times at least, in the upper quarter by churn x lines and the upper half by lines (nearest rank over all changed production files)."""
    changed = churn(commit_files).join(files.select("path", "loc"), "path").where((F.col("churn") > 0) & (F.col("loc") > 0) & ~is_non_production(F.col("path"))).withColumn("score", F.col("churn") * F.col("loc"))
    cut = changed.agg(F.expr("percentile_disc(0.75) within group (order by score)").alias("least_score"), F.expr("percentile_disc(0.5) within group (order by loc)").alias("least_loc"))
    kept = changed.crossJoin(F.broadcast(cut)).where("commits >= 3 and score >= least_score and loc >= least_loc")  # cut: one row
    return kept.select("path", "churn", "commits", "loc", "score").orderBy(F.desc("score"), "path").limit(top)


def renamed(commit_files: DataFrame, renames: DataFrame) -> DataFrame:
    """commit_files with old paths replaced by today's. renames: seq (0 is the newest commit), old, new.

    A rename holds for the commits older than it. Chains are followed link by link, from older renames to newer ones, so
    each round joins the current names with the renames that came after.
    """
    now = commit_files.withColumn("_at", F.col("seq")).withColumn("_row", F.monotonically_increasing_id())
    now = settle(now, "renames")
    columns = [c for c in now.columns if c not in ("path", "_at")]
    while True:  # ends: each round follows renames that are newer than the last
        r = renames.select(F.col("seq").alias("_seq"), F.col("old").alias("path"), F.col("new").alias("_new"))
        hit = now.join(r, "path").where("_seq < _at").withColumn("_nth", F.row_number().over(W.partitionBy("_row").orderBy(F.desc("_seq"), "_new"))).where("_nth = 1").select("_row", "_new", "_seq")
        nxt = settle(now.join(hit, "_row", "left").select(*columns, F.coalesce("_new", "path").alias("path"), F.coalesce("_seq", "_at").alias("_at"), F.col("_new").isNotNull().alias("_moved")), "renames")
        moved = nxt.where("_moved").limit(1).count()
        release(now)
        now = nxt.drop("_moved")
        now.settled_at = nxt.settled_at
        if not moved:
            break
    return now.select(*commit_files.columns)


def numstat(log: DataFrame, line: str = "line") -> DataFrame:
    """added, deleted, old and path of each line of git's numstat output; a binary file counts 0, old is null without a rename."""
    part = lambda k: F.regexp_extract(line, r"^([0-9]+|-)\t([0-9]+|-)\t(.*)$", k)
    raw, braces = part(3), r"^(.*)\{(.*) => (.*)\}(.*)$"
    side = lambda k: F.regexp_replace(F.concat(F.regexp_extract(raw, braces, 1), F.regexp_extract(raw, braces, k), F.regexp_extract(raw, braces, 4)), "//", "/")
    plain = r"^(.*) => (.*)$"
    new = F.when(raw.rlike(braces), side(3)).when(raw.rlike(plain), F.regexp_extract(raw, plain, 2)).otherwise(raw)
    old = F.when(raw.rlike(braces), side(2)).when(raw.rlike(plain), F.regexp_extract(raw, plain, 1))
    n = lambda k: F.when(part(k) == "-", F.lit(0)).otherwise(part(k).try_cast("long"))
    return log.where(raw != "").withColumns({"added": n(1), "deleted": n(2), "old": old, "path": new})

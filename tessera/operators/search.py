"""Search, prompt matching, evidence and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, decision_id, tokens
from . import globindex

K1, B = 1.2, 0.75


def term_frequencies(documents: DataFrame) -> DataFrame:
    """id, term, tf of documents(id, text)."""
    return documents.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def bm25(documents: DataFrame, query: str, top: int = 10) -> DataFrame:
    """id and score (6 decimals) of the best documents for a query, ties by id. Only postings of the query's terms leave the scan; lengths come as one number a document."""
    spark = documents.sparkSession
    terms = [t for t in dict.fromkeys(spark.range(1).select(tokens(F.lit(query))).first()[0])]
    counted = documents.select("id", tokens(F.col("text")).alias("t")).select("id", F.size("t").alias("length"), F.filter("t", lambda w: w.isin(terms)).alias("hits") if terms else F.array().cast("array<string>").alias("hits"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = counted.where(F.size("hits") > 0).select("id", "length", F.explode("hits").alias("term")).groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # df: a row for each query term; stats: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def evidence(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes(id, source, quote) with found: whether the source(source, text) has the quote, white space collapsed."""
    texts = sources.select("source", collapse(F.col("text")).alias("_text"))
    return quotes.join(texts, "source", "left").select("id", "source", F.coalesce(F.contains(F.col("_text"), collapse(F.col("quote"))), F.lit(False)).alias("found"))


def title_matches(prompts: DataFrame, titles: DataFrame, least: int = 2) -> DataFrame:
    """prompt_id, title_id, shared: titles that share at least so many different terms of three letters or more with a prompt. An equality join on terms."""
    terms = lambda d, key: d.select(key, F.explode(F.array_distinct(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 3))).alias("term"))
    return terms(prompts, "prompt_id").join(terms(titles, "title_id"), "term").groupBy("prompt_id", "title_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def stale_governs(decisions: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """id, target: what accepted decisions(id, status, governs) govern that is neither *, a component(component) nor a glob that takes a path of files(path). Globs meet the files that share their literal part."""
    asked = decisions.where("status = 'accepted'").select("id", F.explode("governs").alias("target")).where("target <> '*'").distinct()
    asked = asked.join(components.select(F.col("component").alias("target")), "target", "left_anti")
    taken = globindex.matches(asked.select(F.col("target").alias("glob")), files).select(F.col("glob").alias("target")).distinct()
    return asked.join(taken, "target", "left_anti").select("id", "target")


def retired_citations(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """rule, decision, status: rules(rule, because) that rest on a decision superseded, deprecated or rejected."""
    cited = rules.select("rule", F.explode("because").alias("raw")).select("rule", decision_id(F.col("raw")).alias("decision"))
    return cited.join(decisions.select(F.col("id").alias("decision"), "status"), "decision").where(F.col("status").isin("superseded", "deprecated", "rejected")).select("rule", "decision", "status").distinct()


def unchecked_assumptions(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """id, check: accepted and proposed decisions whose assumption names a rule that doesn't exist. decisions: id, status, checks."""
    open_ = decisions.where(F.col("status").isin("accepted", "proposed"))
    return open_.select("id", F.explode("checks").alias("check")).join(rules.select(F.col("rule").alias("check")), "check", "left_anti").select("id", "check")


def page(findings: DataFrame, offset: int, size: int, cursor: str | None = None) -> tuple[DataFrame, str]:
    """Rows offset to offset + size in the order of key, and the cursor that names the whole list; a cursor of another list is refused.

    The list's hash is a sum over rows, so it takes no ordering and no collected list.
    """
    mark = findings.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(F.xxhash64("key").cast("decimal(38,0)")), F.lit(0)).cast("string")), 256), 1, 12)).first()[0]
    if cursor is not None and cursor != mark:
        raise ValueError("the list has changed since this cursor was made")
    return findings.orderBy("key").offset(offset).limit(size), mark


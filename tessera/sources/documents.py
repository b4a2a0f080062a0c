"""Decision records and knowledge cards: markdown with front matter, read with Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decision_id
from . import markdown

_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, _FRONT, 1)


def body(text: Column) -> Column:
    return F.when(text.rlike(_FRONT), F.regexp_extract(text, _FRONT, 2)).otherwise(text)


def field(front: Column, name: str) -> Column:
    """A scalar of simple front matter; null where it is absent."""
    got = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.+?)[ \t]*$", 1)
    return F.when(got != "", F.regexp_replace(got, r"""^["']|["']$""", ""))


def items(front: Column, name: str) -> Column:
    """A list of simple front matter, on one line in brackets or as dashed lines."""
    inline = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\[(.*?)\][ \t]*$", 1)
    block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]*.*(?:\r?\n|$))+)", 1)
    clean = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(F.trim(x), r"""^-?[ \t]*["']?|["']?[ \t]*$""", "")), lambda x: x != "")
    return F.when(inline != "", clean(F.split(inline, ","))).otherwise(clean(F.split(block, r"\r?\n")))


#: The statuses of a decision, and other words for them.
STATUSES = ("proposed", "accepted", "rejected", "deprecated", "superseded")
STATUS_WORDS = {"approved": "accepted", "adopted": "accepted", "draft": "proposed"}


def names(value: Column) -> Column:
    """A list written on one line, parted by commas."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")


def status_of(said: Column) -> Column:
    """The status that a text starts with, marks aside; proposed where there is none or an unknown one."""
    word = F.regexp_extract(F.lower(F.regexp_replace(said, "[*_`]", "")), "^[^a-z]*([a-z]+)", 1)
    word = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_WORDS.items() for x in kv)), word), word)
    return F.when(word.isin(*STATUSES), word).otherwise("proposed")


def decisions(files: DataFrame) -> DataFrame:
    """id, file, title, status, superseded_by, date, makers, governs, supersedes, weakens, assumptions (text, check, review_by), evidence (source, quote, note), checks and body of files(path, text) whose name starts with a number.

    What the front matter lacks of status, date and makers stands in the body: the first line of a section of that name,
    else a line of its own. A title is that of the front matter, else the first heading without its number, else the
    file's name.
    """
    numbered = files.where(F.col("path").rlike(r"(^|/)[0-9]+[^/]*\.md$")).withColumn("_t", F.regexp_replace(F.regexp_replace("text", "^\ufeff", ""), "\r\n", "\n"))
    read = numbered.select("path", front_matter(F.col("_t")).alias("front"), body(F.col("_t")).alias("body"))
    said = markdown.first_lines(markdown.sections(read), ("status", "date", "decision-makers", "deciders"))
    read = read.join(said, "path", "left")
    front, text = F.col("front"), F.col("body")
    given = lambda name: F.coalesce(field(front, name), F.col(f"`{name}`"), markdown.bullet(text, name))
    status = given("status")
    heading = markdown.first_heading(text)
    bare = F.nullif(F.trim(F.regexp_replace(heading, r"(?i)^(?:ADR[-_ ]?)?\d+(?:\s*[:.)\u2013\u2014-]\s*|\s+)", "")), F.lit(""))
    file_name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    title = F.coalesce(F.nullif(F.trim(field(front, "title")), F.lit("")), bare, heading, F.nullif(F.regexp_replace(file_name, r"^[0-9]+[-_ ]*", ""), F.lit("")), file_name)
    listed = lambda name: F.when(F.size(items(front, name)) > 0, items(front, name)).otherwise(names(field(front, name)))
    makers = F.coalesce(listed("decision-makers"), listed("deciders"), names(F.coalesce(F.col("`decision-makers`"), markdown.bullet(text, "decision-makers"), F.col("deciders"), markdown.bullet(text, "deciders"))), F.array().cast("array<string>"))
    by = F.regexp_extract(F.lower(F.regexp_replace(status, "[*_`]", "")), r"superseded\s+by\b(.*)$", 1)
    assumptions = markdown.nested(front, "assumptions", ("text", "check", "review_by"))
    return read.select(
        decision_id(F.regexp_extract("path", r"([0-9]+)[^/]*\.md$", 1)).alias("id"), F.col("path").alias("file"), title.alias("title"), status_of(status).alias("status"),
        F.coalesce(decision_id(field(front, "superseded-by")), F.when(status_of(status) == "superseded", decision_id(by))).alias("superseded_by"), given("date").alias("date"), makers.alias("makers"), items(front, "governs").alias("governs"), items(front, "supersedes").alias("supersedes"), items(front, "weakens").alias("weakens"),
        assumptions.alias("assumptions"), markdown.nested(front, "evidence", ("source", "quote", "note")).alias("evidence"), F.filter(F.transform(assumptions, lambda x: x["check"]), lambda x: x.isNotNull()).alias("checks"), text.alias("body"),
    )


def cards(files: DataFrame) -> DataFrame:
    """id, headline, signals and the text that search sees (the headline three times) of knowledge cards(path, text)."""
    front = front_matter(F.col("text"))
    headline, signals = F.coalesce(field(front, "headline"), F.lit("")), items(front, "code_signals")
    return files.select(F.coalesce(field(front, "id"), F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("id"), headline.alias("headline"), signals.alias("signals"), F.concat_ws("\n", headline, headline, headline, field(front, "problem"), field(front, "use_when"), F.array_join(signals, " "), body(F.col("text"))).alias("text"))


def cards_for(findings: DataFrame, known: DataFrame) -> DataFrame:
    """rule, kind, id: cards with a signal finding:<rule> or rule-kind:<kind>."""
    wants = findings.select("rule", "kind").distinct().select("rule", "kind", F.explode(F.array(F.concat(F.lit("finding:"), "rule"), F.concat(F.lit("rule-kind:"), "kind"))).alias("signal"))
    return wants.join(known.select("id", F.explode("signals").alias("signal")), "signal").select("rule", "kind", "id").distinct()

"""Markdown by lines: sections outside of fences, and lists of front matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sections(files: DataFrame, text: str = "body") -> DataFrame:
    """path, nth (from 1), heading and text of the second-level sections of files(path, body), trimmed; what stands before the first has none.

    A line that opens or closes a fence turns the state of those behind it; headings within a fence are text. The state
    runs over a file's lines in their order.
    """
    lines = files.select("path", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    run = W.partitionBy("path").orderBy("pos")
    fences = F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(run)
    found = F.nullif(F.regexp_extract("line", r"^##[ \t]+(.+?)[ \t]*#*[ \t]*$", 1), F.lit(""))
    marked = lines.withColumn("heading", F.when(fences % 2 == 0, found)).withColumn("nth", F.count("heading").over(run)).where("nth > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("heading").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return marked.groupBy("path", "nth").agg(F.max("heading").alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("text"))


def first_lines(found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """path, and for each name a column with the first line, without its bullet, of a file's first section(path, nth, heading, text) of that name in any case; null where there is none."""
    named = found.withColumn("name", F.lower("heading")).where(F.col("name").isin(*names))
    line = F.nullif(F.regexp_extract("text", r"(?m)^[ \t]*(?:[*-][ \t]+)?(\S.*?)[ \t]*$", 1), F.lit(""))
    return named.groupBy("path").agg(*(F.min_by(F.when(F.col("name") == n, line), F.when(F.col("name") == n, F.col("nth"))).alias(n) for n in names))


def bullet(body: Column, name: str) -> Column:
    """A field written as a line, with or without a bullet and bold marks; null where there is none."""
    return F.nullif(F.regexp_extract(body, rf"(?mi)^[ \t]*(?:[*-][ \t]+)?(?:\*\*)?{name}(?:\*\*)?:(?:\*\*)?[ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))


def first_heading(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def unquoted(value: Column) -> Column:
    """A scalar without the quotes around it, a plain one without a comment behind it."""
    quoted = value.rlike(r"""^(".*"|'.*')$""")
    return F.when(quoted, F.regexp_replace(value, r"""^["']|["']$""", "")).otherwise(F.regexp_replace(value, r"\s+#.*$", ""))


def nested(front: Column, name: str, fields: tuple[str, ...]) -> Column:
    """An array of structs of text fields from a front matter's list of mappings; a field that an item lacks is null, a list that is absent is empty.

    Items start with a dash, each field has a line of its own; the list ends with the first line that is neither indented
    nor an item. Scalars of several lines and lists in brackets aren't read.
    """
    block = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*\n((?:(?:[ \t]+\S.*|-[ \t].*|[ \t]*)(?:\n|$))+)", 1)
    items = F.filter(F.split(F.concat(F.lit("\n"), block), r"\n[ \t]*-[ \t]+"), lambda x: x.rlike(r"\S"))
    field = lambda item, f: unquoted(F.nullif(F.regexp_extract(item, rf"(?m)^[ \t]*{f}:[ \t]*(\S.*?)[ \t]*$", 1), F.lit("")))
    return F.transform(items, lambda item: F.struct(*(field(item, f).alias(f) for f in fields)))

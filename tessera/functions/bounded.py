"""Steps whose memory stays bounded: rows dealt over all partitions, and counts with the first few rows of each group, whatever a group's size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bytes of input files for each partition, about; of how many files the sizes are asked.
SHARE, SIZED_FILES = 4 << 20, 200


def shares(rows: DataFrame) -> int:
    """How many partitions hold the rows: as many as shuffles have, and more where the files that they come from are large, so that a partition's share doesn't grow with them."""
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [] if rows.isStreaming else rows.inputFiles()
    if not named:
        return least
    asked = named[:: -(-len(named) // SIZED_FILES)]
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in asked]
    size = sum(p.getFileSystem(hadoop).getFileStatus(p).getLen() for p in paths) * len(named) / len(asked)
    return max(least, -(-int(size) // SHARE))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys over as many partitions as their files need, and at least as many as shuffles have.

    Adaptive execution puts partitions together by their compressed bytes, and rows that compress well then meet in a few
    tasks whose memory grows with the table. It leaves a number of partitions that was asked for.
    """
    return rows.repartition(shares(rows), *keys)


def dealt(rows: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """The rows by keys over as many partitions as their files need (or n, those of what they meet), where that is more than shuffles have; else as they are, and what follows shuffles them."""
    n = n or shares(rows)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows with a column that is evaluated once a row, however often what follows reads it, and whole: a generator's output, not an expression that is put in at each use."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def parted(spark: SparkSession, n: int) -> AbstractContextManager[None]:
    """Within it, steps that run shuffle into n partitions: for counts that tasks combine before they deal them, where spread would come too early."""
    return _held(spark, "spark.sql.shuffle.partitions", str(n))


def tidied(spark: SparkSession) -> AbstractContextManager[None]:
    """Within it, a step that runs deletes its shuffle files when it is done, not when the driver happens to collect garbage: for steps that are settled, whose shuffles nothing reads again."""
    return _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def count_and_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """keys, n and first: how many rows a group has, and its first ones by order as an array of structs of these columns.

    Neither meets as a group: counts combine before the shuffle, and the window's limit keeps most rows of a task and group
    before it. Null keys are a group; rows equal in order count as often as they come.
    """
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = rows.select(*keys, *order).withColumn("_nth", nth).where(F.col("_nth") <= most).select(*keys, F.lit(0).cast("long").alias("_n"), F.struct("_nth", F.struct(*order).alias("row")).alias("_first"))
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = n.select(*keys, "_n", F.lit(None).cast(first.schema["_first"].dataType).alias("_first")).union(first)
    return both.groupBy(*keys).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list("_first")).alias("_first")).select(*keys, "n", F.transform("_first", lambda x: x["row"]).alias("first"))


def more(texts: Column, n: Column) -> Column:
    """texts, and after them "+k more" where there are more than these."""
    rest = n - F.size(texts)
    return F.when(rest > 0, F.concat(texts, F.array(F.concat(F.lit("+"), rest.cast("string"), F.lit(" more"))))).otherwise(texts)

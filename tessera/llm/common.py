"""Tables, scratch space and text helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import release as drop_stash
from ..scratch import settle as stash

__all__ = ["LAST_ID", "arrow_batches", "drop_stash", "slices", "stash", "table", "text_or_empty"]

#: Stands for a null id where ids are compared; such rows rank behind all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 500):
    """Arrow batches in pieces, so that a task holds the Python objects of few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "4m", read: int | None = None) -> Iterator[None]:
    """Within it, batches to Python have about that size at most, and those read from Parquet read rows. For rows that are large themselves: a task then holds a few of them on both sides, not as many as the usual limits (by number, in Parquet's reader) let in."""
    limits = {"spark.sql.execution.arrow.maxBytesPerBatch": size} | ({"spark.sql.parquet.columnarReaderBatchSize": str(read)} if read else {})
    before = {key: spark.conf.get(key) for key in limits}
    try:
        for key, value in limits.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

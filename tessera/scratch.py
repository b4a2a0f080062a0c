"""Fixpoint state on the shared folder: a written table ends lineage and survives lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def _base(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir", None):
        return base
    master = conf.get("spark.master", "")
    if master.startswith("local") and not master.startswith("local-cluster"):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="tessera-"))
        return f"file://{_local[0]}"
    raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folder(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted at the end; for tables that are kept between the steps of a job."""
    path = f"{_base(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, tag: str, group_mb: int | None = None) -> DataFrame:
    """The rows as a table of their own. group_mb: MB of a Parquet row group, about, of which a task that writes holds one; for rows that are large themselves."""
    spark = df.sparkSession
    path = f"{_base(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    out = df.write if group_mb is None else df.write.option("parquet.block.size", group_mb << 20)
    out.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.settled_at)
        _written[:] = [w for w in _written if w[1] != df.settled_at]


@atexit.register
def _release_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            return

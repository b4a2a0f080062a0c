"""Longest-processing-time sharding of a corpus: equal texts stay together, shards get near equal bytes.

The groups of equal texts are scheduled exactly as one heap over all of them would do it, but by classes: the driver holds
the different group sizes and how many groups have each, the groups of a size are numbered on the cluster, and a class of
equal jobs goes to the least-loaded shards at once. Different sizes are few: as each is one byte more than the one before
at least, there are no more than sqrt(2 x all bytes) of them.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stash, stash, text_or_empty

#: Rows or groups that are numbered together, about.
NUMBERED_TOGETHER = 1000
#: Groups with more than 1/LARGE of all rows (LARGE of them at most) are looked up in a broadcast table, so that no task takes all rows of one.
LARGE = 4096


def longest_first(jobs: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int]]:
    """(job, shard) for jobs of (job, size): the largest goes first, always to the least-loaded shard (ties: the lower shard, the lower job)."""
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for job, size in sorted(jobs, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out.append((job, s))
        heapq.heappush(heap, (load + size, s))
    return out


def classes_first(classes: list[tuple[int, int]], n_shards: int) -> list[list[int]]:
    """How many jobs of each class (size, jobs), in the given order, each shard gets: the counts of longest_first over the jobs themselves.

    Few jobs go over the heap one by one. Of many equal ones a shard's k-th finds it with its load plus k sizes; those below
    the highest level that the jobs can reach are counted, and the rest goes to the shards that stand at that level.
    """
    heap = [(0, s) for s in range(n_shards)]
    counts = [[0] * n_shards for _ in classes]
    for k in sorted(range(len(classes)), key=lambda k: -classes[k][0]):
        size, jobs = classes[k]
        own = counts[k]
        if jobs > 2 * n_shards:
            loads = dict((s, load) for load, s in heap)
            below = lambda level: [max(0, -(-(level - loads[s]) // size)) for s in range(n_shards)]  # noqa: B023, E731
            low, high = min(loads.values()), max(loads.values()) + size * jobs
            while low < high:  # the highest level with no more jobs below it than there are
                mid = (low + high + 1) // 2
                low, high = (mid, high) if sum(below(mid)) <= jobs else (low, mid - 1)
            own[:] = below(low)
            jobs -= sum(own)
            heap = [(loads[s] + own[s] * size, s) for s in range(n_shards)]
            heapq.heapify(heap)
        for _ in range(jobs):
            load, s = heapq.heappop(heap)
            own[s] += 1
            heapq.heappush(heap, (load + size, s))
    return counts


def _numbered(rows: DataFrame, by: str, order: list[str], parts: int) -> DataFrame:
    """rows with n: their number from 0 within by, counted by parts of bounded size (the column part)."""
    counts = rows.groupBy(by, "part").count()
    before = counts.select(by, "part", (F.sum("count").over(W.partitionBy(by).orderBy("part")) - F.col("count")).alias("before"))
    at = rows.withColumn("k", F.row_number().over(W.partitionBy(by, "part").orderBy(*order)))
    return at.join(before, [by, "part"]).withColumn("n", F.col("before") + F.col("k") - 1).drop("before", "k", "part")


def shard(docs: DataFrame, n_shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs.

    size: UTF-8 bytes of the text plus 1. A null text counts as an empty one (size 1, CRC 0), a null id is an id like
    any other, repeated rows each get a slot, columns other than these two are ignored, an empty table gives none.
    Equal texts form a group and share a shard. Of groups of equal size the shards take them in the order of a hash. Slots
    run from 0 without gaps within a shard.
    """
    spark = docs.sparkSession
    body = F.encode(text_or_empty(text), "UTF-8")
    rows = stash(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("g"), F.monotonically_increasing_id().alias("uid")), "shard")
    groups = stash(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    n_rows, n_groups = (x or 0 for x in groups.agg(F.sum("rows"), F.count("*")).first())

    classes = groups.groupBy("bytes").agg(F.count("*").alias("jobs")).toArrow()  # sqrt(2 x all bytes) rows at most
    sizes, jobs = (classes[c].to_pylist() for c in ("bytes", "jobs"))
    ends = np.cumsum(np.array(classes_first(list(zip(sizes, jobs, strict=True)), n_shards), np.int64).reshape(-1, n_shards), axis=1)
    flat = pa.array(ends.ravel())
    plan = spark.createDataFrame(pa.table({"bytes": pa.array(sizes, pa.int64()), "ends": pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * n_shards), flat)}))
    parts = max(1, n_groups // NUMBERED_TOGETHER)
    ranked = _numbered(groups.withColumn("part", F.pmod("g", F.lit(parts)).cast("int")), "bytes", ["g"], parts)
    placed = stash(ranked.join(plan, "bytes").select("g", "rows", F.size(F.filter("ends", lambda e: e <= F.col("n"))).alias("shard")), "shard-placed")

    large = F.col("rows") > n_rows // LARGE
    alone = placed.where(large).select("g", F.col("shard").alias("s"))  # LARGE rows at most
    marked = rows.join(F.broadcast(alone), "g", "left")
    rest = marked.where("s is null").drop("s").join(placed.where(~large).select("g", "shard"), "g")
    at = rest.select("doc_id", "size", "text_crc32", "uid", "shard").union(marked.where("s is not null").select("doc_id", "size", "text_crc32", "uid", "s"))
    parts = max(1, n_rows // (n_shards * NUMBERED_TOGETHER))
    at = stash(at.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")), "shard-rows")
    drop_stash(rows, groups, placed)
    return _numbered(at, "shard", ["doc_id", "uid"], parts).select("doc_id", "size", "text_crc32", "shard", F.col("n").alias("slot"))

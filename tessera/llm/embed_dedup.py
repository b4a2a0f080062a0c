"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Cells lose no link. A vector belongs to the cell of its nearest centroid and also visits each cell in which a partner at
the threshold could be at home: if x is at home in cell c and y in cell d, then x.(c - d) >= 0, so that
y.(c - d) >= -|x - y| |c - d|, and |x - y|^2 = 2 - 2 cos(x, y). Equal vectors of a label are one class before any product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash
from .components import components

#: Vectors, at most, that the centroids are learnt from; all vectors are then assigned.
KMEANS_SAMPLE, KMEANS_ROUNDS, MOST_CELLS = 20_000, 8, 1024
#: Vectors of a cell that meet in one block, about.
BLOCK = 2048
_SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = KMEANS_ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of unit rows x, k at most; an emptied cell starts anew at the row that fits its own cell least."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        fit = near[np.arange(len(x)), own]
        size = np.sqrt((total * total).sum(axis=1))
        lost = np.flatnonzero(size < 1e-12)
        total[lost] = x[np.argsort(fit, kind="stable")[: len(lost)]]
        c = total / np.sqrt((total * total).sum(axis=1, keepdims=True))
    return c


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as float64 rows, shorter ones filled with zeros, longer ones cut (only for the choice of cells)."""
    out = np.zeros((len(column), width))
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat, at = column.flatten().to_numpy(zero_copy_only=False), 0
    if len(sizes) and (sizes == sizes[0]).all():
        w = int(sizes[0])
        out[:, : min(w, width)] = flat.reshape(len(sizes), w)[:, :width]
        return out
    for k, n in enumerate(sizes.tolist()):
        out[k, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def _cells(c: np.ndarray, reach: float):
    apart = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vectors = part.column("e")
                x = _matrix(vectors, int(pa.compute.max(pa.compute.list_value_length(vectors)).as_py()))
                x = unit(x)
                y = np.zeros((len(x), c.shape[1]))
                y[:, : min(x.shape[1], c.shape[1])] = x[:, : c.shape[1]]
                near = y @ c.T
                home = near.argmax(axis=1)
                best = near[np.arange(len(x)), home]
                row, cell = np.nonzero(near >= best[:, None] - reach * apart[home] - _SLACK)
                t = pa.RecordBatch.from_arrays([*part.columns], part.schema.names).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell.astype(np.int32)), pa.array(home[row] == cell)], [*t.schema.names, "cell", "home"])

    return run


def _compare(threshold: float):
    def links(h: np.ndarray, m: np.ndarray) -> np.ndarray:
        cos = unit(h) @ unit(m).T
        near = cos >= threshold
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12), strict=True):
            near[i, j] = h[i] @ m[j] / math.sqrt((h[i] @ h[i]) * (m[j] @ m[j])) >= threshold
        return near

    def run(t: pd.DataFrame) -> pd.DataFrame:
        x = np.array(t["e"].tolist(), np.float64)
        cid, size, role = (t[c].to_numpy() for c in ("cid", "size", "role"))
        own, other = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        count, least = np.zeros(len(t), np.int64), cid.copy()
        masks = []
        for k in range(0, len(own), 512):
            part = own[k : k + 512]
            near = links(x[part], x[other])
            near &= cid[part][:, None] != cid[other][None, :]
            count[part] = near @ size[other]
            rows = near.any(axis=1)
            if rows.any():
                cols = np.flatnonzero(near.any(axis=0))
                masks.append((part[rows], other[cols], near[rows][:, cols]))
        changed = True
        while changed:
            before = least.copy()
            for rows, cols, near in masks:
                low = np.where(near, least[cols][None, :], np.iinfo(np.int64).max).min(axis=1)
                least[rows] = np.minimum(least[rows], low)
                low = np.where(near, least[rows][:, None], np.iinfo(np.int64).max).min(axis=0)
                least[cols] = np.minimum(least[cols], low)
            changed = (least != before).any()
        said = (count > 0) | (least != cid)
        return pd.DataFrame({"cid": cid[said], "links": count[said], "root": least[said]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    Two vectors of one label and one length link at a cosine (double precision) of the threshold or more. n_links counts
    the other rows linked directly, equal ones included; component_id is the smallest vec_id reachable, the own included;
    kept marks the representative. Vectors that are null, empty, zero or hold null or non-finite components, and rows with
    a null label or id, link with nothing: 0, their own id, kept (false for a null id). Rows with one id are told apart;
    other columns are ignored; an empty table gives none.
    """
    rows = stash(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("e"), F.expr(f"{vec_id} is not null and {label} is not null and size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({embedding}, x -> x <> 0)").alias("fit")), "vectors")
    fit, unfit = rows.where("fit"), rows.where("not coalesce(fit, false)")
    classes = stash(fit.groupBy("label", "e").agg(F.count("*").alias("size"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    sample = [r.e for r in classes.orderBy(F.xxhash64("cid")).limit(KMEANS_SAMPLE).select("e").collect()]
    width = max(map(len, sample), default=1)
    x = _matrix(pa.array(sample, pa.list_(pa.float64())), width) if sample else np.ones((1, 1))
    c = spherical_kmeans(unit(x), min(MOST_CELLS, math.ceil(math.cbrt(n) / 2)) or 1)

    fields = "label {}, e {}, cid long, size long, cell int, home boolean".format(*(classes.schema[k].dataType.simpleString() for k in ("label", "e")))
    visits = classes.select("label", "e", "cid", "size").mapInArrow(_cells(c, math.sqrt(2 - 2 * threshold)), fields).withColumn("width", F.size("e"))
    where = ["label", "width", "cell"]
    crowded = visits.groupBy(*where).count().where(F.col("count") > BLOCK).select(*where, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = visits.join(crowded, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    # role: 1 as one at home in block i, 2 as anyone in block j, 3 both
    dealt = dealt.withColumn("meet", F.explode(F.expr("concat(transform(filter(sequence(0, blocks - 1), j -> home and j <> own), j -> struct(own as i, j as j, 1 as role)), transform(sequence(0, blocks - 1), i -> struct(i as i, own as j, if(home and i = own, 3, 2) as role)))")))
    found = stash(dealt.select(*where, "cid", "size", "e", "meet.*").groupBy(*where, "i", "j").applyInPandas(_compare(threshold), "cid long, links long, root long"), "vector-links")

    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found, "cid", "root", "vector-components")
    of = classes.select("label", "e", "cid", "size", "least").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    of = stash(of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("label", "e", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vector-groups")
    drop_stash(found)
    done = fit.join(of, ["label", "e"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return done.unionByName(unfit.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")))

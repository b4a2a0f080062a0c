"""Exact top-k inner products by best-first search in M-trees.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and a query q a zero: then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner products are the nearest neighbours of a metric space. Candidates
are dealt to the nearest of some routing vectors, and each shard's pages are an M-tree: nodes with a pivot, a covering
radius and the distance to the parent's pivot. A query visits the shards whose routing vector and covering radius allow a
result, and a tree is sent where a query visits it, nowhere else. A search opens the page with the best bound first and leaves out distances
that the stored ones bound by the triangle inequality. Scores themselves are integers.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stash, stash

#: Entries of a leaf page; children of an inner page; candidates of one tree and queries searched together, about.
PAGE, FAN, TREE, TOGETHER = 256, 16, 16384, 4096
#: Vectors, at most, that routing vectors are drawn from, routing vectors of one vector length, and lengths, the most frequent ones, that have any; vectors of another length are one shard.
ROUTE_SAMPLE, MOST_ROUTES, MOST_WIDTHS = 4096, 512, 32
_EXACT = 2.0**52

_PAGES = "width int, shard int, block int, page int, parent int, leaf boolean, pivot array<long>, radius double, to_parent double, ids array<long>, dists array<double>, vectors array<long>"


def _lifted(v: np.ndarray, m2: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms equal."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(0, m2 - (v * v).sum(axis=1, keepdims=True)))])


def _dist(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    d = x - p
    return np.sqrt((d * d).sum(axis=-1))


def build_pages(ids: np.ndarray, v: np.ndarray, m2: float, seed: int = 5) -> list[dict]:
    """An M-tree over rows v: a list of pages, the root first. Leaves hold entries with their distances to the pivot."""
    x, pages, rng = _lifted(v, m2), [], np.random.default_rng(seed)
    todo = [(np.arange(len(v)), None, -1)]
    while todo:
        rows, pivot, parent = todo.pop()
        pivot = int(rows[0]) if pivot is None else pivot
        d = _dist(x[rows], x[pivot])
        page = {"page": len(pages), "parent": parent, "leaf": len(rows) <= PAGE, "pivot": v[pivot], "radius": float(d.max()), "to_parent": float(_dist(x[pivot], _lifted(pages[parent]["pivot"][None, :], m2)[0])) if parent >= 0 else 0.0, "ids": ids[:0], "dists": d[:0], "vectors": v[:0]}
        pages.append(page)
        if page["leaf"]:
            page |= {"ids": ids[rows], "dists": d, "vectors": v[rows]}
            continue
        picks = rng.choice(rows, min(FAN, -(-len(rows) // PAGE)), replace=False)
        own = np.stack([_dist(x[rows], x[p]) for p in picks]).argmin(axis=0)
        if (np.bincount(own, minlength=len(picks)) == len(rows)).any():  # equal vectors: any cut will do
            own = np.arange(len(rows)) * len(picks) // len(rows)
        todo += [(rows[own == k], int(p), page["page"]) for k, p in enumerate(picks) if (own == k).any()]
    return pages


class Tree:
    def __init__(self, pages: pd.DataFrame, m2: float):
        pages = pages.sort_values("page")
        self.m2 = m2
        self.leaf, self.radius, self.to_parent = (pages[c].to_numpy() for c in ("leaf", "radius", "to_parent"))
        self.pivots = _lifted(np.stack(pages["pivot"].tolist()), m2)
        width = self.pivots.shape[1] - 1
        self.ids = [np.asarray(i, np.int64) for i in pages["ids"]]
        self.dists = [np.asarray(d, np.float64) for d in pages["dists"]]
        self.vectors = [np.asarray(x, np.int64).reshape(-1, width) for x in pages["vectors"]]
        self.small = max((float(np.abs(x).max(initial=0)) for x in self.vectors), default=0.0)
        self.floats = [x.astype(np.float64) for x in self.vectors]
        parent = pages["parent"].to_numpy()
        self.children = [np.flatnonzero(parent == k) for k in range(len(pages))]

    def scores(self, leaf: int, keep: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.small * float(np.abs(q).max(initial=0)) * len(q) < _EXACT:
            return (self.floats[leaf][keep] @ q.astype(np.float64)).astype(np.int64)
        return self.vectors[leaf][keep] @ q

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, -id) of other rows than own; floor: what k others are known to reach."""
        x = np.append(q.astype(np.float64), 0.0)
        q2 = float(x @ x)
        slack = 1e-9 * (q2 + self.m2 + 1)
        best: list[tuple[int, int]] = []

        def reach() -> float:
            """No distance above this one can matter."""
            low = best[0][0] if len(best) == k else floor
            if floor is not None and low < floor:
                low = floor
            return math.inf if low is None else math.sqrt(max(0.0, q2 + self.m2 - 2 * float(low)) + slack)

        d = float(_dist(x, self.pivots[0]))
        heap = [(max(0.0, d - self.radius[0]), 0, d)]
        while heap:
            bound, page, d = heapq.heappop(heap)
            if bound > (far := reach()):
                break
            if not self.leaf[page]:
                c = self.children[page]
                c = c[np.abs(d - self.to_parent[c]) - self.radius[c] <= far]  # no distance needed for the others
                for p, dp in zip(c.tolist(), _dist(self.pivots[c], x).tolist(), strict=True):
                    if (bound := max(0.0, dp - self.radius[p])) <= far:
                        heapq.heappush(heap, (bound, p, dp))
                continue
            keep = np.flatnonzero((np.abs(d - self.dists[page]) <= far) & (self.ids[page] != own))
            if not len(keep):
                continue
            s, ids = self.scores(page, keep, q), self.ids[page][keep]
            top = np.lexsort((ids, -s))[:k]
            for one in zip(s[top].tolist(), (-ids[top]).tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
                else:
                    break
        return sorted(best, reverse=True)


def _route(routes: dict[int, np.ndarray], m2: float):
    """Adds each row's shard and its distance from the shard's routing vector."""

    def run(batches):
        for t in batches:
            shard, dist = np.zeros(len(t), np.int32), np.zeros(len(t))
            for w, rows in t.groupby("width").indices.items():
                if w in routes:
                    pivots = routes[w]
                    x = _lifted(np.stack(t["v"].iloc[rows].tolist()).reshape(len(rows), w), m2)
                    shard[rows] = ((pivots * pivots).sum(axis=1) - 2 * x @ pivots.T).argmin(axis=1)
                    dist[rows] = _dist(x, pivots[shard[rows]])
            yield t.assign(shard=shard, dist=dist)

    return run


def _visits(shards: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], m2: float, nearest: bool):
    """The shard whose bound is best for a query (first), or all that can better the floor, that one among them. Lengths without routing vectors have one shard."""

    def run(batches):
        for t in batches:
            out = []
            for w, at in t.groupby("width").indices.items():
                if w not in shards:
                    out.append(t.iloc[at].assign(shard=0, first=True))
                    continue
                where, pivots, radius = shards[w]
                x = np.stack(t["v"].iloc[at].tolist()).astype(np.float64).reshape(len(at), w)
                q2 = (x * x).sum(axis=1)
                d = np.sqrt(np.maximum(0, q2[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots[:, :-1].T))
                bound = np.maximum(0, d - radius - 1e-6 * (1 + d))
                pick = np.lexsort((d.T, bound.T), axis=0)[0] if len(where) > 1 else np.zeros(len(at), int)
                if nearest:
                    row, col = np.arange(len(at)), pick
                else:
                    floor = t["floor"].iloc[at].to_numpy(np.float64)
                    far = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(0, q2 + m2 - 2 * np.nan_to_num(floor))) + 1e-6 * (1 + np.sqrt(q2 + m2)))
                    row, col = np.nonzero((bound <= far[:, None]) | (np.arange(len(where)) == pick[:, None]))
                out.append(t.iloc[at[row]].assign(shard=where[col], first=col == pick[row]))
            yield pd.concat(out) if out else t.assign(shard=0, first=True).iloc[:0]

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of queries the k rows of vectors with the largest inner
    products, all if there are fewer, its own id left out; ties go to the smaller vec_id.

    Components x count as floor(scale * x), x as double. Rows with a null id, or a vector that is null, empty or holds
    null or non-finite components, take no part; only vectors of one length are compared. Rows with one id and one vector
    are one; other columns are ignored; empty tables give none. Scores must fit a long.
    """
    spark = vectors.sparkSession

    def cleaned(df: DataFrame) -> DataFrame:
        fit = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
        return fit.select("vec_id", F.size("e").alias("width"), F.expr(f"transform(e, x -> cast(floor(cast(x as double) * {scale}D) as bigint))").alias("v"))

    # behind k + 1 smaller ids with the same vector no row can be among the k best of any query
    ranked = cleaned(vectors).distinct().withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    rows = stash(ranked, "topk-rows")
    m2 = rows.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * x)"))).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(ROUTE_SAMPLE).select("width", "v").collect()
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), "width").limit(MOST_WIDTHS).collect()
    routes = {}
    for w, n in widths:
        if own := [r.v for r in sample if r.width == w][: max(1, min(MOST_ROUTES, n // TREE))]:
            routes[w] = _lifted(np.array(own, np.int64).reshape(-1, w), m2)

    routed = stash(rows.mapInPandas(_route(routes, m2), "vec_id long, width int, v array<long>, shard int, dist double"), "topk-routed")
    drop_stash(rows)
    shard = ["width", "shard"]
    sizes = stash(routed.groupBy(*shard).agg(F.ceil(F.count("*") / TREE).cast("int").alias("blocks"), F.max("dist").alias("radius")), "topk-shards")
    known = sizes.where(F.col("width").isin(*routes)).collect()  # MOST_WIDTHS * MOST_ROUTES at most
    shards = {}
    for w, pivots in routes.items():
        own = sorted((r.shard, r.radius) for r in known if r.width == w)
        at = np.array([x for x, _ in own], np.int32)
        shards[w] = (at, pivots[at], np.array([x for _, x in own]))

    def build(t: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(t["v"].tolist()).astype(np.int64)
        order = np.argsort(t["vec_id"].to_numpy(), kind="stable")
        pages = pd.DataFrame(build_pages(t["vec_id"].to_numpy()[order], v[order], m2))
        pages["vectors"] = [x.reshape(-1) for x in pages["vectors"]]
        return pages.assign(**{c: t[c].iloc[0] for c in tree})[[c.split()[0] for c in _PAGES.split(", ")]]

    tree = [*shard, "block"]
    placed = routed.join(sizes.select(*shard, "blocks"), shard).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    pages = stash(placed.select(*tree, "vec_id", "v").groupBy(*tree).applyInPandas(build, _PAGES), "topk-pages")
    drop_stash(routed)

    held = stash(cleaned(queries).withColumnRenamed("vec_id", "query_id").withColumn("qid", F.monotonically_increasing_id()), "topk-queries")
    chunks = max(1, -(-held.count() // TOGETHER))
    asked = held.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame({"qid": [], "query_id": [], "vec_id": [], "score": []})
        pages, out = Tree(p, m2), []
        for qid, query, v, floor in zip(q["qid"], q["query_id"], q["v"], q["floor"], strict=True):
            out += [(qid, query, -i, s) for s, i in pages.search(np.asarray(v, np.int64), query, k, None if pd.isna(floor) else int(floor))]
        return pd.DataFrame(out, columns=["qid", "query_id", "vec_id", "score"])

    asks = "qid long, query_id long, width int, v array<long>, chunk int, floor decimal(20,0), shard int, first boolean"

    def look(asked: DataFrame, nearest: bool) -> DataFrame:
        visits = asked.select("qid", "query_id", "width", "v", "chunk", "floor").mapInPandas(_visits(shards, m2, nearest), asks).join(sizes.select(*shard, "blocks"), shard)
        one = F.pmod(F.xxhash64("qid"), "blocks").cast("int")  # the tree of the first shard that a query visits first
        sent = visits.withColumn("block", one) if nearest else visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(~F.col("first") | (F.col("block") != one))
        sent = stash(sent.drop("blocks", "first"), "topk-visits")
        wanted = sent.select(*tree, "chunk").distinct().toDF("w", "s", "b", "chunk")
        spread = pages.join(wanted, (F.col("width") == F.col("w")) & (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select(*pages.columns, "chunk")
        found = sent.groupBy(*tree, "chunk").cogroup(spread.groupBy(*tree, "chunk")).applyInPandas(search, "qid long, query_id long, vec_id long, score long")
        out = stash(found, "topk-found")
        drop_stash(sent)
        return out

    near = look(asked.withColumn("floor", F.lit(None).cast("decimal(20,0)")), True)
    floors = near.groupBy("qid").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") >= k)
    rest = look(asked.join(floors, "qid", "left").withColumn("floor", F.col("least").cast("decimal(20,0)")), False)
    drop_stash(held, sizes, pages)
    best = near.union(rest).distinct().withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

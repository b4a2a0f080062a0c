"""Graph algorithms as fixpoints of joins, each round settled in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounded import spread
from ..scratch import release, settle

#: Nodes and pairs, at most, of a graph that the driver closes by itself.
SMALL_NODES, SMALL_PAIRS = 1000, 100_000


def reachable(pairs: DataFrame, reflexive: bool = False, tag: str = "reach") -> DataFrame:
    """All (a, b) with a path from a to b over pairs(a, b), by doubling: as many rounds as the longest path's logarithm. reflexive adds (n, n) for every node."""
    now = settle(pairs.select("a", "b").where("a is not null and b is not null").distinct(), tag)
    n = now.count()
    while True:
        step = now.select("a", F.col("b").alias("m")).join(now.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        nxt = settle(now.union(step).distinct(), tag)
        release(now)
        now, before, n = nxt, n, nxt.count()
        if n == before:
            break
    if not reflexive:
        return now
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("a")).where("a is not null").distinct()
    return now.union(nodes.select("a", F.col("a").alias("b"))).distinct()


def _trim(edges: DataFrame) -> DataFrame:
    """Edges without nodes that nothing enters or nothing leaves: these are in no cycle."""
    while True:
        n = edges.count()
        kept = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        nxt = settle(kept, "scc-trim")
        release(edges)
        edges = nxt
        if edges.count() == n:
            return edges


def _least_label(edges: DataFrame, labels: DataFrame, forward: bool = True) -> DataFrame:
    """The least label that reaches each node."""
    src, dst = ("a", "b") if forward else ("b", "a")
    while True:
        sent = edges.join(labels.select(F.col("node").alias(src), "label"), src).select(F.col(dst).alias("node"), "label")
        nxt = settle(labels.union(sent).groupBy("node").agg(F.min("label").alias("label")), "scc-label")
        moved = nxt.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        release(labels)
        labels = nxt
        if not moved:
            return labels


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) of all nodes of pairs(a, b), and the pairs of different nodes as ids, each once: rounds then shuffle and write numbers, not names. What the pairs come from is read once."""
    pairs = settle(pairs.select("a", "b"), "graph-pairs")
    names = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct().withColumn("id", F.monotonically_increasing_id()), "graph-names")
    end = lambda c: names.select(F.col("node").alias(c), F.col("id").alias(f"i{c}"))
    return names, settle(pairs.select("a", "b").where("a <> b").join(end("a"), "a").join(end("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct(), "graph")


def strong_components(pairs: DataFrame) -> DataFrame:
    """node and scc (its smallest member) of every node in a strongly connected component of two or more; self loops don't count.

    Colouring: the least label that reaches a node names its colour; what reaches the colour's own node within the colour
    is a component. It leaves with its nodes, the rest is trimmed and coloured again.
    """
    names, edges = _numbered(pairs)
    found = _strong(edges)
    if found is None:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("scc")).limit(0)
    told = settle(found.withColumnRenamed("node", "id").join(names, "id").select("node", F.col("scc").alias("own")), "scc-told")
    return told.join(told.groupBy("own").agg(F.min("node").alias("scc")), "own").select("node", "scc")


def _strong(edges: DataFrame) -> DataFrame | None:
    """node and scc (some member) for settled edges(a, b) of different nodes, each once; None without any. The edges are released."""
    edges, found = _trim(edges), None
    while edges.head(1):
        nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _least_label(edges, settle(nodes.select("node", F.col("node").alias("label")), "scc-label"))
        c = colour.select("node", F.col("label").alias("colour"))
        inside = settle(edges.join(c.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")), "scc-inside")
        back = settle(colour.where("node = label").select("node", F.col("label").alias("scc")), "scc-back")
        while True:
            grown = inside.join(back.select(F.col("node").alias("b"), "scc"), "b").select(F.col("a").alias("node"), "scc")
            nxt = settle(back.union(grown).distinct(), "scc-back")
            more = nxt.count() > back.count()
            release(back)
            back = nxt
            if not more:
                break
        release(inside, colour)
        own = back.join(back.groupBy("scc").count().where("count > 1"), "scc").select("node", "scc")
        found = settle(own if found is None else found.union(own), "scc-found")
        gone = back.select("node")
        rest = settle(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "scc")
        release(edges, back)
        edges = _trim(rest)
    return found


def reached(pairs: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """The nodes that start(node) reaches over pairs(a, b), itself included; backward: that reach it. Each round goes on from the nodes that the last one found."""
    src, dst = ("a", "b") if forward else ("b", "a")
    now = front = settle(start.select("node").where("node is not null").distinct(), "reached")
    while front.head(1):
        step = pairs.join(front.select(F.col("node").alias(src)), src, "left_semi").select(F.col(dst).alias("node")).distinct()
        fresh = settle(step.join(now, "node", "left_anti"), "reached-front")
        after = settle(now.union(fresh), "reached")
        release(now, *([front] if front is not now else []))
        now, front = after, fresh
    release(*([front] if front is not now else []))
    return now


def updated_components(pairs: DataFrame, kept: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """strong_components of pairs(a, b) after an edit, from those before it, kept(node, scc), and the pairs that it added and removed.

    Components that change lie in a region: the members of those that lost a pair inside, and the nodes that an added pair
    leads to and that lead to an added pair. Only the region is searched; all others stay.
    """
    ends = lambda d: d.where("a <> b and a is not null and b is not null").select("a", "b").distinct()
    inside = ends(removed).join(kept.select(F.col("node").alias("a"), "scc"), "a").join(kept.select(F.col("node").alias("b"), F.col("scc").alias("other")), "b").where("scc = other").select("scc").distinct()
    lost = kept.join(inside, "scc", "left_semi").select("node")
    new = settle(ends(added).join(kept.select(F.col("node").alias("a"), F.col("scc").alias("sa")), "a", "left").join(kept.select(F.col("node").alias("b"), F.col("scc").alias("sb")), "b", "left").where("sa is null or sb is null or sa <> sb").select("a", "b"), "scc-added")
    region = lost
    if new.head(1):
        ahead = reached(pairs, new.select(F.col("b").alias("node")))
        back = reached(pairs, new.select(F.col("a").alias("node")), False)
        region = lost.union(ahead.join(back, "node", "left_semi"))
    region = settle(region.distinct(), "scc-region")
    if not region.head(1):
        return kept
    within = pairs.join(region.withColumnRenamed("node", "a"), "a", "left_semi").join(region.withColumnRenamed("node", "b"), "b", "left_semi")
    return settle(kept.select("node", "scc").join(region, "node", "left_anti").union(strong_components(within).select("node", "scc")), "scc-updated")


def small_closure(pairs: DataFrame) -> tuple[list, np.ndarray] | None:
    """The nodes of pairs(a, b) in order and the matrix of who reaches whom (itself always), by squaring; None beyond SMALL_NODES nodes. For graphs of components, which a contract lists: rounds of jobs would cost more than the answer."""
    rows = pairs.where("a is not null and b is not null").select("a", "b").distinct().limit(SMALL_PAIRS + 1).collect()
    names = sorted({x for r in rows for x in r})
    if len(rows) > SMALL_PAIRS or len(names) > SMALL_NODES:
        return None
    at = {x: k for k, x in enumerate(names)}
    reach = np.eye(len(names), dtype=bool)
    for a, b in rows:
        reach[at[a], at[b]] = True
    while (more := reach.astype(np.float32) @ reach > 0).sum() > reach.sum():
        reach = more
    return names, reach


def mutual_components(pairs: DataFrame) -> DataFrame:
    """The rows of strong_components by way of reachability, for graphs of components; a large one takes rounds of joins, and as many rows as pairs that reach each other."""
    pairs = pairs.where("a <> b")
    if found := small_closure(pairs):
        names, reach = found
        both = reach & reach.T
        kind = pairs.schema["a"].dataType.simpleString()
        return pairs.sparkSession.createDataFrame([(names[k], names[int(row.argmax())]) for k, row in enumerate(both) if row.sum() > 1], f"node {kind}, scc {kind}")
    reach = reachable(pairs.where("a <> b"), tag="mutual")
    back = reach.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = reach.where("a <> b").join(back, ["a", "b"]).groupBy("a").agg(F.min("b").alias("least"))
    return both.select(F.col("a").alias("node"), F.least("a", "least").alias("scc"))


def clusters(pairs: DataFrame) -> DataFrame:
    """node and root (the smallest node it is connected with) for pairs(a, b) taken both ways.

    Alternating stars: a round hangs each node's larger neighbours on the smallest one that it knows, then each node's
    smaller ones; a path shortens by a factor a round, so that rounds grow with the logarithm of the longest path. Both
    steps are a minimum that combines before the shuffle and one join.
    """
    least = lambda d: d.groupBy("u").agg(F.min("v").alias("m"))
    nodes = settle(pairs.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct(), "cluster-nodes")
    now = settle(pairs.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cluster")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(both.where("v > u").join(least(both).select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cluster-large")
        m = least(large)
        small = large.join(m, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(m.select("u", F.col("m").alias("v")))
        nxt = settle(small.where("u <> v").distinct(), "cluster")
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        release(now, large)
        now = nxt
        if mark == seen:  # a forest of stars that a round leaves alone
            return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        seen = mark


def _peeled(nodes: DataFrame, dag: DataFrame) -> tuple[DataFrame, int]:
    """(node, height) of nodes(node), as far as they reach no cycle over dag(a, b), pairs of different nodes, each once; and how many do.

    Round by round the nodes leave whose targets have all left: a pair is told once, to its first node, which counts. The
    pairs are dealt by their targets once and stay so; a node that left is not read again.
    """
    dealt = spread(dag, "b").persist()
    out = dag.groupBy("a").agg(F.count("*").alias("left")).withColumnRenamed("a", "node")
    state = settle(nodes.select("node").join(out, "node", "left").na.fill(0, ["left"]), "peel")
    done, height = nodes.select("node", F.lit(0).alias("height")).limit(0), 0
    while True:  # ends: each round takes nodes out
        front = state.where("left = 0").select("node")
        done = done.union(front.withColumn("height", F.lit(height)))
        sent = dealt.join(front.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.count("*").alias("n")).withColumnRenamed("a", "node")
        state = settle(state.where("left > 0").join(sent, "node", "left").select("node", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "peel")
        height += 1
        if not state.where("left = 0").head(1):
            dealt.unpersist()
            return done, state.count()


def heights(pairs: DataFrame) -> DataFrame:
    """node and height (edges of the longest path down to a sink) over the condensation of pairs(a, b): members of one component share a height. Components are searched only where some node reaches a cycle."""
    names, edges = _numbered(pairs)
    done, cyclic = _peeled(names.select(F.col("id").alias("node")), edges)
    if not cyclic:
        return done.join(names.withColumnRenamed("node", "name").withColumnRenamed("id", "node"), "node").select(F.col("name").alias("node"), "height")
    scc = _strong(settle(edges, "scc"))
    group = settle(names.join(scc.withColumnRenamed("node", "id"), "id", "left").select("node", "id", F.coalesce("scc", "id").alias("group")), "height-group")
    g = lambda c: group.select(F.col("id").alias(c), F.col("group").alias(f"g{c}"))
    dag = settle(edges.join(g("a"), "a").join(g("b"), "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct(), "height-dag")
    done, _ = _peeled(group.select(F.col("group").alias("node")).distinct(), dag)
    return group.select("node", "group").join(done.withColumnRenamed("node", "group"), "group").select("node", "height")


def cycle_paths(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """scc and path: a shortest closed path through the smallest member of each component of members(node, scc); of equal ones the first by names.

    All components are searched at once, breadth first: each round extends the paths that end at nodes reached for the first
    time, and keeps the least path to each node.
    """
    m = members.select(F.col("node").alias("b"), F.col("scc"))
    inside = settle(pairs.where("a <> b").join(members.select(F.col("node").alias("a"), "scc"), "a").join(m, ["b", "scc"]).select("scc", "a", "b").distinct(), "cycle-edges")
    front = settle(members.select("scc").distinct().select("scc", F.col("scc").alias("node"), F.array("scc").alias("path")), "cycle-front")
    seen, done = settle(front.select("scc", "node"), "cycle-seen"), None
    while True:  # ends: each round reaches nodes for the first time
        step = settle(front.join(inside.withColumnRenamed("a", "node"), ["scc", "node"]).select("scc", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path")), "cycle-step")
        closed = step.where("node = scc").groupBy("scc").agg(F.min("path").alias("path"))
        done = settle(closed if done is None else done.union(closed.join(done.select("scc"), "scc", "left_anti")), "cycle-done")
        fresh = step.join(seen, ["scc", "node"], "left_anti").join(done.select("scc"), "scc", "left_anti").groupBy("scc", "node").agg(F.min("path").alias("path"))
        nxt = settle(fresh.select("scc", "node", "path"), "cycle-front")
        seen2 = settle(seen.union(nxt.select("scc", "node")), "cycle-seen")
        release(front, step, seen)
        front, seen = nxt, seen2
        if not front.head(1):
            break
    release(inside, front, seen)
    return done

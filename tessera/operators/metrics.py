"""Component graph and coupling metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import settle
from .graph import reachable, small_closure


def component_graph(edges: DataFrame, samples: int = 3) -> DataFrame:
    """from_c, to_c, cnt, kinds (sorted) and samples (file, line, target; the first by these) for each ordered pair of different components.

    Samples are cut before the shuffle as well: each task keeps the least few of a pair, so a pair with most of all edges
    stays small. Kinds are counted before they are collected: a set for each pair would have each task sort all its edges.
    The graph is settled, as what is asked of it is mostly several things: edges are read for it once.
    """
    e = edges.select(F.col("src.component").alias("from_c"), F.col("dst.component").alias("to_c"), "kind", F.struct(F.col("from_").alias("file"), "line", F.coalesce("to_", "workspace").alias("target")).alias("sample")).where("from_c is not null and to_c is not null and from_c <> to_c")
    counted = e.groupBy("from_c", "to_c", "kind").agg(F.count("*").alias("n")).groupBy("from_c", "to_c").agg(F.sum("n").alias("cnt"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    first = e.withColumn("nth", F.row_number().over(W.partitionBy("from_c", "to_c").orderBy("sample"))).where(F.col("nth") <= samples).groupBy("from_c", "to_c").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return settle(counted.join(first, ["from_c", "to_c"]), "component-graph")


def coupling(components: DataFrame, files: DataFrame, graph: DataFrame) -> DataFrame:
    """component, files, loc, fan_in, fan_out and instability (fan_out over both; null without any) of every component(component), those without files too."""
    size = files.where("component is not null").groupBy("component").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))
    out = graph.groupBy(F.col("from_c").alias("component")).agg(F.count_distinct("to_c").alias("fan_out"))
    into = graph.groupBy(F.col("to_c").alias("component")).agg(F.count_distinct("from_c").alias("fan_in"))
    joined = components.select("component").join(size, "component", "left").join(into, "component", "left").join(out, "component", "left").na.fill(0, ["files", "loc", "fan_in", "fan_out"])
    return joined.select("component", F.col("files").cast("long").alias("files"), F.col("loc").cast("long").alias("loc"), F.col("fan_in").cast("long").alias("fan_in"), F.col("fan_out").cast("long").alias("fan_out"), F.when(F.col("fan_in") + F.col("fan_out") > 0, F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))).alias("instability"))


def propagation_cost(components: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: the share of all ordered pairs of components, (c, c) included, in which the first reaches the second."""
    n = components.agg(F.count_distinct("component").alias("n"))
    links = graph.select(F.col("from_c").alias("a"), F.col("to_c").alias("b"))
    if found := small_closure(links):
        reach = graph.sparkSession.createDataFrame([(int(found[1].sum()) - len(found[0]),)], "pairs long")
    else:
        reach = reachable(links).where("a <> b").agg(F.count("*").alias("pairs"))
    return n.crossJoin(reach).select("n", (F.col("pairs") + F.col("n")).alias("reachable"), F.when(F.col("n") > 0, (F.col("pairs") + F.col("n")) / (F.col("n") * F.col("n"))).otherwise(0.0).alias("cost"))  # one row each


def hubs(metrics: DataFrame) -> DataFrame:
    """Components with many dependents and many dependencies: at least max(3, ceil(0.3 (n - 1))) of each."""
    least = metrics.agg(F.greatest(F.lit(3), F.ceil(F.lit(0.3) * (F.count("*") - 1))).alias("least"))
    return metrics.crossJoin(F.broadcast(least)).where("fan_in >= least and fan_out >= least").select("component", "fan_in", "fan_out", F.col("least").cast("long").alias("least"))  # least: one row


def gods(metrics: DataFrame, share: float = 0.3, least: int = 4, total: DataFrame | None = None) -> DataFrame:
    """Components with over the share of all files and of all lines, where there are enough components. metrics: over production files; total: all_files and all_loc in one row, where files without a component count too."""
    own = metrics.agg(F.count("*").alias("n"), F.sum("files").alias("all_files"), F.sum("loc").alias("all_loc"))
    total = own if total is None else own.select("n").crossJoin(total)
    return metrics.crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("files") > share * F.col("all_files")) & (F.col("loc") > share * F.col("all_loc"))).select("component", "files", "loc")  # total: one row


def unstable(graph: DataFrame, metrics: DataFrame, by: float = 0.25) -> DataFrame:
    """Dependencies on a component less stable by more than by."""
    i = lambda c, name: metrics.select(F.col("component").alias(c), F.col("instability").alias(name))
    return graph.select("from_c", "to_c").join(i("from_c", "i_from"), "from_c").join(i("to_c", "i_to"), "to_c").where(F.col("i_to") - F.col("i_from") > by).select("from_c", "to_c", "i_from", "i_to")


def coverage(files: DataFrame, edges: DataFrame) -> DataFrame:
    """language, files, loc, unmapped and parse_errors by language, and the edges from it that are unresolved or dynamic."""
    by = files.groupBy("language").agg(F.count("*").alias("files"), F.sum("loc").cast("long").alias("loc"), F.count_if(F.col("component").isNull()).alias("unmapped"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"))
    of = edges.join(files.select(F.col("path").alias("from_"), "language"), "from_").groupBy("language").agg(F.count_if(F.coalesce("unresolved", F.lit(False))).alias("unresolved"), F.count_if(F.col("kind") == "dynamic").alias("dynamic"))
    return by.join(of, "language", "left").na.fill(0, ["unresolved", "dynamic"])


def file_edges(edges: DataFrame) -> DataFrame:
    """Each pair of files once, with the least line."""
    return edges.where("to_ is not null and from_ <> to_").groupBy("from_", "to_").agg(F.min("line").alias("line"))

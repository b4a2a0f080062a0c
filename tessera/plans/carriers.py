"""Code-base shaped views over the star-schema tables, for Spark and, as common table expressions, for SQL.

A part is a file (its brand the folder and component, its size the lines), consecutive positions of an order are imports,
a position's supplier is a package, an order is a commit. Whole tables throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bounded import dealt, once, shares
from ..operators.mapping import component_of, with_endpoints
from ..schemas import Component

BRANDS = tuple(f"Brand#{k}" for k in range(1, 26))
COMPONENTS = tuple(Component(b, (f"src/{b}",), entrypoints=(f"src/{b}/ECONOMY",)) for b in BRANDS)
CUT = "1998-01-01"

SQL = """
files as (select 'src/' || p_brand || '/' || p_type || '/p' || p_partkey || '.ts' as path, p_partkey as pk, p_size as loc, p_brand as component from part),
pos as (select l_orderkey o, l_partkey pk, l_suppkey sk, l_linenumber line, case l_returnflag when 'A' then 'static' when 'N' then 'type' else 'dynamic' end kind,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) n from lineitem),
edges as (select x.path ef, y.path et, x.component cf, y.component ct, x.loc lf, y.loc lt, a.kind, a.line, a.o from pos a join pos b on a.o = b.o and b.n = a.n + 1
  join files x on x.pk = a.pk join files y on y.pk = b.pk where a.pk <> b.pk),
packages as (select x.path ef, x.component cf, s.s_name pkg, s.s_suppkey % 10 = 0 builtin, a.kind, a.line from pos a join files x on x.pk = a.pk join supplier s on s.s_suppkey = a.sk),
changes as (select l_orderkey sha, x.path, x.component, l_quantity::bigint added, l_linenumber::bigint deleted from lineitem join files x on x.pk = l_partkey)
"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit("/p"), "p_partkey", F.lit(".ts"))
    return p.select(path.alias("path"), F.col("p_partkey").alias("pk"), F.col("p_size").alias("loc"), F.col("p_brand").alias("component"), F.col("p_type").alias("language"), F.lit(None).cast("string").alias("parse_error"))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(read(spark, sf_dir, "lineitem"), "l_orderkey")
    kind = F.when(F.col("l_returnflag") == "A", "static").when(F.col("l_returnflag") == "N", "type").otherwise("dynamic")
    following = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("line"), kind.alias("kind"), following.alias("next"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import edges with endpoints; o is the order they come from. The next position is a window function away, so no self join is needed.

    Orders, files and edges are dealt over a number of partitions that grows with the orders' files, so each task holds its
    share; files are dealt before their components are matched. What is dealt before the last join has the same columns for
    all that a query asks of edges: if it asks several things, the steps up to there run once.
    """
    p = _positions(spark, sf_dir).where("next is not null and next <> pk")
    n = shares(read(spark, sf_dir, "lineitem"))
    f = once(dealt(files(spark, sf_dir).select("pk", "path"), "pk", n=n), component_of(F.col("path"), COMPONENTS), "own")
    first = p.join(f.select("pk", F.col("path").alias("from_"), F.col("own").alias("from_component")), "pk")
    columns = ("next", "from_", "from_component", "kind", "line", "o")
    first = once(first.select(*columns).repartition(n, "next"), F.struct(*columns), "edge").select("edge.*")
    ends = first.join(f.select(F.col("pk").alias("next"), F.col("path").alias("to_"), F.col("own").alias("to_component")), "next")
    none = F.lit(None).cast("string")
    return with_endpoints(ends.select("from_", "to_", "from_component", "to_component", none.alias("workspace"), none.alias("package"), F.lit(False).alias("builtin"), F.col("to_").alias("specifier"), "kind", "line", F.lit(False).alias("unresolved"), "o"), COMPONENTS)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _positions(spark, sf_dir).join(files(spark, sf_dir).select("pk", F.col("path").alias("from_")), "pk").join(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sk"), F.col("s_name").alias("package")), "sk")
    none = F.lit(None).cast("string")
    return with_endpoints(p.select("from_", none.alias("to_"), none.alias("workspace"), "package", (F.col("sk") % 10 == 0).alias("builtin"), F.col("package").alias("specifier"), "kind", "line", F.lit(False).alias("unresolved")), COMPONENTS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(read(spark, sf_dir, "lineitem"), "l_partkey").join(files(spark, sf_dir).select(F.col("pk").alias("l_partkey"), "path", "component"), "l_partkey")
    return li.select(F.col("l_orderkey").alias("sha"), "path", "component", F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges of orders before the cut and from it on."""
    e = edges(spark, sf_dir).join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), (F.col("o_orderdate") >= F.lit(CUT).cast("date")).alias("late")), "o")
    return e.where("not late"), e.where("late")


VERSIONS_SQL = f"base as (select e.* from edges e join orders on o_orderkey = o where o_orderdate < date '{CUT}'), head as (select e.* from edges e join orders on o_orderkey = o where o_orderdate >= date '{CUT}')"

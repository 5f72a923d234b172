"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one in local runs and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lodestream-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def saved(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written once under the shared folder and read back, so that what follows reads it and works nothing out again.

    ``by`` names columns (the last ones) that each have a folder a value, so that who asks for one reads no other.
    """
    path = f"{shared_folder(df.sparkSession)}/lodestream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over as many tasks as a shuffle has: a file of few row groups is read by few tasks, however many
    cores there are, too few for work that costs far more than reading its rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: A node is hot if it is in more than one in HOT of all edges, and in more than MANY: there are fewer than twice HOT of them.
HOT, MANY = 1000, 100_000


def _with_least(edges: DataFrame, total: int, most: int) -> DataFrame:
    """``edges`` (u, v) with m, the least v of each u. Hot u, if there can be any, meet theirs by a broadcast, the others by a shuffle."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if most <= MANY or most * HOT <= total:
        return edges.join(least.select("u", "m"), "u")
    is_hot = (F.col("n") * HOT > total) & (F.col("n") > MANY)
    hot = least.filter(is_hot).select("u", F.col("m").alias("hot"))
    dealt = edges.join(F.broadcast(hot), "u", "left")
    cold = dealt.filter("hot is null").select("u", "v").join(least.filter(~is_hot).select("u", "m"), "u")
    return dealt.filter("hot is not null").select("u", "v", F.col("hot").alias("m")).union(cold.select("u", "v", "m"))


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Number of edges, the most that a node has, and how many nodes are not yet in order: above one node and below another, or above two."""
    end = lambda c, up: F.struct(F.col(c).alias("node"), F.lit(up).alias("up"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    open_ = F.count_if(((F.col("up") > 0) & (F.col("n") > F.col("up"))) | (F.col("up") > 1))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), open_).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node that has an edge to another; component is the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A round is two grouped minima, which
    combine before the shuffle, and the joins that bring them back to the edges, where no task holds the edges of a
    hub; each round is written to the shared folder, so the lineage stays one round long. Ends when every node but the
    least ones has one edge, to its least one. Null ends and self loops are ignored.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/lodestream/components-{uuid.uuid4().hex}"
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = ends.filter("_a is not null and _b is not null and u != v").select("u", "v").distinct()
    schema, k = now.schema, 0
    while True:
        path = f"{folder}/{k}"
        now.write.parquet(path)
        now = spark.read.schema(schema).parquet(path)
        total, most, open_ = _state(now)
        if not open_:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        k += 1
        both = now.union(now.select("v", "u"))
        # a node's edges grow no more numerous by the first step, so ``most`` holds for both
        large = _with_least(both, total, most).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, total, most)
        # each lesser neighbour, and the node itself, comes under the least one
        small = small.select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        ).select("e.*")
        now = small.filter("u != v").distinct()

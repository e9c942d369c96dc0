"""Graphs derived from the test tables, as (i, j, w) adjacencies with both directions of each edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mirrored(edges: DataFrame) -> DataFrame:
    """(i, j, w) -> both directions, in one pass over the edges."""
    both = F.explode(F.array(F.struct("i", "j", "w"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "w")))
    return edges.select(both.alias("e")).select("e.i", "e.j", "e.w")


def bipartite(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """Edges between ``2 * left`` and ``2 * right + 1``, weighted by how many rows tell of them."""
    named = rows.select((left.cast("long") * 2).alias("i"), (right.cast("long") * 2 + 1).alias("j"))
    return mirrored(spread(named, "i", "j").groupBy("i", "j").agg(F.count("*").cast("double").alias("w")))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_partkey"))


def with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-part graph and an edge from each order to its status, a vertex of negative id: hubs of up to half of all
    orders."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("i"), (F.col("l_partkey") * 2 + 1).alias("j"))
    states = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).alias("i"), (-F.ascii("o_orderstatus").cast("long")).alias("j"))
    return mirrored(spread(lines.unionByName(states), "i", "j").groupBy("i", "j").agg(F.count("*").cast("double").alias("w")))


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_suppkey"))


def customer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderkey"))


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bipartite(table(spark, sf_dir, "nation"), F.col("n_nationkey"), F.col("n_regionkey"))


def hashed_value(i: Column, k: int) -> Column:
    """A fixed pseudo-random value in [0, 1) of vertex ``i`` in vector ``k``: 32 bits of a digest of both, so that vectors are
    independent draws whatever the ids. Four vectors share a digest."""
    digest = F.md5(F.concat_ws(":", i.cast("string"), F.lit(str(k // 4))).cast("binary"))
    return F.conv(F.substring(digest, 8 * (k % 4) + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hashed_vector(ids: DataFrame, k: int = 0) -> DataFrame:
    return ids.select("i", hashed_value(F.col("i"), k).alias("v"))

"""What a task holds, and what is shuffled, on large tables."""

from pyspark.sql import functions as F

from quillgraph import storage
from quillgraph.operators import graph, linalg
from quillgraph.storage import materialize, spread


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ring(spark, n=50):
    ring = spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 1) % n).alias("j"), F.lit(2.0).alias("w"))
    return materialize(ring.unionByName(ring.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "ring")


def test_only_the_diagonal_is_summed(spark):
    """entries beside it are rows of the adjacency, which no shuffle moves."""
    plan = _plan(graph.laplacian(_ring(spark)))
    assert plan.count("Exchange hashpartitioning(i#") == 1 == plan.count("Exchange")


def test_parts_grow_with_the_files(spark, monkeypatch):
    """what a task adds up does not grow with the tables."""
    a = _ring(spark).withColumnRenamed("w", "v")
    few = linalg.ewise_add(a, linalg.transpose(a))
    monkeypatch.setattr(storage, "SPREAD", 100)
    many = linalg.ewise_add(a, linalg.transpose(a))
    assert spread(a, "i").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "REPARTITION_BY_NUM" in _plan(many) and "REPARTITION_BY_NUM" not in _plan(few)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))

"""Elimination without products of matrices."""

import numpy as np
from pyspark.sql import functions as F
from quillgraph.operators import elimination, graph
from quillgraph.storage import materialize


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_elimination_adds_up_pairs_of_neighbours(spark):
    """The entries of the triple product, with one sum by place and at most three shuffles of the matrix."""
    ring = spark.range(40).select(F.col("id").alias("a"), ((F.col("id") * 7 + 1) % 40).alias("b")).where("a <> b")
    chords = spark.range(12).select((F.col("id") * 3).alias("a"), F.lit(39).cast("long").alias("b")).where("a <> b")
    edges = ring.union(chords).groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg((F.count("*") + F.min("a") % 3).cast("double").alias("w"))
    lap = materialize(graph.laplacian(edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))), "lap")
    gone = materialize(elimination.select(lap), "gone")
    assert gone.count() > 3
    product, direct = elimination.coarse(lap, elimination.prolongation(lap, gone)), elimination.schur(lap, gone)
    expected = {(r["i"], r["j"]): r["v"] for r in product.collect()}
    rows = direct.collect()
    assert len(rows) == len(expected) and all(np.isclose(r["v"], expected[r["i"], r["j"]], rtol=1e-12, atol=1e-14) for r in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert _plan(elimination.schur(lap, gone)).count("Exchange hashpartitioning(i#") < _plan(elimination.coarse(lap, elimination.prolongation(lap, gone))).count("Exchange hashpartitioning")
        assert "double) * v" not in _plan(elimination.schur(lap, gone)) and _plan(elimination.schur(lap, gone)).count("SortMergeJoin") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

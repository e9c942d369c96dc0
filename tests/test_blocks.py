"""What products of a matrix with its transpose move."""

from pyspark.sql import functions as F
from test_wedges import _moved

from quillgraph.operators import tiles
from quillgraph.queries import QUERIES
from quillgraph.storage import materialize


def test_no_sum_is_moved(spark):
    """bands that meet add up their products where they arise, so rows moved follow the entries, not the pairs."""
    n = 300
    rows = [(i, j, 1.0) for i in range(n) for j in (0, 1 + i % 7)]
    a = materialize(spark.createDataFrame(rows, "i long, j long, v double"), "a")
    before = _moved(spark)
    found = tiles.by_bands(a, 150).toPandas()
    assert _moved(spark) - before < 5 * len(rows) < n * n
    assert len(found) == len(found[["i", "j"]].drop_duplicates()) == n * n
    assert all(v == 1 + (i % 7 == j % 7) for i, j, v in found.itertuples(index=False))


def test_a_part_that_all_sell_moves_no_pair(spark, tmp_path):
    """all suppliers share part 0, so every pair of them is found, and none is moved."""
    n = 400
    spark.range(n).select(F.col("id").alias("l_suppkey"), (1 + F.col("id") % 40).alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    before = _moved(spark)
    total, pairs = QUERIES["cooccurrence_hub"](spark, str(tmp_path)).agg(F.sum("v"), F.count("*")).first()
    assert _moved(spark) - before < 20 * n < n * (n - 1) == pairs
    assert total == n * (n - 1) + n * (n // 40 - 1)

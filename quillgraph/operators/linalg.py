"""Semiring linear algebra over DataFrames: matrices are (i, j, v) with at most one row per (i, j), vectors (i, v).

Everything is a lazy composition of joins, group-bys and column expressions. A product shuffles its matrix once by
column (to meet the vector) and its partial sums once by row; partial sums are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import dealt
from quillgraph.operators.packed import packed
from quillgraph.semiring import PLUS_TIMES, Semiring
from quillgraph.storage import materialize, spread


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def apply(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.withColumn("v", f(F.col("v")))


def prune(a: DataFrame, drop: Callable[[Column], Column]) -> DataFrame:
    return a.where(~drop(F.col("v")))


def find(x: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """A sparse vector: the entries that satisfy ``keep``."""
    return x.where(keep(F.col("v")))


def diagonal(a: DataFrame) -> DataFrame:
    if tiles := packed(a):
        return tiles.diagonal
    return a.where("i = j").select("i", "v")


def identity(ids: DataFrame) -> DataFrame:
    return ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def constant(ids: DataFrame, value: float) -> DataFrame:
    return ids.select("i", F.lit(value).alias("v"))


def vertices(a: DataFrame) -> DataFrame:
    """Row ids of a matrix."""
    if tiles := packed(a):
        return tiles.diagonal.select("i")
    return a.select("i").distinct()


def from_triples(rows: DataFrame) -> DataFrame:
    """A matrix from (i, j, v) rows; repeated places are added up."""
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def spmv(a: DataFrame, x: DataFrame, semiring: Semiring = PLUS_TIMES, domain: DataFrame | None = None) -> DataFrame:
    """y_i = add over j of mul(a_ij, x_j). Without a ``domain`` (rows i) the result is sparse: rows that meet no entry of
    ``x`` are absent. Hubs of a matrix that :func:`quillgraph.operators.dealt.deal` has dealt are met in parts. Sums with a packed
    matrix take an ``x`` that has a value for each vertex."""
    if semiring is PLUS_TIMES and (tiles := packed(a)):
        y = tiles.product(x, {"av": "v"}, []).select("i", F.col("av").alias("v"))
        return y if domain is None else domain.select("i").join(y, "i", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    met = dealt.meet(a, x.select("i", F.col("v").alias("x")))
    y = met.groupBy("i").agg(semiring.add(semiring.mul(F.col("v"), F.col("x"))).alias("v"))
    if domain is not None:
        y = domain.select("i").join(y, "i", "left")
    return y if semiring.zero is None else y.withColumn("v", F.coalesce("v", F.lit(semiring.zero)))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    return a.join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("k", "j")


def triple_product(p: DataFrame, a: DataFrame) -> DataFrame:
    """Pᵀ A P for a sparse P (i, j, v)."""
    return spgemm(transpose(p), spgemm(a, p))


def galerkin_of_map(assign: DataFrame, a: DataFrame) -> DataFrame:
    """Rᵀ A R where R maps vertices to aggregates (i, agg): two lookups and one group-by."""
    rows = a.join(assign.withColumnRenamed("agg", "row"), "i")
    both = rows.join(assign.select(F.col("i").alias("j"), F.col("agg").alias("col")), "j")
    return both.groupBy("row", "col").agg(F.sum("v").alias("v")).withColumnsRenamed({"row": "i", "col": "j"})


def ewise_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """a + b over the union of their patterns."""
    return from_triples(spread(a.select("i", "j", "v").unionByName(b.select("i", "j", "v")), "i", "j"))


def symmetrize(a: DataFrame) -> DataFrame:
    return apply(ewise_add(a, transpose(a)), lambda v: v / 2)


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha x + y of two dense vectors over the same ids."""
    return x.withColumnRenamed("v", "x").join(y, "i").select("i", (F.lit(alpha) * F.col("x") + F.col("v")).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """One row: v."""
    return x.join(y.withColumnRenamed("v", "w"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def orthogonalize(x: DataFrame) -> DataFrame:
    """x less its mean; the mean is one row."""
    return x.join(F.broadcast(x.agg(F.avg("v").alias("mean"))), F.lit(True)).select("i", (F.col("v") - F.col("mean")).alias("v"))


def reduce_rows(a: DataFrame, add: Callable[[Column], Column] = F.sum) -> DataFrame:
    return a.groupBy("i").agg(add(F.col("v")).alias("v"))


def reduce_columns(a: DataFrame, add: Callable[[Column], Column] = F.sum) -> DataFrame:
    return a.groupBy(F.col("j").alias("i")).agg(add(F.col("v")).alias("v"))


def dim_apply(a: DataFrame, x: DataFrame, dim: str, op: Callable[[Column, Column], Column]) -> DataFrame:
    """op(a_ij, x_i) for dim ``i``, op(a_ij, x_j) for ``j``."""
    return a.join(x.select(F.col("i").alias(dim), F.col("v").alias("_x")), dim).select("i", "j", op(F.col("v"), F.col("_x")).alias("v"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    return axpy(-1.0, spmv(a, x, domain=b), b)


def norm(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))


def permute(a: DataFrame, order: DataFrame) -> DataFrame:
    """Rename vertices by ``order`` (i, new); rows without a new name go."""
    rows = a.join(order.withColumnRenamed("new", "row"), "i")
    both = rows.join(order.select(F.col("i").alias("j"), F.col("new").alias("col")), "j")
    return both.select(F.col("row").alias("i"), F.col("col").alias("j"), "v")


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``new``: 0, 1, ... by ``keys``. Range partitions are written with their number; each is numbered on
    its own and moved by the sizes of those before it, so no task sees all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").count()  # as many rows as there are partitions
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return ranged.withColumn("_own", own).join(before, "_part").withColumn("new", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def followed(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the ``value`` of the next row of the same ``group`` in ``order`` (null for the last one). A
    group may hold most rows: range partitions are written, and the last row of each takes its value from the next one."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    key = F.struct(group, *order)
    # as many rows as there are partitions
    firsts = ranged.groupBy("_part").agg(F.min(F.struct(key.alias("k"), F.col(group).alias("g"), F.col(value).alias("x"))).alias("f"))
    after = firsts.select((F.lead("f").over(Window.orderBy("_part"))).alias("n"), "_part").select("_part", F.col("n.g").alias("_g"), F.col("n.x").alias("_x"))
    own = Window.partitionBy("_part").orderBy(group, *order)
    seen = ranged.withColumns({"_next": F.lead(F.struct(F.col(group).alias("g"), F.col(value).alias("x"))).over(own)}).join(F.broadcast(after), "_part")
    following = F.when(F.col("_next").isNotNull(), F.when(F.col("_next.g") == F.col(group), F.col("_next.x"))).otherwise(F.when(F.col("_g") == F.col(group), F.col("_x")))
    return seen.withColumn(name, following).drop("_part", "_next", "_g", "_x")


def random_order(ids: DataFrame, seed: int = 0) -> DataFrame:
    """(i, new): contiguous numbers from 0 in an order drawn by ``seed``, to balance ids by :func:`permute`."""
    return numbered(ids.select("i").distinct().withColumn("_h", F.xxhash64("i", F.lit(seed))), "_h", "i").select("i", "new")


def renumber(ids: DataFrame) -> DataFrame:
    """(i, new): order-preserving contiguous numbers from 0."""
    return numbered(ids.select("i").distinct(), "i").select("i", "new")


def remove_zero_rows(a: DataFrame) -> DataFrame:
    """Rows whose sum is not 0, renumbered; columns keep their names."""
    kept = reduce_rows(a).where("v <> 0")
    return a.join(renumber(kept), "i").select(F.col("new").alias("i"), "j", "v")

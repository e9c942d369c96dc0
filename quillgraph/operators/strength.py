"""Strength of connection between neighbours: test vectors, their smoothing, and scalings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.graphs import hashed_value
from quillgraph.operators import dealt, linalg
from quillgraph.operators.packed import packed


def test_vectors(ids: DataFrame, count: int = 10) -> DataFrame:
    """(i, xs): ``count`` fixed pseudo-random vectors in one array, each less its mean (all means are one row)."""
    raw = ids.select("i", *(hashed_value(F.col("i"), k).alias(f"x{k}") for k in range(count)))
    means = F.broadcast(raw.agg(*(F.avg(f"x{k}").alias(f"m{k}") for k in range(count))))
    return raw.join(means, F.lit(True)).select("i", F.array(*(F.col(f"x{k}") - F.col(f"m{k}") for k in range(count))).alias("xs"))


def smooth(lap: DataFrame, vectors: DataFrame, count: int, omega: float = 2.0 / 3.0) -> DataFrame:
    """One weighted Jacobi sweep with a zero right-hand side on all vectors at once: one join, one group-by."""
    if tiles := packed(lap):
        columns = [f"x{k}" for k in range(count)]
        state = vectors.select("i", *(F.col("xs")[k].alias(c) for k, c in enumerate(columns)))
        swept = tiles.product(state, {f"s{k}": c for k, c in enumerate(columns)}, columns, negative=True)
        return swept.select("i", F.array(*(omega * (F.lit(0.0) - F.col(f"s{k}")) / F.col("d") + (1 - omega) * F.col(c) for k, c in enumerate(columns))).alias("xs"))
    met = dealt.meet(lap, vectors)
    own = F.col("i") == F.col("j")
    sums = [F.sum(F.when(F.col("v") < 0, F.col("v") * F.col("xs")[k])).alias(f"s{k}") for k in range(count)]
    kept = met.groupBy("i").agg(*sums, F.max(F.when(own, F.col("v"))).alias("d"), F.max(F.when(own, F.col("xs"))).alias("xs"))
    new = [omega * (F.lit(0.0) - F.coalesce(f"s{k}", F.lit(0.0))) / F.col("d") + (1 - omega) * F.col("xs")[k] for k in range(count)]
    return kept.select("i", F.array(*new).alias("xs"))


def _of_edges(lap: DataFrame, vectors: DataFrame) -> DataFrame:
    edges = dealt.meet(lap, vectors.withColumnRenamed("xs", "xj")).where("i <> j")
    return dealt.meet(edges, vectors.withColumnRenamed("xs", "xi"), "i", hubs=getattr(lap, "_quill_hubs", None))


def _sum(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def affinity(lap: DataFrame, vectors: DataFrame, squared: bool = True) -> DataFrame:
    """(Σ xi xj)² over the squares (``squared``) or the plain product of Σ xi² and Σ xj²."""
    xy, xx, yy = _sum(F.col("xi"), F.col("xj")), _sum(F.col("xi"), F.col("xi")), _sum(F.col("xj"), F.col("xj"))
    below = xx * yy
    return _of_edges(lap, vectors).select("i", "j", F.coalesce(F.try_divide(xy * xy, below * below if squared else below), F.lit(0.0)).alias("v"))


def algebraic_distance(lap: DataFrame, vectors: DataFrame, most: float = 1e300) -> DataFrame:
    """1 / max |xi - xj|; equal vectors are as near as can be (``most``)."""
    apart = F.array_max(F.zip_with("xi", "xj", lambda x, y: F.abs(x - y)))
    return _of_edges(lap, vectors).select("i", "j", F.coalesce(F.try_divide(F.lit(1.0), apart), F.lit(most)).alias("v"))


def weights(lap: DataFrame) -> DataFrame:
    return lap.where("i <> j").select("i", "j", F.greatest(-F.col("v"), F.lit(0.0)).alias("v"))


def _share(a: Column, s: Column) -> Column:
    return F.coalesce(F.try_divide(a, s), F.lit(0.0))


def scale(s: DataFrame, how: str = "max") -> DataFrame:
    """none, row, column, row_column, sym, or max: v over the greater of its row's and its column's maximum."""
    by = lambda a, dim: linalg.dim_apply(a, linalg.reduce_rows(a) if dim == "i" else linalg.reduce_columns(a), dim, _share)
    if how == "none":
        return s
    if how == "row":
        return by(s, "i")
    if how == "column":
        return by(s, "j")
    if how == "row_column":
        return by(by(s, "i"), "j")
    if how == "sym":
        return linalg.symmetrize(by(s, "i"))
    if how == "max":
        rows, columns = linalg.reduce_rows(s, F.max).withColumnRenamed("v", "r"), linalg.reduce_columns(s, F.max).select(F.col("i").alias("j"), F.col("v").alias("c"))
        return s.join(rows, "i").join(columns, "j").select("i", "j", _share(F.col("v"), F.greatest("r", "c")).alias("v"))
    raise ValueError(f"no such scaling: {how}")

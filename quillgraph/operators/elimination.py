"""Elimination of an independent set of low-degree vertices: an exact coarsening step.

A candidate goes when it is the least candidate of its closed neighbourhood, so no two neighbours go at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import linalg
from quillgraph.operators.graph import degrees


def candidates(lap: DataFrame, max_degree: int = 4) -> DataFrame:
    return degrees(lap).where(F.col("v") <= max_degree).select("i")


def select(lap: DataFrame, max_degree: int = 4) -> DataFrame:
    """(i): the vertices to eliminate."""
    low = candidates(lap, max_degree)
    between = lap.where("v <> 0").join(low, "i", "left_semi").join(low.withColumnRenamed("i", "j"), "j", "left_semi")
    return between.groupBy("i").agg(F.min("j").alias("least")).where("least = i").select("i")


def survivors(lap: DataFrame, gone: DataFrame) -> DataFrame:
    return linalg.vertices(lap).join(gone, "i", "left_anti")


def id_map(lap: DataFrame, gone: DataFrame) -> DataFrame:
    """(i, new): contiguous ids of the survivors in order, -1 for eliminated vertices."""
    kept = linalg.renumber(survivors(lap, gone))
    return linalg.vertices(lap).join(kept, "i", "left").select("i", F.coalesce("new", F.lit(-1).cast("long")).alias("new"))


def prolongation(lap: DataFrame, gone: DataFrame) -> DataFrame:
    """P (i, j, v): survivors stay, an eliminated vertex is the mean of its neighbours."""
    rows = lap.join(gone, "i", "left_semi")
    d = linalg.diagonal(rows).withColumnRenamed("v", "d")
    means = rows.where("i <> j").join(d, "i").select("i", "j", (-F.col("v") / F.col("d")).alias("v"))
    return linalg.identity(survivors(lap, gone)).unionByName(means)


def inverse(lap: DataFrame, gone: DataFrame) -> DataFrame:
    """Q (i, j, v): the inverse diagonal on eliminated vertices."""
    return lap.where("i = j").join(gone, "i", "left_semi").select("i", "j", (F.lit(1.0) / F.col("v")).alias("v"))


def coarse(lap: DataFrame, p: DataFrame) -> DataFrame:
    """Pᵀ L P, the Schur complement of what was eliminated. Places of survivors and eliminated vertices that cancel out
    are no entries."""
    return linalg.triple_product(p, lap)


def schur(lap: DataFrame, gone: DataFrame) -> DataFrame:
    """:func:`coarse` of a symmetric ``lap`` (a written table) without products of matrices: an eliminated vertex, whose
    neighbours are few and stay, gives each pair of them one entry, and survivors keep what is between them. One of the two
    halves is added up."""
    row = lap.join(gone, "i", "left_semi").groupBy("i")
    stars = row.agg(F.max(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("d"), F.collect_list(F.when(F.col("i") != F.col("j"), F.struct("j", "v"))).alias("n"))
    entry = lambda a, b: F.struct(a["j"].alias("i"), b["j"].alias("j"), (-a["v"] * b["v"] / F.col("d")).alias("v"))
    pairs = F.flatten(F.transform("n", lambda a: F.transform(F.filter("n", lambda b: b["j"] >= a["j"]), lambda b: entry(a, b))))
    kept = lap.where("i <= j").join(gone, "i", "left_anti").join(gone.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "v")
    half = kept.unionByName(stars.select(F.explode(pairs).alias("e")).select("e.*")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    there, back = F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))).alias("e")).select("e.*")


def compose(p: DataFrame, q: DataFrame, p2: DataFrame, q2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(P, Q) of two eliminations in a row: P P2 and Q + P Q2 Pᵀ."""
    return linalg.spgemm(p, p2), linalg.ewise_add(q, linalg.spgemm(linalg.spgemm(p, q2), linalg.transpose(p)))


def extend(p: DataFrame, q: DataFrame, coarse_x: DataFrame, b: DataFrame) -> DataFrame:
    """x = P xc + Q b."""
    both = linalg.spmv(p, coarse_x).unionByName(linalg.spmv(q, b))
    return both.groupBy("i").agg(F.sum("v").alias("v"))

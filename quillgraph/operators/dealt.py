"""Products that survive hubs: rows and columns of a matrix that hold a large part of all its entries.

A hub's column is dealt over as many parts as it has ``limit`` entries, by the rows of the entries, and the vector's value
at the hub is sent to every part. Sums by row are combined where they arise, so a hub's row is one partial sum a task. Where
the product is one of two matrices, columns that would pair too many entries are multiplied as blocks: blocks of rows of
the left one with blocks of columns of the right one, all such columns at once, so that what leaves a block is summed.

The limit is at least a 1024th of the whole, so at most ``HUBS`` ids are hubs, whatever the matrix: their table is
broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import bucketed, measured

HUBS = 1024
MOST = 1 << 16


def hubs_of(a: DataFrame, side: str, total: float, most: int = MOST) -> DataFrame | None:
    """(id, deals): rows (``i``) or columns (``j``) of ``a`` with more than ``most`` of its ``total`` entries and a 1024th
    of them; none where there is no such one. A written table of at most ``HUBS`` rows."""
    limit = max(most, total / HUBS)
    if total <= limit:
        return None
    sizes = a.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    found, s = measured(sizes.select("id", F.ceil(F.col("n") / F.lit(float(limit))).cast("int").alias("deals")), "hubs", n=F.count("*"))
    return found if s["n"] else None


def deal(a: DataFrame, name: str, total: float, most: int = MOST) -> DataFrame:
    """``a`` (i, j, v; a table that is cheap to read again) kept in buckets by column, hubs' columns dealt by row. With hubs
    it has a column ``_part``. :func:`meet` joins it with vectors without moving it."""
    by_row, by_column = hubs_of(a, "i", total, most), hubs_of(a, "j", total, most)
    if by_column is None:
        out = bucketed(a.select("i", "j", "v"), name, "j")
    else:
        out = bucketed(_parted(a.select("i", "j", "v"), "j", "i", by_column), name, "j", "_part")
    out._quill_hubs = {"i": by_row, "j": by_column}
    return out


def _parted(rows: DataFrame, side: str, other: str, hubs: DataFrame) -> DataFrame:
    """``rows`` with ``_part``: of a hub at ``side``, a part by their ``other`` id; else 0."""
    known = rows.join(F.broadcast(hubs.withColumnRenamed("id", side)), side, "left")
    return known.withColumn("_part", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("deals"))).cast("int")).drop("deals")


def meet(rows: DataFrame, x: DataFrame, side: str = "j", small: bool = False, hubs: dict | None = None) -> DataFrame:
    """``rows`` with the columns of ``x`` (i, ...) at their id ``side``. ``small``: the caller has counted ``x`` and found it
    few enough to broadcast. ``hubs``: those of the matrix that ``rows`` come from, where ``rows`` is not itself what
    :func:`deal` gave."""
    x = x.withColumnRenamed("i", side)
    if small:
        return rows.drop("_part").join(F.broadcast(x), side)
    hubs = (hubs or getattr(rows, "_quill_hubs", None) or {}).get(side)
    if hubs is None:
        return rows.drop("_part").join(x, side) if "_part" in rows.columns else rows.join(x, side)
    if side != "j" or "_part" not in rows.columns:
        rows = _parted(rows.drop("_part"), side, "j" if side == "i" else "i", hubs)
    sent = x.join(F.broadcast(hubs.withColumnRenamed("id", side)), side, "left")
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return rows.join(sent, [side, "_part"]).drop("_part")


def _block_product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """The sums of a block of rows and a block of columns over the heavy columns between them; a place has an entry where
    any product falls on it."""
    if a.empty or b.empty:
        return pd.DataFrame({"i": [], "k": [], "v": []})
    rows, row = np.unique(a["i"].to_numpy(), return_inverse=True)
    columns, column = np.unique(b["k"].to_numpy(), return_inverse=True)
    inner, both = np.unique(np.concatenate([a["j"].to_numpy(), b["j"].to_numpy()]), return_inverse=True)
    left, right = np.zeros((len(rows), len(inner))), np.zeros((len(inner), len(columns)))
    is_left, is_right = np.zeros(left.shape, dtype=np.float32), np.zeros(right.shape, dtype=np.float32)
    left[row, both[: len(a)]], is_left[row, both[: len(a)]] = a["v"], 1
    right[both[len(a) :], column], is_right[both[len(a) :], column] = b["w"], 1
    at, to = np.nonzero(is_left @ is_right)
    return pd.DataFrame({"i": rows[at], "k": columns[to], "v": (left @ right)[at, to]})


def multiply(a: DataFrame, b: DataFrame, most_pairs: int = 1 << 24, block: int = 1024) -> DataFrame:
    """a b as (i, j, v), entries of both unique. Inner ids that pair more than ``most_pairs`` entries, and a 1024th of all
    pairs, are multiplied in blocks of about ``block`` entries a side; all others by a join on the inner id. Both tables
    are read twice."""
    right = b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("w"))
    sizes = a.groupBy("j").agg(F.count("*").alias("na")).join(right.groupBy("j").agg(F.count("*").alias("nb")), "j")
    sizes, s = measured(sizes, "inner_sizes", pairs=F.sum(F.col("na").cast("double") * F.col("nb")))
    limit = max(most_pairs, s["pairs"] / HUBS)
    heavy, s = measured(sizes.where(F.col("na").cast("double") * F.col("nb") > limit), "heavy", n=F.count("*"), na=F.sum("na"), nb=F.sum("nb"))
    if not s["n"]:
        met = a.join(right, "j").select("i", "k", (F.col("v") * F.col("w")).alias("v"))
        return met.groupBy("i", "k").agg(F.sum("v").alias("v")).withColumnRenamed("k", "j")
    p, q = math.ceil(s["na"] / block), math.ceil(s["nb"] / block)
    ids = F.broadcast(heavy.select("j"))
    at, to = F.pmod(F.xxhash64("i"), F.lit(p)).cast("int"), F.pmod(F.xxhash64("k"), F.lit(q)).cast("int")
    of_rows = a.join(ids, "j", "left_semi").select("i", "j", "v", at.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("t"))
    of_columns = right.join(ids, "j", "left_semi").select("j", "k", "w", to.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("s"))
    blocks = of_rows.groupBy("s", "t").cogroup(of_columns.groupBy("s", "t")).applyInPandas(_block_product, "i long, k long, v double")
    light = a.join(ids, "j", "left_anti").join(right.join(ids, "j", "left_anti"), "j").select("i", "k", (F.col("v") * F.col("w")).alias("v"))
    return light.unionByName(blocks).groupBy("i", "k").agg(F.sum("v").alias("v")).withColumnRenamed("k", "j")


def dealt_table(a: DataFrame, most: int = MOST) -> DataFrame:
    """:func:`deal` of a matrix that is not written yet."""
    written, s = measured(a, "matrix", n=F.count("*"))
    return deal(written, "dealt", s["n"], most)

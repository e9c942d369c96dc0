"""Connected components of an edge table by alternating star contractions.

Each round hangs every vertex's larger neighbours on the least vertex of its neighbourhood (large star) and then every
vertex's smaller neighbours likewise (small star). The edges end up as stars around the least vertex of each component,
after a number of rounds that grows with the logarithm of the component size, not with its diameter. Each round is two
group-bys with map-side combine and two joins, and ends in one written table. A star is a hot key: the rows of a vertex
with more than ``most`` edges are dealt on before a join. There are at most ``HUBS`` such vertices, so their names are
broadcast; where the table is too small for any, joins are plain. A round never has more edges than the one before, so its
table is written by no more tasks than those edges need (``TASK_ROWS`` each, but one for each core).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.storage import discard, materialize


HUBS = 1024
TASK_ROWS = 1 << 16


def _met(rows: DataFrame, least: DataFrame, limit: float) -> DataFrame:
    """``rows`` (u, v) with m of ``least`` (u, m, d: rows of u); those of a u with more than ``limit`` rows are dealt on. No
    limit: no u can have too many."""
    if not limit:
        return rows.join(least, "u")
    deals = F.greatest(F.ceil(F.col("d") / F.lit(limit)), F.lit(1)).cast("int")
    hubs = least.where(F.col("d") > limit).select("u", deals.alias("deals"))
    left = rows.join(F.broadcast(hubs), "u", "left")
    left = left.select("u", "v", F.when(F.col("deals").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("deals"))).cast("int").alias("salt"))
    return left.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), deals - 1)).alias("salt")), ["u", "salt"])


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, most: int = 1 << 16) -> DataFrame:
    """(node, label): ``label`` is the least vertex of the component. Vertices that are in no edge but loops, and null
    ends, do not appear. The result is a written table."""
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    now, seen = materialize(now, "star"), None
    cores = edges.sparkSession.sparkContext.defaultParallelism
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        limit = max(most, 2 * state[0] / HUBS)  # of twice so many rows, at most HUBS vertices have more
        limit = limit if 2 * state[0] > limit else 0
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = _met(both, least, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        inner = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        moved = _met(large, inner, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = moved.unionByName(inner.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(after.coalesce(max(cores, math.ceil(state[0] / TASK_ROWS))), "star")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out = labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out._quill_path = now._quill_path
    return out

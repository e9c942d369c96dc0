"""Embedding near-dedup by an epsilon grid order join (operator 4).

Vectors of one label link when their cosine reaches a threshold, that is, when their directions (unit vectors) are at
most ``eps`` apart.

1. *Classes*: rows with equal vectors and labels are one class with a count, so copies are joined once.
2. *Principal dimensions*: second moments of all directions are Spark sums; the leading eigenvectors of that one small
   matrix make the grid's axes.
3. *Order*: classes are sorted by label and grid cells of side ``eps`` on those axes, by range partitions (a label that
   holds most rows is cut like any other), and cut into intervals of at most ``interval`` rows, each with its box.
4. *Interval join*: the sequence is joined with itself recursively. Runs of intervals meet first, then, level by level,
   the parts of those whose boxes are at most ``eps`` apart on all axes of the projection, down to single intervals. A
   projection can only shrink distances, so a skipped pair is provably distant.
5. *Recursion*: pairs of intervals from the same two runs share a task, to which each interval is sent once. Two
   meeting intervals are halved again and again, and halves whose boxes are too far apart are skipped; what is left is
   compared exactly, in double precision. A task gives link counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.vectors import doubles, usable
from quillgraph.operators.components import star_components
from quillgraph.storage import discard, materialize

AXES = 8
LEAF = 64
#: A run of intervals, and a run of runs, has up to 2 ** FAN parts.
FAN = 3


def _directions(vectors: pd.Series) -> np.ndarray:
    return _normed(np.array(vectors.tolist(), dtype=np.float64))


def _normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    by_width: dict[int, np.ndarray] = {}
    for frame in frames:
        for width, own in frame.groupby(frame["v"].map(len)):
            x = _directions(own["v"])
            with_mean = np.hstack((x, np.ones((len(x), 1))))
            by_width[width] = by_width.get(width, 0) + with_mean.T @ with_mean
    if by_width:
        yield pd.DataFrame({"width": list(by_width), "m": [m.ravel() for m in by_width.values()]})


def principal_axes(classes: DataFrame, count: int = AXES) -> dict[int, np.ndarray]:
    """width -> (width, count) matrix of leading eigenvectors of the directions' covariance, from sums over all rows."""
    parts = classes.select("v").mapInPandas(_moments, "width int, m array<double>")
    sums = parts.select("width", F.posexplode("m").alias("k", "x")).groupBy("width", "k").agg(F.sum("x").alias("x"))
    axes = {}
    for row in sums.groupBy("width").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("m")).collect():
        width = row["width"]
        m = np.array([x for _, x in row["m"]]).reshape(width + 1, width + 1)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        _, vectors = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
        axes[width] = np.ascontiguousarray(vectors[:, ::-1][:, :count])
    return axes


def _project(frames: Iterator[pd.DataFrame], axes: dict[int, np.ndarray], eps: float, kind: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        widths = frame["v"].map(len)
        for width, own in frame.groupby(widths):
            x = _directions(own["v"])
            p = x @ axes[width]
            yield pd.DataFrame({
                "cls": own["cls"], "label": own["label"], "n": own["n"], "width": width,
                "cells": list(np.floor(p / eps).astype(np.int32)), "p": list(p), "x": [row.tobytes() for row in np.array(own["v"].tolist(), dtype=kind)],
            })


def _intervals(frames: Iterator[pd.DataFrame], interval: int) -> Iterator[pd.DataFrame]:
    """Sorted rows -> one row per interval with its box and its rows as arrays."""
    number, held = 0, None

    def close(rows: pd.DataFrame) -> dict:
        nonlocal number
        p = np.array(rows["p"].tolist())
        number += 1
        return {
            "block": (TaskContext.get().partitionId() << 32) + number, "label": rows["label"].iloc[0], "width": rows["width"].iloc[0], "low": p.min(0), "high": p.max(0),
            "cls": rows["cls"].tolist(), "n": rows["n"].tolist(), "p": p.astype("<f8").tobytes(), "x": b"".join(rows["x"]),
        }

    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        group = ((frame["label"] != frame["label"].shift()) | (frame["width"] != frame["width"].shift())).cumsum()
        out, held = [], None
        groups = [own for _, own in frame.groupby(group, sort=False)]
        for k, own in enumerate(groups):
            for at in range(0, len(own), interval):
                rows = own.iloc[at : at + interval]
                if len(rows) < interval and k == len(groups) - 1:
                    held = rows
                else:
                    out.append(close(rows))
        if out:
            yield pd.DataFrame(out)
    if held is not None and len(held):
        yield pd.DataFrame([close(held)])


def _far(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    """Whether the boxes of two runs of projected rows are more than ``eps`` apart."""
    gap = np.maximum(0.0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
    return float((gap * gap).sum()) > eps * eps


def _recurse(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, eps: float, cosine: float, out: list, i: int = 0, j: int = 0) -> None:
    """Links between two sequence intervals as (places in the first, places in the second)."""
    if _far(p, q, eps):
        return
    if max(len(x), len(y)) <= LEAF:
        a, b = np.nonzero(x @ y.T >= cosine)
        if same and i == j:
            a, b = a[a < b], b[a < b]
        if a.size:
            out.append((a + i, b + j))
        return
    if same and i == j:
        h = len(x) // 2
        for s, t in ((slice(0, h), slice(0, h)), (slice(0, h), slice(h, None)), (slice(h, None), slice(h, None))):
            _recurse(x[s], y[t], p[s], q[t], True, eps, cosine, out, i + (s.start or 0), j + (t.start or 0))
        return
    if len(x) >= len(y):
        h = len(x) // 2
        _recurse(x[:h], y, p[:h], q, same, eps, cosine, out, i, j)
        _recurse(x[h:], y, p[h:], q, same, eps, cosine, out, i + h, j)
    else:
        h = len(y) // 2
        _recurse(x, y[:h], p, q[:h], same, eps, cosine, out, i, j)
        _recurse(x, y[h:], p, q[h:], same, eps, cosine, out, i, j + h)


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Places of edges that keep what all edges connect: union-find over the few places of one task."""
    root = list(range(size))
    kept = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while root[u] != u:
            root[u] = u = root[root[u]]
        while root[v] != v:
            root[v] = v = root[root[v]]
        if u != v:
            root[max(u, v)] = min(u, v)
            kept.append(k)
    return np.array(kept, dtype=np.int64)


def _join_group(pairs: pd.DataFrame, intervals: pd.DataFrame, eps: float, cosine: float, kind: str) -> pd.DataFrame:
    """Of the pairs of intervals in a group: link counts (src = dst) and edges (links 0)."""
    held = {}
    for row in intervals.itertuples(index=False):
        classes = np.asarray(row.cls, dtype=np.int64)
        x = _normed(np.frombuffer(row.x, dtype=kind).reshape(len(classes), -1).astype(np.float64))
        held[row.block] = classes, np.asarray(row.n, dtype=np.int64), np.frombuffer(row.p, dtype="<f8").reshape(len(classes), -1), x
    out = [np.zeros((0, 3), dtype=np.int64)]
    for block, block2 in zip(pairs["block"], pairs["block2"], strict=True):
        same, found = block == block2, []
        (first, n, p, x), (second, m, q, y) = held[block], held[block2]
        _recurse(x, y, p, q, same, eps, cosine, found)
        if not found:
            continue
        a, b = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        for ids, links in ((first, np.bincount(a, weights=m[b], minlength=len(first))), (second, np.bincount(b, weights=n[a], minlength=len(second)))):
            some = np.flatnonzero(links)
            out.append(np.column_stack((ids[some], ids[some], links[some].astype(np.int64))))
        keep = _spanning(a, b + (0 if same else len(first)), len(first) + (0 if same else len(second)))
        out.append(np.column_stack((first[a[keep]], second[b[keep]], np.zeros(len(keep), dtype=np.int64))))
    return pd.DataFrame(np.concatenate(out), columns=["src", "dst", "links"])


def _near(eps: float) -> Column:
    """Whether the boxes low0.., high0.. and low20.., high20.. are at most ``eps`` apart; axes that are not there are null."""
    gaps = [F.greatest(F.col(f"low{k}") - F.col(f"high2{k}"), F.col(f"low2{k}") - F.col(f"high{k}"), F.lit(0.0)) for k in range(AXES)]
    return sum((g * g for g in gaps), F.lit(0.0)) <= eps * eps


def meeting_intervals(blocks: DataFrame, eps: float) -> DataFrame:
    """(block, block2, pair_group) of the intervals of one label and width whose boxes are at most ``eps`` apart: a written
    table. The sequence is cut in runs of runs of intervals; only parts of runs that meet can meet."""
    most = blocks.agg(F.max(F.shiftright("block", 32)).alias("part"), F.max(F.col("block").bitwiseAND((1 << 32) - 1)).alias("number")).first()
    bits = int(most["number"] or 0).bit_length()
    levels = -(-(bits + int(most["part"] or 0).bit_length()) // FAN)
    place = F.shiftleft(F.shiftright("block", 32), bits) + F.col("block").bitwiseAND((1 << 32) - 1)
    ends = [f"{end}{k}" for end in ("low", "high") for k in range(AXES)]
    boxes = materialize(blocks.select("label", "width", "block", place.alias("place"), *(F.get(end, F.lit(k)).alias(f"{end}{k}") for end in ("low", "high") for k in range(AXES))), "boxes")

    def runs(level: int) -> DataFrame:
        """label, width, run, up (the run of the level above) and box."""
        placed = boxes.withColumn("run", F.shiftright("place", FAN * level)).withColumn("up", F.shiftright("place", FAN * (level + 1)))
        if not level:
            return placed.drop("place")
        return placed.groupBy("label", "width", "run", "up").agg(*((F.min if end.startswith("low") else F.max)(end).alias(end) for end in ends))

    pairs = runs(levels).select("label", "width", "run", F.col("run").alias("run2"))  # one run for each label and width
    for level in range(levels - 1, -1, -1):
        own = runs(level).withColumnsRenamed({"run": "part", "up": "run"})
        other = own.select("label", "width", F.col("run").alias("run2"), F.col("part").alias("part2"), *(F.col(end).alias(end[:-1] + "2" + end[-1]) for end in ends), *([F.col("block").alias("block2")] if not level else []))
        met = pairs.join(own, ["label", "width", "run"]).join(other, ["label", "width", "run2"]).where((F.col("part") <= F.col("part2")) & _near(eps))
        if level:
            pairs = materialize(met.select("label", "width", F.col("part").alias("run"), F.col("part2").alias("run2")), "runs")
    if not levels:
        met = boxes.withColumn("block2", F.col("block")).withColumns({"run": F.lit(0), "run2": F.lit(0)})
    return materialize(met.select("block", "block2", F.xxhash64("label", "width", "run", "run2").alias("pair_group")), "meeting")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, interval: int = 512) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links (other vectors linked directly),
    component_id (least vec_id reachable by links, itself included), kept (vec_id = component_id).

    Rows link when their labels are equal and not null and the cosine is at least ``cosine``. Null, empty and all-zero
    vectors, vectors with null or non-finite components, and vectors of different lengths link with nothing. Repeated
    rows are rows of their own; a null vec_id counts as a link but names no component (null unless another row of it
    has an id). An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9  # rounding must not skip a link
    rows = doubles(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label"), "v")
    able = rows.withColumn("able", usable("v") & F.col("label").isNotNull())
    able = able.withColumn("cls", F.when(F.col("able"), F.xxhash64("label", "v")))
    classes = able.where("able").groupBy("label", "v", "cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    classes = materialize(classes, "vector_classes")
    axes = principal_axes(classes)
    came = vectors.schema["embedding"].dataType
    kind = "<f4" if isinstance(came, T.ArrayType) and isinstance(came.elementType, T.FloatType) else "<f8"  # vectors travel as they came
    placed = classes.select("cls", F.xxhash64("label").alias("label"), "n", "v").mapInPandas(
        partial(_project, axes=axes, eps=eps, kind=kind), "cls long, label long, n long, width int, cells array<int>, p array<double>, x binary"
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "label", "width", "cells", "cls").sortWithinPartitions("label", "width", "cells", "cls")
    blocks = materialize(
        ordered.mapInPandas(
            partial(_intervals, interval=interval),
            "block long, label long, width int, low array<double>, high array<double>, cls array<long>, n array<long>, p binary, x binary",
        ),
        "intervals",
    )
    pairs = meeting_intervals(blocks, eps)
    wanted = pairs.select(F.col("pair_group").alias("g"), F.explode(F.array("block", "block2")).alias("block")).distinct()
    sent = wanted.join(blocks.select("block", "cls", "n", "p", "x"), "block")
    joined = pairs.groupBy("pair_group").cogroup(sent.groupBy("g")).applyInPandas(lambda a, b: _join_group(a, b, eps, cosine, kind), "src long, dst long, links long")
    links = materialize(joined, "vector_links")
    discard(blocks, pairs)
    counts = links.where("src = dst").groupBy("src").agg(F.sum("links").alias("links"))
    labels = star_components(links.where("src <> dst").select("src", "dst"))
    known = classes.select("cls", "first_id", "n").join(counts, F.col("cls") == F.col("src"), "left").join(labels, F.col("cls") == F.col("node"), "left")
    known = known.select("cls", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "cls").alias("root"))
    least = known.groupBy("root").agg(F.min("first_id").alias("component"))
    known = known.join(least, "root").select("cls", "n_links", "component")
    out = able.select("vec_id", "cls").join(known, "cls", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

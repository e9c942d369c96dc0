"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 8).

Nearness is the largest inner product. For building the graph, one more component makes all vectors equally long, so
that near in inner product is near in distance too; searches and results use inner products of the original vectors.

1. *Nodes*: rows with equal vectors are one node; results put its rows (the least ids, enough for any answer) back.
2. *Start*: a few random hyperplane trees deal all nodes into small leaves; near ones within a leaf are the first graph.
   Leaves that come out too large are dealt on.
3. *NN-descent*: entries of the neighbour lists are new until they have been tried. In a round, a node samples some of
   its new entries and of the nodes that newly list it, and introduces all of them to each other and to its old
   neighbours: neighbours of a neighbour (both of which have that node in common) are compared. What beats the last of
   a list enters it, as new. Entries that were not sampled stay new for a later round, so every entry gets its turn.
   Rounds end when they change less than ``settled`` of all entries. A block of nodes (some leaves of the first tree)
   shares the vectors that its nodes need.
4. *Search*: queries, in blocks too, start from their own node, if they have one, and from a fixed number of seed
   nodes, some random and some the longest vectors, and walk greedily: the nodes that neighbour, or list as neighbours,
   the best of those in their list of ``beam`` that have not been expanded are scored, until all have been.

Blocks and leaves are bounded, lists are arrays of fixed length, and each round ends in a written table. Who lists a
node is sampled before it is gathered, and what blocks propose for a node is cut to ``degree`` in two steps, so a node
that very many others list is no hot group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.vectors import doubles, usable
from quillgraph.operators.linalg import numbered
from quillgraph.storage import discard, materialize, measured

LEAF = 256
#: Nodes of a block that are tried at once.
SLICE = 512
#: Bits of a block's name that tell parts of a large leaf apart.
SALT_BITS = 24
#: Bytes of vectors that a block of queries may gather for a step, about, and of scores that it holds at once.
STEP_BYTES = 1 << 28


def _matrix(raw: pd.Series, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1)


def _packed(frames: Iterator[pd.DataFrame], squared: float) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, with the component that makes them equally long: x in double, f in single precision. The graph
    is built on f; searches and scores use x."""
    for frame in frames:
        x = np.array(frame["v"].tolist(), dtype="<f8").reshape(len(frame), -1)
        more = np.sqrt(np.maximum(0.0, squared - (x * x).sum(axis=1)))
        both = np.column_stack((x, more))
        yield pd.DataFrame({"node": frame["node"], "more": more, "x": [row.tobytes() for row in both.astype("<f8")], "f": [row.tobytes() for row in both.astype("<f4")]})


def _leaves(frames: Iterator[pd.DataFrame], trees: int, depth: int, mean: np.ndarray) -> Iterator[pd.DataFrame]:
    """Each node's leaf in each tree: the signs of a few projections, taken at the mean."""
    planes = np.random.Generator(np.random.PCG64(11)).standard_normal((len(mean), trees * depth))
    for frame in frames:
        signs = (_matrix(frame["f"], "<f4") - mean) @ planes > 0 if depth else np.zeros((len(frame), 0), dtype=bool)
        for t in range(trees):
            leaf = signs[:, t * depth : (t + 1) * depth] @ (1 << np.arange(depth)) if depth else np.zeros(len(frame), dtype=np.int64)
            yield pd.DataFrame({"tree": t, "leaf": leaf.astype(np.int64), "node": frame["node"], "f": frame["f"]})


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the best ``k`` scores of each row, best first, ties to smaller ids."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.tile(np.arange(k), (len(scores), 1))
    own = np.take_along_axis(scores, part, axis=1)
    order = np.lexsort((ids[part], -own), axis=1)
    return np.take_along_axis(part, order, axis=1), np.take_along_axis(own, order, axis=1)


def _first_graph(frame: pd.DataFrame, degree: int) -> pd.DataFrame:
    x, ids = _matrix(frame["f"], "<f4"), frame["node"].to_numpy(dtype=np.int64)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    at, own = _nearest(scores, ids, min(degree, max(len(ids) - 1, 1)))
    some = np.isfinite(own)
    return pd.DataFrame({"node": ids, "ids": [ids[a[s]] for a, s in zip(at, some, strict=True)], "scores": [o[s].astype(np.float32) for o, s in zip(own, some, strict=True)]})


def _padded(lists: pd.Series, order: np.ndarray) -> np.ndarray:
    """Places in ``order`` (sorted ids) of the ids in each list, filled up with -1."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    out = np.full((len(sizes), int(sizes.max(initial=0))), -1, dtype=np.int64)
    if sizes.sum():
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.searchsorted(order, np.concatenate([np.asarray(x, dtype=np.int64) for x in lists]))
    return out


_PROPOSED = "node long, block long, ids array<long>, scores array<float>"


def _introduce(nodes: pd.DataFrame, near: pd.DataFrame, degree: int) -> pd.DataFrame:
    """For each node that a block's nodes have among their neighbours: the best ``degree`` of those it was introduced
    to that beat the last of its list. ``nodes``: block, new, old (ids); ``near``: w (id), y (vector), worst (score)."""
    names = ["node", "block", "ids", "scores"]
    if nodes.empty or near.empty:
        return pd.DataFrame([], columns=names, dtype=object)
    near = near.sort_values("w")
    ids, y, worst = near["w"].to_numpy(dtype=np.int64), _matrix(near["y"], "<f4"), near["worst"].to_numpy(dtype=np.float32)
    keys, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.float32)]
    for at in range(0, len(nodes), SLICE):
        own = nodes.iloc[at : at + SLICE]
        new, old = _padded(own["new"], ids), _padded(own["old"], ids)
        all_ = np.hstack((new, old))
        if not new.shape[1]:
            continue
        found = np.matmul(y[new], y[all_].transpose(0, 2, 1))
        a, b = np.broadcast_to(new[:, :, None], found.shape), np.broadcast_to(all_[:, None, :], found.shape)
        for to, other in ((a, b), (b, a)):
            good = (a >= 0) & (b >= 0) & (a != b) & (found > worst[to])
            keys.append(to[good] * len(ids) + other[good])
            scores.append(found[good])
    key, score = np.concatenate(keys), np.concatenate(scores)
    key, first = np.unique(key, return_index=True)
    to, other, score = key // len(ids), key % len(ids), score[first]
    order = np.lexsort((other, -score, to))
    to, other, score = to[order], other[order], score[order]
    begin = np.searchsorted(to, to)
    keep = np.arange(len(to)) - begin < degree
    to, other, score = to[keep], other[keep], score[keep]
    targets, begin = np.unique(to, return_index=True)
    if not len(targets):
        return pd.DataFrame([], columns=names, dtype=object)
    return pd.DataFrame({"node": ids[targets], "block": int(nodes["block"].iloc[0]), "ids": np.split(ids[other], begin[1:]), "scores": np.split(score, begin[1:])}, columns=names)


def _best(ids: list, scores: list, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``degree`` distinct ids of several lists with their scores; of repeated ids the first list's score."""
    all_ids, at = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]), return_index=True)
    marks = np.concatenate([np.asarray(x, dtype=np.float32) for x in scores])[at]
    order = np.lexsort((all_ids, -marks))[:degree]
    return all_ids[order], marks[order]


def _shorten(frames: Iterator[pd.DataFrame], degree: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        both = [_best(i, s, degree) for i, s in zip(frame["ids"], frame["scores"], strict=True)]
        yield pd.DataFrame({"node": frame["node"], "ids": [a for a, _ in both], "scores": [b for _, b in both]})


_GRAPH = "node long, block long, nbrs array<long>, scores array<float>, fresh array<boolean>, changed int"


def _merge(frames: Iterator[pd.DataFrame], degree: int) -> Iterator[pd.DataFrame]:
    """Lists with what was proposed; ``changed``: how many entries are new in the list."""
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            have, flags = np.asarray(row.nbrs, dtype=np.int64), np.asarray(row.fresh, dtype=bool)
            if row.ids is None or not len(row.ids):
                rows.append((row.node, row.block, have, row.scores, flags, 0))
                continue
            ids, marks = _best([have, *row.ids], [row.scores, *row.proposed], degree)
            was = dict(zip(have.tolist(), flags.tolist(), strict=True))
            rows.append((row.node, row.block, ids, marks, np.array([was.get(i, True) for i in ids.tolist()], dtype=bool), sum(i not in was for i in ids.tolist())))
        yield pd.DataFrame(rows, columns=["node", "block", "nbrs", "scores", "fresh", "changed"])


def _split(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``salt``: deals groups of more than ``size`` rows on."""
    counted = rows.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / size).alias("deals"))
    return rows.join(counted, keys).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("deals"))).drop("deals")


def _no(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _round(graph: DataFrame, nodes: DataFrame, turn: int, degree: int, sample: int) -> tuple[DataFrame, dict[str, float]]:
    """One round of NN-descent on a written graph, with the numbers of changed and of all entries."""
    entries = F.arrays_zip("nbrs", "fresh")
    drawn = F.transform(F.filter(entries, lambda e: e["fresh"]), lambda e: F.struct(F.xxhash64(F.col("node"), e["nbrs"], F.lit(turn)).alias("h"), e["nbrs"].alias("w")))
    drawn = F.transform(F.slice(F.array_sort(drawn), 1, sample), lambda e: e["w"])
    tried = graph.withColumn("new", drawn)
    old = F.transform(F.filter(entries, lambda e: ~e["fresh"]), lambda e: e["nbrs"])
    lists = tried.select("node", "block", "new", old.alias("old"))
    # who lists a node, as many of each kind as it samples itself
    back = lists.select(F.col("node").alias("by"), F.explode(F.concat(F.transform("new", lambda w: F.struct(w.alias("w"), F.lit(True).alias("new"))), F.transform("old", lambda w: F.struct(w.alias("w"), F.lit(False).alias("new"))))).alias("e"))
    back = back.select(F.col("e.w").alias("node"), "by", F.col("e.new").alias("is_new"))
    place = F.row_number().over(Window.partitionBy("node", "is_new").orderBy(F.xxhash64("by", "node", F.lit(turn)), "by"))
    back = back.withColumn("place", place).where(F.col("place") <= sample).groupBy("node")
    back = back.agg(F.collect_list(F.when(F.col("is_new"), F.col("by"))).alias("more_new"), F.collect_list(F.when(~F.col("is_new"), F.col("by"))).alias("more_old"))
    met = lists.join(back, "node", "left")
    new = F.array_distinct(F.concat("new", F.coalesce("more_new", _no("long"))))
    met = met.withColumn("new", new).withColumn("old", F.array_except(F.concat("old", F.coalesce("more_old", _no("long"))), F.col("new")))
    met = materialize(met.where(F.size("new") > 0).select("block", "new", "old"), "introductions")
    worst = F.when(F.size("scores") >= degree, F.element_at("scores", -1)).otherwise(F.lit(float("-inf")).cast("float"))
    known = nodes.select(F.col("node").alias("w"), F.col("f").alias("y")).join(graph.select(F.col("node").alias("w"), worst.alias("worst")), "w")
    near = met.select(F.col("block").alias("b"), F.explode(F.concat("new", "old")).alias("w")).distinct().join(known, "w")
    proposed = met.groupBy("block").cogroup(near.groupBy("b")).applyInPandas(lambda a, b: _introduce(a, b, degree), _PROPOSED)
    # cut to ``degree`` in two steps, so that no node gathers the proposals of all blocks at once
    part = F.xxhash64("node", F.pmod(F.xxhash64("block"), F.lit(64)))
    few = proposed.groupBy("node", part.alias("part")).agg(F.flatten(F.collect_list("ids")).alias("ids"), F.flatten(F.collect_list("scores")).alias("scores"))
    few = few.select("node", F.array("ids").alias("ids"), F.array("scores").alias("scores")).mapInPandas(partial(_shorten, degree=degree), "node long, ids array<long>, scores array<float>")
    few = few.groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("proposed"))
    used = F.transform(entries, lambda e: e["fresh"] & ~F.array_contains(F.col("new"), e["nbrs"]))
    after = tried.withColumn("fresh", used).select("node", "block", "nbrs", "scores", "fresh").join(few, "node", "left")
    out = measured(after.mapInPandas(partial(_merge, degree=degree), _GRAPH), "graph", changed=F.sum("changed"), size=F.sum(F.size("nbrs")))
    discard(met)
    return out


def build_graph(nodes: DataFrame, degree: int = 24, trees: int = 4, settled: float = 0.002, sample: int = 12, max_rounds: int = 60) -> DataFrame:
    """(node, block, nbrs array<long>, ...): a written neighbour graph of ``nodes`` (node, f), which must be written too.
    Rounds go on until one changes at most ``settled`` of the entries; more than ``max_rounds`` of them raise."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF))) if n > LEAF else 0

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"s": [_matrix(frame["f"], "<f4").sum(axis=0, dtype=np.float64)]})

    total = nodes.select("f").mapInPandas(sums, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    mean = np.array([r["s"] for r in total.orderBy("k").collect()]) / max(n, 1)  # as many numbers as a vector has
    leaves = nodes.mapInPandas(partial(_leaves, trees=trees, depth=depth, mean=mean), "tree int, leaf long, node long, f binary")
    # one hashed key, so that the parts of a large leaf are dealt to different tasks
    leaves = _split(leaves, ["tree", "leaf"], LEAF).withColumn("part", F.xxhash64("tree", "leaf", "salt"))
    first = leaves.select("part", "node", "f").groupBy("part").applyInPandas(lambda frame: _first_graph(frame, degree), "node long, ids array<long>, scores array<float>")
    lists = first.groupBy("node").agg(F.collect_list("ids").alias("ids"), F.collect_list("scores").alias("scores"))  # a row a tree
    best = lists.mapInPandas(partial(_shorten, degree=degree), "node long, ids array<long>, scores array<float>")
    # four neighbouring leaves share a block, and so the vectors that they gather; blocks are named in order of leaves
    blocks = leaves.where("tree = 0").select("node", (F.shiftleft(F.shiftright("leaf", 2), SALT_BITS) + F.pmod("salt", F.lit(1 << SALT_BITS))).alias("block"))
    nbrs, scores = F.coalesce("ids", _no("long")), F.coalesce("scores", _no("float"))
    start = blocks.join(best, "node", "left").select("node", "block", nbrs.alias("nbrs"), scores.alias("scores"))
    graph = materialize(start.withColumns({"fresh": F.transform("nbrs", lambda w: F.lit(True)), "changed": F.lit(0)}), "graph")
    for turn in range(max_rounds):
        before, (graph, seen) = graph, _round(graph, nodes, turn, degree, sample)
        discard(before)
        if seen["changed"] <= settled * seen["size"]:
            return graph
    raise RuntimeError(f"the neighbour graph did not settle in {max_rounds} rounds")


def _candidates(q: np.ndarray, near: pd.DataFrame, beam: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``beam`` best of ``near`` for each row of ``q``, taken in slices. What a slice's product selects
    is scored anew, one row at a time in a fixed order of sums, so a pair's score doesn't depend on the block that it is in."""
    step = max(beam, STEP_BYTES // (8 * max(len(q), 1)))
    ids, marks = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))
    for begin in range(0, len(near), step):
        own = near.iloc[begin : begin + step]
        w, y = own["w"].to_numpy(dtype=np.int64), _matrix(own["y"])[:, :width]
        at, _ = _nearest(q @ y.T, w, beam)
        exact = np.stack([(y[a] * x).sum(axis=1) for a, x in zip(at, q, strict=True)])
        ids, marks = np.hstack((ids, w[at])), np.hstack((marks, exact))
        order = np.lexsort((ids, -marks), axis=1)[:, :beam]
        ids, marks = np.take_along_axis(ids, order, axis=1), np.take_along_axis(marks, order, axis=1)
    return ids, marks


def _walk(lists: pd.DataFrame, near: pd.DataFrame, beam: int, width: int, expand: int) -> pd.DataFrame:
    """Score a block's new candidates for its queries and keep the best of each list. ``fresh``: those that have not been
    expanded; ``next``: the best ``expand`` of them, to be expanded in the next step."""
    lists = lists.sort_values("query")
    rows = []
    found, best = _candidates(_matrix(lists["q"]), near.drop_duplicates("w"), beam, width)
    for k, row in enumerate(lists.itertuples(index=False)):
        have, known = np.asarray(row.ids, dtype=np.int64), np.asarray(row.scores, dtype=np.float64)
        new = ~np.isin(found[k], have)
        ids, marks = np.concatenate((have, found[k][new])), np.concatenate((known, best[k][new]))
        waits = np.setdiff1d(np.asarray(row.fresh, dtype=np.int64), np.asarray(row.next, dtype=np.int64))
        fresh = np.concatenate((np.isin(have, waits), np.ones(int(new.sum()), dtype=bool)))
        order = np.lexsort((ids, -marks))[:beam]
        ids, marks, open_ = ids[order], marks[order], ids[order][fresh[order]]
        rows.append((row.query, row.block, row.q, ids, marks, open_, open_[:expand]))
    return pd.DataFrame(rows, columns=["query", "block", "q", "ids", "scores", "fresh", "next"])


def _apart(near: DataFrame) -> DataFrame:
    """The same rows under columns of their own, for a cogroup of tables with a common source."""
    return near.select(F.col("block").alias("b"), F.col("w").alias("v"), F.col("y").alias("z")).toDF("block", "w", "y")


_LISTS = "query long, block long, q binary, ids array<long>, scores array<double>, fresh array<long>, next array<long>"


def _both_ways(graph: DataFrame, most: int = 48) -> DataFrame:
    """(node, nbrs): a node's neighbours, and the ``most`` nearest of those that list it: some that are nobody's
    neighbour can only be reached that way."""
    back = graph.select(F.col("node").alias("by"), F.explode(F.arrays_zip("nbrs", "scores")).alias("e")).select(F.col("e.nbrs").alias("node"), "by", F.col("e.scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "by"))
    back = back.withColumn("place", place).where(F.col("place") <= most).groupBy("node").agg(F.collect_list("by").alias("by"))
    return graph.select("node", "nbrs").join(back, "node", "left").select("node", F.array_union("nbrs", F.coalesce("by", _no("long"))).alias("nbrs"))


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, beam: int = 64, seeds: int = 256, max_rounds: int = 200) -> DataFrame:
    """Greedy graph search: a written table query, ids, scores (best first, at most ``beam``).

    ``queries``: query (unique), node (its own node, or null), q (vector as bytes). In a step, each query expands its best
    entries that it has not expanded, as many as keep a block's vectors within about ``STEP_BYTES``. The walk ends when
    every entry of every list is expanded; more than ``max_rounds`` steps raise.
    """
    width = (len(nodes.first()["x"]) if not nodes.isEmpty() else 8) // 8 - 1
    most_back = 48
    links = materialize(_both_ways(graph, most_back), "links").withColumnRenamed("node", "w")
    longest_list = graph.agg(F.max(F.size("nbrs"))).first()[0] or 0
    expand = max(1, STEP_BYTES // (LEAF * (longest_list + most_back) * 8 * (width + 1)))
    at = queries.join(graph.select("node", F.col("block").alias("at")), "node", "left")
    # neighbouring leaves share a block of about LEAF queries: a block's name without its last bits
    groups = max(1, graph.select("block").distinct().count())
    merged = max(0, math.floor(math.log2(max(1.0, LEAF * groups / max(queries.count(), 1)))))
    sized = at.withColumn("leaf", F.coalesce(F.shiftright("at", SALT_BITS + merged), F.lit(-1).cast("long")))
    sized = _split(sized.withColumnsRenamed({"node": "own", "query": "node"}), ["leaf"], LEAF).withColumnRenamed("node", "query")
    empty = {"ids": _no("long"), "scores": _no("double"), "fresh": _no("long"), "next": _no("long")}
    start = materialize(sized.withColumn("block", F.xxhash64("leaf", "salt")), "queries")
    lists = start.select("query", "block", "q").withColumns(empty)
    longest = nodes.select("node", "more").orderBy("more", "node").limit(seeds).select("node")
    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(seeds).union(longest).distinct()
    near = start.select("block", F.col("own").alias("w")).where("w is not null").distinct()
    near = near.join(links, "w").select("block", F.explode(F.concat(F.array("w"), "nbrs")).alias("w"))
    # every block meets the fixed number of seeds
    near = near.unionByName(start.select("block").distinct().join(F.broadcast(entries.select(F.collect_list("node").alias("all"))), F.lit(True)).select("block", F.explode("all").alias("w")))
    vectors = nodes.select(F.col("node").alias("w"), F.col("x").alias("y"))
    for turn in range(max_rounds):
        candidates = near.distinct().join(vectors, "w")
        walked = lists.groupBy("block").cogroup(_apart(candidates).groupBy("block")).applyInPandas(lambda a, b: _walk(a, b, beam, width, expand), _LISTS)
        before, (lists, seen) = lists, measured(walked, "lists", open=F.sum(F.size("next")))
        if turn:
            discard(before)
        if not seen["open"]:
            break
        near = lists.select("block", F.explode("next").alias("w")).distinct().join(links, "w").select("block", F.explode("nbrs").alias("w"))
    else:
        raise RuntimeError(f"the walk did not end in {max_rounds} steps")
    discard(start, links)
    return lists.select("query", "ids", "scores")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, degree: int = 24, trees: int = 4, beam: int = 64) -> DataFrame:
    """The ``k`` nearest found of every row of ``vectors`` (vec_id, embedding) that satisfies ``is_query``, among all
    rows but itself: query_id, rank (from 1), vec_id, score (inner product, in double precision).

    Nearest first, ties to the smaller vec_id; with fewer candidates, all of them. Null and all-zero vectors, vectors
    with null or non-finite components, and rows with a null vec_id take no part. Vectors of different lengths have no
    inner product: each length is a table of its own. A vec_id that repeats takes part once for each different vector.
    An empty table gives no rows; other columns are ignored.
    """
    rows = doubles(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), is_query.alias("asks")), "v")
    rows = rows.where(usable("v") & F.col("vec_id").isNotNull())
    lengths = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]
    found = [_nearest_of_length(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, k, degree, trees, beam) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)


def _nearest_of_length(rows: DataFrame, k: int, degree: int, trees: int, beam: int) -> DataFrame:
    # equal vectors: the least id stands for all, the k + 1 least are kept
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.select("v", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    members = kept.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.array_sort(F.collect_set("vec_id")).alias("members"))
    # nodes are numbered in order of their least ids, which may repeat
    groups = materialize(numbered(members, "first_id", "v").withColumnRenamed("new", "node"), "nodes")
    longest = groups.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] or 0.0
    nodes = materialize(groups.select("node", "v").mapInPandas(partial(_packed, squared=longest), "node long, more double, x binary, f binary"), "node_vectors")
    graph = build_graph(nodes, degree, trees)
    asked = materialize(rows.where("asks").select("vec_id", "v").distinct().join(groups.select("v", "node"), "v").select("node", F.col("vec_id").alias("query_id")), "asked")
    width = F.octet_length("x") - 8
    queries = asked.select("node").distinct().join(nodes.select("node", "x"), "node").select(F.col("node").alias("query"), "node", F.substring("x", F.lit(1), width).alias("q"))
    found = search(graph, nodes, queries, max(beam, k + 1))
    hits = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query", F.col("h.ids").alias("node"), F.col("h.scores").alias("score"))
    rows_of = hits.join(groups.select("node", "members"), "node").select("query", F.explode(F.transform("members", lambda m: F.struct((-F.col("score")).alias("d"), m.alias("vec_id")))).alias("a"))
    # the best k + 1 of a node, for all rows that ask with its vector; those of a very common vector are dealt on
    place = F.row_number().over(Window.partitionBy("query").orderBy("a"))
    lists = rows_of.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list("a")).alias("best"))
    deals = asked.groupBy("node").agg(F.ceil(F.count("*") / 4096).cast("int").alias("deals"))
    lists = lists.join(deals.withColumnRenamed("node", "query"), "query").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    salted = asked.join(deals, "node").select("query_id", F.xxhash64("node", F.pmod(F.xxhash64("query_id"), F.col("deals")).cast("int")).alias("key"), F.col("node").alias("query"))
    answers = salted.join(lists.select("query", F.xxhash64("query", "salt").alias("key"), "best"), ["key", "query"])
    # a query_id with several vectors gets the best of all of them
    own = F.slice(F.filter("best", lambda a: a["vec_id"] != F.col("query_id")), 1, k)
    flat = answers.select("query_id", F.explode(own).alias("a"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("a"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("a.vec_id").alias("vec_id"), (-F.col("a.d")).alias("score"))

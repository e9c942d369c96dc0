"""Approximate neighbours against brute force, on a table large enough for many leaves, blocks and rounds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import neighbours


def exact(rows, queries, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=np.float64)
    for q in queries:
        scores = x @ x[q]
        scores[ids == ids[q]] = -np.inf
        order = np.lexsort((ids, -scores))[: min(k, int((ids != ids[q]).sum()))]
        yield int(ids[q]), ids[order], scores[order]


def test_recall_on_many_vectors(spark):
    """Clusters, a third of all vectors in one tight cluster, many copies of one vector."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((200, 24))
    x = centres[rng.integers(0, 200, 20_000)] + 0.5 * rng.standard_normal((20_000, 24))
    x[:6_600] = centres[0] + 0.05 * rng.standard_normal((6_600, 24))
    x[7_000:7_300] = x[7_000]
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    found = {q: own.sort_values("rank") for q, own in got.groupby("query_id")}
    assert len(found) == 1000 and len(got) == 20_000
    hits = np.zeros(20_000)
    for query, ids, scores in exact(list(zip(range(20_000), x, strict=True)), range(0, 20_000, 20)):
        own = found[query]
        assert own["rank"].tolist() == list(range(1, 21)) and query not in set(own["vec_id"])
        assert np.allclose(own["score"], x[own["vec_id"]] @ x[query], rtol=1e-12, atol=1e-12)
        marks = list(zip(-own["score"], own["vec_id"], strict=True))
        assert marks == sorted(marks) and own["vec_id"].is_unique
        hits[query] = (own["score"].to_numpy() >= scores[-1] - 1e-9).mean()
    hits = hits[::20]
    assert hits.mean() >= 0.95 and hits[:330].mean() >= 0.9 and hits[330:].mean() >= 0.9


def test_rules_of_small_tables(spark):
    """Ties, repeated rows, a vec_id with two vectors, lengths apart, rows that take no part, clashing columns."""
    rows = [(k, [1.0, 0.0]) for k in (5, 40, 3, 20, 7)] + [(60, [0.0, 2.0]), (60, [0.0, 2.0]), (60, [0.5, 0.5]), (80, [1.0, 1.0, 1.0]), (9, [2.0, 0.0, 0.0])]
    rows += [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (None, [1.0, 1.0]), (160, []), (180, [1.0, None])]
    table = spark.createDataFrame([(v, e, 0, 0) for v, e in rows], "vec_id long, embedding array<double>, rank int, node int")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    got = {q: [(v, s) for _, v, s in sorted(own)] for q, own in got.items()}
    assert set(got) == {20, 40, 60, 80}
    assert got[20] == [(3, 1.0), (5, 1.0), (7, 1.0)] and got[40] == [(3, 1.0), (5, 1.0), (7, 1.0)]
    assert got[80] == [(9, 2.0)]
    assert [v for v, _ in got[60]][:3] == [3, 5, 7]
    assert neighbours.nearest(table.where("false"), F.lit(True)).count() == 0


def test_not_settled_raises(spark):
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(k, [float(v) for v in rng.standard_normal(6)]) for k in range(600)], "node long, v array<double>")
    packed = table.mapInPandas(lambda frames: neighbours._packed(frames, 60.0), "node long, more double, x binary, f binary").cache()
    with pytest.raises(RuntimeError):
        neighbours.build_graph(packed, degree=4, trees=1, settled=-1.0, max_rounds=2)

"""Every query of the graph engine against its SQL, and the solver on graphs of its own."""

import pytest
from conftest import duck, rows_of

from quillgraph.functions.convergence import measure
from quillgraph.operators import aggregation, elimination, graph, linalg
from quillgraph.operators.components import star_components
from quillgraph.oracles import ORACLES
from quillgraph.queries import QUERIES
from quillgraph.sources import matrices

SF = "/root/testdata/sf0.001"


def adjacency(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges] + [(b, a, float(w)) for a, b, w in edges], "i long, j long, w double")


#: Iterations that SQL does not express; other tests hold them against dense versions.
ITERATIVE = {"kcycle"}


def test_all_have_sql():
    assert set(QUERIES) - ITERATIVE == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck(SF).execute(ORACLES[name]).df())


def test_products_of_whole_tables(spark):
    """All rows of the tables count: the products' totals follow from the rows of each part, and of each customer."""
    con = duck(SF)
    shared = "SELECT sum(n * n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {})"
    pairs = QUERIES["cooccurrence_all"](spark, SF).toPandas()
    assert pairs.v.sum() == con.execute(shared.format("l_partkey")).fetchone()[0] - con.execute(shared.format("l_partkey, l_suppkey")).fetchone()[0]
    squared = QUERIES["spgemm_customer_order"](spark, SF).toPandas()
    assert squared.v.sum() == sum(con.execute(f"SELECT sum(n * n) FROM (SELECT count(*) AS n FROM orders GROUP BY {key})").fetchone()[0] for key in ("o_custkey", "o_orderkey"))


def test_components_and_ties(spark):
    adj = adjacency(spark, [(0, 1, 1), (2, 3, 1), (3, 4, 1), (7, 7, 1)])
    assert {r["i"]: r["label"] for r in graph.connected_components(adj).collect()} == {0: 1, 1: 1, 2: 4, 3: 4, 4: 4, 7: 7}
    tied = graph.largest_component(adjacency(spark, [(0, 1, 2), (2, 3, 1)]))
    assert sorted(map(tuple, tied.collect())) == [(0, 1, 2.0), (1, 0, 2.0)]


def test_components_of_large_stars(spark):
    """Hubs whose edges are dealt on, as least, greatest and middle vertex, and a path through them."""
    stars = [(hub, 10_000 * k + leaf) for k, hub in enumerate((3, 90_001, 25_000)) for leaf in range(3_000) if 10_000 * k + leaf != hub]
    edges = spark.createDataFrame([*stars, (200_000, 200_001), (2_999, 90_001)], "src long, dst long")
    got = {r["node"]: r["label"] for r in star_components(edges, most=512).collect()}
    assert len(got) == 9_004 and {got[k] for k in (3, 0, 2_999, 90_001, 12_999)} == {0} and {got[25_000], got[22_999]} == {20_000} and got[200_001] == 200_000


def test_self_loops_cancel(spark):
    lap = graph.laplacian(spark.createDataFrame([(0, 0, 5.0), (0, 1, 1.0), (1, 0, 1.0)], "i long, j long, w double"))
    assert {(r["i"], r["j"]): r["v"] for r in lap.collect()} == {(0, 0): 1.0, (0, 1): -1.0, (1, 0): -1.0, (1, 1): 1.0}


def test_elimination_is_exact(spark):
    lap = graph.laplacian(adjacency(spark, [(0, 1, 2), (1, 2, 3), (0, 2, 1), (2, 3, 4)]))
    gone = elimination.select(lap)
    assert [r["i"] for r in gone.collect()] == [0]
    coarse = elimination.coarse(lap, elimination.prolongation(lap, gone))
    assert all(abs(r["v"]) < 1e-12 for r in linalg.reduce_rows(coarse).collect())


def test_every_vertex_has_a_root(spark):
    adj = adjacency(spark, [(k, k + 1, 1 + k % 3) for k in range(60)])
    states = aggregation.aggregate(graph.as_matrix(adj), linalg.vertices(graph.as_matrix(adj)), 10)
    assign = {r["i"]: r["agg"] for r in aggregation.restriction(states).collect()}
    assert len(assign) == 61 and set(assign.values()) <= set(assign)


def test_rejections(spark):
    states = spark.createDataFrame([(0, 0, "S", 0.0), (1, 0, "D", 0.0), (2, 0, "D", 0.0), (3, 0, "D", 0.0)], "i long, ind long, state string, votes double")
    tied = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.5), (3, 0, 0.7)], "i long, j long, v double")
    after = {r["i"]: (r["ind"], r["state"]) for r in aggregation.reject_large(states, tied, 2).collect()}
    assert after == {0: (0, "R"), 1: (0, "D"), 2: (2, "U"), 3: (0, "D")}
    adj = adjacency(spark, [(0, 1, 1), (1, 9, 5)])
    loose = aggregation.reject_loose(spark.createDataFrame([(0, 0, "S", 0.0), (1, 0, "D", 0.0), (9, 9, "S", 0.0)], "i long, ind long, state string, votes double"), adj, 2.0)
    assert {r["i"]: r["state"] for r in loose.collect()} == {0: "S", 1: "U", 9: "S"}


def parts_of(path):
    """The lines of a folder of part files, in order of their names."""
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_files(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate integer symmetric\n% note\n3 3 3\n1 1 2\n2 1 -1\n3 3 4\n")
    a = matrices.read_matrix_market(spark, str(tmp_path / "a.mtx"))
    assert sorted(map(tuple, a.collect())) == [(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (2, 2, 4.0)]
    matrices.write_matrix_market(a, str(tmp_path / "b"), 3)
    assert parts_of(tmp_path / "b") == ["%%MatrixMarket matrix coordinate real general", "3 3 4", "1 1 2.0", "2 1 -1.0", "1 2 -1.0", "3 3 4.0"]
    assert sorted(map(tuple, matrices.read_matrix_market(spark, str(tmp_path / "b")).collect())) == sorted(map(tuple, a.collect()))
    (tmp_path / "v.txt").write_text("2\n0.5\n1.5\n")
    assert sorted(map(tuple, matrices.read_vector(spark, str(tmp_path / "v.txt")).collect())) == [(0, 0.5), (1, 1.5)]
    x = spark.range(1000).selectExpr("id AS i", "id / 8.0D AS v")
    matrices.write_vector(x, str(tmp_path / "x"))
    assert parts_of(tmp_path / "x")[:3] == ["1000", "0.0", "0.125"]
    assert sorted(map(tuple, matrices.read_vector(spark, str(tmp_path / "x")).collect())) == [(k, k / 8) for k in range(1000)]
    matrices.write_vector(x, str(tmp_path / "plain"), length=False)
    assert len(parts_of(tmp_path / "plain")) == 1000
    (tmp_path / "short.txt").write_text("3 1 2")
    with pytest.raises(ValueError):
        matrices.read_vector(spark, str(tmp_path / "short.txt"))


def test_binary_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(matrices.vector_bytes([1.0, -2.0]))
    x = matrices.read_binary_vector(spark, str(tmp_path / "v.bin"))
    assert sorted(map(tuple, x.collect())) == [(0, 1.0), (1, -2.0)]
    assert matrices.binary_vector(x).first()["content"] == (tmp_path / "v.bin").read_bytes()
    a = spark.createDataFrame([(0, 0, 2.0), (2, 1, -1.5), (0, 2, 0.25)], "i long, j long, v double")
    matrices.write_binary(matrices.binary_matrix(a, 3), str(tmp_path / "a.bin"))
    raw = (tmp_path / "a.bin").read_bytes()
    assert raw[:16] == bytes.fromhex("00127b50") + bytes([0, 0, 0, 3] * 3) and len(raw) == 16 + 12 + 36
    assert sorted(map(tuple, matrices.read_binary_matrix(spark, str(tmp_path / "a.bin")).collect())) == sorted(map(tuple, a.collect()))


def test_adjacency_and_catalog(spark, tmp_path):
    lap = graph.laplacian(adjacency(spark, [(0, 1, 2), (1, 2, 3), (0, 2, 1), (2, 3, 4)]))
    matrices.write_adjacency(lap, str(tmp_path / "g"))
    assert parts_of(tmp_path / "g") == ["4 4", "2 3", "1 3", "1 2 4", "3"]
    (tmp_path / "c.csv").write_text("2\n01-Jan-2020\nA,one,3,3,7,1,0,0,1,1.0,0.5,graph\nB,two,4,4,9,0,1,1,0,0.5,0.5,mesh\n")
    rows = matrices.read_catalog(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [(r["id"], r["name"], r["rows"], r["real"], r["posdef"], r["kind"]) for r in rows] == [(1, "one", 3, True, True, "graph"), (2, "two", 4, False, False, "mesh")]
    assert [r["name"] for r in graph.of_kinds(matrices.read_catalog(spark, str(tmp_path / "c.csv")), "kind", ["mesh"]).collect()] == ["two"]


def test_convergence_figures():
    found = measure([1.0, 0.1, 0.01], 2.0, 0.0, 0.0, 10)
    assert found.iters == 2 and abs(found.wda - 2.0) < 1e-9

"""The solver and its parts against dense versions, on small graphs."""

import math

import numpy as np
import pytest

from quillgraph import graphs
from quillgraph.operators import aggregation, elimination, graph, linalg, smoothers, strength
from quillgraph.plans import hierarchy
from quillgraph.plans.eigen import largest_pairs, smallest_pairs
from quillgraph.plans.krylov import METHODS, conjugate_gradients, jacobi_preconditioner, no_preconditioner
from quillgraph.plans.options import Options
from quillgraph.plans.solver import Solver, sweep, time_products
from quillgraph.storage import materialize

SIDE = 6


def grid_edges():
    across = [(r * SIDE + c, r * SIDE + c + 1, 1 + (r + c) % 2) for r in range(SIDE) for c in range(SIDE - 1)]
    return across + [(r * SIDE + c, (r + 1) * SIDE + c, 1) for r in range(SIDE - 1) for c in range(SIDE)] + [(k, SIDE * SIDE + k, 2) for k in range(0, 9, 3)]


@pytest.fixture(scope="module")
def grid(spark):
    edges = [(a, b, float(w)) for a, b, w in grid_edges()]
    names = {v: k for k, v in enumerate(sorted({v for a, b, _ in edges for v in (a, b)}))}
    both = [(names[a], names[b], w) for a, b, w in edges] + [(names[b], names[a], w) for a, b, w in edges]
    lap = materialize(graph.laplacian(spark.createDataFrame(both, "i long, j long, w double")), "grid")
    dense = np.zeros((len(names),) * 2)
    for r in lap.collect():
        dense[r["i"], r["j"]] = r["v"]
    return lap, dense


def vector(spark, values):
    return materialize(spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i long, v double"), "vector")


def values(x, n):
    out = np.zeros(n)
    for r in x.collect():
        out[r["i"]] = r["v"]
    return out


@pytest.mark.parametrize(
    "options",
    [
        Options(min_size=50, coarse_vertices=12),
        Options(min_size=50, coarse_vertices=20, broadcast_vertices=15, kcycle=True, smoother="jacobi", always_elim=False, strength="none"),
        Options(min_size=50, coarse_vertices=20, tol=1e-7, outer="fgmres", elim_iters=2, top_elim=False, neighbor_of_neighbor=True, constant_correction=True),
    ],
)
def test_solve_is_the_dense_solution(spark, grid, options):
    lap, dense = grid
    b = np.random.default_rng(1).standard_normal(len(dense))
    b -= b.mean()
    solver = Solver(lap, options)
    got = values(solver.solve(vector(spark, b)), len(dense))
    want = np.linalg.pinv(dense) @ b
    assert np.abs(got - want).max() < 1e-5 * np.abs(want).max()
    kinds = [r["kind"] for r in solver.report().orderBy("level").collect()]
    assert kinds[-1] == "coarse" and "agg" in kinds
    assert solver.convergence.iters >= 1 and math.isfinite(solver.convergence.wda) and solver.convergence.rel_error <= options.tol


def test_cycles_are_the_dense_ones(spark, grid):
    """V- and K-cycle with Jacobi sweeps over two aggregation levels."""
    lap, dense = grid
    n = len(dense)
    maps = [np.arange(n) % 12, np.arange(12) % 6]
    mats = [dense]
    for m in maps:
        r = np.zeros((m.max() + 1, len(m)))
        r[m, np.arange(len(m))] = 1
        mats.append(r @ mats[-1] @ r.T)

    def sweep(a, x, b):
        d = np.diag(a)
        off = np.where(a < 0, a, 0)
        return 2 / 3 * (b - off @ x) / d + x / 3

    def flexible(a, b, k):
        x, r, p, ap, last, before = np.zeros(len(b)), b - b.mean(), 0, 0, None, 0
        for _ in range(2):
            z = cycle(r, k, True)
            beta = 0 if last is None else (r - before) @ z / last
            last = r @ z
            p = z + beta * p
            ap = a @ p
            alpha = last / (p @ ap)
            x, before, r = x + alpha * p, r, r - alpha * ap
        return x

    def cycle(b, k, kcycle):
        a = mats[k]
        if k == 2:
            return np.linalg.pinv(a) @ b
        x = sweep(a, np.zeros(len(b)), b)
        rest = np.bincount(maps[k], weights=b - a @ x)
        inner = flexible(mats[k + 1], rest, k + 1) if kcycle and k == 0 else cycle(rest, k + 1, kcycle)
        return sweep(a, x + inner[maps[k]], b)

    levels, now = [], hierarchy.Counted(lap)
    for m in maps:
        assign = materialize(spark.createDataFrame([(int(i), int(a)) for i, a in enumerate(m)], "i long, agg long"), "assign")
        levels.append(hierarchy.Aggregation(now.matrix, now.size, now.nnz, assign=assign))
        now = hierarchy.Counted(linalg.galerkin_of_map(assign, now.matrix))
    levels.append(hierarchy.coarse_level(now.matrix))
    b = np.random.default_rng(2).standard_normal(n)
    b -= b.mean()
    for kcycle in (False, True):
        got = values(hierarchy.cycle(levels, vector(spark, b), Options(smoother="jacobi", kcycle=kcycle)), n)
        assert np.abs(got - cycle(b, 0, kcycle)).max() < 1e-9
    few, many = (hierarchy.coarse_level(now.matrix, Options(coarse_vertices=k)) for k in (6, 5))
    rest = vector(spark, np.array([1.0, -2, 3, -4, 2.5, -0.5]))
    one, other = (values(level.apply([level], rest, Options(), 0), 6) for level in (few, many))
    assert few.inverse is not None and many.inverse is None and np.abs((one - one.mean()) - (other - other.mean())).max() < 1e-8


@pytest.mark.parametrize("method", sorted(METHODS))
def test_outer_methods(spark, grid, method):
    lap, dense = grid
    b = np.random.default_rng(3).standard_normal(len(dense))
    found = METHODS[method](lap, vector(spark, b), jacobi_preconditioner(lap), 1e-6, 200)
    want = np.linalg.pinv(dense) @ (b - b.mean())
    got = values(found.x, len(dense))
    assert np.abs((got - got.mean()) - want).max() < 1e-4 and found.residuals[-1] <= 1e-6 * found.residuals[0]


def test_products_of_large_levels_leave_the_matrix_in_place(spark, grid):
    """Where vectors are too long to broadcast, a product shuffles the vector by column and the sums by row, no more."""
    lap, dense = grid
    level = hierarchy.Counted(lap, 10)
    x = vector(spark, np.arange(len(dense)))
    product = smoothers.with_product(level.matrix, x)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = product._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan
        got = {r["i"]: r["av"] for r in product.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert np.allclose([got[k] for k in range(len(dense))], dense @ np.arange(len(dense)))


def test_zero_and_single_right_hand_sides(spark, grid):
    lap, dense = grid
    zero = conjugate_gradients(lap, vector(spark, np.zeros(len(dense))), no_preconditioner)
    assert zero.iters == 0 and not values(zero.x, len(dense)).any()


def test_eigenpairs(spark, grid):
    lap, dense = grid
    want = np.linalg.eigvalsh(dense)
    low = smallest_pairs(lap, 1, Options(min_size=10**9), tol=1e-6)
    high = largest_pairs(lap, 2)
    assert np.allclose(low.values, want[1:2], rtol=1e-4) and np.allclose(high.values, want[::-1][:2], rtol=1e-4)
    rows = high.long().where("k = 0").collect()
    x = np.zeros(len(dense))
    for r in rows:
        x[r["i"]] = r["v"]
    assert np.abs(dense @ x - high.values[0] * x).max() < 1e-2 and abs(np.linalg.norm(x) - 1) < 1e-6


def test_composed_eliminations_are_exact(spark, grid):
    """P xc + Q b solves L x = b where xc solves what two eliminations leave."""
    lap, dense = grid
    p, q, left, _ = hierarchy.eliminate(hierarchy.Counted(lap), Options(elim_iters=2, elim_factor=1.0))
    b = np.random.default_rng(4).standard_normal(len(dense))
    b -= b.mean()
    kept = sorted(r["i"] for r in linalg.vertices(left.matrix).collect())
    small = np.zeros((len(kept),) * 2)
    for r in left.matrix.collect():
        small[kept.index(r["i"]), kept.index(r["j"])] = r["v"]
    rest = values(linalg.spmv(linalg.transpose(p), vector(spark, b)), len(dense))[kept]
    inner = spark.createDataFrame([(k, float(v)) for k, v in zip(kept, np.linalg.pinv(small) @ rest, strict=True)], "i long, v double")
    x = values(elimination.extend(p, q, inner, vector(spark, b)), len(dense))
    assert len(kept) < left.size + 1 == len(kept) + 1 and np.abs(dense @ x - b).max() < 1e-8


def test_basis_is_orthonormal(spark):
    assign = spark.createDataFrame([(10, 1), (11, 1), (15, 1), (20, 2), (30, 3), (31, 3)], "i long, agg long")
    columns = {}
    for r in smoothers.orthogonal_basis(assign).collect():
        columns.setdefault((r["agg"], r["k"]), {})[r["i"]] = r["v"]
    assert set(columns) == {(1, 1), (1, 2), (3, 1)}
    for a, x in columns.items():
        assert abs(sum(x.values())) < 1e-12
        for b, y in columns.items():
            assert abs(sum(v * y.get(i, 0) for i, v in x.items()) - (a == b)) < 1e-12


def test_followed_across_partitions(spark):
    rows = spark.createDataFrame([(k % 3 if k > 40 else 7, k, k * 10) for k in range(60)], "g long, at long, x long")
    got = {(r["g"], r["at"]): r["after"] for r in linalg.followed(rows, "g", ["at"], "x", "after").collect()}
    for group in (0, 1, 2, 7):
        own = sorted(at for g, at in got if g == group)
        assert [got[group, at] for at in own] == [at * 10 for at in own[1:]] + [None]


def test_random_order_and_bad_options(spark):
    got = sorted((r["i"], r["new"]) for r in linalg.random_order(spark.range(20).withColumnRenamed("id", "i"), 3).collect())
    assert sorted(new for _, new in got) == list(range(20)) and [new for _, new in got] != list(range(20))
    for wrong in ({"strength": "x"}, {"scaling": "x"}, {"smoother": "x"}, {"outer": "x"}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_neighbours_of_neighbours_may_be_joined(spark):
    """On a path, seeds alone leave more aggregates than chains of joiners do."""
    edges = [(k, k + 1) for k in range(40)]
    adj = spark.createDataFrame([(a, b, 1.0 + (a * 7 % 5)) for a, b in edges] + [(b, a, 1.0 + (a * 7 % 5)) for a, b in edges], "i long, j long, v double")
    tied = materialize(strength.scale(adj, "max"), "tied")
    count = lambda spread: aggregation.restriction(aggregation.aggregate(tied, linalg.vertices(tied), 10, spread=spread)).select("agg").distinct().count()
    assert count(True) <= count(False)


def test_sweep_and_timing(spark, grid):
    lap, dense = grid
    b = linalg.orthogonalize(graphs.hashed_vector(linalg.vertices(lap)))
    rows = sweep(lap, b, "grid", Options(min_size=10**9), smoother=["jacobi"], outer=["cg", "fcg"]).collect()
    assert [(r["smoother"], r["outer"], r["graph"]) for r in rows] == [("jacobi", "cg", "grid"), ("jacobi", "fcg", "grid")]
    assert time_products(lap, b, True, 1, 2) > 0


def test_dump_and_record(spark, grid, tmp_path):
    lap, dense = grid
    solver = Solver(lap, Options(min_size=10**9))
    b = linalg.orthogonalize(graphs.hashed_vector(linalg.vertices(lap)))
    solver.solve(b)
    solver.dump(f"{tmp_path}/dump")
    assert spark.read.parquet(f"{tmp_path}/dump/level=0/A").count() == solver.levels[0].nnz
    for name in ("one", "two"):
        solver.write_csv(name, f"{tmp_path}/csv")
    read = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert {r["graph"] for r in read.collect()} == {"one", "two"} and {"smoother", "outer", "wda", "setup_time", "option_iters", "iters"} <= set(read.columns)
    found = largest_pairs(lap, 1)
    found.write(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs/vectors").count() == len(dense)
    assert spark.read.parquet(f"{tmp_path}/pairs/values").first()["eigenvalue"] == found.values[0]

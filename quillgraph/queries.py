"""Registered queries of the graph engine, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import graphs
from quillgraph import semiring as sr
from quillgraph.graphs import hashed_value, hashed_vector, table
from quillgraph.operators import aggregation, colouring, compatible, dealt, elimination, graph, linalg, smoothers, strength
from quillgraph.operators.packed import pack
from quillgraph.plans import hierarchy
from quillgraph.plans.eigen import Pairs, largest_pairs, smallest_pairs, smoothing_eigenvalue, smoothing_pairs
from quillgraph.plans.hierarchy import largest_eigenvalue, smoothed, smoothed_strength, strengths
from quillgraph.plans.krylov import conjugate_gradients, jacobi_preconditioner, no_preconditioner, pipelined_conjugate_gradients, truncated_conjugate_gradients
from quillgraph.plans.options import Options
from quillgraph.plans.solver import Solver
from quillgraph.storage import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Floating-point columns (``v`` unless named) rounded, without negative zeros."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or ("v",)})


def lap_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.laplacian(graphs.order_part(spark, sf_dir))


def matrix_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.as_matrix(graphs.order_part(spark, sf_dir))


def x_of(a: DataFrame, k: int = 0) -> DataFrame:
    return hashed_vector(linalg.vertices(a), k)


# ---- core


@query
def scan_edges(spark, sf_dir):
    return matrix_of(spark, sf_dir)


@query
def pattern_apply(spark, sf_dir):
    return linalg.apply(lap_of(spark, sf_dir), lambda v: F.when(v != 0, F.lit(1.0)).otherwise(0.0))


@query
def transpose(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_suppkey").alias("j"), F.lit(1.0).alias("v"))
    return linalg.transpose(linalg.from_triples(rows))


@query
def diagonal(spark, sf_dir):
    return linalg.diagonal(lap_of(spark, sf_dir))


@query
def identity_spmv(spark, sf_dir):
    ids = linalg.vertices(matrix_of(spark, sf_dir))
    return shown(linalg.spmv(linalg.identity(ids), hashed_vector(ids)))


@query
def axpy(spark, sf_dir):
    ids = linalg.vertices(matrix_of(spark, sf_dir))
    return shown(linalg.axpy(2.5, hashed_vector(ids), hashed_vector(ids, 1)))


@query
def row_reduce(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    return a.groupBy("i").agg(F.sum("v").alias("total"), F.max("v").alias("most"))


@query
def col_reduce(spark, sf_dir):
    return linalg.reduce_columns(matrix_of(spark, sf_dir), F.max)


@query
def dot(spark, sf_dir):
    ids = linalg.vertices(matrix_of(spark, sf_dir))
    return shown(linalg.dot(hashed_vector(ids), hashed_vector(ids, 1)))


@query
def orthogonalize(spark, sf_dir):
    return shown(linalg.orthogonalize(x_of(matrix_of(spark, sf_dir))))


@query
def ewise_add(spark, sf_dir):
    return linalg.ewise_add(lap_of(spark, sf_dir), matrix_of(spark, sf_dir))


@query
def permute(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    return linalg.permute(a, linalg.vertices(a).select("i", ((F.col("i") * 7 + 3) % 1000003).alias("new")))


@query
def renumber(spark, sf_dir):
    return linalg.renumber(linalg.vertices(matrix_of(spark, sf_dir)))


@query
def remove_zero_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("v"))
    return linalg.remove_zero_rows(linalg.from_triples(rows))


# ---- products


def _product(semiring: sr.Semiring) -> Query:
    return lambda spark, sf_dir: shown(linalg.spmv(lap := lap_of(spark, sf_dir), x_of(lap), semiring))


for _name, _semiring in {"spmv_plus_times": sr.PLUS_TIMES, "spmv_offdiag": sr.OFF_DIAGONAL, "spmv_diag": sr.DIAGONAL, "spmv_inv_diag": sr.INVERSE_DIAGONAL, "spmv_max": sr.MAX}.items():
    QUERIES[_name] = _product(_semiring)


@query
def spmv_min_index(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    return linalg.spmv(lap, linalg.vertices(lap).select("i", F.col("i").alias("v")), sr.MIN_INDEX)


@query
def spmv_collect(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    found = linalg.spmv(a, linalg.vertices(a).select("i", F.col("i").alias("v")), sr.COLLECT)
    return found.select("i", F.array_join(F.col("v").cast("array<string>"), ",").alias("v"))


def _with_hubs(spark, sf_dir) -> DataFrame:
    return dealt.dealt_table(graph.laplacian(graphs.with_status(spark, sf_dir)), 64)


@query
def spmv_hub(spark, sf_dir):
    """A product with hubs, whose columns are dealt."""
    lap = _with_hubs(spark, sf_dir)
    return shown(linalg.spmv(lap, x_of(lap)))


@query
def smooth_hub(spark, sf_dir):
    """Four test vectors after two sweeps on a graph with hubs."""
    lap = _with_hubs(spark, sf_dir)
    vectors = strength.test_vectors(linalg.vertices(lap), 4)
    for _ in range(2):
        vectors = strength.smooth(lap, vectors, 4)
    return shown(vectors.select("i", F.posexplode("xs").alias("k", "v")))


@query
def affinity_hub(spark, sf_dir):
    """Strengths by four test vectors as drawn, on a graph with hubs."""
    lap = _with_hubs(spark, sf_dir)
    return shown(linalg.apply(strength.affinity(lap, strength.test_vectors(linalg.vertices(lap), 4)), _logged))


@query
def cooccurrence_hub(spark, sf_dir):
    """What suppliers share, where all of them sell part 0 beside their own: every pair of them, in blocks of rows."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
    common = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.lit(0).cast("long").alias("j"))
    return graph.cooccurrence(linalg.from_triples(spread(lines.unionByName(common).withColumn("v", F.lit(1.0)), "i", "j")))


@query
def spgemm(spark, sf_dir):
    a = graph.as_matrix(graphs.nation_region(spark, sf_dir))
    return linalg.spgemm(a, a)


@query
def spgemm_customer_order(spark, sf_dir):
    a = graph.as_matrix(graphs.customer_order(spark, sf_dir))
    return linalg.spgemm(a, a)


@query
def residual(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    return shown(linalg.residual(lap, x_of(lap), x_of(lap, 1)))


@query
def residual_norm(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    return shown(linalg.norm(linalg.residual(lap, x_of(lap), x_of(lap, 1))))


# ---- graphs


@query
def laplacian(spark, sf_dir):
    return lap_of(spark, sf_dir)


@query
def degrees(spark, sf_dir):
    return graph.degrees(lap_of(spark, sf_dir))


@query
def weighted_degree(spark, sf_dir):
    return graph.weighted_degree(graphs.order_part(spark, sf_dir))


@query
def symmetrize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return linalg.symmetrize(linalg.from_triples(rows))


@query
def cooccurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(1.0).alias("v"))
    return graph.cooccurrence(linalg.from_triples(spread(rows, "i", "j")))


@query
def cooccurrence_all(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.lit(1.0).alias("v"))
    return graph.cooccurrence(linalg.from_triples(spread(rows, "i", "j")))


@query
def connected_components(spark, sf_dir):
    return graph.connected_components(graphs.customer_order(spark, sf_dir))


@query
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.connected_components(graphs.customer_order(spark, sf_dir)))


@query
def largest_cc(spark, sf_dir):
    return graph.largest_component(graphs.nation_region(spark, sf_dir))


@query
def largest_cc_customer_order(spark, sf_dir):
    return graph.largest_component(graphs.customer_order(spark, sf_dir))


def _users(spark, sf_dir):
    """Users who follow each other in a day's stream of events."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", "user_id")
    pairs = linalg.followed(e, "day", ["ts", "event_id"], "user_id", "after").select(F.col("user_id").alias("a"), F.col("after").alias("b")).where("a <> b")
    return graphs.mirrored(pairs.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.count("*").cast("double").alias("w")))


@query
def triangles(spark, sf_dir):
    return graph.triangles(_users(spark, sf_dir))


@query
def clustering(spark, sf_dir):
    return shown(graph.clustering(_users(spark, sf_dir)), "global_clustering", "average_local")


@query
def block_nnz(spark, sf_dir):
    return graph.block_nnz(matrix_of(spark, sf_dir), 30000, 16)


@query
def catalog_select(spark, sf_dir):
    return graph.of_kinds(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["Brand#11", "Brand#22", "Brand#33", "Brand#44"])


@query
def colormap_bins(spark, sf_dir):
    return graph.colormap_bins(graph.weighted_degree(graphs.order_part(spark, sf_dir)), 10)


# ---- elimination


def _eliminated(spark, sf_dir):
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return lap, materialize(elimination.select(lap), "gone")


@query
def elim_candidates(spark, sf_dir):
    return elimination.candidates(lap_of(spark, sf_dir))


@query
def elim_select(spark, sf_dir):
    return elimination.select(lap_of(spark, sf_dir))


@query
def elim_idmap(spark, sf_dir):
    return elimination.id_map(*_eliminated(spark, sf_dir))


@query
def elim_P(spark, sf_dir):  # noqa: N802
    return shown(elimination.prolongation(*_eliminated(spark, sf_dir)))


@query
def elim_Q(spark, sf_dir):  # noqa: N802
    return shown(elimination.inverse(*_eliminated(spark, sf_dir)))


@query
def galerkin_elim(spark, sf_dir):
    lap, gone = _eliminated(spark, sf_dir)
    return shown(elimination.schur(lap, gone))


@query
def elim_solve(spark, sf_dir):
    lap, gone = _eliminated(spark, sf_dir)
    inner = hashed_vector(elimination.survivors(lap, gone), 1)
    return shown(elimination.extend(elimination.prolongation(lap, gone), elimination.inverse(lap, gone), inner, x_of(lap)))


@query
def elim_compose(spark, sf_dir):
    """P of two eliminations in a row."""
    lap, gone = _eliminated(spark, sf_dir)
    p, q = elimination.prolongation(lap, gone), elimination.inverse(lap, gone)
    left = materialize(elimination.schur(lap, gone), "left")
    more = materialize(elimination.select(left), "more")
    return shown(elimination.compose(p, q, elimination.prolongation(left, more), elimination.inverse(left, more))[0])


# ---- strength and aggregation

TVS, SWEEPS = 10, 4


def _strength(spark, sf_dir, how: str) -> DataFrame:
    return smoothed_strength(materialize(lap_of(spark, sf_dir), "lap"), TVS, SWEEPS, how)


@query
def tv_init(spark, sf_dir):
    ids = linalg.vertices(matrix_of(spark, sf_dir))
    return shown(strength.test_vectors(ids, TVS).select("i", F.posexplode("xs").alias("k", "v")))


@query
def tv_smooth(spark, sf_dir):
    return shown(smoothed(materialize(lap_of(spark, sf_dir), "lap"), TVS, SWEEPS))


def _logged(v: Column) -> Column:
    """Raw strengths span many orders of magnitude."""
    return F.log10(v + F.lit(1.0))


@query
def affinity_raw(spark, sf_dir):
    return shown(linalg.apply(_strength(spark, sf_dir, "affinity"), _logged))


@query
def affinity_algdist(spark, sf_dir):
    return shown(linalg.apply(_strength(spark, sf_dir, "algebraic_distance"), _logged))


@query
def affinity_none(spark, sf_dir):
    return strength.weights(lap_of(spark, sf_dir))


def _scaled(how: str) -> Query:
    return lambda spark, sf_dir: shown(strength.scale(strength.weights(lap_of(spark, sf_dir)), how), digits=9)


for _how, _name in {"row": "affinity_row", "column": "affinity_col", "row_column": "affinity_rowcol", "sym": "affinity_sym", "max": "affinity_max"}.items():
    QUERIES[_name] = _scaled(_how)


def _tied(spark, sf_dir) -> DataFrame:
    """Pruned edge weights scaled by maxima, the strength that the voting queries use."""
    scaled = linalg.apply(strength.scale(strength.weights(lap_of(spark, sf_dir)), "max"), lambda v: F.round(v, 9))
    return materialize(linalg.prune(scaled, lambda v: v < 1e-8), "tied")


@query
def affinity_scaled(spark, sf_dir):
    """The default strength: affinity of smoothed vectors, scaled by maxima."""
    return shown(strength.scale(materialize(_strength(spark, sf_dir, "affinity"), "strength"), "max"))


@query
def agg_affinity(spark, sf_dir):
    """Aggregates of ten voting rounds over the default strength."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    tied = materialize(strengths(lap, Options()), "tied")
    return aggregation.restriction(aggregation.aggregate(tied, linalg.vertices(lap)))


@query
def affinity_prune(spark, sf_dir):
    return linalg.prune(_scaled("max")(spark, sf_dir), lambda v: v < 0.3)


def _after(spark, sf_dir, rounds: int) -> DataFrame:
    tied = _tied(spark, sf_dir)
    return aggregation.aggregate(tied, linalg.vertices(tied), rounds)


@query
def agg_vote(spark, sf_dir):
    tied = _tied(spark, sf_dir)
    return shown(aggregation.vote(tied, aggregation.initial(linalg.vertices(tied)), 0.5), "weight", digits=9)


@query
def agg_round1(spark, sf_dir):
    return shown(_after(spark, sf_dir, 1), "votes")


@query
def agg_tally(spark, sf_dir):
    tied = _tied(spark, sf_dir)
    states = aggregation.initial(linalg.vertices(tied))
    return shown(aggregation.tally(states, aggregation.vote(tied, states, 0.5), 0.5)[1], "votes")


@query
def agg_reject_size(spark, sf_dir):
    """Aggregates of three rounds, cut to four members beside their root."""
    tied = _tied(spark, sf_dir)
    states = aggregation.aggregate(tied, linalg.vertices(tied), 3)
    return aggregation.reject_large(states, tied, 4).select("i", "ind", "state")


@query
def agg_reject_loose(spark, sf_dir):
    """After three rounds, those with twice as much weight to other aggregates leave."""
    states = _after(spark, sf_dir, 3)
    return aggregation.reject_loose(states, graphs.order_part(spark, sf_dir), 2.0).select("i", "ind", "state")


@query
def restriction(spark, sf_dir):
    return aggregation.restriction(_after(spark, sf_dir, 10))


@query
def agg_assign(spark, sf_dir):
    return _after(spark, sf_dir, 10).select("i", "ind", "state")


@query
def agg_state_counts(spark, sf_dir):
    return _after(spark, sf_dir, 10).groupBy("state").agg(F.count("*").alias("n"))


@query
def agg_sizes(spark, sf_dir):
    return _after(spark, sf_dir, 10).groupBy("ind").agg(F.count("*").alias("size"))


#: A simple assignment with an oracle: vertices by blocks of ids.
def _blocks(a: DataFrame) -> DataFrame:
    return linalg.vertices(a).select("i", F.floor(F.col("i") / 8).alias("agg"))


@query
def conductance(spark, sf_dir):
    adj = graphs.part_supplier(spark, sf_dir)
    found = graph.conductance_ratio(adj, linalg.vertices(adj).select("i", (F.col("i") % 16).alias("agg")))
    return shown(found.select("i", "external", "internal", F.when(F.col("internal") != 0, F.col("ratio")).alias("ratio")), "ratio")


@query
def galerkin_agg(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    return linalg.galerkin_of_map(_blocks(lap), lap)


@query
def agg_renumber(spark, sf_dir):
    return aggregation.contiguous(_blocks(matrix_of(spark, sf_dir)))


# ---- solving


@query
def jacobi_sweep(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    state = linalg.vertices(lap).select("i", hashed_value(F.col("i"), 0).alias("x"), hashed_value(F.col("i"), 1).alias("b"))
    return shown(smoothers.jacobi(lap, state).select("i", F.col("x").alias("v")))


@query
def jacobi_4(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    state = linalg.vertices(lap).select("i", hashed_value(F.col("i"), 0).alias("x"), hashed_value(F.col("i"), 1).alias("b"))
    return shown(smoothers.jacobi(lap, state, sweeps=4).select("i", F.col("x").alias("v")))


@query
def lambda_max_power(spark, sf_dir):
    """The largest eigenvalue of D⁻¹A by eight power steps."""
    return spark.createDataFrame([(round(largest_eigenvalue(materialize(lap_of(spark, sf_dir), "lap")), 6),)], "v double")


@query
def chebyshev_2(spark, sf_dir):
    lap = lap_of(spark, sf_dir)
    state = linalg.vertices(lap).select("i", F.lit(0.0).alias("x"), hashed_value(F.col("i"), 1).alias("b"))
    return shown(smoothers.chebyshev(lap, state, 2.0).select("i", F.col("x").alias("v")))


@query
def restrict(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    return shown(smoothers.restrict(x_of(a), _blocks(a)))


@query
def prolong(spark, sf_dir):
    blocks = _blocks(matrix_of(spark, sf_dir))
    return shown(smoothers.prolong(hashed_vector(blocks.select(F.col("agg").alias("i")).distinct()), blocks))


@query
def project_mean(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    return shown(smoothers.project_mean(x_of(a), _blocks(a)))


@query
def cr_bad_aggregates(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    return shown(smoothers.bad_aggregates(smoothers.project_mean(x_of(a), _blocks(a)), _blocks(a), 0.4), "norm2", "norm_inf")


def _bad(spark, sf_dir):
    a = matrix_of(spark, sf_dir)
    x = materialize(smoothers.project_mean(x_of(a), _blocks(a)), "x")
    return x, _blocks(a), smoothers.bad_aggregates(x, _blocks(a), 0.4)


@query
def cr_split(spark, sf_dir):
    return smoothers.split_by_sign(*_bad(spark, sf_dir))


@query
def cr_roots(spark, sf_dir):
    return smoothers.extreme_roots(*_bad(spark, sf_dir))


@query
def cr_votes(spark, sf_dir):
    adj = graphs.part_supplier(spark, sf_dir)
    ids = linalg.vertices(adj)
    return shown(smoothers.compatible_votes(adj, ids.select("i", (hashed_value(F.col("i"), 0) - 0.5).alias("v")), ids.select("i", (F.col("i") % 16).alias("agg"))), "votes")


@query
def cr_voted_roots(spark, sf_dir):
    x, blocks, bad = _bad(spark, sf_dir)
    votes = x.select("i", F.round(F.abs("v"), 3).alias("votes"))
    return smoothers.voted_roots(votes, blocks, x, bad)


@query
def p_to_s(spark, sf_dir):
    return shown(smoothers.orthogonal_basis(_blocks(matrix_of(spark, sf_dir))))


@query
def smoothing_power(spark, sf_dir):
    """The largest eigenvalue of what aggregates of eight ids leave to smoothing, by four power steps."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return spark.createDataFrame([(round(smoothing_eigenvalue(lap, _blocks(lap), 4), 6),)], "v double")


@query
def cg_k(spark, sf_dir):
    """Three iterations from zero without a preconditioner."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return shown(conjugate_gradients(lap, x_of(lap), no_preconditioner, 0.0, 3, flexible=False).x, digits=5)


@query
def cg_coefficients(spark, sf_dir):
    """Step lengths and weights of three iterations, from which eigenvalue bounds follow."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    found = conjugate_gradients(lap, linalg.orthogonalize(x_of(lap)), jacobi_preconditioner(lap), 0.0, 3, flexible=False)
    rows = [(k, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(zip(found.alphas, found.betas, strict=True))]
    return spark.createDataFrame(rows, "step int, alpha double, beta double")


@query
def fcg_k(spark, sf_dir):
    """Three iterations from zero with the last two directions kept."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return shown(truncated_conjugate_gradients(lap, linalg.orthogonalize(x_of(lap)), jacobi_preconditioner(lap), 0.0, 3, 2).x, digits=5)


@query
def pipecg_k(spark, sf_dir):
    """Three iterations from zero by pipelined recurrences."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return shown(pipelined_conjugate_gradients(lap, linalg.orthogonalize(x_of(lap)), jacobi_preconditioner(lap), 0.0, 3).x, digits=5)


@query
def pcg_jacobi_k(spark, sf_dir):
    """Three iterations from zero."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    b = linalg.orthogonalize(x_of(lap))
    return shown(conjugate_gradients(lap, b, jacobi_preconditioner(lap), 0.0, 3).x, digits=5)


#: Fixed levels for cycles: aggregates by the remainder of ids.
def _by_remainder(lap: DataFrame, *counts: int) -> list[hierarchy.Level]:
    levels: list[hierarchy.Level] = []
    now = hierarchy.Counted(lap)
    for count in counts:
        assign = linalg.vertices(now.matrix).select("i", (F.col("i") % count).alias("agg"))
        levels.append(hierarchy.Aggregation(now.matrix, now.size, now.nnz, assign=assign))
        now = hierarchy.Counted(linalg.galerkin_of_map(assign, now.matrix))
    return [*levels, hierarchy.coarse_level(now.matrix)]


def _fixed_x(ids: DataFrame) -> DataFrame:
    """A vector of whole thousandths."""
    return ids.select("i", ((F.col("i") * 37 % 1000) / 1000).alias("v"))


def _less_first(x: DataFrame) -> DataFrame:
    """x less its value at the least id, to three digits: a solution up to the constant that it may differ by."""
    first = x.agg(F.min(F.struct("i", "v"))["v"].alias("first"))
    return shown(x.join(F.broadcast(first), F.lit(True)).select("i", (F.col("v") - F.col("first")).alias("v")), digits=3)


@query
def two_grid(spark, sf_dir):
    """Jacobi sweep from zero, exact correction on 16 aggregates, Jacobi sweep."""
    lap = graph.laplacian(graphs.part_supplier(spark, sf_dir))
    b = materialize(linalg.orthogonalize(x_of(lap, 1)), "b")
    return shown(hierarchy.cycle(_by_remainder(lap, 16), b, Options(smoother="jacobi")))


@query
def vcycle_1(spark, sf_dir):
    """One V-cycle of an elimination, an aggregation and a coarse level."""
    lap, gone = _eliminated(spark, sf_dir)
    p, q = materialize(elimination.prolongation(lap, gone), "p"), materialize(elimination.inverse(lap, gone), "q")
    levels = [hierarchy.Elimination(lap, 0, 0, p=p, q=q), *_by_remainder(elimination.schur(lap, gone), 16)]
    b = materialize(linalg.orthogonalize(x_of(lap, 1)), "b")
    return shown(hierarchy.cycle(levels, b, Options(smoother="jacobi")))


@query
def kcycle(spark, sf_dir):
    """Residual norms, relative to the right-hand side, of two K-cycles in a row."""
    lap = materialize(graph.laplacian(graphs.part_supplier(spark, sf_dir)), "lap")
    levels, options = _by_remainder(lap, 256, 16), Options(kcycle=True)
    found = conjugate_gradients(lap, x_of(lap, 1), lambda r: hierarchy.cycle(levels, r, options), 0.0, 2)
    return shown(spark.createDataFrame([(k, r / found.residuals[0]) for k, r in enumerate(found.residuals)], "cycle int, v double"))


@query
def colours(spark, sf_dir):
    """Of a colouring of the stars of customers and orders: edges within a colour, and colours, which are two."""
    lap = materialize(graph.laplacian(graphs.customer_order(spark, sf_dir)), "lap")
    found, count = colouring.colours(lap)
    met = lap.where("i <> j").join(found, "i").join(found.select(F.col("i").alias("j"), F.col("colour").alias("other")), "j")
    return met.agg(F.sum((F.col("colour") == F.col("other")).cast("long")).alias("alike"), F.lit(count).cast("long").alias("colours"))


@query
def coarse_solve(spark, sf_dir):
    """The coarse level's answer where it is known."""
    lap = graph.laplacian(graphs.part_supplier(spark, sf_dir))
    level = hierarchy.coarse_level(materialize(linalg.galerkin_of_map(linalg.vertices(lap).select("i", (F.col("i") % 16).alias("agg")), lap), "coarse"))
    return _less_first(level.apply([level], linalg.spmv(level.matrix, _fixed_x(linalg.vertices(level.matrix))), Options(), 0))


@query
def hierarchy_report(spark, sf_dir):
    """Two levels by ten voting rounds on edge weights."""
    levels = hierarchy.build(lap_of(spark, sf_dir), Options(strength="none", always_elim=False, max_levels=2, coarse_vertices=1))
    return spark.createDataFrame(hierarchy.report(levels), "level int, kind string, size long, nnz long")


@query
def fiedler(spark, sf_dir):
    """Of the largest component of customers and orders (a star): the smallest eigenvalue beside 0, its vector's distance
    from an eigenvector, and the largest eigenvalue."""
    lap = materialize(graph.laplacian(graph.largest_component(graphs.customer_order(spark, sf_dir))), "lap")
    low, high = smallest_pairs(lap), largest_pairs(lap)
    x = low.vectors.select("i", F.col("x0").alias("v"))
    away = linalg.norm(linalg.axpy(-low.values[0], x, linalg.spmv(lap, x)))
    return away.select(F.lit(round(low.values[0], 6)).alias("smallest"), (F.round("v", 6) + F.lit(0.0)).alias("away"), F.lit(round(high.values[0], 6)).alias("largest"))


def _away(pairs: Pairs, lap: DataFrame, digits: int) -> DataFrame:
    """(k, away, length): how far a vector of each pair is from an eigenvector, by a product of its own, and its length."""
    met = lap.join(pairs.long().select("k", F.col("i").alias("j"), F.col("v").alias("x")), "j")
    value = F.element_at(F.array(*map(F.lit, pairs.values)), F.col("k") + 1)
    sums = met.groupBy("k", "i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"), F.max(F.when(F.col("i") == F.col("j"), F.col("x"))).alias("x"))
    off = F.col("ax") - value * F.col("x")
    found = sums.groupBy("k").agg(F.sqrt(F.sum(off * off)).alias("away"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return shown(found, "away", "length", digits=digits)


@query
def smallest_eigenpairs(spark, sf_dir):
    """Three smallest pairs of parts and suppliers beside the constant vector's: residuals and lengths."""
    lap = materialize(graph.laplacian(graphs.part_supplier(spark, sf_dir)), "lap")
    return _away(smallest_pairs(lap, 3, tol=1e-5), lap, 2)


@query
def largest_eigenpairs(spark, sf_dir):
    """Two largest pairs of parts and suppliers: residuals and lengths."""
    lap = pack(graph.laplacian(graphs.part_supplier(spark, sf_dir)))
    return _away(largest_pairs(lap, 2, 1e-8), lap, 3)


@query
def smoothing_eigenpair(spark, sf_dir):
    """The leading pair of what aggregates of eight ids leave to smoothing, by Arnoldi steps: its residual, by a product of
    its own, and its length."""
    lap = pack(graph.laplacian(graphs.part_supplier(spark, sf_dir)))
    found = smoothing_pairs(lap, _blocks(lap), 1)
    x = materialize(found.vectors.select("i", F.col("re0").alias("v")), "x")
    off = linalg.axpy(-found.values[0].real, x, smoothers.Complement.of(_blocks(lap)).step(lap, x))
    both = off.withColumnRenamed("v", "off").join(x, "i").agg(F.sqrt(F.sum(F.col("off") * F.col("off"))).alias("away"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    return shown(both, "away", "length", digits=4)


@query
def cr_smooth(spark, sf_dir):
    """Four test vectors after two sweeps, aggregates of eight ids made mean-free after each."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return shown(compatible.smooth(lap, _blocks(lap), 4, 2).select("i", F.posexplode("xs").alias("k", "v")))


@query
def cr_bad(spark, sf_dir):
    """The aggregates of eight ids on which much of them is left."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    return shown(compatible.bad(compatible.smooth(lap, _blocks(lap), 4, 2), _blocks(lap), 4, 0.35, "both"), "two", "inf")


@query
def solve(spark, sf_dir):
    """A full solve of L x = b where x is known, up to a constant."""
    lap = materialize(graph.laplacian(graphs.part_supplier(spark, sf_dir)), "lap")
    b = materialize(linalg.spmv(lap, _fixed_x(linalg.vertices(lap))), "b")
    return _less_first(Solver(lap, Options(tol=1e-9)).solve(b))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full solve on the order-part graph: (i, x, residual)."""
    lap = materialize(lap_of(spark, sf_dir), "lap")
    b = materialize(linalg.orthogonalize(x_of(lap)), "b")
    x = materialize(Solver(lap, Options(coarse_vertices=300)).solve(b), "x")
    return x.withColumnRenamed("v", "x").join(linalg.residual(lap, x, b).withColumnRenamed("v", "residual"), "i")

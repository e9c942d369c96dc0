"""The multigrid hierarchy and its cycles.

Levels hold written tables. A cycle goes down and up the levels as one lazy plan that is cut where a vector is used twice:
an aggregation level writes one table, and the whole cycle one more. The coarsest level is solved exactly: where it has few
vertices, by a dense pseudo-inverse whose rows are a table; where coarsening ended early, by iteration.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import aggregation, colouring, compatible, dealt, elimination, linalg, smoothers, strength, tiles
from quillgraph.operators.graph import adjacency
from quillgraph.operators.stars import Stars
from quillgraph.plans.krylov import conjugate_gradients, eigenvalue_bound, jacobi_preconditioner
from quillgraph.plans.options import Options
from quillgraph.storage import discard, materialize, measured, scratch


@dataclass
class Level:
    """What all levels have: their matrix (i, j, v), its rows and entries, and whether a vector of theirs may be broadcast.
    ``exact`` levels pass a K-cycle through. A level of another kind gives ``kind``, ``work`` and ``apply``."""

    matrix: DataFrame
    size: int
    nnz: int
    small: bool = False
    kind: str = ""
    exact: bool = False

    def work(self, options: Options) -> float:
        raise NotImplementedError

    def apply(self, levels: list[Level], b: DataFrame, options: Options, at: int) -> DataFrame:
        """The answer (i, v) for the right-hand side ``b`` (i, v), from zero."""
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {"A": self.matrix}


@dataclass
class Elimination(Level):
    p: DataFrame | None = None
    q: DataFrame | None = None
    extra: int = 0
    kind: str = "elim"
    exact: bool = True

    def work(self, options: Options) -> float:
        return self.extra

    def apply(self, levels: list[Level], b: DataFrame, options: Options, at: int) -> DataFrame:
        return elimination.extend(self.p, self.q, below(levels, linalg.spmv(linalg.transpose(self.p), b), options, at), b)

    def tables(self) -> dict[str, DataFrame]:
        return super().tables() | {"P": self.p, "Q": self.q}


@dataclass
class Aggregation(Level):
    assign: DataFrame | None = None
    largest: float = 2.0
    kind: str = "agg"
    #: Strengths, and states and votes of each round by name, where they were kept.
    rounds: dict[str, DataFrame] = field(default_factory=dict)

    def work(self, options: Options) -> float:
        return (options.pre_smooth + options.post_smooth + 1) * self.nnz + 3 * self.size

    def smooth(self, state: DataFrame, options: Options, sweeps: int, zero: bool = False) -> DataFrame:
        if options.smoother == "jacobi":
            return smoothers.jacobi(self.matrix, state, sweeps=1, zero=zero, small=self.small)  # one sweep whatever the setting
        return smoothers.chebyshev(self.matrix, state, self.largest, sweeps, options.cheby_low, options.cheby_high, zero, self.small)

    def apply(self, levels: list[Level], b: DataFrame, options: Options, at: int) -> DataFrame:
        state = self.smooth(b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("b")), options, options.pre_smooth, zero=True)
        state = materialize(smoothers.with_residual(self.matrix, state, self.small), "smoothed")
        rest = smoothers.restrict(state.select("i", F.col("r").alias("v")), self.assign)
        inner = smoothers.prolong(below(levels, rest, options, at), self.assign)
        state = state.join(inner, "i").select("i", (F.col("x") + F.col("v")).alias("x"), "b")
        scale = F.lit(4.0 / 3.0 if options.constant_correction else 1.0)
        return self.smooth(state, options, options.post_smooth).select("i", (scale * F.col("x")).alias("v"))

    def tables(self) -> dict[str, DataFrame]:
        return super().tables() | {"R": self.assign} | self.rounds


@dataclass
class Coarse(Level):
    #: (i, row array<double>): rows of the pseudo-inverse, columns in order of i; none where the level is too large.
    inverse: DataFrame | None = None
    kind: str = "coarse"
    sweeps: colouring.Sweeps | None = None
    #: Of the last solve by iteration.
    iterations: int = 0

    def work(self, options: Options) -> float:
        return self.nnz

    def apply(self, levels: list[Level], b: DataFrame, options: Options, at: int) -> DataFrame:
        if self.inverse is None:
            found = conjugate_gradients(self.matrix, b, self.sweeps or jacobi_preconditioner(self.matrix), options.coarse_tol, options.iters, small=self.small)
            self.iterations = found.iters
            if found.reason in ("iterations", "diverged"):
                raise RuntimeError(f"the coarse level of {self.size} vertices was not solved: {found.reason}, residual {found.residuals[-1]:.3g}")
            return found.x
        known = self.inverse.select("i").join(b, "i", "left").select("i", F.coalesce("v", F.lit(0.0)).alias("v"))
        ordered = known.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("b"))  # at most coarse_vertices values
        value = F.aggregate(F.zip_with("row", "b", lambda a, x: a * x), F.lit(0.0), lambda s, x: s + x)
        return self.inverse.join(F.broadcast(ordered), F.lit(True)).select("i", value.alias("v"))


#: Entries of a matrix that is large enough for sweeps by stars, and the most of them that may lie between outer vertices.
MANY, MOST_REST = 1 << 22, 0.05


def sweeps_of(lap: DataFrame) -> Stars | tiles.Tiles:
    """What smooths vectors on a written Laplacian."""
    return lap.count() > MANY and Stars.of(lap, MOST_REST) or tiles.Tiles.of(lap)


def largest_eigenvalue(lap: DataFrame, steps: int = 8, small: bool = False) -> float:
    """Of D⁻¹A of a written Laplacian, by power iteration from a fixed vector: the growth in the last of some steps, which
    are one plan where it is not swept as stars."""
    from quillgraph.graphs import hashed_value

    if lap.count() > MANY and (held := Stars.of(lap, MOST_REST)):
        with scratch():
            start = held.kinds.select("i", F.array(hashed_value(F.col("i"), 3) - 0.5).alias("xs"))
            swept = held.swept(start, 1, steps, 1.0, -1.0, negative=False)
            before, after = swept.squares(steps - 1), swept.squares(steps)
        return float(np.sqrt(after / before)) if before else 1.0
    d = linalg.diagonal(lap).withColumnRenamed("v", "d")
    x = linalg.vertices(lap).select("i", (hashed_value(F.col("i"), 3) - 0.5).alias("v"))
    for _ in range(steps - 1):
        x = smoothers.with_product(lap, x, small).join(d, "i").select("i", (F.col("av") / F.col("d")).alias("v"))
    last = smoothers.with_product(lap, x, small).join(d, "i")
    growth = last.agg(F.sqrt(F.sum(F.pow(F.col("av") / F.col("d"), 2))).alias("after"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("before")).first()
    return float(growth["after"] / growth["before"]) if growth["before"] else 1.0


#: Weight of a sweep of test vectors.
OMEGA = 2.0 / 3.0


def smoothed(lap: DataFrame, count: int, sweeps: int) -> DataFrame:
    """(i, k, v): test vectors after some sweeps on a written Laplacian."""
    held = sweeps_of(lap)
    if isinstance(held, Stars):
        return held.swept(strength.test_vectors(held.kinds.select("i"), count), count, sweeps, 1 - OMEGA, OMEGA).long()
    return held.smooth(strength.test_vectors(linalg.vertices(lap), count), count, sweeps, OMEGA).select("i", F.posexplode("xs").alias("k", "v"))


def smoothed_strength(lap: DataFrame, count: int, sweeps: int, how: str) -> DataFrame:
    """Strengths by test vectors after some sweeps on a written Laplacian."""
    held = sweeps_of(lap)
    if isinstance(held, Stars):
        return held.swept(strength.test_vectors(held.kinds.select("i"), count), count, sweeps, 1 - OMEGA, OMEGA).strength(how)
    return held.strength(strength.test_vectors(linalg.vertices(lap), count), count, sweeps, how, OMEGA)


def strengths(lap: DataFrame, options: Options) -> DataFrame:
    raw = strength.weights(lap) if options.strength == "none" else smoothed_strength(lap, options.num_tvs, options.tvs_smooth, options.strength)
    scaled = linalg.apply(strength.scale(materialize(raw, "strength"), options.scaling), lambda v: F.round(v, 9))
    return linalg.prune(scaled, lambda v: v < options.thresh)


@dataclass
class Counted:
    """A written matrix with its entries and rows, counted while it was written. One with too many rows for a vector to
    be broadcast is kept in buckets by column, hubs' columns in parts, so that products shuffle the vector and not the
    matrix."""

    matrix: DataFrame
    broadcast_vertices: int = Options.broadcast_vertices
    nnz: int = field(init=False)
    size: int = field(init=False)

    def __post_init__(self) -> None:
        self.matrix, s = measured(self.matrix, "level", nnz=F.count("*"), size=F.count(F.when(F.col("i") == F.col("j"), 1)))
        self.nnz, self.size = int(s["nnz"]), int(s["size"])
        if self.size > self.broadcast_vertices:
            plain, self.matrix = self.matrix, dealt.deal(self.matrix, "level", self.nnz)
            discard(plain)


def eliminate(now: Counted, options: Options) -> tuple[DataFrame, DataFrame, Counted, int] | None:
    """(P, Q, what is left, entries of P twice and of Q) of up to ``elim_iters`` eliminations in a row; none where too
    few vertices would go."""
    found = None
    for _ in range(options.elim_iters):
        gone, s = measured(elimination.select(now.matrix, options.elim_degree), "gone", k=F.count("*"))
        k = int(s["k"])
        if not 0 < k < now.size or now.size - k > options.elim_factor * now.size:
            break
        p, q = materialize(elimination.prolongation(now.matrix, gone), "elim_p"), materialize(elimination.inverse(now.matrix, gone), "elim_q")
        left = Counted(elimination.schur(now.matrix, gone), options.broadcast_vertices)
        if found:
            p, q = (materialize(x, "elim_pq") for x in elimination.compose(found[0], found[1], p, q))
        found, now = (p, q, left), left
    if not found:
        return None
    p, q, left = found
    return p, q, left, 2 * p.count() + q.count()


def build(lap: DataFrame, options: Options = Options(), tried: bool = False) -> list[Level]:
    """Levels from fine to coarse. Coarsening stops when a level is small, or does not get smaller. ``tried``: it is known
    that too few vertices of ``lap`` can be eliminated."""
    levels: list[Level] = []
    now = Counted(lap, options.broadcast_vertices)
    small = lambda: now.size <= options.broadcast_vertices
    while len(levels) < options.max_levels - 1 and now.size > options.coarse_vertices or not levels and options.max_levels > 1:
        if now.nnz <= options.min_size or now.size <= 1:
            break
        if options.always_elim and not (tried and not levels) and (gone := eliminate(now, options)):
            p, q, left, extra = gone
            levels.append(Elimination(now.matrix, now.size, now.nnz, small(), p=p, q=q, extra=extra))
            now = left
            if now.nnz <= options.min_size or now.size <= options.coarse_vertices or len(levels) >= options.max_levels - 1:
                break
        if now.size <= options.coarse_vertices:
            break
        tied, s = measured(strengths(now.matrix, options), "scaled_strength", n=F.count("*"))
        if not small():
            plain, tied = tied, dealt.deal(tied, "scaled_strength", s["n"])
            discard(plain)
        trace: dict[str, DataFrame] = {}
        voted = partial(
            aggregation.aggregate, tied, linalg.vertices(now.matrix), options.agg_iters, options.agg_init_factor, options.agg_iter_factor, options.votes_to_seed, options.max_agg_size, adjacency(now.matrix),
            options.rejection_ratio, options.rejection_to_seed, options.neighbor_of_neighbor, trace=trace if options.keep_rounds else None,
        )
        states = voted()
        assign = materialize(aggregation.restriction(states), "assign")
        for _ in range(options.cr_iters if options.compatible != "none" else 0):
            states, assign = _relaxed(now.matrix, states, assign, voted, options)
        if options.keep_rounds:
            trace["strength"] = tied
        else:
            discard(tied, states)
        if assign.select("agg").distinct().count() > options.stall * now.size:
            break
        levels.append(Aggregation(now.matrix, now.size, now.nnz, small(), assign=assign, largest=eigenvalue_bound(now.matrix, options.cheby_steps, small()), rounds=trace))
        now = Counted(linalg.galerkin_of_map(assign, now.matrix), options.broadcast_vertices)
    return [*levels, coarse_level(now.matrix, options)]


def _relaxed(matrix: DataFrame, states: DataFrame, assign: DataFrame, voted: Callable[..., DataFrame], options: Options) -> tuple[DataFrame, DataFrame]:
    """States and aggregates after one round of compatible relaxation."""
    settings = options.cr_threshold, options.cr_tvs, options.cr_smoothing_iters, options.cr_norm
    with scratch() as kept:
        if options.compatible == "split":
            after = states
            changed = materialize(compatible.split(matrix, assign, *settings), "assign")
        else:
            after = voted(start=compatible.reseeded(matrix, states, assign, *settings))
            changed = materialize(aggregation.restriction(after), "assign")
            kept.append(after)
        kept.append(changed)
    discard(assign)
    return after, changed


def coarse_level(matrix: DataFrame, options: Options = Options()) -> Coarse:
    nnz, size = matrix.agg(F.count("*"), F.count(F.when(F.col("i") == F.col("j"), 1))).first()
    small = size <= options.broadcast_vertices
    if size > options.coarse_vertices:
        return Coarse(matrix, size, nnz, small, sweeps=colouring.Sweeps.of(matrix, small) if options.coarse_precondition == "sor" else None)
    rows = matrix.toPandas()  # at most coarse_vertices squared
    ids = np.unique(rows["i"].to_numpy(dtype=np.int64))
    dense = np.zeros((len(ids), len(ids)))
    dense[np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])] = rows["v"]
    inverse = np.linalg.pinv((dense + dense.T) / 2, rcond=1e-12, hermitian=True)
    frame = pd.DataFrame({"i": ids, "row": inverse.tolist()})
    return Coarse(matrix, size, nnz, small, inverse=materialize(matrix.sparkSession.createDataFrame(frame, "i long, row array<double>"), "inverse"))


def cycle(levels: list[Level], b: DataFrame, options: Options, at: int = 0) -> DataFrame:
    """One V- or K-cycle from zero for the right-hand side ``b`` (i, v): (i, v), a written table; no other one is left."""
    with scratch() as kept:
        kept.append(out := materialize(levels[at].apply(levels, b, options, at), "cycled"))
    return out


def below(levels: list[Level], b: DataFrame, options: Options, at: int) -> DataFrame:
    """The next level's answer: a cycle, or in a K-cycle a few accelerated ones."""
    following = levels[at + 1]
    if options.kcycle and not following.exact and following.kind != "coarse":
        return conjugate_gradients(following.matrix, b, lambda r: cycle(levels, r, options, at + 1), 0.0, options.kcycle_iters, small=following.small).x
    return following.apply(levels, b, options, at + 1)


def cycle_complexity(levels: list[Level], options: Options) -> float:
    """Work of a cycle in products with the finest matrix."""
    total, times = 0.0, 1
    for level in levels:
        if options.kcycle and not level.exact and level is not levels[0] and level.kind != "coarse":
            times *= options.kcycle_iters
        total += times * level.work(options)
    return total / max(1, levels[0].nnz)


def report(levels: list[Level]) -> list[tuple[int, str, int, int]]:
    """(level, kind, size, nnz)"""
    return [(k, level.kind, level.size, level.nnz) for k, level in enumerate(levels)]


def spread(level: Level) -> tuple[int, float]:
    """Partitions of a level's matrix, and the entries of the largest one over the mean of all."""
    sizes = level.matrix.groupBy(F.spark_partition_id().alias("at")).count()
    largest, rows, used = sizes.agg(F.max("count"), F.sum("count"), F.count("*")).first()
    return used, float(largest * used / rows) if rows else 1.0


def dump(levels: list[Level], path: str) -> None:
    """Every table of every level as Parquet below ``path``: ``level=<n>/<name>``, names A, P, Q and R (i, agg), and where rounds
    were kept, strength, agg_state_<round> and voting_for_<round>."""
    for k, level in enumerate(levels):
        for name, table in level.tables().items():
            table.drop("_part").write.mode("overwrite").parquet(f"{path}/level={k}/{name}")

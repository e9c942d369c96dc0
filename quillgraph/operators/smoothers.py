"""Smoothers and grid transfer. A sweep is one join and one group-by: the Laplacian has each row's diagonal, so the row's
own values travel with the join and no second one is needed. ``state`` is (i, x, b). ``small`` says that the caller has
counted the vertices and found them few enough to broadcast; the matrix is then not shuffled to meet the vector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillgraph.operators import dealt, linalg
from quillgraph.operators.packed import packed
from quillgraph.storage import materialize


def _met(lap: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    return dealt.meet(lap, state, small=small)


def _own(column: str) -> Column:
    return F.max(F.when(F.col("i") == F.col("j"), F.col(column)))


def _with_ax(lap: DataFrame, state: DataFrame, small: bool, *own: str) -> DataFrame:
    """(i, ax, d, ...): the product with x and the diagonal beside the row's own columns."""
    if tiles := packed(lap):
        return tiles.product(state, {"ax": "x"}, list(own))
    return _met(lap, state, small).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"), _own("v").alias("d"), *(_own(c).alias(c) for c in own))


def _from_zero(lap: DataFrame, state: DataFrame, step: float) -> DataFrame:
    """A sweep from x = 0 is a scaling by the diagonal: it needs no product."""
    x = F.lit(step) * F.col("b") / F.col("d")
    return state.select("i", "b").join(linalg.diagonal(lap).withColumnRenamed("v", "d"), "i").select("i", x.alias("x"), "b", x.alias("p"))


def jacobi(lap: DataFrame, state: DataFrame, omega: float = 2.0 / 3.0, sweeps: int = 1, zero: bool = False, small: bool = False) -> DataFrame:
    """(i, x, b) after weighted Jacobi sweeps; ``zero``: x is known to be 0."""
    for k in range(sweeps):
        if zero and k == 0:
            state = _from_zero(lap, state, omega).drop("p")
            continue
        off = F.coalesce(F.sum(F.when(F.col("v") < 0, F.col("v") * F.col("x"))), F.lit(0.0))
        if tiles := packed(lap):
            sums = tiles.product(state, {"off": "x"}, ["x", "b"], negative=True)
        else:
            sums = _met(lap, state, small).groupBy("i").agg(off.alias("off"), _own("v").alias("d"), _own("x").alias("x"), _own("b").alias("b"))
        state = sums.select("i", (omega * (F.col("b") - F.col("off")) / F.col("d") + (1 - omega) * F.col("x")).alias("x"), "b")
    return state


def chebyshev(lap: DataFrame, state: DataFrame, largest: float, sweeps: int = 2, low: float = 0.3, high: float = 1.1, zero: bool = False, small: bool = False) -> DataFrame:
    """(i, x, b) after Chebyshev steps on D⁻¹A for eigenvalues between ``low`` and ``high`` times ``largest``; ``zero``: x
    is known to be 0."""
    a, b = low * largest, high * largest
    theta, delta = (a + b) / 2, (b - a) / 2
    sigma = theta / delta
    rho = 1 / sigma
    state = state.withColumn("p", F.lit(0.0))
    for k in range(sweeps):
        if zero and k == 0:
            state = _from_zero(lap, state, 1 / theta)
            continue
        sums = _with_ax(lap, state, small, "x", "b", "p")
        r = (F.col("b") - F.col("ax")) / F.col("d")
        if k == 0:
            step = r / theta
        else:
            after = 1 / (2 * sigma - rho)
            step = F.col("p") * (after * rho) + r * (2 * after / delta)
            rho = after
        state = sums.select("i", (F.col("x") + step).alias("x"), "b", step.alias("p"))
    return state.drop("p")


def with_residual(lap: DataFrame, state: DataFrame, small: bool = False) -> DataFrame:
    """``state`` with r = b - A x."""
    sums = _with_ax(lap, state, small, "x", "b")
    return sums.select("i", "x", "b", (F.col("b") - F.col("ax")).alias("r"))


def with_product(lap: DataFrame, x: DataFrame, small: bool = False, diagonal: bool = False) -> DataFrame:
    """(i, v) -> (i, v, av): a vector beside its product, and with the ``diagonal`` d."""
    beside = ["d"] if diagonal else []
    if tiles := packed(lap):
        return tiles.product(x, {"av": "v"}, ["v"]).select("i", "v", "av", *beside)
    met = _met(lap, x.withColumnRenamed("v", "x"), small)
    return met.groupBy("i").agg(_own("x").alias("w"), F.sum(F.col("v") * F.col("x")).alias("av"), *(_own("v").alias(d) for d in beside)).withColumnRenamed("w", "v")


def restrict(r: DataFrame, assign: DataFrame) -> DataFrame:
    """(i, v) -> sums by aggregate."""
    return r.join(assign, "i").groupBy(F.col("agg").alias("i")).agg(F.sum("v").alias("v"))


def prolong(coarse: DataFrame, assign: DataFrame) -> DataFrame:
    """(i, v): each vertex has its aggregate's value."""
    return assign.join(coarse.select(F.col("i").alias("agg"), "v"), "agg").select("i", "v")


def project_mean(x: DataFrame, assign: DataFrame) -> DataFrame:
    """x less the mean of its aggregate; sums are combined before they are shuffled, so a large aggregate does no harm."""
    placed = x.join(assign, "i")
    means = placed.groupBy("agg").agg(F.avg("v").alias("mean"))
    return placed.join(means, "agg").select("i", (F.col("v") - F.col("mean")).alias("v"))


def bad_aggregates(x: DataFrame, assign: DataFrame, threshold: float) -> DataFrame:
    """(agg, norm2, norm_inf, size): aggregates of two or more whose mean square or largest absolute value exceeds ``threshold``."""
    sums = x.join(assign, "i").groupBy("agg").agg(F.avg(F.col("v") * F.col("v")).alias("norm2"), F.max(F.abs("v")).alias("norm_inf"), F.count("*").alias("size"))
    return sums.where((F.col("size") > 1) & (F.greatest("norm2", "norm_inf") > threshold))


def split_by_sign(x: DataFrame, assign: DataFrame, bad: DataFrame) -> DataFrame:
    """(i, agg): bad aggregates are split by the sign of the smoothed vector ``x``; members with a negative value get the
    least id among them as their root."""
    placed = assign.join(x, "i").join(bad.select("agg", F.lit(True).alias("bad")), "agg", "left")
    moves = F.coalesce("bad", F.lit(False)) & (F.col("v") < 0)
    roots = placed.where(moves).groupBy("agg").agg(F.min("i").alias("root"))
    return placed.join(roots, "agg", "left").select("i", F.when(moves, F.col("root")).otherwise(F.col("agg")).alias("agg"))


def extreme_roots(x: DataFrame, assign: DataFrame, bad: DataFrame) -> DataFrame:
    """(agg, least, most): the members with the least and the greatest value of each bad aggregate, its two new roots
    (ties: smaller id)."""
    placed = assign.join(x, "i").join(bad.select("agg"), "agg", "left_semi")
    return placed.groupBy("agg").agg(F.min(F.struct("v", "i"))["i"].alias("least"), F.min(F.struct((-F.col("v")).alias("v"), "i"))["i"].alias("most"))


def compatible_votes(adj: DataFrame, x: DataFrame, assign: DataFrame) -> DataFrame:
    """(i, votes): what neighbours of the same aggregate and sign give to a vertex: their edge weight over how far their
    value is from its own."""
    known = x.join(assign, "i")
    ends = adj.where("i <> j").join(known, "i").join(known.select(F.col("i").alias("j"), F.col("v").alias("vj"), F.col("agg").alias("aggj")), "j")
    alike = (F.col("agg") == F.col("aggj")) & (F.signum("v") == F.signum("vj"))
    return ends.groupBy("i").agg(F.sum(F.when(alike, F.col("w") / (F.abs(F.col("v") - F.col("vj")) + 1e-4)).otherwise(0.0)).alias("votes"))


def voted_roots(votes: DataFrame, assign: DataFrame, x: DataFrame, bad: DataFrame) -> DataFrame:
    """(agg, low, high): of each bad aggregate, the member with most votes among the negative values and among the
    others (ties: smaller id; null where there is none)."""
    placed = assign.join(votes, "i").join(x, "i").join(bad.select("agg"), "agg", "left_semi")
    best = lambda side: F.min(F.when(side, F.struct((-F.col("votes")).alias("d"), "i")))["i"]
    return placed.groupBy("agg").agg(best(F.col("v") < 0).alias("low"), best(F.col("v") >= 0).alias("high"))


def orthogonal_basis(assign: DataFrame) -> DataFrame:
    """(i, agg, k, v): for each aggregate of n vertices an orthonormal basis of the vectors on it that sum to zero, as
    n - 1 columns k = 1, 2, ... over its members in order of their ids: column k is 1 on the first k members and -k on
    the next, over sqrt(k (k + 1)). The span is that of the left singular vectors of I - 11ᵀ/n."""
    member = F.row_number().over(Window.partitionBy("agg").orderBy("i"))
    sized = assign.withColumn("m", member).join(assign.groupBy("agg").agg(F.count("*").cast("int").alias("n")), "agg")
    columns = F.when((F.col("n") > 1) & (F.col("m") > 1), F.sequence(F.col("m") - 1, F.col("n") - 1)).when(F.col("n") > 1, F.sequence(F.lit(1), F.col("n") - 1))
    k = F.col("k").cast("double")
    value = F.when(F.col("m") == F.col("k") + 1, -k).otherwise(1.0) / F.sqrt(k * (k + 1))
    return sized.select("i", "agg", "m", F.explode(columns).alias("k")).select("i", "agg", "k", value.alias("v"))


def _earlier() -> WindowSpec:
    """The parts of an aggregate before this one; there are as many as range partitions at most."""
    return Window.partitionBy("agg").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)


@dataclass
class Complement:
    """The basis of :func:`orthogonal_basis` as an operator, without its columns: the coefficient of column k of an
    aggregate lives on the aggregate's member k + 1, so coefficients are a vector (i, v) over all vertices but the first of
    each aggregate. Both products are running sums within aggregates, whose members are written in order by range
    partitions: an aggregate of any size is no task's alone, and rows are as many as vertices."""

    members: DataFrame

    @classmethod
    def of(cls, assign: DataFrame) -> Complement:
        """From (i, agg)."""
        spark = assign.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = materialize(assign.select("i", "agg").repartitionByRange(parts, "agg", "i").withColumn("at", F.spark_partition_id()), "ranged")
        sizes = ranged.groupBy("agg", "at").agg(F.count("*").alias("n"))
        before = sizes.withColumn("before", F.coalesce(F.sum("n").over(_earlier()), F.lit(0))).select("agg", "at", "before")
        placed = ranged.withColumn("own", F.row_number().over(Window.partitionBy("agg", "at").orderBy("i"))).join(before, ["agg", "at"])
        return cls(materialize(placed.select("i", "agg", "at", (F.col("before") + F.col("own")).cast("double").alias("m")), "members"))

    def coefficients(self) -> DataFrame:
        """(i, agg, k): where the coefficients live."""
        return self.members.where("m > 1").select("i", "agg", (F.col("m") - 1).cast("long").alias("k"))

    def _running(self, values: DataFrame) -> DataFrame:
        """``values`` (i, v) beside agg, at, m; ``upto``: their sum over the members up to this one, and ``total`` over all."""
        placed = self.members.join(values, "i", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
        parts = placed.groupBy("agg", "at").agg(F.sum("v").alias("part"))
        carried = parts.select("agg", "at", F.coalesce(F.sum("part").over(_earlier()), F.lit(0.0)).alias("before"), F.sum("part").over(Window.partitionBy("agg")).alias("total"))
        here = Window.partitionBy("agg", "at").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
        return placed.withColumn("here", F.sum("v").over(here)).join(carried, ["agg", "at"]).withColumn("upto", F.col("before") + F.col("here"))

    def expand(self, x: DataFrame) -> DataFrame:
        """S x: (i, v) over all vertices."""
        scaled = x.join(self.members.select("i", "m"), "i").select("i", (F.col("v") / F.sqrt(F.col("m") * (F.col("m") - 1))).alias("v"))
        return self._running(scaled).select("i", (F.col("total") - F.col("upto") - (F.col("m") - 1) * F.col("v")).alias("v"))

    def project(self, y: DataFrame) -> DataFrame:
        """Sᵀ y: coefficients."""
        m = F.col("m")
        return self._running(y).where("m > 1").select("i", ((F.col("upto") - F.col("v") - (m - 1) * F.col("v")) / F.sqrt(m * (m - 1))).alias("v"))

    def step(self, lap: DataFrame, x: DataFrame) -> DataFrame:
        """Sᵀ D⁻¹ A S x for coefficients x. The eigenvalues of this operator say how well a Jacobi-like smoother does what
        the coarse level can't."""
        return self.project(with_product(lap, self.expand(x), diagonal=True).select("i", (F.col("av") / F.col("d")).alias("v")))



"""Preconditioned Krylov methods for singular Laplacians: the right-hand side's mean is taken out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.graphs import hashed_value
from quillgraph.operators import linalg
from quillgraph.operators.smoothers import with_product
from quillgraph.storage import discard, materialize, measured, scratch

Preconditioner = Callable[[DataFrame], DataFrame]
#: A residual norm of so many times the first ends a method.
DIVERGED = 1e10


@dataclass
class Iterations:
    """``reason`` says why a method ended: ``converged``, ``iterations`` (as many as were allowed), ``diverged`` (the residual
    grew beyond the bound) or ``indefinite`` (a direction along which the energy does not grow). ``alphas`` and ``betas``
    are the step lengths and the weights of the last direction, where the method has them."""

    x: DataFrame
    residuals: list[float] = field(default_factory=list)
    reason: str = "converged"
    alphas: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)

    @property
    def iters(self) -> int:
        return len(self.residuals) - 1


def jacobi_preconditioner(lap: DataFrame) -> Preconditioner:
    d = linalg.diagonal(lap).withColumnRenamed("v", "d")
    return lambda r: r.join(d, "i").select("i", (F.col("v") / F.col("d")).alias("v"))


def no_preconditioner(r: DataFrame) -> DataFrame:
    return r


def _start(b: DataFrame) -> tuple[DataFrame, float]:
    """A written table of b less its mean, and its norm."""
    table, s = measured(b.select("i", "v"), "rhs", n=F.count("*"), v=F.sum("v"), vv=F.sum(F.col("v") * F.col("v")))
    mean = s["v"] / s["n"] if s["n"] else 0.0
    return table.withColumn("v", F.col("v") - F.lit(mean)), max(0.0, s["vv"] - s["n"] * mean * mean) ** 0.5


def _ended(norms: list[float], tol: float) -> str:
    """Why a loop ended whose last residual norm is known."""
    if norms[-1] <= tol * norms[0]:
        return "converged"
    return "diverged" if not norms[-1] <= DIVERGED * norms[0] else "iterations"


def conjugate_gradients(lap: DataFrame, b: DataFrame, precondition: Preconditioner, tol: float = 1e-8, iters: int = 500, flexible: bool = True, small: bool = False) -> Iterations:
    """Solve L x = b from zero until the residual norm is ``tol`` times the first, or has grown ``DIVERGED`` times.

    An iteration is the preconditioner and one written table: z meets the last direction and the product of z, and all
    sums that the step needs are taken while the table is written. ``flexible``: the preconditioner may change from one
    iteration to the next (Polak-Ribière's step)."""
    rhs, start = _start(b)
    zero = F.lit(0.0)
    now = rhs.select("i", zero.alias("x"), F.col("v").alias("r"), zero.alias("before"), zero.alias("p"), zero.alias("ap"))
    norms, last, curve, written, reason = [start], 0.0, 0.0, rhs, ""
    alphas, betas = [], []
    while start > 0 and tol * start < norms[-1] <= DIVERGED * start and len(norms) <= iters:
        preconditioned = precondition(now.select("i", F.col("r").alias("v")))
        z = with_product(lap, preconditioned, small).withColumnsRenamed({"v": "z", "av": "az"})
        r, before, ap, z_, az = (F.col(c) for c in ("r", "before", "ap", "z", "az"))
        products = {"rz": r * z_, "bz": before * z_, "zaz": z_ * az, "zap": z_ * ap, "rr": r * r, "raz": r * az, "rap": r * ap, "azaz": az * az, "azap": az * ap, "apap": ap * ap}
        held, s = measured(now.join(z, "i"), "cg", **{k: F.sum(c) for k, c in products.items()})
        discard(preconditioned, written)
        written = held
        norms[-1] = s["rr"] ** 0.5  # taken from the vector itself now
        beta = 0.0 if not last else (s["rz"] - s["bz"] if flexible else s["rz"]) / last
        last = s["rz"]
        curve = s["zaz"] + 2 * beta * s["zap"] + beta * beta * curve
        if not curve > 0:
            now, reason = held, "indefinite" if norms[-1] > tol * start else "converged"
            break
        alpha = last / curve
        alphas.append(alpha)
        betas.append(beta)
        p, ap = z_ + F.lit(beta) * F.col("p"), az + F.lit(beta) * ap
        now = held.select("i", (F.col("x") + F.lit(alpha) * p).alias("x"), (r - F.lit(alpha) * ap).alias("r"), r.alias("before"), p.alias("p"), ap.alias("ap"))
        left = s["rr"] - 2 * alpha * (s["raz"] + beta * s["rap"]) + alpha * alpha * (s["azaz"] + 2 * beta * s["azap"] + beta * beta * s["apap"])
        if left <= max(1e-8 * s["rr"], (tol * start) ** 2) or len(norms) >= iters:  # the difference may be rounding only: sum up
            left = now.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        norms.append(max(0.0, left) ** 0.5)
    return Iterations(now.select("i", F.col("x").alias("v")), norms, reason or _ended(norms, tol), alphas, betas)


def truncated_conjugate_gradients(lap: DataFrame, b: DataFrame, precondition: Preconditioner, tol: float = 1e-8, iters: int = 500, directions: int = 5, small: bool = False) -> Iterations:
    """Flexible conjugate gradients that make each new direction conjugate to the last ``directions`` ones, as a
    preconditioner needs that changes much between iterations. An iteration is the preconditioner and one written table."""
    rhs, start = _start(b)
    zero = F.lit(0.0)
    now = rhs.select("i", zero.alias("x"), F.col("v").alias("r"))
    norms, written, reason, curves, alphas, slots = [start], rhs, "", {}, [], []
    while start > 0 and tol * start < norms[-1] <= DIVERGED * start and len(norms) <= iters:
        preconditioned = precondition(now.select("i", F.col("r").alias("v")))
        z = with_product(lap, preconditioned, small).withColumnsRenamed({"v": "z", "av": "az"})
        r, z_, az = F.col("r"), F.col("z"), F.col("az")
        products = {"rz": r * z_, "zaz": z_ * az, "rr": r * r, "raz": r * az, "azaz": az * az}
        for k in slots:
            products |= {f"zap{k}": z_ * F.col(f"ap{k}"), f"rp{k}": r * F.col(f"p{k}"), f"rap{k}": r * F.col(f"ap{k}"), f"azap{k}": az * F.col(f"ap{k}")}
        products |= {f"apap{k}_{m}": F.col(f"ap{k}") * F.col(f"ap{m}") for k in slots for m in slots if k <= m}
        held, s = measured(now.join(z, "i"), "fcg", **{k: F.sum(c) for k, c in products.items()})
        discard(preconditioned, written)
        written = held
        norms[-1] = s["rr"] ** 0.5
        beta = {k: -s[f"zap{k}"] / curves[k] for k in slots}
        curve = s["zaz"] - sum(s[f"zap{k}"] ** 2 / curves[k] for k in slots)
        if not curve > 0:
            now, reason = held, "indefinite" if norms[-1] > tol * start else "converged"
            break
        alpha = (s["rz"] + sum(beta[k] * s[f"rp{k}"] for k in slots)) / curve
        p, ap = z_, az
        for k in slots:
            p, ap = p + F.lit(beta[k]) * F.col(f"p{k}"), ap + F.lit(beta[k]) * F.col(f"ap{k}")
        own = len(alphas)
        alphas.append(alpha)
        raz = s["raz"] + sum(beta[k] * s[f"rap{k}"] for k in slots)
        apap = s["azaz"] + 2 * sum(beta[k] * s[f"azap{k}"] for k in slots) + sum(beta[k] * beta[m] * s[f"apap{min(k, m)}_{max(k, m)}"] for k in slots for m in slots)
        kept = slots[-(directions - 1) :] if directions > 1 else []
        now = held.select("i", (F.col("x") + F.lit(alpha) * p).alias("x"), (r - F.lit(alpha) * ap).alias("r"), p.alias(f"p{own}"), ap.alias(f"ap{own}"), *(c for k in kept for c in (f"p{k}", f"ap{k}")))
        slots, curves[own] = [*kept, own], curve
        left = s["rr"] - 2 * alpha * raz + alpha * alpha * apap
        if left <= max(1e-8 * s["rr"], (tol * start) ** 2) or len(norms) >= iters:  # the difference may be rounding only: sum up
            left = now.agg(F.sum(F.col("r") * F.col("r"))).first()[0] or 0.0
        norms.append(max(0.0, left) ** 0.5)
    return Iterations(now.select("i", F.col("x").alias("v")), norms, reason or _ended(norms, tol), alphas)


def pipelined_conjugate_gradients(lap: DataFrame, b: DataFrame, precondition: Preconditioner, tol: float = 1e-8, iters: int = 500, replace: int = 10, flexible: bool = False, small: bool = False) -> Iterations:
    """Conjugate gradients by pipelined recurrences: the preconditioner and the product of an iteration do not wait for its
    sums, for all vectors that follow from them are carried along. An iteration is the preconditioner and two written
    tables. Every ``replace`` iterations residual, preconditioned residual and products are computed anew, since the
    recurrences drift; with one that changes (``flexible``) they hold for one iteration, and a direction is made conjugate
    to the last one by its product."""
    rhs, start = _start(b)
    norms, alphas, betas, reason = [start], [], [], ""
    if not start > 0:
        return Iterations(rhs.select("i", F.lit(0.0).alias("v")), norms)
    known = materialize(rhs.withColumnRenamed("v", "b"), "pipe_b")
    discard(rhs)
    rhs, zero = known, F.lit(0.0)
    now, held, gamma_before, curve, alpha = None, [], 0.0, 0.0, 0.0
    replace = 1 if flexible else replace
    x = rhs.select("i", zero.alias("x"))
    directions = None
    while tol * start < norms[-1] <= DIVERGED * start and len(norms) <= iters:
        if now is None:  # from the solution so far: r, u = M r, w = A u, and the directions' products
            first = materialize(linalg.residual(lap, x.withColumnRenamed("x", "v"), rhs.withColumnRenamed("b", "v")).withColumnRenamed("v", "r"), "pipe")
            u = precondition(first.withColumnRenamed("r", "v"))
            begun = x.join(first, "i").join(with_product(lap, u, small).withColumnsRenamed({"v": "u", "av": "w"}), "i")
            if directions is None:
                begun = begun.select("*", *(zero.alias(c) for c in ("p", "s", "q", "z")))
            else:
                s = materialize(with_product(lap, directions.withColumnRenamed("p", "v"), small).withColumnsRenamed({"v": "p", "av": "s"}), "pipe")
                q = precondition(s.select("i", F.col("s").alias("v")))
                begun = begun.join(s, "i").join(with_product(lap, q, small).withColumnsRenamed({"v": "q", "av": "z"}), "i")
                held += [s, q]
            now = materialize(begun, "pipe")
            discard(first, u, *held)
            held = [now]
        r, u_, w = F.col("r"), F.col("u"), F.col("w")
        sums = now.agg(F.sum(r * u_).alias("gamma"), F.sum(w * u_).alias("delta"), F.sum(r * r).alias("rr"), F.sum(u_ * F.col("s")).alias("us"), F.sum(r * F.col("p")).alias("rp")).first()
        norms[-1] = sums["rr"] ** 0.5
        if norms[-1] <= tol * start:
            break
        m = precondition(now.select("i", F.col("w").alias("v")))
        n = with_product(lap, m, small).withColumnsRenamed({"v": "m", "av": "n"})
        if flexible:
            beta = -sums["us"] / curve if curve else 0.0
            curve, gamma = sums["delta"] + beta * sums["us"], sums["gamma"] + beta * sums["rp"]
        else:
            gamma = sums["gamma"]
            beta = gamma / gamma_before if gamma_before else 0.0
            curve = sums["delta"] - (beta * gamma / alpha if alpha else 0.0)
        if not curve > 0:
            reason = "indefinite"
            break
        alpha, gamma_before = gamma / curve, gamma
        alphas.append(alpha)
        betas.append(beta)
        a, c = F.lit(alpha), F.lit(beta)
        moved = now.join(n, "i").select("i", "x", "r", "u", "w", (F.col("n") + c * F.col("z")).alias("z"), (F.col("m") + c * F.col("q")).alias("q"), (w + c * F.col("s")).alias("s"), (u_ + c * F.col("p")).alias("p"))
        moved = moved.select("i", (F.col("x") + a * F.col("p")).alias("x"), (r - a * F.col("s")).alias("r"), (u_ - a * F.col("q")).alias("u"), (w - a * F.col("z")).alias("w"), "p", "s", "q", "z")
        after, s = measured(moved, "pipe", rr=F.sum(F.col("r") * F.col("r")))
        discard(m, *held)
        held, now = [after], after
        norms.append(max(0.0, s["rr"]) ** 0.5)
        if len(alphas) % replace == 0 or norms[-1] <= tol * start:  # what the recurrence says is checked against b - A x
            x, directions, now = after.select("i", "x"), after.select("i", "p"), None
            if norms[-1] <= tol * start:
                norms[-1] = float(linalg.norm(linalg.residual(lap, x.withColumnRenamed("x", "v"), rhs.withColumnRenamed("b", "v"))).first()[0])
    found = (now if now is not None else held[-1]).select("i", F.col("x").alias("v"))
    return Iterations(found, norms, reason or _ended(norms, tol), alphas, betas)


def eigenvalue_bound(lap: DataFrame, steps: int = 5, small: bool = False, seed: int = 3) -> float:
    """An upper bound of the eigenvalues of D⁻¹A from the coefficients of ``steps`` iterations of conjugate gradients on a
    fixed vector: the largest eigenvalue of their tridiagonal matrix and the norm of its residual, at most 2, which no
    Laplacian's exceeds."""
    with scratch():
        noise = linalg.vertices(lap).select("i", (hashed_value(F.col("i"), seed) - 0.5).alias("v"))
        noise = materialize(noise.join(linalg.diagonal(lap).withColumnRenamed("v", "d"), "i").select("i", (F.col("v") * F.sqrt("d")).alias("v")), "noise")
        found = conjugate_gradients(lap, noise, jacobi_preconditioner(lap), 1e-12, steps + 1, flexible=False, small=small)
    t, last = lanczos_matrix(found.alphas, found.betas, steps)
    if not len(t):
        return 2.0
    values, vectors = np.linalg.eigh(t)
    return float(min(2.0, values[-1] + last * abs(vectors[-1, -1])))


def lanczos_matrix(alphas: list[float], betas: list[float], steps: int) -> tuple[np.ndarray, float]:
    """The tridiagonal matrix of the first ``steps`` iterations (or as many as there are), and the entry that would follow
    beside its last one (0 where there is no further iteration)."""
    size = min(steps, len(alphas))
    t = np.zeros((size, size))
    for k in range(size):
        t[k, k] = 1 / alphas[k] + (betas[k] / alphas[k - 1] if k else 0.0)
        if k + 1 < size:
            t[k, k + 1] = t[k + 1, k] = max(0.0, betas[k + 1]) ** 0.5 / alphas[k]
    return t, (max(0.0, betas[size]) ** 0.5 / alphas[size - 1] if size and len(betas) > size else 0.0)


def generalised_minimal_residual(lap: DataFrame, b: DataFrame, precondition: Preconditioner, tol: float = 1e-8, iters: int = 500, restart: int = 30, small: bool = False) -> Iterations:
    """Flexible GMRES, restarted: an orthonormal basis of at most ``restart`` columns in one table, and a least-squares
    problem of that size on the driver. An iteration writes two tables; basis vectors are made orthogonal twice."""
    rhs, start = _start(b)
    x, norms = rhs.select("i", F.lit(0.0).alias("v")), [start]
    residual, norm = rhs, start
    while start > 0 and norms[-1] > tol * start and len(norms) <= iters:
        basis, held = residual.select("i", (F.col("v") / F.lit(norm)).alias("q0")), []
        h = np.zeros((restart + 1, restart))
        for k in range(restart):
            z = precondition(basis.select("i", F.col(f"q{k}").alias("v")))
            pair = with_product(lap, z, small).withColumnsRenamed({"v": f"z{k}", "av": "w"})
            w, columns = F.col("w"), [F.col(f"q{m}") for m in range(k + 1)]
            first, dots = measured(basis.join(pair, "i"), "gmres", **{f"d{m}": F.sum(w * q) for m, q in enumerate(columns)})
            less = w - sum((F.lit(dots[f"d{m}"]) * q for m, q in enumerate(columns)), F.lit(0.0))
            again, more = measured(first.withColumn("w", less), "gmres", ww=F.sum(F.col("w") * F.col("w")), **{f"d{m}": F.sum(F.col("w") * q) for m, q in enumerate(columns)})
            less = w - sum((F.lit(more[f"d{m}"]) * q for m, q in enumerate(columns)), F.lit(0.0))
            h[: k + 1, k] = [dots[f"d{m}"] + more[f"d{m}"] for m in range(k + 1)]
            h[k + 1, k] = max(0.0, more["ww"] - sum(more[f"d{m}"] ** 2 for m in range(k + 1))) ** 0.5
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], norm * np.eye(k + 2)[0], rcond=None)
            norms.append(float(np.linalg.norm(norm * np.eye(k + 2)[0] - h[: k + 2, : k + 1] @ y)))
            discard(z, first, *held)
            held = [again]
            basis = again.withColumn(f"q{k + 1}", less / F.lit(h[k + 1, k] or 1.0)).drop("w")
            if norms[-1] <= tol * start or not h[k + 1, k] > 1e-14 * norm or len(norms) > iters:
                break
        step = basis.select("i", sum((F.lit(float(c)) * F.col(f"z{m}") for m, c in enumerate(y)), F.lit(0.0)).alias("v"))
        x = materialize(linalg.axpy(1.0, step, x), "gmres_x")
        residual, s = measured(linalg.axpy(-1.0, linalg.spmv(lap, x, domain=rhs), rhs), "gmres_r", vv=F.sum(F.col("v") * F.col("v")))
        norm = s["vv"] ** 0.5
        if norm > norms[0] * DIVERGED or norm == 0 or not h[k + 1, k] > 1e-14 * norms[0]:
            norms[-1] = norm
            break
        norms[-1] = norm
    return Iterations(x, norms, _ended(norms, tol))


#: Outer methods by name.
METHODS: dict[str, Callable[..., Iterations]] = {
    "cg": lambda *args, **kwargs: conjugate_gradients(*args, flexible=False, **kwargs),
    "fcg": truncated_conjugate_gradients,
    "pipecg": pipelined_conjugate_gradients,
    "pipefcg": partial(pipelined_conjugate_gradients, flexible=True),
    "fgmres": generalised_minimal_residual,
}

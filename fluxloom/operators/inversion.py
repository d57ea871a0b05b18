"""Bayesian inversions: a distributed accumulation of the normal equations, and solves in blocks.

One pass over the observations serves a whole ensemble: the sums depend on the observation error only, every other
hyper-parameter enters at the solve. The n x n system is a table of square blocks; a block Gauss-Jordan elimination over
that table solves all members of an ensemble at once, so no matrix is ever whole in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.session import cut

#: Rows and columns of a block.
BLOCK = 256
_SUMS = "sigma double, I int, J int, nr int, nc int, vals array<double>"
_DOUBLES = T.ArrayType(T.DoubleType())


def normal_equations(obs: DataFrame, n: int, sigmas: list[float], weight: str = "p", block: int = BLOCK) -> DataFrame:
    """sigma, I, J, nr, nc, vals: blocks (row-major) of sum K'K/s2 for each observation error in ``sigmas``; the last
    block column (J = number of blocks, nc = 1) is the right side sum K'dy/s2.

    ``obs`` has k (array of n), dy and ``weight`` (pixels per observation). Each task sums its own rows with one matrix
    product per Arrow batch (its memory is n x n per error); the observations are not moved, and the blocks are added up
    in two steps, so that no task adds more than about the root of all tasks' blocks. A NULL in k or dy is an error in
    the input and raises, as silently dropped rows would bias the result.
    """
    cuts = [(a, min(a + block, n)) for a in range(0, n, block)]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {s: np.zeros((n, n + 1)) for s in sigmas}
        seen = False
        for batch in batches:
            if not len(batch):
                continue
            seen = True
            k = np.stack(batch["k"].to_numpy()).astype(float)
            dy, p = batch["dy"].to_numpy(float), np.maximum(batch["p"].to_numpy(float), 1.0)
            if np.isnan(k).any() or np.isnan(dy).any():
                raise ValueError("missing values in the Jacobian or the mismatch")
            both = np.column_stack([k, dy])
            for s in sigmas:
                error2 = s**2 * (s**2 * (0.45 / p + 0.55) + 4.5**2) / (s**2 + 4.5**2)
                sums[s] += (k / np.where(error2 > 0, error2, 1.0)[:, None]).T @ both
        if seen:
            for s, m in sums.items():
                for r, (a, b) in enumerate(cuts):
                    parts = [(s, r, c, b - a, d - e, m[a:b, e:d].ravel().tolist()) for c, (e, d) in enumerate([*cuts, (n, n + 1)])]
                    yield pd.DataFrame(parts, columns=["sigma", "I", "J", "nr", "nc", "vals"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1][["sigma", "I", "J", "nr", "nc"]].reset_index(drop=True)
        total = np.zeros(len(rows["vals"].iloc[0]))
        for v in rows["vals"]:
            total += v
        out["vals"] = [total.tolist()]
        return out

    parts = obs.select("k", "dy", F.col(weight).cast("double").alias("p")).mapInPandas(partial, _SUMS)
    salted = parts.withColumn("salt", F.spark_partition_id() % F.lit(64))
    return salted.groupBy("sigma", "I", "J", "salt").applyInPandas(added, _SUMS).groupBy("sigma", "I", "J").applyInPandas(added, _SUMS)


@dataclass(frozen=True)
class Layout:
    """What the state vector's elements are: emissions first, then boundary conditions, then OH."""

    n: int
    n_bc: int = 0
    n_oh: int = 0
    n_buffer: int = 0

    @property
    def n_emis(self) -> int:
        return self.n - self.n_bc - self.n_oh

    def kinds(self) -> list[str]:
        return ["emission"] * self.n_emis + ["boundary"] * self.n_bc + ["oh"] * self.n_oh


def lognormal(
    g: np.ndarray, b: np.ndarray, layout: Layout, prior: float, gamma: float, prior_buffer: float = 0.5, prior_bc: float = 10.0, prior_oh: float = 0.5,
    prior_scale: float | None = None, kappa: float = 10.0, tolerance: float = 5e-3, max_rounds: int = 500,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(xhat, posterior variances, kernel diagonal, J_A / n) with lognormal errors on the region's emissions by Levenberg-Marquardt steps, normal ones elsewhere.

    K' = K D with D = diag(x), so every step needs only the sums of the prior Jacobian: one pass over the data. ``b``
    is the right side at the prior (mismatch y - F(xa)). ``prior_scale`` turns the prior from a mean into a median; by
    default it follows from ``prior``. The posterior uses K' of the start of the last step.
    """
    n, m = layout.n, layout.n_emis - layout.n_buffer
    prior_scale = math.exp(-(math.log(prior) ** 2) / 2) if prior_scale is None else prior_scale
    xa = np.r_[np.ones(layout.n_emis), np.zeros(layout.n_bc), np.ones(layout.n_oh)]
    plain = np.r_[np.full(m, np.log(prior) ** 2), np.full(layout.n_buffer, prior_buffer**2), np.full(layout.n_bc, prior_bc**2), np.full(layout.n_oh, prior_oh**2)]
    tight = plain.copy()
    if layout.n_oh:
        tight[n - layout.n_oh :] *= layout.n_oh / max(1, n - m - layout.n_oh)
    full = g @ xa + b  # K'S^-1 (y - background) with F linear
    scale = np.r_[np.full(m, prior_scale), np.ones(n - m)]
    z = np.r_[np.zeros(m), xa[m:]]
    za = z.copy()
    d = np.ones(n)
    for _ in range(max_rounds):
        x = np.r_[np.exp(z[:m]), z[m:]]
        d = np.r_[x[:m], np.ones(n - m)] * scale
        step = np.linalg.solve(gamma * d[:, None] * g * d[None, :] + np.diag((1 + kappa) / tight), gamma * d * (full - g @ (scale * x)) - (z - za) / tight)
        moved = np.max(np.abs(np.expm1(step[:m]))) if m else 0.0
        z = z + step
        if moved < tolerance:
            break
    else:
        raise RuntimeError(f"the lognormal solution has not settled after {max_rounds} rounds")
    h = gamma * d[:, None] * g * d[None, :]
    s_post = np.linalg.inv(h + np.diag(1 / plain))
    x = np.r_[np.exp(z[:m]) * np.exp(np.diag(s_post)[:m] / 2) * prior_scale, z[m:]]
    gap = z[:m] - za[:m]
    return x, np.diag(s_post), np.einsum("ij,ji->i", s_post, h), float(gap @ (gap / plain[:m])) / n


def members(priors: list[float], sigmas: list[float], gammas: list[float], bc: list[float] = (10.0,), oh: list[float] = (0.5,), buffer: list[float] = (0.5,)) -> list[dict]:
    """The hyper-parameters of an ensemble: the product of all errors."""
    names = ("prior_err", "obs_err", "gamma", "prior_err_bc", "prior_err_oh", "prior_err_buffer")
    return [dict(zip(names, map(float, v)), member=k) for k, v in enumerate(product(priors, sigmas, gammas, bc, oh, buffer))]


def _members_table(spark, params: list[dict]) -> DataFrame:
    names = ["member", "prior_err", "obs_err", "gamma", "prior_err_bc", "prior_err_oh", "prior_err_buffer"]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in params], "member int, " + ", ".join(f"{n} double" for n in names[1:]))


def _matrix(vals, rows: int, columns: int) -> np.ndarray:
    return np.asarray(vals, float).reshape(rows, columns)


@F.pandas_udf(_DOUBLES)
def _shifted(vals: pd.Series, gamma: pd.Series, inverse: pd.Series, same: pd.Series) -> pd.Series:
    """gamma times a block, with the inverse prior variances added on the diagonal of the system."""
    out = []
    for v, g, d, on in zip(vals, gamma, inverse, same):
        m = np.asarray(v, float) * g
        if on:
            m[:: len(d) + 1] += np.asarray(d, float)
        out.append(m)
    return pd.Series(out)


@F.pandas_udf(_DOUBLES)
def _inverse(vals: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([np.linalg.inv(_matrix(v, k, k)).ravel() for v, k in zip(vals, n)])


@F.pandas_udf(_DOUBLES)
def _times(a: pd.Series, b: pd.Series, rows: pd.Series, inner: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([(_matrix(x, r, k) @ _matrix(y, k, c)).ravel() for x, y, r, k, c in zip(a, b, rows, inner, columns)])


@F.pandas_udf(_DOUBLES)
def _less(v: pd.Series, a: pd.Series, b: pd.Series, rows: pd.Series, inner: pd.Series, columns: pd.Series) -> pd.Series:
    return pd.Series([(_matrix(w, r, c) - _matrix(x, r, k) @ _matrix(y, k, c)).ravel() for w, x, y, r, k, c in zip(v, a, b, rows, inner, columns)])


def solved(system: DataFrame, keys: list[str], n: int, block: int = BLOCK) -> DataFrame:
    """``system`` (keys, I, J, nr, nc, vals) with the matrix replaced by its inverse and the right side by the solution.

    Block Gauss-Jordan elimination: per block column one join that updates every other block of every system at once.
    The matrices must be symmetric and positive definite, so pivots need no search.
    """
    for k in range(-(-n // block)):
        at_row, at_col = F.col("I") == k, F.col("J") == k
        pivot = system.where(at_row & at_col).select(*keys, _inverse("vals", "nr").alias("p"), F.col("nr").alias("kk"))
        row = system.where(at_row & ~at_col).join(pivot, keys).select(*keys, "I", "J", F.col("kk").alias("nr"), "nc", _times("p", "vals", "kk", "kk", "nc").alias("vals"))
        column = system.where(~at_row & at_col)
        left = column.select(*keys, "I", F.col("vals").alias("c"), F.col("nc").alias("kk"))
        rest = system.where(~at_row & ~at_col).join(row.select(*keys, "J", F.col("vals").alias("r")), [*keys, "J"]).join(left, [*keys, "I"])
        rest = rest.select(*keys, "I", "J", "nr", "nc", _less("vals", "c", "r", "nr", "kk", "nc").alias("vals"))
        below = column.join(pivot, keys).select(*keys, "I", "J", "nr", "nc", _times("vals", "p", "nr", "kk", "kk").alias("vals"))
        below = below.withColumn("vals", F.transform("vals", lambda x: -x))
        own = pivot.select(*keys, F.lit(k).alias("I"), F.lit(k).alias("J"), F.col("kk").alias("nr"), F.col("kk").alias("nc"), F.col("p").alias("vals"))
        system = cut(rest.unionByName(row).unionByName(below).unionByName(own))
    return system


def _variance(layout: Layout, element: Column, weighted: bool) -> Column:
    """Prior variance of an element (from 0): emissions, then boundaries, then OH, whose constraint is weighted by its
    share of the state vector."""
    e = layout.n_emis
    oh = F.col("prior_err_oh") ** 2 * (layout.n_oh / (layout.n - layout.n_oh) if weighted and layout.n_oh else 1.0)
    return F.when(element < e, F.col("prior_err") ** 2).when(element < e + layout.n_bc, F.col("prior_err_bc") ** 2).otherwise(oh)


def gaussian(equations: DataFrame, layout: Layout, params: list[dict], block: int = BLOCK) -> DataFrame:
    """member, element (from 1), xhat, s_post_diag, a_diag, penalty of every member: maximum a posteriori scale factors.

    The OH elements are constrained with a variance weighted by their share of the state vector, but their posterior
    error uses the plain one. Boundary elements are concentrations and are not shifted by 1. ``penalty`` is the
    element's part of J_A. All members are solved together, in blocks.
    """
    spark = equations.sparkSession
    which = [True, False] if layout.n_oh else [False]
    table = _members_table(spark, params).withColumn("weighted", F.explode(F.array(*map(F.lit, which))))
    rows = equations.join(F.broadcast(table), F.col("sigma") == F.col("obs_err"))  # bounded by the parameters named
    at = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.col("I") * block + r)
    inverse = F.when(F.col("weighted"), F.transform(at, lambda e: 1 / _variance(layout, e, True))).otherwise(F.transform(at, lambda e: 1 / _variance(layout, e, False)))
    keys = ["member", "weighted"]
    system = rows.select(*keys, "I", "J", "nr", "nc", _shifted("vals", "gamma", inverse, F.col("I") == F.col("J")).alias("vals"))
    done = solved(cut(system), keys, layout.n, block)
    last = -(-layout.n // block)
    delta = done.where((F.col("J") == last) & (F.col("weighted") == which[0])).select("member", "I", F.posexplode("vals").alias("r", "delta"))
    diagonal = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.col("vals")[r * (F.col("nc") + 1)])
    s_post = done.where((F.col("I") == F.col("J")) & ~F.col("weighted")).select("member", "I", F.posexplode(diagonal).alias("r", "s_post_diag"))
    out = delta.join(s_post, ["member", "I", "r"]).join(F.broadcast(_members_table(spark, params)), "member")
    e = F.col("I") * block + F.col("r")
    plain = _variance(layout, e, False)
    shift = F.when((e >= layout.n_emis) & (e < layout.n_emis + layout.n_bc), 0.0).otherwise(1.0)
    return out.select("member", (e + 1).cast("int").alias("element"), (F.col("delta") + shift).alias("xhat"), "s_post_diag", (1 - F.col("s_post_diag") / plain).alias("a_diag"), (F.col("delta") ** 2 / plain / layout.n).alias("penalty"))


def lognormal_members(equations: DataFrame, layout: Layout, params: list[dict], block: int = BLOCK) -> DataFrame:
    """As ``gaussian`` with ``lognormal`` errors on the region's emissions: members are solved beside each other, each by
    one task, whose memory is n x n. ``penalty`` is spread evenly over the elements."""
    by_member = {p["member"]: p for p in params}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = by_member[int(rows["member"].iloc[0])]
        whole = np.zeros((layout.n, layout.n + 1))
        for i, j, nr, nc, v in zip(rows["I"], rows["J"], rows["nr"], rows["nc"], rows["vals"]):
            whole[i * block : i * block + nr, min(j * block, layout.n) : min(j * block, layout.n) + nc] = _matrix(v, nr, nc)
        x, s, a, ja = lognormal(whole[:, :-1], whole[:, -1], layout, p["prior_err"], p["gamma"], p["prior_err_buffer"], p["prior_err_bc"], p["prior_err_oh"])
        return pd.DataFrame({"member": p["member"], "element": np.arange(1, layout.n + 1), "xhat": x, "s_post_diag": s, "a_diag": a, "penalty": ja / layout.n})

    table = F.broadcast(_members_table(equations.sparkSession, params).select("member", "obs_err"))
    rows = equations.join(table, F.col("sigma") == F.col("obs_err")).drop("sigma", "obs_err")
    return rows.groupBy("member").applyInPandas(run, "member int, element int, xhat double, s_post_diag double, a_diag double, penalty double")


def ensemble_summary(elements: DataFrame, params: list[dict], n_roi: int) -> DataFrame:
    """The hyper-parameters of every member with ja_normalized, dofs (of all elements), dofs_roi (of the first ``n_roi``)
    and is_default (J_A / n nearest 1, the first on ties)."""
    per = elements.groupBy("member").agg(F.sum("penalty").alias("ja_normalized"), F.sum("a_diag").alias("dofs"), F.sum(F.when(F.col("element") <= n_roi, F.col("a_diag"))).alias("dofs_roi"))
    best = per.agg(F.min_by("member", F.struct(F.abs(F.col("ja_normalized") - 1), "member")).alias("default"))
    out = per.join(F.broadcast(_members_table(elements.sparkSession, params)), "member").join(F.broadcast(best), F.col("member") == F.col("default"), "left")
    return out.withColumn("is_default", F.col("default").isNotNull()).drop("default")


def ensemble_totals(elements: DataFrame, emissions: DataFrame) -> DataFrame:
    """One row: members, mean and population deviation of their total emissions; ``emissions`` has element, tg (prior).

    Elements without emissions (boundaries, OH) add nothing.
    """
    totals = elements.join(emissions, "element").groupBy("member").agg(F.sum(F.col("xhat") * F.col("tg")).alias("total"))
    return totals.agg(F.count("*").alias("members"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("sd"))


def rescaled_jacobian(k, reference_effective, effective, target, reference_target):
    """Rows of a reference Jacobian scaled to other perturbations, element by element; missing tail elements keep 1."""
    ratio = F.zip_with(reference_effective, effective, lambda r, e: r / e * (target / reference_target))
    return F.zip_with(k, ratio, lambda x, r: x * F.coalesce(r, F.lit(1.0)))

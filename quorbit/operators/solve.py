"""Lowest eigenpairs by Davidson and Lanczos.

The loop runs on the driver. The whole subspace is one table, a row for each
state: its diagonal element and arrays of its components in the vectors and in
their images. So linear combinations are projections, all inner products of a
step are one aggregation, and only the operator itself needs a join. Each step's
table is checkpointed.

An operator is a table of edges (bra, ket, h), or a function that takes (det, values)
rows and names of values to the same of their images, as the product form has.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.functions import complex as X
from quorbit.functions.exact import exact_sums
from quorbit.operators.apply import start_vector
from quorbit.operators.edges import hop_edges
from quorbit.session import cut, cut_by


@dataclass
class Solution:
    energy: float
    vector: DataFrame
    residual: float
    history: list[float] = field(default_factory=list)
    energies: list[float] = field(default_factory=list)
    vectors: list[DataFrame] = field(default_factory=list)
    applications: int = 0


Images = Callable[[DataFrame, list[str]], DataFrame]


def stored(edges: DataFrame) -> Images:
    """The operator of an edge table, which is dealt by ket once; a step moves only the vectors to it, and partial sums back."""
    dealt = cut_by(edges.select("bra", "ket", "h"), "ket")

    def images(kets: DataFrame, values: list[str]) -> DataFrame:
        sums = [F.sum(F.col("h") * F.col(v)).alias(v) for v in values]
        return dealt.join(kets.withColumnRenamed("det", "ket"), "ket").groupBy(F.col("bra").alias("det")).agg(*sums)

    return images


def hopping(width: int, h: Column, diagonal: Column) -> Images:
    """The operator of moves with elements ``h`` (of i, a and ket), and of a ``diagonal`` (of det); symmetric if these are.

    Its edges are made from deletion keys in each step and summed by bra where they are
    made, so none is stored or shuffled: a step sends rows for states and their occupied sites.
    """

    def images(kets: DataFrame, values: list[str]) -> DataFrame:
        moved = hop_edges(kets, width, values).select(F.col("bra").alias("det"), *[(h * F.col(v)).alias(v) for v in values])
        stayed = kets.select("det", *[(diagonal * F.col(v)).alias(v) for v in values])
        return moved.unionByName(stayed).groupBy("det").agg(*[F.sum(v).alias(v) for v in values])

    return images


def _mix(column: str, weights: list[float]) -> Column:
    total = F.lit(0.0)
    for k, w in enumerate(weights):
        total = total + F.col(column)[k] * F.lit(float(w))
    return total


def _plain_sums(rows: DataFrame, *values: Column) -> list[float]:
    return [float(x or 0.0) for x in rows.agg(*[F.sum(v) for v in values]).first()]


class Subspace:
    """Orthonormal vectors ``v`` and their images ``w``, as arrays by state."""

    def __init__(self, operator: DataFrame | Images, starts: list[DataFrame], diagonal: DataFrame | None = None, exact: bool = False):
        self.sums = exact_sums if exact else _plain_sums
        self.operator = stored(operator) if isinstance(operator, DataFrame) else operator
        self.applications = 0
        table = starts[0].select("det", F.array("c").alias("v"))
        for other in starts[1:]:
            more = other.select("det", F.col("c").alias("_c"))
            table = table.join(more, "det").select("det", F.concat("v", F.array("_c")).alias("v"))
        if diagonal is None:
            table = table.withColumn("h", F.lit(0.0))
        else:  # states without a diagonal row have a zero there
            table = table.join(diagonal.select("det", "h"), "det", "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
        self.table = cut(table.withColumn("w", F.array().cast("array<double>")).select("det", "h", "v", "w"))
        gram = self._gram("v", range(len(starts)), range(len(starts)))
        values, vectors = np.linalg.eigh(gram)
        if not (values > 1e-20).any():
            raise ValueError("a zero vector has no direction")
        sharp = [(vectors[:, k] / math.sqrt(values[k])).tolist() for k in reversed(range(len(values))) if values[k] > 1e-12 * values[-1]]
        self.table = self.table.withColumn("v", F.array(*[_mix("v", m) for m in sharp]))
        self.size, self.images = len(sharp), 0

    def _gram(self, right: str, rows: range, columns: range) -> np.ndarray:
        products = [F.col("v")[i] * F.col(right)[j] for i in rows for j in columns]
        return np.array(self.sums(self.table, *products), float).reshape(len(rows), len(columns))

    def apply(self) -> np.ndarray:
        """Adds the missing images, and returns the vectors' products with them."""
        new = range(self.images, self.size)
        kets = self.table.select("det", *[F.col("v")[k].alias(f"w{k}") for k in new])
        made = self.operator(kets, [f"w{k}" for k in new])
        self.applications += 1
        joined = self.table.join(made, "det", "left")
        self.table = cut(joined.select("det", "h", "v", F.concat("w", F.array(*[F.coalesce(f"w{k}", F.lit(0.0)) for k in new])).alias("w")))
        self.images = self.size
        return self._gram("w", range(self.size), new)

    def against(self, vector: Column, beside: Column | None = None) -> list[float]:
        """The square of ``beside``, or of ``vector``, and the vectors' products with ``vector``, in one aggregation."""
        beside = vector if beside is None else beside
        return self.sums(self.table, beside * beside, *[F.col("v")[k] * vector for k in range(self.size)])

    def append(self, vector: Column, least: float = 1e-10, dots: list[float] | None = None) -> float:
        """Adds the part of ``vector`` that is orthogonal to all, found in two passes, of which ``dots`` may be the first.

        Returns its length, under which nothing is added.
        """
        self.table = self.table.withColumn("t", vector - _mix("v", dots or self.against(vector)[1:]))
        square, *dots = self.against(F.col("t"))
        self.table = self.table.withColumn("t", F.col("t") - _mix("v", dots))
        length = math.sqrt(max(square - sum(d * d for d in dots), 0.0))
        if length > least:
            self.table = self.table.withColumn("v", F.concat("v", F.array(F.col("t") / F.lit(length))))
            self.size += 1
        self.table = self.table.drop("t")
        return length

    def residuals(self, mixes: list[list[float]], energies: list[float], regular: float) -> list[tuple[Column, float, list[float]]]:
        """For each combination its preconditioned residual, the residual's norm, and the vectors' products with the former: one aggregation."""
        made, sums = [], []
        for mix, energy in zip(mixes, energies, strict=True):
            down = F.lit(energy) - F.col("h")
            rest = self.residual(mix, energy)
            made.append(rest / F.when(F.abs(down) < regular, F.lit(regular)).otherwise(down))
            sums += [rest * rest, *[F.col("v")[k] * made[-1] for k in range(self.size)]]
        found = self.sums(self.table, *sums)
        each = self.size + 1
        return [(m, math.sqrt(found[i * each]), found[i * each + 1 : (i + 1) * each]) for i, m in enumerate(made)]

    def residual(self, mix: list[float], energy: float) -> Column:
        return _mix("w", mix) - F.lit(energy) * _mix("v", mix)

    def residual_norm(self, mix: list[float], energy: float) -> float:
        r = self.residual(mix, energy)
        return math.sqrt(self.sums(self.table, r * r)[0])

    def restart(self, mixes: list[list[float]]) -> None:
        """Keeps these orthonormal combinations alone; their images are the images' combinations, so nothing is applied anew."""
        both = [F.array(*[_mix(c, m) for m in mixes]).alias(c) for c in ("v", "w")]
        self.table = cut(self.table.select("det", "h", *both))
        self.size = self.images = len(mixes)

    def vector(self, mix: list[float]) -> DataFrame:
        return cut(self.table.select("det", _mix("v", mix).alias("c")))


def davidson(operator: DataFrame | Images, diagonal: DataFrame, start: DataFrame | list[DataFrame], eps: float = 1e-4, restarts: int = 1, block: int = 10, regular: float = 1e-12, max_time: float | None = None, wanted: int = 1, keep: int | None = None, exact: bool = False) -> Solution:
    """The ``wanted`` lowest states; stops where all their residual norms are under ``eps``.

    Several start vectors open the first subspace together. A step adds a vector
    for each state that is not there yet, and applies the operator to all of them
    in one pass. At ``block`` vectors it begins again from the ``keep`` lowest
    combinations, as many as there were start vectors, or states wanted, unless told.
    ``exact`` takes inner products by sums that do not depend on the order of rows,
    in a second pass over the subspace.
    """
    starts = start if isinstance(start, list) else [start]
    keep = keep or max(wanted, len(starts))
    if keep >= block and restarts > 1:
        raise ValueError(f"{block} vectors leave no room beside {keep} that a restart keeps")
    space, began, history = Subspace(operator, starts, diagonal, exact), time.time(), []
    energies: list[float] = []
    for turn in range(max(restarts, 1)):
        if turn:
            space.restart(mixes[:keep])
        small = np.diag(energies[:keep]) if turn else np.zeros((0, 0))
        while True:
            if space.images < space.size:
                old, products = len(small), space.apply()
                small = np.pad(small, (0, space.size - old))
                small[:, old:] = products
                small[old:, :] = products.T
            values, vectors = np.linalg.eigh((small + small.T) / 2)
            energies, mixes = [float(v) for v in values], vectors.T.tolist()
            history.append(energies[0])
            made = space.residuals(mixes[:wanted], energies[:wanted], regular)
            spent = time.time() - began
            late = max_time is not None and spent + spent / len(history) > max_time
            done = len(made) == wanted and all(size < eps for _, size, _ in made)
            if done or late or space.size >= block:
                break
            added = 0
            for rest, size, dots in made:
                if size >= eps and space.size < block:
                    added += space.append(rest, dots=None if added else dots) > 1e-10
            if not added:
                break
        if done or late:
            break
    found = [space.vector(m) for m in mixes[:wanted]]
    return Solution(energies[0], found[0], made[0][1], history, energies[:wanted], found, space.applications)


def lanczos(operator: DataFrame | Images, start: DataFrame, eps: float = 1e-8, most: int = 60, exact: bool = False) -> Solution:
    """Stops where the energy moves, or the next vector's length is, under ``eps``; two Gram-Schmidt passes a step."""
    space, alpha, beta, history = Subspace(operator, [start], exact=exact), [], [], []
    while True:
        alpha.append(float(space.apply()[-1, -1]))
        values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
        mix = vectors[:, 0].tolist()
        history.append(float(values[0]))
        if len(history) >= most or len(history) > 1 and abs(history[-1] - history[-2]) < eps:
            break
        if (length := space.append(F.col("w")[space.size - 1], eps)) <= eps:
            break
        beta.append(length)
    return Solution(history[-1], space.vector(mix), space.residual_norm(mix, history[-1]), history)


def real_edges(edges: DataFrame) -> DataFrame:
    """Edges of a complex Hermitian operator as those of a real symmetric one on parts of states: 0 the real part, 1 the imaginary one."""
    part = lambda name, k: F.struct(F.col(name).alias("det"), F.lit(k).alias("part")).alias(name)
    entries = ((0, 0, F.col("h.re")), (1, 1, F.col("h.re")), (0, 1, -F.col("h.im")), (1, 0, F.col("h.im")))
    made = [edges.select(part("bra", b), part("ket", k), h.alias("h")) for b, k, h in entries]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3]).filter("h <> 0 or bra = ket")


def real_vector(x: DataFrame) -> DataFrame:
    c = X.as_complex(F.col("c"), X.is_complex(x, "c"))
    parts = F.array(F.struct(F.lit(0).alias("part"), c["re"].alias("c")), F.struct(F.lit(1).alias("part"), c["im"].alias("c")))
    return x.withColumn("_p", F.explode(parts)).select(F.struct("det", "_p.part").alias("det"), F.col("_p.c").alias("c"))


def complex_vector(x: DataFrame) -> DataFrame:
    held = lambda k: F.sum(F.when(F.col("det.part") == k, F.col("c")).otherwise(0.0))
    return x.groupBy(F.col("det.det").alias("det")).agg(X.make(held(0), held(1)).alias("c"))


def ground_state(edges: DataFrame | Images, basis: DataFrame, method: str = "davidson", seed: int = 1, n_start: int = 1, start: DataFrame | None = None, diagonal: DataFrame | None = None, **options) -> Solution:  # noqa: ANN003
    """From ``start``, or random vectors; an operator that is no edge table comes with its ``diagonal``.

    A complex operator is solved as the real one of twice the size, in which each
    level is there twice; vectors are complex again in the result.
    """
    if isinstance(edges, DataFrame) and X.is_complex(edges, "h"):
        first = start if start is not None else start_vector(basis, "random", seed)
        options |= {"keep": max(2, n_start)} if method == "davidson" and options.get("block", 10) > 2 else {}
        found = ground_state(cut(real_edges(edges)), real_vector(first), method, seed, n_start, real_vector(first), None, **options)
        found.vector, found.vectors = complex_vector(found.vector), [complex_vector(v) for v in found.vectors]
        return found
    if method == "lanczos":
        return lanczos(edges, start_vector(basis, "random", seed) if start is None else start, **options)
    starts = [start] if start is not None else []
    starts += [start_vector(basis, "random", seed + k) for k in range(n_start - len(starts))]
    if diagonal is None:
        diagonal = edges.filter("bra = ket").select(F.col("bra").alias("det"), "h")
    return davidson(edges, diagonal, starts, **options)

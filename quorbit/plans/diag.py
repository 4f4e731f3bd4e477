"""The drivers: from files or tables to energies, densities and the next basis."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.operators import expand, observe, select
from quorbit.operators.algebra import Operator, term_table
from quorbit.operators.apply import normalized, start_vector
from quorbit.operators.edges import match_checkpoint
from quorbit.operators.elements import Integrals, integral_edges, operator_edges
from quorbit.operators.product import ProductOperator
from quorbit.operators.solve import Images, Solution, ground_state
from quorbit.session import cut
from quorbit.sources.files import load_wavefunction
from quorbit.sources.generate import product_states


METHODS, INITS, CARRYOVERS = ("davidson", "lanczos"), ("random", "first"), ("top", "threshold", "random")


@dataclass(frozen=True)
class Options:
    """What changes results; layout is Spark's affair."""

    method: str = "davidson"
    eps: float = 1e-4
    restarts: int = 1
    block: int = 10
    seed: int = 1
    max_time: float | None = None
    rdm: bool = False
    carryover: int = 0
    threshold: float = 0.01
    heatbath_cutoff: float = 1e-4
    init: str = "random"
    initial: int | list[int] | None = None
    load: str | None = None
    vectors: int = 1
    carryover_type: str = "top"
    ratio: float | None = None
    saved: DataFrame | None = None

    def __post_init__(self) -> None:
        for value, known in ((self.method, METHODS), (self.init, INITS), (self.carryover_type, CARRYOVERS)):
            if value not in known:
                raise ValueError(f"{value} is none of {', '.join(known)}")

    @property
    def carries(self) -> bool:
        return bool(self.carryover or self.ratio or self.carryover_type == "threshold")


@dataclass
class Result:
    energy: float
    solution: Solution
    occupation: DataFrame
    carryover: DataFrame | None = None
    expanded: DataFrame | None = None
    discarded: float = 0.0
    extra: dict = field(default_factory=dict)


def _start(basis: DataFrame, o: Options) -> DataFrame | None:
    """The first start vector where the options name one: saved, on a given state, or on the first; else random ones are drawn."""
    if o.saved is not None:
        return normalized(match_checkpoint(basis, o.saved))
    if o.load:
        return load_wavefunction(basis.sparkSession, o.load, basis)
    if o.initial is not None:
        return start_vector(basis, "given", det=o.initial)
    return start_vector(basis, "first") if o.init == "first" else None


def _solve(operator: DataFrame | Images, basis: DataFrame, o: Options, diagonal: DataFrame | None = None) -> Solution:
    start = _start(basis, o)
    if o.method == "lanczos":
        return ground_state(operator, basis, "lanczos", o.seed, start=start, eps=o.eps, most=o.block * max(1, o.restarts))
    return ground_state(operator, basis, "davidson", o.seed, o.vectors, start, diagonal, eps=o.eps, restarts=o.restarts, block=o.block, max_time=o.max_time)


def carried(wave: DataFrame, o: Options) -> tuple[DataFrame, float]:
    """The states that go on, and the weight that is left out.

    ``top``: the ``carryover`` of greatest weight, or that ``ratio`` of all, if it is
    given; ``threshold``: those with |c|^2 over it; ``random``: as many as for ``top``, by a seeded order.
    """
    if o.carryover_type == "threshold":
        kept = select.truncated(wave, o.threshold)
        return kept, 1 - weight(kept) / weight(wave)
    k = math.ceil(o.ratio * wave.count()) if o.ratio else o.carryover
    if o.carryover_type == "top":
        return select.top_states(wave, k)
    kept = cut(select.shuffled(wave, o.seed).filter(F.col("position") < k).drop("position"))
    return kept, 1 - weight(kept) / weight(wave)


def weight(wave: DataFrame) -> float:
    return float(wave.agg(F.sum(select.weight_of(wave))).first()[0] or 0.0)


def determinants(basis: DataFrame, ints: Integrals, o: Options = Options(), product: ProductOperator | None = None) -> Result:
    """Selected determinants with integrals; on the ``product`` form, if their halves' pairs are all there."""
    if product is None:
        found = _solve(cut(integral_edges(basis, ints)), basis, o)
    else:
        found = _solve(product.images, basis, o, product.diagonal(basis))
    wave, width = found.vector, 2 * ints.norb
    out = Result(found.energy, found, observe.occupation(wave, width))
    if o.rdm:
        one, two = cut(observe.one_rdm(wave, width)), cut(observe.two_rdm(wave, width))
        out.extra = {"one": one, "two": two, "energy": observe.rdm_energy(one, two, ints)}
    if o.carries:
        out.carryover, out.discarded = carried(wave, o)
        out.expanded = expand.integral_expansion(out.carryover, ints, o.heatbath_cutoff)
    return out


def tensor(alpha: DataFrame, beta: DataFrame, ints: Integrals, o: Options = Options()) -> Result:
    """Every pair of an alpha and a beta half, on moves of halves; the carryover are halves by marginal weight."""
    basis = cut(product_states(alpha, beta, ints.norb))
    out = determinants(basis.select("det"), ints, o, ProductOperator(alpha, beta, ints))
    wave = out.solution.vector.withColumn("adet", B.alpha_of("det", ints.norb)).withColumn("bdet", B.beta_of("det", ints.norb))
    out.extra["halves"] = {h: select.weight_cut(observe.marginal(wave, h), "p", h, 1 - o.threshold) for h in ("adet", "bdet")}
    return out


def operators(spark: SparkSession, basis: DataFrame, operator: Operator, width: int, o: Options = Options()) -> Result:
    """Arbitrary ladder operators, also complex ones, on states of plain sites, also more than 62."""
    terms = cut(term_table(spark, operator, width))
    edges = cut(operator_edges(basis, terms, operator.fermion))
    found = _solve(edges, basis, o)
    held = found.vector.select(F.explode(B.keys(basis).sites("det", width)).alias("site"), select.weight_of(found.vector).alias("w"))
    density = held.groupBy("site").agg(F.sum("w").alias("n"))
    out = Result(found.energy, found, density)
    if o.carries:
        out.carryover, out.discarded = carried(select.truncated(found.vector, 0.0), o)
        out.expanded = expand.operator_expansion(out.carryover, terms, operator.fermion, o.heatbath_cutoff)
    return out

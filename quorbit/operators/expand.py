"""Growing a basis."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.functions import complex as X
from quorbit.operators.elements import Integrals, apply_terms, doubles, singles
from quorbit.operators.select import truncated
from quorbit.session import cut, observed


def half_moves(halves: DataFrame, width: int, order: int = 1, name: str = "det") -> DataFrame:
    """(det, bra) for all single, or double, moves of each half state."""
    state = halves.select(F.col(name).alias("det"))
    k = B.keys(state)
    out = state.withColumn("i", F.explode(k.sites("det", width))).withColumn("a", F.explode(k.sites("det", width, 0)))
    if order == 1:
        return out.select("det", k.flip("det", F.col("i"), F.col("a")).alias("bra"))
    out = out.withColumn("j", F.explode(k.sites("det", width))).filter("i < j").withColumn("b", F.explode(k.sites("det", width, 0))).filter("a < b")
    return out.select("det", k.flip("det", *(F.col(c) for c in "iajb")).alias("bra"))


def labelled_moves(states: DataFrame, width: int, order: int = 1, name: str = "det") -> DataFrame:
    """(det, bra, i, a, spin) of single moves from i to a on spin-orbitals in turn, each within its spin.

    Of double ones (det, bra, i, j, a, b, spin): i < j, a < b, and spin 0 for two alpha, 1 for
    two beta electrons and 2 for one of each.
    """
    state = states.select(F.col(name).alias("det"))
    k = B.keys(state)
    out = state.withColumn("i", F.explode(k.sites("det", width))).withColumn("a", F.explode(k.sites("det", width, 0)))
    if order == 1:
        return out.filter("i % 2 = a % 2").select("det", k.flip("det", F.col("i"), F.col("a")).alias("bra"), "i", "a", (F.col("i") % 2).cast("int").alias("spin"))
    out = out.withColumn("j", F.explode(k.sites("det", width))).filter("i < j").withColumn("b", F.explode(k.sites("det", width, 0))).filter("a < b and i % 2 + j % 2 = a % 2 + b % 2")
    spin = F.when(F.col("i") % 2 != F.col("j") % 2, 2).otherwise(F.col("i") % 2).cast("int")
    return out.select("det", k.flip("det", *(F.col(c) for c in "iajb")).alias("bra"), "i", "j", "a", "b", spin.alias("spin"))


def singles_extended(halves: DataFrame, width: int, name: str = "det") -> DataFrame:
    """The halves and all their single moves, once each."""
    own = halves.select(F.col(name).alias("det"))
    return own.unionByName(half_moves(halves, width, 1, name).select(F.col("bra").alias("det"))).distinct()


def important_halves(wave: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Halves of states with |c|^2 over the threshold."""
    held = truncated(wave, threshold)
    return held.select("adet").distinct(), held.select("bdet").distinct()


def important_half_counts(wave: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The same with ``n``: in how many of these states each half is."""
    held = truncated(wave, threshold)
    return tuple(held.groupBy(h).agg(F.count("*").alias("n")) for h in ("adet", "bdet"))


def counted_expansion(wave: DataFrame, terms: DataFrame, fermion: bool, cutoff: float, truncation: float = 0.0) -> tuple[DataFrame, dict[str, int]]:
    """``operator_expansion`` and what its steps made: parents, generated, accepted and states. Counted on the way, within the one job that makes it."""
    seen = {name: Observation(name) for name in ("parents", "generated", "accepted")}
    count = lambda df, name: df.observe(seen[name], F.count(F.lit(1)).alias("n"))
    parents, made = _expanded(wave, terms, fermion, cutoff, truncation, count)
    states = cut(parents.unionByName(made).distinct())
    return states, {name: observed(o, "n")["n"] for name, o in seen.items()} | {"states": states.count()}


def operator_expansion(wave: DataFrame, terms: DataFrame, fermion: bool, cutoff: float, truncation: float = 0.0) -> DataFrame:
    """Heat bath on terms: parents, and the states that a term with |coef| |c| over the cutoff reaches."""
    parents, made = _expanded(wave, terms, fermion, cutoff, truncation)
    return parents.unionByName(made).distinct()


def _expanded(wave: DataFrame, terms: DataFrame, fermion: bool, cutoff: float, truncation: float, count: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    parents = truncated(wave, truncation)
    off, of_terms, of_wave = terms.filter("not is_diag"), X.is_complex(terms, "coef"), X.is_complex(wave, "c")
    weight = X.size(F.col("c"), of_wave)
    heavy = parents.filter(weight > 0).withColumn("least", F.lit(cutoff) / weight)
    made = count(apply_terms(heavy.select("det", "least"), off.filter(X.size(F.col("coef"), of_terms) > 0), fermion), "generated")
    kept = count(made.filter(X.size(F.col("h"), of_terms) > F.col("least")), "accepted")
    return count(parents.select("det"), "parents"), kept.select(F.col("bra").alias("det"))


def integral_expansion(wave: DataFrame, ints: Integrals, cutoff: float, variant: str = "integral") -> DataFrame:
    """Heat bath on determinants: |H| |c| over the cutoff; parents always stay.

    ``integral`` prunes doubles by their integral within the join, before moves
    are tested for room; ``exhaustive`` tests each element afterwards. Both give
    the same set, as a double's element is its integral up to a sign.
    """
    weights = wave.select("det", "c").filter("c <> 0")
    limit = F.lit(cutoff) / F.abs("c")
    one = singles(weights, ints).join(weights, "det").filter(F.abs(F.col("h")) > limit)
    two = doubles(weights, ints, limit if variant == "integral" else None).filter(F.abs(F.col("h")) > limit)
    made = one.select("bra").unionByName(two.select("bra")).select(F.col("bra").alias("det"))
    return wave.select("det").unionByName(made).distinct()

"""Densities and reduced density matrices, in sparse long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.functions import complex as X
from quorbit.operators.edges import hamming_edges
from quorbit.operators.elements import Integrals


def occupation(wave: DataFrame, width: int) -> DataFrame:
    """(orbital, spin, n): sum of c^2 over states that hold spin-orbital 2 orbital + spin."""
    square = X.square(F.col("c")) if X.is_complex(wave, "c") else F.col("c") * F.col("c")
    held = wave.select(F.explode(B.keys(wave).sites("det", width)).alias("i"), square.alias("w"))
    return held.groupBy(F.shiftright("i", 1).alias("orbital"), (F.col("i") % 2).alias("spin")).agg(F.sum("w").alias("n"))


def marginal(wave: DataFrame, half: str) -> DataFrame:
    return wave.groupBy(half).agg(F.sum(F.col("c") * F.col("c")).alias("p"))


def one_rdm(wave: DataFrame, width: int) -> DataFrame:
    """(p, q, v) = <a+_p a_q> over spin-orbitals, by removing one electron: states with the same rest meet."""
    k = B.keys(wave)
    cut = wave.select("c", "det", F.explode(k.sites("det", width)).alias("p"))
    cut = cut.select("p", k.flip("det", F.col("p")).alias("rest"), (F.col("c") * k.string_sign("det", F.col("p"))).alias("c"))
    other = cut.select(F.col("p").alias("q"), "rest", F.col("c").alias("d"))
    return cut.join(other, "rest").filter("p % 2 = q % 2").groupBy("p", "q").agg(F.sum(F.col("c") * F.col("d")).alias("v"))


def two_rdm(wave: DataFrame, width: int) -> DataFrame:
    """(p, q, r, s, v) = <a+_p a+_q a_s a_r> for p < q and r < s, by removing two electrons."""
    k = B.keys(wave)
    cut = wave.select("c", "det", F.explode(k.sites("det", width)).alias("p")).withColumn("q", F.explode(k.sites("det", width))).filter("p < q")
    one = k.flip("det", F.col("p"))
    sign = k.string_sign("det", F.col("p")) * k.string_sign(one, F.col("q"))
    cut = cut.select("p", "q", k.flip(one, F.col("q")).alias("rest"), (F.col("c") * sign).alias("c"))
    other = cut.select(F.col("p").alias("r"), F.col("q").alias("s"), "rest", F.col("c").alias("d"))
    return cut.join(other, "rest").groupBy("p", "q", "r", "s").agg(F.sum(F.col("c") * F.col("d")).alias("v"))


def rdm_energy(one: DataFrame, two: DataFrame, ints: Integrals) -> float:
    """Core + one- and two-electron parts, recomposed from density matrices and integrals."""
    h = ints.one.select("p", "q", F.col("v").alias("h"))
    first = one.join(h, ["p", "q"]).agg(F.sum(F.col("v") * F.col("h"))).first()[0] or 0.0
    pair = ints.direct.select("p", "q", F.col("v").alias("g"))
    same = two.filter("p = r and q = s").join(pair, ["p", "q"]).agg(F.sum(F.col("v") * F.col("g"))).first()[0] or 0.0
    # p, q -> r, s with one shared spin-orbital, whose elements are the single table's
    moves = _as_moves(two.filter("not (p = r and q = s)"))
    single = ints.single.select(F.col("i").alias("i"), "a", "j", F.col("v").alias("g"))
    shared = moves.filter("j = b").join(single, ["i", "a", "j"]).agg(F.sum(F.col("v") * F.col("g"))).first()[0] or 0.0
    double = ints.double.select(F.col("i").alias("r"), F.col("j").alias("s"), F.col("a").alias("p"), F.col("b").alias("q"), F.col("v").alias("g"))
    both = two.join(double, ["p", "q", "r", "s"]).agg(F.sum(F.col("v") * F.col("g"))).first()[0] or 0.0
    return float(ints.core + first + same + shared + both)


def _as_moves(two: DataFrame) -> DataFrame:
    """Entries that share one index, as i -> a beside j = b, with the sign of that order."""
    out = None
    for left, right, sign in (("p", "r", 1), ("p", "s", -1), ("q", "r", -1), ("q", "s", 1)):
        other_left, other_right = "q" if left == "p" else "p", "s" if right == "r" else "r"
        part = two.filter(f"{left} = {right}").select(
            F.col(other_right).alias("i"), F.col(other_left).alias("a"), F.col(right).alias("j"), F.col(left).alias("b"), (F.col("v") * sign).alias("v")
        )
        out = part if out is None else out.unionByName(part)
    return out


def neighbours_sum(wave: DataFrame, distance: int = 2) -> DataFrame:
    """(bra, y): sum of the coefficients of states at a Hamming distance."""
    edges = hamming_edges(wave, (distance,))
    return edges.join(wave.select(F.col("det").alias("ket"), "c"), "ket").groupBy("bra").agg(F.sum("c").alias("y"))

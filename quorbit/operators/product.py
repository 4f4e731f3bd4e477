"""The Hamiltonian on a product of alpha and beta halves, through moves of halves.

Where a basis holds every pair of an alpha and a beta half, H is a sum of what moves
alpha alone, what moves beta alone, and products of one move of each. Their lists
grow with the halves, not with the pairs, so no edge between pairs is ever stored:
a step joins the vector with lists of moves, and sums by pair.

Signs: with all alpha operators before the beta ones, a half's moves have signs of
their own. States have them in turn, so both orders differ by the sign of a state's
pairs of an alpha above a beta, which the vector takes on before and after.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.operators.edges import hop_edges
from quorbit.operators.elements import Integrals, integral_edges, small
from quorbit.session import cut

#: Two-electron integrals between spins that are broadcast as rows of arrays; beyond this they are shuffled.
MOST_INTEGRALS = 20_000_000


def crossings(alpha: Column, beta: Column) -> Column:
    """Sign of reordering: by the pairs of an occupied alpha orbital above an occupied beta one."""
    above = F.shiftright(alpha, 1)  # bit q: whether an odd number of alpha orbitals lies above q
    for step in (1, 2, 4, 8, 16):
        above = above.bitwiseXOR(F.shiftright(above, step))
    return B.minus_one_if(F.bit_count(above.bitwiseAND(beta)))


def half_edges(halves: DataFrame, ints: Integrals, spin: int) -> DataFrame:
    """(bra, ket, h) of the Hamiltonian of one spin alone within distinct halves ``det``, without the core energy."""
    alone = halves.select(B.spread("det", ints.norb, spin).alias("det"))
    made = integral_edges(alone, replace(ints, core=0.0)).filter("h <> 0")
    return made.select(B.gather("bra", ints.norb, spin).alias("bra"), B.gather("ket", ints.norb, spin).alias("ket"), "h")


def half_moves(halves: DataFrame, norb: int) -> DataFrame:
    """(bra, ket, a, i, sign): one electron from i to a within the halves, also from an orbital to itself."""
    moved = hop_edges(halves, norb).select("bra", "ket", "a", "i", B.parity("ket", F.col("i"), F.col("a")).alias("sign"))
    stayed = halves.select(F.col("det").alias("bra"), F.col("det").alias("ket"), F.explode(B.sites("det", norb)).alias("a"))
    return moved.unionByName(stayed.select("bra", "ket", "a", F.col("a").alias("i"), F.lit(1).alias("sign")))


class ProductOperator:
    """H on all pairs of alpha halves (column adet) and beta halves (bdet).

    Lists of moves are checkpointed once; moves whose integrals with all moves of the
    other spin are zero have no row, so local models keep few.
    """

    def __init__(self, alpha: DataFrame, beta: DataFrame, ints: Integrals):
        self.norb, self.core = ints.norb, ints.core
        halves = [cut(alpha.select(F.col("adet").alias("det")).distinct()), cut(beta.select(F.col("bdet").alias("det")).distinct())]
        self.alone = [small(cut(half_edges(h, ints, s))) for s, h in enumerate(halves)]
        n = ints.norb
        between = ints.two.filter("p % 2 = 0 and r % 2 = 1").select(*[F.shiftright(c, 1).alias(c) for c in "pqrs"], "v")
        pair = lambda x, y: (F.col(x) * n + F.col(y)).cast("int")
        between = between.select(pair("p", "q").alias("pq"), pair("r", "s").alias("rs"), "v")
        moves = [half_moves(h, n).select("bra", "ket", pair("a", "i").alias(k), "sign") for h, k in zip(halves, ("pq", "rs"), strict=True)]
        self.moves = [small(cut(m.join(between.select(k).distinct(), k, "left_semi"))) for m, k in zip(moves, ("pq", "rs"), strict=True)]
        # a row for each beta move, with its integrals by alpha move
        held = between.groupBy("rs").agg(F.map_from_entries(F.collect_list(F.struct("pq", "v"))).alias("g"))
        row = F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.coalesce(F.try_element_at("g", k), F.lit(0.0)))
        rows = cut(held.select("rs", row.alias("g")))
        self.integrals = F.broadcast(rows) if rows.count() * n * n <= MOST_INTEGRALS else rows

    def apply(self, wave: DataFrame, values: tuple[str, ...] = ("c",)) -> DataFrame:
        """H times each of the ``values`` of (adet, bdet, ...) rows; a row for every pair that any of them reaches."""
        signed = lambda df: df.select("adet", "bdet", *[(F.col(v) * crossings(F.col("adet"), F.col("bdet"))).alias(v) for v in values])
        x = signed(wave)
        parts = [x.select("adet", "bdet", *[(F.col(v) * F.lit(self.core)).alias(v) for v in values])]
        for edges, half in zip(self.alone, ("adet", "bdet"), strict=True):
            to = edges.withColumnRenamed("ket", half)
            kept = "bdet" if half == "adet" else "adet"
            parts.append(x.join(to, half).select(F.col("bra").alias(half), kept, *[(F.col("h") * F.col(v)).alias(v) for v in values]))
        alpha, beta = (m.select(F.col("ket").alias(h), F.col("bra").alias(f"{h}_"), k, F.col("sign").alias(f"{k}_")) for m, h, k in zip(self.moves, ("adet", "bdet"), ("pq", "rs"), strict=True))
        both = x.join(alpha, "adet").join(beta, "bdet").join(self.integrals, "rs").withColumn("h", F.get("g", F.col("pq")) * F.col("pq_") * F.col("rs_")).filter("h <> 0")
        parts.append(both.select(F.col("adet_").alias("adet"), F.col("bdet_").alias("bdet"), *[(F.col("h") * F.col(v)).alias(v) for v in values]))
        total = parts[0]
        for part in parts[1:]:
            total = total.unionByName(part)
        return signed(total.groupBy("adet", "bdet").agg(*[F.sum(v).alias(v) for v in values]))

    def images(self, kets: DataFrame, values: list[str]) -> DataFrame:
        """As ``apply``, on states in turn: (det, values)."""
        halved = kets.select(B.alpha_of("det", self.norb).alias("adet"), B.beta_of("det", self.norb).alias("bdet"), *values)
        return self.apply(halved, tuple(values)).select(B.interleave("adet", "bdet", self.norb).alias("det"), *values)

    def diagonal(self, basis: DataFrame) -> DataFrame:
        """(det, h) of states in turn, from the moves that stay."""
        own = basis.select("det", B.alpha_of("det", self.norb).alias("adet"), B.beta_of("det", self.norb).alias("bdet"))
        alone = [e.filter("bra = ket").select(F.col("ket").alias(h), F.col("h").alias(f"{h}_h")) for e, h in zip(self.alone, ("adet", "bdet"), strict=True)]
        alpha, beta = (m.filter("bra = ket").select(F.col("ket").alias(h), k) for m, h, k in zip(self.moves, ("adet", "bdet"), ("pq", "rs"), strict=True))
        between = own.join(alpha, "adet").join(beta, "bdet").join(self.integrals, "rs").groupBy("det").agg(F.sum(F.get("g", F.col("pq"))).alias("g"))
        held = own.join(alone[0], "adet", "left").join(alone[1], "bdet", "left").join(between, "det", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return held.select("det", (zero("adet_h") + zero("bdet_h") + zero("g") + F.lit(self.core)).alias("h"))

"""Joins that make edges between basis states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.functions import complex as X


def hop_edges(basis: DataFrame, width: int, values: Sequence[str] = ()) -> DataFrame:
    """(bra, ket, i, a) one move apart, and the ket's ``values``, by deletion keys.

    Both states are the same without the site that the move empties or fills. So a
    state sends a row for each occupied site, not for each move, and none for moves
    that lead out of the basis; a key has no more states than there are sites.
    """
    k = B.keys(basis)
    keyed = basis.select("det", *values, F.explode(k.sites("det", width)).alias("site")).withColumn("rest", k.flip("det", F.col("site")))
    kets, bras = keyed.select("rest", F.col("site").alias("i"), *values), keyed.select("rest", F.col("site").alias("a"))
    made = kets.join(bras.hint("merge"), "rest")  # not by broadcast: its estimate knows nothing of how many keys a state has
    return made.filter("i <> a").select(k.flip("rest", F.col("a")).alias("bra"), k.flip("rest", F.col("i")).alias("ket"), "i", "a", *values)


def hamming_edges(basis: DataFrame, distances: tuple[int, ...] = (2, 4)) -> DataFrame:
    """(bra, ket, distance) with the distance in ``distances``, of states with equal numbers of occupied sites.

    By deletion keys, an equi-join: the two differ in d/2 sites each, so what is
    left of either without those sites is the same. All pairs are compared by
    no plan; d = 4 costs C(occupied, 2) keys a state.
    """
    out, k = None, B.keys(basis)
    for d in sorted(distances):
        if d == 0:
            made = basis.select(F.col("det").alias("bra"), F.col("det").alias("ket"), F.lit(0).alias("distance"))
        else:
            keyed = basis.select("det", F.col("det").alias("rest"), F.lit(1 << 30).alias("last"))
            for _ in range(d // 2):
                keyed = keyed.withColumn("site", F.explode(k.sites("rest"))).filter("site < last")
                keyed = keyed.withColumn("rest", k.flip("rest", F.col("site"))).withColumn("last", F.col("site")).drop("site")
            a, b = keyed.select(F.col("det").alias("bra"), "rest"), keyed.select(F.col("det").alias("ket"), "rest")
            met = a.join(b.hint("merge"), "rest")  # not by broadcast: its estimate knows nothing of how many keys a state has
            made = met.filter(k.differ("bra", "ket") == d).select("bra", "ket", F.lit(d).alias("distance"))
        out = made if out is None else out.unionByName(made)
    return out


def labelled(pairs: DataFrame, width: int) -> DataFrame:
    """Pairs of bra and ket with ``created`` and ``annihilated``: the sites that the bra has and the ket has not, and the other way round, ascending."""
    k = B.keys(pairs, "bra")
    only = lambda a, b: k.few_sites(k.minus(F.col(a), F.col(b)), width)
    return pairs.withColumn("created", only("bra", "ket")).withColumn("annihilated", only("ket", "bra"))


def lookup(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """Edges with the ket's coefficient."""
    return edges.join(vector.withColumnRenamed("det", "ket"), "ket")


def match_checkpoint(basis: DataFrame, saved: DataFrame) -> DataFrame:
    """(det, c) of the basis: the saved coefficient, real or complex, or zero; saved states outside the basis go."""
    zero = X.make(F.lit(0.0), F.lit(0.0)) if X.is_complex(saved, "c") else F.lit(0.0)
    return basis.select("det").join(saved.select("det", "c"), "det", "left").select("det", F.coalesce("c", zero).alias("c"))


def outside(children: DataFrame, basis: DataFrame) -> DataFrame:
    return children.join(basis.select("det"), "det", "left_anti")

"""Ladder terms made from the rows of integrals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.operators.algebra import SMALLEST
from quorbit.operators.elements import Integrals
from quorbit.operators.select import ranked
from quorbit.session import cut


def integral_terms(ints: Integrals, blocked: bool = True) -> DataFrame:
    """The integrals as normal-ordered terms, greatest |coef| first, as ``term_table`` has them.

    ``blocked`` sites: alpha orbitals 0 to norb - 1, then beta ones; else spin-orbitals
    in turn. An integral's places, spins and order of operators are rows, whose
    coefficients are summed by the sites that they create and annihilate; equal
    operators of one kind leave no row. The core energy is the term without operators.
    """
    site = lambda c: (F.shiftright(c, 1) + (F.col(c) % 2) * ints.norb if blocked else F.col(c)).cast("int")
    one = ints.one.select(F.array(site("p")).alias("up"), F.array(site("q")).alias("down"), F.col("v").alias("coef"))
    places = ints.two.filter("p <> r and q <> s").select(*[site(c).alias(c) for c in "pqrs"], "v")
    # a+_p a+_r a_s a_q: creations ascending and annihilations descending
    sign = F.when((F.col("p") < F.col("r")) == (F.col("q") < F.col("s")), 0.5).otherwise(-0.5)
    two = places.select(F.array(F.least("p", "r"), F.greatest("p", "r")).alias("up"), F.array(F.least("q", "s"), F.greatest("q", "s")).alias("down"), (F.col("v") * sign).alias("coef"))
    none = F.array().cast("array<int>")
    core = ints.one.sparkSession.range(1).select(none.alias("up"), none.alias("down"), F.lit(float(ints.core)).alias("coef"))
    sums = one.unionByName(two).unionByName(core).groupBy("up", "down").agg(F.sum("coef").alias("coef")).filter(F.abs("coef") > SMALLEST)
    mask = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(B.bit(i)))
    ladder = lambda dag: lambda i: F.struct(F.lit(dag).alias("dag"), i.alias("site"))
    made = sums.select(
        "coef", mask("up").alias("create"), mask("down").alias("annihilate"), (F.col("up") == F.col("down")).alias("is_diag"),
        F.concat(F.transform("up", ladder(True)), F.transform(F.reverse("down"), ladder(False))).alias("ops"), F.abs("coef").alias("size"), F.struct("up", "down").alias("places"),
    )
    return cut(ranked(made, "size", "places").select(F.col("position").cast("int").alias("term_id"), "coef", "create", "annihilate", "ops", "is_diag"))


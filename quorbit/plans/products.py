"""Queries on products of halves, larger bases and steps of the solvers, each with its SQL.

Halves, states and weights come from line items; larger tables reach more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.operators import apply as A
from quorbit.operators import edges as J
from quorbit.operators import elements as E
from quorbit.operators import expand as X
from quorbit.operators import solve
from quorbit.operators.product import ProductOperator
from quorbit.operators.terms import integral_terms
from quorbit.plans.catalog import basis, basis_sql, query
from quorbit.plans.library import _dense, _rules_sql
from quorbit.session import cut, table
from quorbit.sources import generate as G

# -- every pair of halves: eight orbitals, three electrons of each spin ----------------

ORBITALS, ELECTRONS = 8, 3
_INTERLEAVED = " | ".join(f"(((a >> {i}) & 1) << {2 * i}) | (((b >> {i}) & 1) << {2 * i + 1})" for i in range(ORBITALS))
_PAIRS = (
    f"WITH line AS (SELECT (l_orderkey*31 + l_partkey*7) & {(1 << ORBITALS) - 1} AS a, (l_suppkey*5 + l_linenumber*3 + l_orderkey) & {(1 << ORBITALS) - 1} AS b, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem), "
    f"held AS (SELECT a, b, sum(q) AS c FROM line WHERE bit_count(a) = {ELECTRONS} AND bit_count(b) = {ELECTRONS} GROUP BY a, b), "
    f"basis AS (SELECT a, b, {_INTERLEAVED} AS det, CAST(coalesce(h.c, 0) AS BIGINT) AS c FROM (SELECT DISTINCT a FROM line WHERE bit_count(a) = {ELECTRONS}) x "
    f"CROSS JOIN (SELECT DISTINCT b FROM line WHERE bit_count(b) = {ELECTRONS}) y LEFT JOIN held h USING (a, b)), sites(i) AS (SELECT CAST(range AS INTEGER) FROM range({2 * ORBITALS}))"
)
_MOVED = f"{_PAIRS}, {_rules_sql('basis')}, off AS (SELECT bra, det AS ket, h FROM dsingle UNION ALL SELECT bra, det, h FROM ddouble), edges AS (SELECT o.* FROM off o JOIN basis b ON b.det = o.bra UNION ALL SELECT det, det, h FROM ddiag)"


def halves_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The alpha halves, the beta halves, and (adet, bdet, c) of every pair, with what line items put on it."""
    key = lambda x: x.bitwiseAND(F.lit((1 << ORBITALS) - 1))
    a, b = F.col("l_orderkey") * 31 + F.col("l_partkey") * 7, F.col("l_suppkey") * 5 + F.col("l_linenumber") * 3 + F.col("l_orderkey")
    line = table(spark, d, "lineitem").select(key(a).alias("adet"), key(b).alias("bdet"), F.round("l_quantity").cast("bigint").alias("q"))
    alpha, beta = (cut(line.filter(F.bit_count(h) == ELECTRONS).select(h).distinct()) for h in ("adet", "bdet"))
    held = line.filter((F.bit_count("adet") == ELECTRONS) & (F.bit_count("bdet") == ELECTRONS)).groupBy("adet", "bdet").agg(F.sum("q").cast("double").alias("c"))
    pairs = G.product_states(alpha, beta, ORBITALS).drop("det")
    return alpha, beta, cut(pairs.join(held, ["adet", "bdet"], "left").na.fill({"c": 0.0}))


@query("apply_mult_product", _MOVED + " SELECT k.a AS adet, k.b AS bdet, CAST(sum(e.h * b.c) AS DOUBLE) AS c FROM edges e JOIN basis b ON b.det = e.ket JOIN basis k ON k.det = e.bra GROUP BY k.a, k.b")
def apply_mult_product(spark, d):  # noqa: ANN001, ANN201
    """H on every pair of halves by moves of halves; no edge between pairs is made."""
    alpha, beta, wave = halves_of(spark, d)
    return ProductOperator(alpha, beta, _dense(spark, ORBITALS)).apply(wave)


@query("element_product_diagonal", _MOVED + " SELECT det, h FROM ddiag")
def element_product_diagonal(spark, d):  # noqa: ANN001, ANN201
    alpha, beta, _ = halves_of(spark, d)
    return ProductOperator(alpha, beta, _dense(spark, ORBITALS)).diagonal(G.product_states(alpha, beta, ORBITALS))


@query("element_term_edges", f"WITH {basis_sql(8)}, sites(i) AS (SELECT CAST(range AS INTEGER) FROM range(8)), {_rules_sql('basis')}, off AS (SELECT bra, det AS ket, h FROM dsingle UNION ALL SELECT bra, det, h FROM ddouble), edges AS (SELECT o.* FROM off o JOIN basis b ON b.det = o.bra UNION ALL SELECT det, det, h FROM ddiag) SELECT bra, ket, h FROM edges WHERE h <> 0")
def element_term_edges(spark, d):  # noqa: ANN001, ANN201
    """The integrals' Hamiltonian again, from a table of ladder terms that their rows make."""
    return E.operator_edges(basis(spark, d, 8), integral_terms(_dense(spark), blocked=False), True).filter("h <> 0")


# -- 24 sites: the more line items, the more states --------------------------------------

_GROWN = f"WITH {basis_sql(24)}, sites(i) AS (SELECT CAST(range AS INTEGER) FROM range(24)), hops AS (SELECT b.det AS ket, b.c, s.i AS i, t.i AS a, xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i) AS bra FROM basis b, sites s, sites t WHERE (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 0), edges AS (SELECT h.* FROM hops h JOIN basis b2 ON b2.det = h.bra)"


@query("join_labelled_moves", _GROWN + " SELECT bra, ket, CAST(1 AS INTEGER) AS n, array_to_string([a], ',') AS created, array_to_string([i], ',') AS annihilated, CAST(a % 2 AS INTEGER) AS spin FROM edges WHERE a % 2 = i % 2")
def join_labelled_moves(spark, d):  # noqa: ANN001, ANN201
    """Pairs of states one move apart with the orbitals that it fills and empties, of one spin."""
    made = J.labelled(J.hamming_edges(basis(spark, d, 24), (2,)), 24).filter("created[0] % 2 = annihilated[0] % 2")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return made.select("bra", "ket", (F.col("distance") / 2).cast("int").alias("n"), text("created"), text("annihilated"), (F.col("created")[0] % 2).cast("int").alias("spin"))


@query("gen_labelled_moves", _GROWN.split(", edges AS")[0] + " SELECT ket AS det, bra, CAST(i AS INTEGER) AS i, CAST(a AS INTEGER) AS a, CAST(i % 2 AS INTEGER) AS spin FROM hops WHERE i % 2 = a % 2")
def gen_labelled_moves(spark, d):  # noqa: ANN001, ANN201
    return X.labelled_moves(basis(spark, d, 24), 24).select("det", "bra", "i", "a", "spin")


@query("apply_mult_grown", _GROWN + ", y AS (SELECT bra, sum(c) AS y FROM edges GROUP BY bra) SELECT b.det, CAST(coalesce(y.y, 0) AS DOUBLE) AS c FROM basis b LEFT JOIN y ON y.bra = b.det")
def apply_mult_grown(spark, d):  # noqa: ANN001, ANN201
    own = cut(basis(spark, d, 24).withColumn("c", F.col("c").cast("double")))
    return A.gathered(J.hop_edges(own, 24, ["c"]).withColumn("h", F.lit(1.0)), own)


# -- two steps of the solvers, whose energies follow from moments ---------------------------

_STEP = (
    _GROWN + ", h1 AS (SELECT b.det, CAST(b.c AS DOUBLE) AS c, coalesce(CAST(e.y AS DOUBLE), 0) - b.det % 5 * CAST(b.c AS DOUBLE) AS y FROM basis b LEFT JOIN (SELECT bra, sum(c) AS y FROM edges GROUP BY bra) e ON e.bra = b.det), "
)
#: The lower eigenvalue of the operator between a vector c with image y and a second vector t with image u, all as columns of ``two``.
_LOWER = (
    "s AS (SELECT sum(c * c) AS cc, sum(c * t) AS ct, sum(t * t) AS tt, sum(c * y) AS cy, sum(c * u) AS cu, sum(t * u) AS tu FROM two), "
    "o AS (SELECT cy / cc AS a, tt - ct * ct / cc AS n, cu - ct / cc * cy AS b, tu - 2 * ct / cc * cu + ct * ct / cc / cc * cy AS d, cc FROM s) "
    "SELECT round((a + d / n) / 2 - sqrt((a - d / n) ** 2 / 4 + b * b / cc / n), 6) AS energy FROM o"
)


def _bonds(spark: SparkSession, d: str) -> tuple[DataFrame, Column, solve.Images]:
    """The states with their weights, diagonal elements of -(det % 5), and the operator of these and hops of one."""
    own, diagonal = cut(basis(spark, d, 24).withColumn("c", F.col("c").cast("double"))), (-(F.col("det") % 5)).cast("double")
    return own, diagonal, solve.hopping(24, F.lit(1.0), diagonal)


@query(
    "solve_lanczos_steps",
    _STEP + "h2 AS (SELECT e.bra, sum(h.y) AS y FROM edges e JOIN h1 h ON h.det = e.ket GROUP BY e.bra), two AS (SELECT h1.c, h1.y, h1.y AS t, coalesce(h2.y, 0) - h1.det % 5 * h1.y AS u FROM h1 LEFT JOIN h2 ON h2.bra = h1.det), " + _LOWER,
)
def solve_lanczos_steps(spark, d):  # noqa: ANN001, ANN201
    """Two steps from the states' weights."""
    own, _, images = _bonds(spark, d)
    found = solve.lanczos(images, own, most=2)
    return spark.createDataFrame([(round(found.energy, 6),)], "energy double")


@query(
    "solve_davidson_steps",
    _STEP + "q AS (SELECT sum(c * y) / sum(c * c) AS e FROM h1), r AS (SELECT det, c, y, (y - e * c) / (CASE WHEN abs(e + det % 5) < 1e-12 THEN 1e-12 ELSE e + det % 5 END) AS t FROM h1, q), "
    "h2 AS (SELECT e.bra, sum(r.t) AS y FROM edges e JOIN r ON r.det = e.ket GROUP BY e.bra), two AS (SELECT r.c, r.y, r.t, coalesce(h2.y, 0) - r.det % 5 * r.t AS u FROM r LEFT JOIN h2 ON h2.bra = r.det), " + _LOWER,
)
def solve_davidson_steps(spark, d):  # noqa: ANN001, ANN201
    """A start vector and one preconditioned residual."""
    own, diagonal, images = _bonds(spark, d)
    found = solve.davidson(images, own.select("det", diagonal.alias("h")), own, eps=0.0, block=2)
    return spark.createDataFrame([(round(found.energy, 6),)], "energy double")

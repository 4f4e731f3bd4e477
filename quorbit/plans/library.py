"""Queries that run a library operator whole, each with the SQL that says the same from the definitions.

Coefficients and integrals are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

import uuid
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.functions.exact import exact_sums
from quorbit.operators import apply as A
from quorbit.operators import edges as J
from quorbit.operators import elements as E
from quorbit.operators import expand as X
from quorbit.operators import select as S
from quorbit.operators import sets as Z
from quorbit.operators import stat
from quorbit.operators.algebra import parse_operator, term_table
from quorbit.plans.catalog import HALVED, HOPS, basis, basis_sql, fock_sql, fock_wave, halved, query, with_sites
from quorbit.session import shared_folder, table
from quorbit.sources import files
from quorbit.sources import generate as G
from quorbit.sources import records


def _value(spark: SparkSession, **named: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in named.values())], ", ".join(f"{n} double" for n in named))


def _wave(spark: SparkSession, d: str, m: int = 12) -> DataFrame:
    return basis(spark, d, m).withColumn("c", F.col("c").cast("double"))


def between(det: str, i: str, a: str) -> str:
    """The sign of a move from i to a: by the occupied sites strictly between."""
    return f"(1 - 2 * CAST(bit_count({det} & (((1::BIGINT << greatest({i}, {a})) - 1) & ~((1::BIGINT << (least({i}, {a}) + 1)) - 1))) & 1 AS INTEGER))"


# -- vectors --------------------------------------------------------------------


@query("apply_inner", f"WITH {basis_sql(12)} SELECT CAST(sum(c * (det % 7)) AS DOUBLE) AS v FROM basis")
def apply_inner(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d)
    return _value(spark, v=A.inner(own, own.withColumn("c", F.col("det") % 7)))


@query("apply_inner_real", "SELECT round(sum(CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE)), 3) AS v, round(sqrt(sum(CAST(l_extendedprice AS DOUBLE) * CAST(l_extendedprice AS DOUBLE))), 3) AS size FROM lineitem")
def apply_inner_real(spark, d):  # noqa: ANN001, ANN201
    """Real values, to the last bit the same for any order of line items."""
    line = table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y"))
    v, size = exact_sums(line, F.col("x") * F.col("y"), F.col("x") * F.col("x"))
    return _value(spark, v=round(v, 3), size=round(size**0.5, 3))


@query("apply_mult", HOPS[12] + ", y AS (SELECT bra, sum(c) AS y FROM edges GROUP BY bra) SELECT b.det, CAST(coalesce(y.y, 0) AS DOUBLE) AS c FROM basis b LEFT JOIN y ON y.bra = b.det")
def apply_mult(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d)
    return A.mult(J.hop_edges(own, 12).withColumn("h", F.lit(1.0)), own)


@query("apply_combined", f"WITH {basis_sql(12)} SELECT det, CAST(2 * c - 3 * (CASE WHEN c % 2 = 0 THEN det % 7 ELSE 0 END) AS DOUBLE) AS c FROM basis")
def apply_combined(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d)
    return A.combined([own, own.filter("c % 2 = 0").withColumn("c", (F.col("det") % 7).cast("double"))], [2.0, -3.0])


@query("apply_expectation", HOPS[12] + ", y AS (SELECT bra, sum(c) AS y FROM edges GROUP BY bra) SELECT round(sum(b.c * coalesce(y.y, 0)) / CAST(sum(b.c * b.c) AS DOUBLE), 9) AS v FROM basis b LEFT JOIN y ON y.bra = b.det")
def apply_expectation(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d)
    return _value(spark, v=round(A.expectation(J.hop_edges(own, 12).withColumn("h", F.lit(1.0)), own), 9))


# -- larger spaces, with what line items put on their states --------------------------


@query("gen_fock_large", fock_sql(20))
def gen_fock_large(spark, d):  # noqa: ANN001, ANN201
    return fock_wave(spark, d, 20)


@query(
    "apply_mult_large",
    f"{fock_sql(18).replace('SELECT CAST(r.', ', wave AS (SELECT CAST(r.', 1)}), sites(i) AS (SELECT CAST(range AS INTEGER) FROM range(18)) "
    "SELECT xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i) AS det, CAST(sum(b.c) AS DOUBLE) AS c FROM wave b, sites s, sites t WHERE (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 0 GROUP BY 1",
)
def apply_mult_large(spark, d):  # noqa: ANN001, ANN201
    """Four million edges of 48,620 states."""
    own = fock_wave(spark, d, 18)
    return A.mult(J.hop_edges(own, 18).withColumn("h", F.lit(1.0)), own)


# -- fermions: hops and repulsions on bonds of three lengths ----------------------

_BONDS = [(i, (i + s) % 12, s) for i in range(12) for s in (1, 3, 5)]


def _fermion_terms(spark: SparkSession) -> DataFrame:
    lines = ["0"]
    for i, j, s in _BONDS:
        lines += [f"{-(i + 1)} cdag {i} c {j}", f"{-(i + 1)} cdag {j} c {i}"]
        lines += [f"{2 * i + 1} cdag {i} c {i} cdag {j} c {j}"] * (s == 1)
    return term_table(spark, parse_operator(lines))


_FERMION = (
    f"WITH {basis_sql(12)}, bonds(i, j, s) AS (VALUES {', '.join(f'({i}, {j}, {s})' for i, j, s in _BONDS)}), "
    "moved AS (SELECT b.det AS ket, xor(xor(b.det, 1::BIGINT << i), 1::BIGINT << j) AS bra, -(i + 1) * "
    + between("b.det", "i", "j")
    + " AS h FROM basis b, bonds WHERE ((b.det >> i) & 1) + ((b.det >> j) & 1) = 1), "
    "edges AS (SELECT m.bra, m.ket, CAST(m.h AS DOUBLE) AS h FROM moved m JOIN basis b2 ON b2.det = m.bra UNION ALL "
    "SELECT b.det, b.det, CAST(sum(2 * i + 1) AS DOUBLE) FROM basis b, bonds WHERE s = 1 AND (b.det >> i) & 1 = 1 AND (b.det >> j) & 1 = 1 GROUP BY b.det)"
)


@query("element_fermion_edges", _FERMION + " SELECT bra, ket, h FROM edges")
def element_fermion_edges(spark, d):  # noqa: ANN001, ANN201
    return E.operator_edges(basis(spark, d), _fermion_terms(spark), True)


@query("element_fermion_diagonal", _FERMION + " SELECT b.det, coalesce(e.h, 0.0) AS h FROM basis b LEFT JOIN edges e ON e.bra = b.det AND e.ket = b.det")
def element_fermion_diagonal(spark, d):  # noqa: ANN001, ANN201
    return E.operator_diagonal(basis(spark, d), _fermion_terms(spark))


@query("apply_mult_operator", _FERMION + ", y AS (SELECT e.bra, sum(e.h * b.c) AS y FROM edges e JOIN basis b ON b.det = e.ket GROUP BY e.bra) SELECT b.det, CAST(coalesce(y.y, 0) AS DOUBLE) AS c FROM basis b LEFT JOIN y ON y.bra = b.det")
def apply_mult_operator(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d)
    return A.mult(E.operator_edges(own, _fermion_terms(spark), True), own)


@query(
    "expand_fermion_heatbath",
    _FERMION.replace("edges AS (", "unused AS (", 1)
    + ", p AS (SELECT det, c FROM basis WHERE c * c > 250000) SELECT det FROM p UNION SELECT m.bra FROM moved m JOIN p ON p.det = m.ket WHERE abs(m.h) * abs(p.c) > 4500",
)
def expand_fermion_heatbath(spark, d):  # noqa: ANN001, ANN201
    return X.operator_expansion(_wave(spark, d), _fermion_terms(spark), True, 4500.0, 250000.0)


@query(
    "expand_counts",
    _FERMION.replace("edges AS (", "unused AS (", 1)
    + ", p AS (SELECT det, c FROM basis WHERE c * c > 250000), made AS (SELECT m.bra, abs(m.h) * abs(p.c) AS w FROM moved m JOIN p ON p.det = m.ket), kept AS (SELECT bra FROM made WHERE w > 4500) "
    "SELECT (SELECT count(*) FROM p) AS parents, (SELECT count(*) FROM made) AS generated, (SELECT count(*) FROM kept) AS accepted, (SELECT count(*) FROM (SELECT det FROM p UNION SELECT bra FROM kept)) AS states",
)
def expand_counts(spark, d):  # noqa: ANN001, ANN201
    """What each step of the heat bath made, counted within the job that makes it."""
    _, counts = X.counted_expansion(_wave(spark, d), _fermion_terms(spark), True, 4500.0, 250000.0)
    return spark.createDataFrame([tuple(counts[k] for k in ("parents", "generated", "accepted", "states"))], "parents long, generated long, accepted long, states long")


_SIMPLE = "(SELECT l_suppkey % 5 AS i, l_partkey % 5 AS j, count(*) AS n FROM lineitem GROUP BY 1, 2)"


@query("algebra_simplify", f"SELECT i, j, CAST(sum(n) AS DOUBLE) AS coef FROM (SELECT i, j, n FROM {_SIMPLE} UNION ALL SELECT j, i, -n FROM {_SIMPLE}) GROUP BY i, j HAVING abs(sum(n)) > 0.00000001")
def algebra_simplify(spark, d):  # noqa: ANN001, ANN201
    """Equal terms of an operator merged, those that cancel dropped: each pair's count, less that of the pair turned round."""
    pairs = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("i"), (F.col("l_partkey") % 5).alias("j")).count().collect()  # 25 rows
    lines = ["0", *(line for i, j, n in pairs for line in (f"{n} cdag {i} c {j}", f"{-n} cdag {j} c {i}"))]
    terms = term_table(spark, parse_operator(lines))
    return terms.select(F.col("ops")[0]["site"].cast("bigint").alias("i"), F.col("ops")[1]["site"].cast("bigint").alias("j"), "coef")


# -- dense integrals over four orbitals --------------------------------------------


def _u(p: int, q: int) -> int:
    return (p * q + 2 * (p + q)) % 7 - 2


def _dense(spark: SparkSession, n: int = 4) -> E.Integrals:
    one = {(p, q): float(_u(p, q)) for p in range(n) for q in range(p + 1)}
    two = {(p, q, r, s): float(_u(p, q) * _u(r, s)) for p, q, r, s in product(range(n), repeat=4) if p >= q and r >= s and (p, q) >= (r, s)}
    return E.integral_tables(spark, n, 0.5, one, two)


def _usql(p: str, q: str) -> str:
    return f"((({p} // 2) * ({q} // 2) + 2 * ({p} // 2 + {q} // 2)) % 7 - 2)"


def _hsql(p: str, q: str) -> str:
    return f"(CASE WHEN {p} % 2 = {q} % 2 THEN {_usql(p, q)} ELSE 0 END)"


def _gsql(p: str, q: str, r: str, s: str) -> str:
    return f"(CASE WHEN {p} % 2 = {q} % 2 AND {r} % 2 = {s} % 2 THEN {_usql(p, q)} * {_usql(r, s)} ELSE 0 END)"


def _rules_sql(parents: str) -> str:
    """Slater and Condon's rules over all moves of ``parents``: ddiag, dsingle and ddouble."""
    return (
        f"occ AS (SELECT b.det, s.i FROM {parents} b, sites s WHERE (b.det >> s.i) & 1 = 1), free AS (SELECT b.det, s.i FROM {parents} b, sites s WHERE (b.det >> s.i) & 1 = 0), "
        f"ddiag AS (SELECT b.det, CAST(0.5 + coalesce((SELECT sum({_hsql('o.i', 'o.i')}) FROM occ o WHERE o.det = b.det), 0) + coalesce((SELECT sum({_gsql('o.i', 'o.i', 'q.i', 'q.i')} - {_gsql('o.i', 'q.i', 'q.i', 'o.i')}) "
        f"FROM occ o JOIN occ q ON q.det = o.det AND o.i < q.i WHERE o.det = b.det), 0) AS DOUBLE) AS h FROM {parents} b), "
        "moves AS (SELECT o.det, o.i, f.i AS a FROM occ o JOIN free f ON f.det = o.det AND f.i % 2 = o.i % 2), "
        f"sums AS (SELECT m.det, m.i, m.a, {_hsql('m.a', 'm.i')} + coalesce((SELECT sum({_gsql('m.a', 'm.i', 'o.i', 'o.i')} - {_gsql('m.a', 'o.i', 'o.i', 'm.i')}) FROM occ o WHERE o.det = m.det AND o.i <> m.i), 0) AS v FROM moves m), "
        f"dsingle AS (SELECT det, xor(xor(det, 1::BIGINT << i), 1::BIGINT << a) AS bra, i, a, CAST(v * {between('det', 'i', 'a')} AS DOUBLE) AS h FROM sums WHERE v <> 0), "
        "twice AS (SELECT o.det, o.i, q.i AS j, f.i AS a, g.i AS b, xor(xor(o.det, 1::BIGINT << o.i), 1::BIGINT << f.i) AS one, "
        f"{_gsql('f.i', 'o.i', 'g.i', 'q.i')} - {_gsql('f.i', 'q.i', 'g.i', 'o.i')} AS v FROM occ o JOIN occ q ON q.det = o.det AND o.i < q.i JOIN free f ON f.det = o.det JOIN free g ON g.det = o.det AND f.i < g.i), "
        f"ddouble AS (SELECT det, xor(xor(one, 1::BIGINT << j), 1::BIGINT << b) AS bra, i, j, a, b, CAST(v * {between('det', 'i', 'a')} * {between('one', 'j', 'b')} AS DOUBLE) AS h FROM twice WHERE v <> 0)"
    )


_DENSE = f"{with_sites(8)}, {_rules_sql('basis')}, off AS (SELECT bra, det AS ket, h FROM dsingle UNION ALL SELECT bra, det, h FROM ddouble), edges AS (SELECT o.* FROM off o JOIN basis b ON b.det = o.bra UNION ALL SELECT det, det, h FROM ddiag)"


@query("element_dense_diagonal", _DENSE + " SELECT det, h FROM ddiag")
def element_dense_diagonal(spark, d):  # noqa: ANN001, ANN201
    return E.diagonal(basis(spark, d, 8), _dense(spark))


@query("element_dense_singles", _DENSE + " SELECT det, bra, i, a, h FROM dsingle")
def element_dense_singles(spark, d):  # noqa: ANN001, ANN201
    return E.singles(basis(spark, d, 8), _dense(spark))


@query("element_dense_doubles", _DENSE + " SELECT det, bra, i, j, a, b, h FROM ddouble")
def element_dense_doubles(spark, d):  # noqa: ANN001, ANN201
    return E.doubles(basis(spark, d, 8).select("det"), _dense(spark)).select("det", "bra", "i", "j", "a", "b", "h")


@query("element_dense_edges", _DENSE + " SELECT bra, ket, h FROM edges")
def element_dense_edges(spark, d):  # noqa: ANN001, ANN201
    return E.integral_edges(basis(spark, d, 8), _dense(spark))


@query("element_dense_pairs", _DENSE + " SELECT x.det AS bra, y.det AS ket, coalesce(e.h, 0.0) AS h FROM basis x CROSS JOIN basis y LEFT JOIN edges e ON e.bra = x.det AND e.ket = y.det WHERE bit_count(xor(x.det, y.det)) <= 4")
def element_dense_pairs(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d, 8)
    return E.pair_elements(J.hamming_edges(own, (0, 2, 4)).select("bra", "ket"), _dense(spark))


@query("apply_mult_integrals", _DENSE + " SELECT e.bra AS det, CAST(sum(e.h * b.c) AS DOUBLE) AS c FROM edges e JOIN basis b ON b.det = e.ket GROUP BY e.bra")
def apply_mult_integrals(spark, d):  # noqa: ANN001, ANN201
    own = _wave(spark, d, 8)
    return A.mult(E.integral_edges(own, _dense(spark)), own)


_HEAT = f"WITH {basis_sql(8)}, sites(i) AS (SELECT CAST(range AS INTEGER) FROM range(8)), p AS (SELECT det, c FROM basis WHERE c % 3 = 0), {_rules_sql('p')}, off AS (SELECT bra, det, h FROM dsingle UNION ALL SELECT bra, det, h FROM ddouble)"


def _expanded(variant: str):  # noqa: ANN202
    return lambda spark, d: X.integral_expansion(_wave(spark, d, 8).filter("c % 3 = 0"), _dense(spark), 2000.0, variant)


for _variant in ("integral", "exhaustive"):
    query(f"expand_dense_{_variant}", _HEAT + " SELECT det FROM p UNION SELECT o.bra FROM off o JOIN p ON p.det = o.det WHERE abs(o.h) * abs(p.c) > 2000")(_expanded(_variant))

# -- statistics outside a basis -----------------------------------------------------

_PARENTS = f"WITH {basis_sql(8)}, sites(i) AS (SELECT CAST(range AS INTEGER) FROM range(8)), p AS (SELECT det, c, 1 + c % 3 AS n FROM basis WHERE c % 3 = 0 OR det % 5 = 1), {_rules_sql('p')}, off AS (SELECT bra AS child, det, h FROM dsingle UNION ALL SELECT bra, det, h FROM ddouble)"
_DIAG_OF = _rules_sql("kids").replace("occ AS (", "kocc AS (", 1).split(", free AS")[0]


def _outside_sql(value: str) -> str:
    """external, variance and pt2 of (child, x, z) rows ``s``; the denominators are the children's diagonal elements."""
    diag = f"0.5 + coalesce((SELECT sum({_hsql('o.i', 'o.i')}) FROM kocc o WHERE o.det = k.det), 0) + coalesce((SELECT sum({_gsql('o.i', 'o.i', 'q.i', 'q.i')} - {_gsql('o.i', 'q.i', 'q.i', 'o.i')}) FROM kocc o JOIN kocc q ON q.det = o.det AND o.i < q.i WHERE o.det = k.det), 0)"
    return (
        f", kids AS (SELECT child AS det, {value} AS v FROM s WHERE child NOT IN (SELECT det FROM p)), {_DIAG_OF}, "
        f"judged AS (SELECT k.v, {diag} AS h FROM kids k) SELECT CAST(count(*) AS DOUBLE) AS external, round(CAST(sum(v) AS DOUBLE), 3) AS variance, round(CAST(sum(v / (-1000.0 - h)) AS DOUBLE), 3) AS pt2 FROM judged"
    )


def _parents(spark: SparkSession, d: str) -> DataFrame:
    own = _wave(spark, d, 8).filter("c % 3 = 0 or det % 5 = 1")
    return own.withColumn("p", F.col("c") / 1024).withColumn("n", (1 + F.col("c") % 3).cast("bigint"))


@query("stat_contributions", _PARENTS + " SELECT p.det, o.child, CAST(p.n * o.h * 1024 AS DOUBLE) AS x, CAST(p.n * (o.h * 1024) ** 2 AS DOUBLE) AS z FROM off o JOIN p USING (det) WHERE abs(p.c * o.h) > 900")
def stat_contributions(spark, d):  # noqa: ANN001, ANN201
    own = _parents(spark, d)
    return stat.contributions(own, stat.integral_children(own, _dense(spark)), 900.0, True)


@query("stat_u_statistic", _PARENTS + ", s AS (SELECT o.child, sum(p.n * o.h * 1024) AS x, sum(p.n * (o.h * 1024) ** 2) AS z FROM off o JOIN p USING (det) WHERE abs(p.c * o.h) > 900 GROUP BY o.child)" + _outside_sql("(x * x - z) / (64 * 63)"))
def stat_u_statistic(spark, d):  # noqa: ANN001, ANN201
    own, ints = _parents(spark, d), _dense(spark)
    parts = stat.contributions(own, stat.integral_children(own, ints), 900.0, True)
    found = stat.u_statistic(parts, own, E.diagonal(parts.select(F.col("child").alias("det")), ints), 64, -1000.0)
    return _value(spark, **{k: round(float(v), 3) for k, v in found.items()})


@query("stat_exact", _PARENTS + ", s AS (SELECT o.child, sum(p.c * o.h) AS x FROM off o JOIN p USING (det) WHERE abs(p.c * o.h) >= 900 GROUP BY o.child)" + _outside_sql("x * x"))
def stat_exact(spark, d):  # noqa: ANN001, ANN201
    own, ints = _parents(spark, d), _dense(spark)
    kids = stat.integral_children(own, ints)
    found = stat.exact(own, kids, own, E.diagonal(kids.select(F.col("child").alias("det")), ints), -1000.0, 900.0)
    return _value(spark, **{k: round(float(v), 3) for k, v in found.items()})


@query("stat_operator_children", _FERMION + " SELECT ket AS det, bra AS child, CAST(h AS DOUBLE) AS h FROM moved")
def stat_operator_children(spark, d):  # noqa: ANN001, ANN201
    return stat.operator_children(basis(spark, d), _fermion_terms(spark), True)


# -- ranges -------------------------------------------------------------------------


@query("join_range_owner", f"WITH {basis_sql(12)}, cut AS (SELECT det, ntile(7) OVER (ORDER BY det) - 1 AS shard FROM basis), starts AS (SELECT shard, min(det) AS least FROM cut GROUP BY shard) SELECT k.det, CAST(greatest(sum(CASE WHEN s.least <= k.det THEN 1 ELSE 0 END) - 1, 0) AS INTEGER) AS owner FROM (SELECT DISTINCT xor(det, 3) AS det FROM basis) k, starts s GROUP BY k.det")
def join_range_owner(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    starts = Z.range_starts(S.equal_ranges(own, 7))
    return Z.range_owner(own.select(F.col("det").bitwiseXOR(F.lit(3)).alias("det")).distinct(), starts)


@query("window_running_whole", f"WITH {basis_sql(16)} SELECT det, c, CAST(coalesce(sum(c) OVER (ORDER BY det ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM basis")
def window_running_whole(spark, d):  # noqa: ANN001, ANN201
    return S.running_sum(basis(spark, d, 16), "c", "det")


# -- files, written into the shared folder and read again ------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("file_text_states", f"WITH {basis_sql(12)} SELECT det FROM basis")
def file_text_states(spark, d):  # noqa: ANN001, ANN201
    path = _folder(spark)
    files.write_states(basis(spark, d), path, 12)
    return files.read_states(spark, path, 12)


@query("file_wavefunction", f"WITH {basis_sql(12)}, saved AS (SELECT * FROM basis WHERE c % 2 = 0), size AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS s FROM saved) SELECT b.det, round(coalesce(v.c, 0) / s, 9) AS c FROM basis b LEFT JOIN saved v USING (det), size")
def file_wavefunction(spark, d):  # noqa: ANN001, ANN201
    path, own = _folder(spark), _wave(spark, d)
    files.save_wavefunction(own.filter("c % 2 = 0"), path)
    return files.load_wavefunction(spark, path, own.select("det")).select("det", F.round("c", 9).alias("c"))


@query("file_product_wavefunction", HALVED + ", size AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS s FROM halved) SELECT adet, bdet, round(c / s, 9) AS c FROM halved, size")
def file_product_wavefunction(spark, d):  # noqa: ANN001, ANN201
    path, own = _folder(spark), halved(spark, d).withColumn("c", F.col("c") / 2)
    files.save_wavefunction(own.unionAll(own).select("adet", "bdet", "c"), path)
    return files.load_product_wavefunction(spark, path, own).select("adet", "bdet", F.round("c", 9).alias("c"))


@query("file_wave_records", f"WITH {basis_sql(12)}, saved AS (SELECT * FROM basis WHERE c % 2 = 0), size AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS s FROM saved) SELECT b.det, round(coalesce(v.c, 0) / s, 9) AS c FROM basis b LEFT JOIN saved v USING (det), size")
def file_wave_records(spark, d):  # noqa: ANN001, ANN201
    """Record files of words of five bits."""
    path, own = f"{_folder(spark)}/wave", _wave(spark, d)
    records.save_wave_records(own.filter("c % 2 = 0"), path, 12, 5)
    return records.load_wave_records(spark, path, own.select("det"), 12, 5).select("det", F.round("c", 9).alias("c"))


@query("file_product_records", HALVED + ", size AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS s FROM halved) SELECT adet, bdet, round(c / s, 9) AS c FROM halved, size")
def file_product_records(spark, d):  # noqa: ANN001, ANN201
    """Record files of the product form; rows that are there twice add up."""
    path, own = f"{_folder(spark)}/wave", halved(spark, d).withColumn("c", F.col("c") / 2)
    records.save_product_records(own.unionAll(own), path, 6)
    return records.load_product_records(spark, path, own, 6).select("adet", "bdet", F.round("c", 9).alias("c"))


@query("file_matrix_form", HALVED + " SELECT printf('%.16e', CAST(c AS DOUBLE)) || ' # ia: ' || right(bin(adet + 64), 6) || ' ib: ' || right(bin(bdet + 64), 6) AS value FROM halved")
def file_matrix_form(spark, d):  # noqa: ANN001, ANN201
    path = _folder(spark)
    files.write_matrix_form(halved(spark, d).withColumn("c", F.col("c").cast("double")), path, 6)
    return spark.read.text(path)


#: One integral for each set of equal places, from line items: a sum of quantities for each pair of pairs of orbitals.
_LINE_PLACES = ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
_INTEGRALS = (
    "WITH placed AS (SELECT l_partkey % 4 + 1 AS p, l_suppkey % 4 + 1 AS q, l_orderkey % 4 + 1 AS r, l_linenumber % 4 + 1 AS s, CAST(round(l_quantity) AS BIGINT) AS n FROM lineitem), "
    "pairs AS (SELECT greatest(p, q) * 5 + least(p, q) AS a, greatest(r, s) * 5 + least(r, s) AS b, n FROM placed), "
    "two AS (SELECT greatest(a, b) AS a, least(a, b) AS b, CAST(sum(n) AS DOUBLE) AS v FROM pairs GROUP BY 1, 2), "
    "one AS (SELECT a, CAST(sum(n) AS DOUBLE) AS v FROM pairs GROUP BY 1)"
)


def _line_integrals(spark: SparkSession, d: str) -> DataFrame:
    """(v, i, j, k, l), 1-based: two-electron integrals, one-electron ones and a core energy of 0.5."""
    p, q, r, s = ((F.col(c) % 4 + 1).cast("int") for c in _LINE_PLACES)
    pair = lambda x, y: F.greatest(x, y) * 5 + F.least(x, y)
    pairs = table(spark, d, "lineitem").select(pair(p, q).alias("a"), pair(r, s).alias("b"), F.round("l_quantity").cast("bigint").alias("n"))
    place = lambda c: (F.floor(F.col(c) / 5).cast("int"), (F.col(c) % 5).cast("int"))
    total = F.sum("n").cast("double").alias("v")
    two = pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(total).select("v", *place("a"), *place("b"))
    one = pairs.groupBy("a").agg(total).select("v", *place("a"), F.lit(0), F.lit(0))
    core = spark.range(1).select(F.lit(0.5), *[F.lit(0)] * 4)
    return two.union(one).union(core).toDF("v", "i", "j", "k", "l")


@query(
    "file_integrals",
    _INTEGRALS + ", places AS (SELECT a // 5 AS i, a % 5 AS j, b // 5 AS k, b % 5 AS l, v FROM two), turned AS ("
    + " UNION ".join(f"SELECT 'two' AS kind, {x[0]} AS p, {x[1]} AS q, {x[2]} AS r, {x[3]} AS s, v FROM places" for x in ("ijkl", "jikl", "ijlk", "jilk", "klij", "lkij", "klji", "lkji"))
    + ") SELECT kind, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, CAST(r AS INTEGER) AS r, CAST(s AS INTEGER) AS s, v FROM turned "
    "UNION SELECT 'one', CAST(a // 5 AS INTEGER), CAST(a % 5 AS INTEGER), 0, 0, v FROM one UNION SELECT 'one', CAST(a % 5 AS INTEGER), CAST(a // 5 AS INTEGER), 0, 0, v FROM one UNION SELECT 'scalar', 0, 0, 0, 0, 0.5",
)
def file_integrals(spark, d):  # noqa: ANN001, ANN201
    """Integrals of line items, written, read again and put in all their places."""
    path = _folder(spark)
    files.write_fcidump(spark, path, {"NORB": "4", "NELEC": "4", "MS2": "0"}, _line_integrals(spark, d))
    return files.classify(files.read_fcidump(spark, path)[1])


@query("file_integral_edges", _DENSE + " SELECT bra, ket, h FROM edges")
def file_integral_edges(spark, d):  # noqa: ANN001, ANN201
    """The same matrix from integrals that are read from a file."""
    path = _folder(spark)
    rows = [(float(_u(p, q) * _u(r, s)), p + 1, q + 1, r + 1, s + 1) for p, q, r, s in product(range(4), repeat=4) if p >= q and r >= s and (p, q) >= (r, s)]
    rows += [(float(_u(p, q)), p + 1, q + 1, 0, 0) for p in range(4) for q in range(p + 1)] + [(0.5, 0, 0, 0, 0)]
    files.write_fcidump(spark, path, {"NORB": "4", "NELEC": "4", "MS2": "0"}, spark.createDataFrame(rows, "v double, i int, j int, k int, l int"))
    return E.integral_edges(basis(spark, d, 8), files.load_integrals(spark, path))


@query("file_operator", _FERMION + " SELECT bra, ket, h FROM edges")
def file_operator(spark, d):  # noqa: ANN001, ANN201
    """The fermion operator, read from a file."""
    path = _folder(spark)
    lines = ["0  # fermions"]
    for i, j, s in _BONDS:
        lines += [f"{-(i + 1)} cdag {i} c {j}", f"{-(i + 1)} cdag {j} c {i}"] + [f"{2 * i + 1} cdag {i} c {i} cdag {j} c {j}"] * (s == 1)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return E.operator_edges(basis(spark, d), term_table(spark, files.read_operator(spark, path)), True)


@query("file_shards", f"WITH {basis_sql(12)} SELECT det FROM basis")
def file_shards(spark, d):  # noqa: ANN001, ANN201
    """Ordered shard files of one name in three folders."""
    root, own = _folder(spark), S.equal_ranges(basis(spark, d), 3)
    for shard in range(3):
        files.write_states(own.filter(F.col("shard") == shard).select("det").coalesce(1), f"{root}/{shard}", 12)
    return files.read_shards(spark, [f"{root}/{shard}" for shard in range(3)], 12)

"""Queries on states of more than one word, and with complex coefficients, each with its SQL.

Wide states have 70 sites, of which those from 12 to 61 are empty: line items fill the
low word's first twelve and the high word's eight, so SQL has them as two columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.functions import complex as C
from quorbit.operators import apply as A
from quorbit.operators import edges as J
from quorbit.operators import elements as E
from quorbit.operators.algebra import parse_operator, term_table
from quorbit.plans.catalog import basis, basis_sql, query
from quorbit.session import cut, shared_folder, table
from quorbit.sources import records

WIDTH, LOW, HIGH = 70, 12, 8
#: (i, j, weight): bonds within each word and between the two.
BONDS = [(0, 62, 1), (5, 63, 2), (11, 69, 3), (3, 4, 4), (10, 11, 5), (62, 63, 6), (64, 69, 7), (1, 66, 8), (2, 9, 9), (7, 68, 10)]

_WIDE = (
    f"WITH line AS (SELECT (l_orderkey*31 + l_partkey*7 + l_suppkey) & {(1 << LOW) - 1} AS low, (l_partkey*5 + l_linenumber*3 + l_orderkey) & {(1 << HIGH) - 1} AS high, CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem), "
    f"basis AS (SELECT low, high, CAST(sum(q) AS BIGINT) AS c FROM line WHERE bit_count(low) = {LOW // 2} AND bit_count(high) = {HIGH // 2} GROUP BY low, high)"
)


def wide_basis(spark: SparkSession, d: str) -> DataFrame:
    """(det, c): det an array of two words."""
    part = lambda x, n: x.bitwiseAND(F.lit((1 << n) - 1))
    low = part(F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey"), LOW)
    high = part(F.col("l_partkey") * 5 + F.col("l_linenumber") * 3 + F.col("l_orderkey"), HIGH)
    rows = table(spark, d, "lineitem").select(low.alias("low"), high.alias("high"), F.round("l_quantity").cast("bigint").alias("q"))
    rows = rows.filter((F.bit_count("low") == LOW // 2) & (F.bit_count("high") == HIGH // 2))
    return rows.groupBy(F.array("low", "high").alias("det")).agg(F.sum("q").cast("double").alias("c"))


def _two(name: str) -> list:
    return [F.col(name)[k].alias(f"{name}{k}") for k in (0, 1)]


def _held(word: str, i: str) -> str:
    return f"(CASE WHEN {i} < 62 THEN ({word}low >> {i}) & 1 ELSE ({word}high >> ({i} - 62)) & 1 END)"


def _flipped(i: str, j: str, side: str, word: str) -> str:
    at = lambda x: f"(CASE WHEN {x} < 62 THEN 1::BIGINT << {x} ELSE 0 END)" if side == "low" else f"(CASE WHEN {x} >= 62 THEN 1::BIGINT << ({x} - 62) ELSE 0 END)"
    return f"xor(xor({word}{side}, {at(i)}), {at(j)})"


def _sign(word: str, i: str, j: str) -> str:
    """By the occupied sites strictly between, in both words."""
    below = lambda x, low: f"((1::BIGINT << greatest(least({x} - {low}, 61), 0)) - 1)"
    count = lambda side, low: f"bit_count({word}{side} & ({below(f'greatest({i}, {j})', low)} & ~{below(f'(least({i}, {j}) + 1)', low)}))"
    return f"(1 - 2 * CAST(({count('low', 0)} + {count('high', 62)}) & 1 AS INTEGER))"


_SITES = f"sites(i) AS (SELECT CAST(range AS INTEGER) FROM range({LOW}) UNION ALL SELECT CAST(62 + range AS INTEGER) FROM range({HIGH}))"


@query(
    "join_wide_moves",
    f"{_WIDE}, {_SITES}, moved AS (SELECT b.low AS ket0, b.high AS ket1, {_flipped('s.i', 't.i', 'low', 'b.')} AS bra0, {_flipped('s.i', 't.i', 'high', 'b.')} AS bra1, s.i AS i, t.i AS a, {_sign('b.', 's.i', 't.i')} AS sign "
    f"FROM basis b, sites s, sites t WHERE {_held('b.', 's.i')} = 1 AND {_held('b.', 't.i')} = 0) SELECT m.* FROM moved m JOIN basis b ON b.low = m.bra0 AND b.high = m.bra1",
)
def join_wide_moves(spark, d):  # noqa: ANN001, ANN201
    """Single moves within the basis, with their signs."""
    made = J.hop_edges(wide_basis(spark, d), WIDTH)
    return made.select(*_two("ket"), *_two("bra"), "i", "a", B.Wide().parity("ket", F.col("i"), F.col("a")).alias("sign"))


@query("join_wide_near", f"{_WIDE} SELECT a.low AS bra0, a.high AS bra1, CAST(bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) AS INTEGER) AS distance, count(*) AS n FROM basis a, basis b WHERE bit_count(xor(a.low, b.low)) + bit_count(xor(a.high, b.high)) IN (2, 4) GROUP BY 1, 2, 3")
def join_wide_near(spark, d):  # noqa: ANN001, ANN201
    """How many states lie two and four sites from each, by deletion keys."""
    near = J.hamming_edges(cut(wide_basis(spark, d).select("det")), (2, 4))
    return near.groupBy("bra", "distance").agg(F.count("*").alias("n")).select(*_two("bra"), "distance", "n")


_BONDS_SQL = ", ".join(f"({i}, {j}, {w})" for i, j, w in BONDS)


@query(
    "apply_mult_wide",
    f"{_WIDE}, bonds(i, j, w) AS (VALUES {_BONDS_SQL}), moved AS (SELECT {_flipped('i', 'j', 'low', 'b.')} AS low, {_flipped('i', 'j', 'high', 'b.')} AS high, -w * {_sign('b.', 'i', 'j')} * b.c AS y FROM basis b, bonds WHERE {_held('b.', 'i')} + {_held('b.', 'j')} = 1 "
    f"UNION ALL SELECT b.low, b.high, w * b.c FROM basis b, bonds WHERE {_held('b.', 'i')} = 1 AND {_held('b.', 'j')} = 1) "
    "SELECT b.low AS det0, b.high AS det1, CAST(coalesce(sum(m.y), 0) AS DOUBLE) AS c FROM basis b LEFT JOIN moved m ON m.low = b.low AND m.high = b.high GROUP BY b.low, b.high",
)
def apply_mult_wide(spark, d):  # noqa: ANN001, ANN201
    """Fermion hops and repulsions on bonds within and between words."""
    lines = ["0"]
    for i, j, w in BONDS:
        lines += [f"{-w} cdag {i} c {j}", f"{-w} cdag {j} c {i}", f"{w} cdag {i} c {i} cdag {j} c {j}"]
    own = cut(wide_basis(spark, d))
    return A.mult(E.operator_edges(own, term_table(spark, parse_operator(lines), WIDTH), True), own).select(*_two("det"), "c")


@query("file_wide_records", f"{_WIDE} SELECT low AS det0, high AS det1, CAST(c AS DOUBLE) AS re, CAST(low % 7 AS DOUBLE) AS im FROM basis")
def file_wide_records(spark, d):  # noqa: ANN001, ANN201
    """Record files of 70 sites in words of 20 bits, with complex coefficients."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/wave"
    records.save_wave_records(wide_basis(spark, d).withColumn("c", C.make(F.col("c"), F.col("det")[0] % 7)), path, WIDTH)
    return records.read_wave_records(spark, path, WIDTH, is_complex=True).select(*_two("det"), "c.re", "c.im")



@query("bit_advanced", f"WITH {basis_sql(16)}, next AS (SELECT det, (det::HUGEINT * 4611686018427387904 + 4611686018427387903 + 1) AS n FROM basis) SELECT det, CAST(n % 4611686018427387904 AS BIGINT) AS low, CAST(n // 4611686018427387904 % 65536 AS BIGINT) AS high FROM next")
def bit_advanced(spark, d):  # noqa: ANN001, ANN201
    """The state after each of 78 sites whose low word is full, so that one carries over; the last begins again."""
    full = F.lit((1 << B.WORD_BITS) - 1).cast("long")
    made = basis(spark, d, 16).select("det", B.advanced(F.array(full, "det"), B.WORD_BITS + 16).alias("next"))
    return made.select("det", F.col("next")[0].alias("low"), F.col("next")[1].alias("high"))


# -- complex coefficients ----------------------------------------------------------------

_RING = [(i, (i + 1) % 12, i + 1) for i in range(12)]
#: The spins' cross terms move a particle with a factor of -i one way and +i the other.
_COMPLEX = (
    f"WITH {basis_sql(12)}, bonds(i, j, w) AS (VALUES {', '.join(f'({i}, {j}, {w})' for i, j, w in _RING)}), "
    "moved AS (SELECT xor(xor(b.det, 1::BIGINT << i), 1::BIGINT << j) AS bra, b.det AS ket, w + 1 AS re, CASE WHEN (b.det >> i) & 1 = 1 THEN -w ELSE w END AS im FROM basis b, bonds WHERE ((b.det >> i) & 1) + ((b.det >> j) & 1) = 1), "
    "edges AS (SELECT m.* FROM moved m JOIN basis b ON b.det = m.bra)"
)


def _complex_terms(spark: SparkSession) -> DataFrame:
    lines = ["1"]
    for i, j, w in _RING:
        lines += [f"{4 * w} sy {i} sx {j}", f"{w + 1} bdag {i} b {j}", f"{w + 1} bdag {j} b {i}"]
    return term_table(spark, parse_operator(lines))


@query("element_complex_edges", _COMPLEX + " SELECT bra, ket, CAST(re AS DOUBLE) AS re, CAST(im AS DOUBLE) AS im FROM edges")
def element_complex_edges(spark, d):  # noqa: ANN001, ANN201
    return E.operator_edges(basis(spark, d), _complex_terms(spark), False).select("bra", "ket", "h.re", "h.im")


@query(
    "apply_mult_complex",
    _COMPLEX + ", y AS (SELECT e.bra, sum(e.re * b.c - e.im * (b.det % 7)) AS re, sum(e.re * (b.det % 7) + e.im * b.c) AS im FROM edges e JOIN basis b ON b.det = e.ket GROUP BY e.bra) SELECT b.det, CAST(coalesce(y.re, 0) AS DOUBLE) AS re, CAST(coalesce(y.im, 0) AS DOUBLE) AS im FROM basis b LEFT JOIN y ON y.bra = b.det",
)
def apply_mult_complex(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d).select("det", C.make(F.col("c"), F.col("det") % 7).alias("c"))
    return A.mult(E.operator_edges(own, _complex_terms(spark), False), own).select("det", "c.re", "c.im")


@query("apply_inner_complex", f"WITH {basis_sql(12)} SELECT CAST(sum(c * (det % 5) + (det % 7) * c) AS DOUBLE) AS re, CAST(sum(c * c - (det % 7) * (det % 5)) AS DOUBLE) AS im FROM basis")
def apply_inner_complex(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    x, y = (own.select("det", C.make(a, b).alias("c")) for a, b in ((F.col("c"), F.col("det") % 7), (F.col("det") % 5, F.col("c"))))
    found = A.inner(x, y)
    return spark.createDataFrame([(found.real, found.imag)], "re double, im double")

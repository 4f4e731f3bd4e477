"""Queries over the given tables, one or more for each operator, with the SQL that says the same.

Amplitudes are integers where sums must not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.operators import edges as J
from quorbit.operators import elements as E
from quorbit.operators import expand as X
from quorbit.operators import observe as O
from quorbit.operators import select as S
from quorbit.operators import sets as Z
from quorbit.operators import summary
from quorbit.operators.algebra import parse_operator, term_table
from quorbit.session import cut, table
from quorbit.sources import generate as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def basis_sql(m: int) -> str:
    return (
        f"basis AS (SELECT det, CAST(sum(q) AS BIGINT) AS c FROM (SELECT (l_orderkey*31 + l_partkey*7 + l_suppkey) & {(1 << m) - 1} AS det, "
        f"CAST(round(l_quantity) AS BIGINT) AS q FROM lineitem) WHERE bit_count(det) = {m // 2} GROUP BY det)"
    )


def bits_sql(det: str, m: int, value: int = 1) -> str:
    return f"list_filter(range({m}), lambda i: (({det} >> i) & 1) = {value})"


def halves_sql(det: str, m: int, offset: int) -> str:
    return "(" + " | ".join(f"((({det} >> {2 * i + offset}) & 1) << {i})" for i in range(m // 2)) + ")"


SITES = "sites(i) AS (SELECT CAST(range AS INTEGER) FROM range({m}))"


def with_sites(m: int) -> str:
    return f"WITH {basis_sql(m)}, {SITES.format(m=m)}"


HOPS = {
    m: f"{with_sites(m)}, hops AS (SELECT b.det AS ket, b.c, s.i AS i, t.i AS a, xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i) AS bra "
    f"FROM basis b, sites s, sites t WHERE (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 0), edges AS (SELECT h.* FROM hops h JOIN basis b2 ON b2.det = h.bra)"
    for m in (12, 16)
}


def basis(spark: SparkSession, sf_dir: str, m: int = 12) -> DataFrame:
    return G.table_basis(spark, sf_dir, m)


def halved(spark: SparkSession, sf_dir: str, m: int = 12) -> DataFrame:
    return basis(spark, sf_dir, m).withColumn("adet", B.alpha_of("det", m // 2)).withColumn("bdet", B.beta_of("det", m // 2))


HALVED = f"WITH {basis_sql(12)}, halved AS (SELECT det, c, {halves_sql('det', 12, 0)} AS adet, {halves_sql('det', 12, 1)} AS bdet FROM basis)"

# -- basis and bits -------------------------------------------------------------


@query("basis_states", f"WITH {basis_sql(16)} SELECT det, c FROM basis")
def basis_states(spark, d):  # noqa: ANN001, ANN201
    return basis(spark, d, 16)


@query("bit_text", f"WITH {basis_sql(16)} SELECT det, right(bin(det + 65536), 16) AS bits, det AS back FROM basis")
def bit_text(spark, d):  # noqa: ANN001, ANN201
    text = B.to_text("det", 16)
    return basis(spark, d, 16).select("det", text.alias("bits"), B.from_text(text, 16).alias("back"))


@query("bit_get_set_count", f"WITH {basis_sql(16)} SELECT det, CAST((det >> 3) & 1 AS INTEGER) AS bit3, det | 32 AS set5, det & ~(1::BIGINT << 7) AS clear7, CAST(bit_count(det) AS INTEGER) AS n FROM basis")
def bit_get_set_count(spark, d):  # noqa: ANN001, ANN201
    return basis(spark, d, 16).select("det", B.occupied_at("det", 3).cast("int").alias("bit3"), B.set_bit("det", 5, 1).alias("set5"), B.set_bit("det", 7, 0).alias("clear7"), B.n_set("det").alias("n"))


@query("bit_open_closed", f"WITH {basis_sql(12)} SELECT det, array_to_string({bits_sql('det', 12)}, ',') AS closed, array_to_string({bits_sql('det', 12, 0)}, ',') AS free FROM basis")
def bit_open_closed(spark, d):  # noqa: ANN001, ANN201
    return basis(spark, d).select("det", F.array_join(B.sites("det", 12).cast("array<string>"), ",").alias("closed"), F.array_join(B.sites("det", 12, 0).cast("array<string>"), ",").alias("free"))


@query("bit_interleave", HALVED + " SELECT det, adet, bdet, det AS again FROM halved")
def bit_interleave(spark, d):  # noqa: ANN001, ANN201
    return halved(spark, d).select("det", "adet", "bdet", B.interleave("adet", "bdet", 6).alias("again"))


@query("half_state_counts", HALVED + " SELECT 'a' AS half, adet AS state, count(*) AS n FROM halved GROUP BY adet UNION ALL SELECT 'b', bdet, count(*) FROM halved GROUP BY bdet")
def half_state_counts(spark, d):  # noqa: ANN001, ANN201
    a, b = B.half_states(basis(spark, d), 6)
    return a.select(F.lit("a").alias("half"), F.col("adet").alias("state"), "n").unionByName(b.select(F.lit("b").alias("half"), F.col("bdet").alias("state"), "n"))


_NEXT = f"WITH {basis_sql(12)}, pairs AS (SELECT det, lead(det) OVER (ORDER BY det) AS other FROM basis)"


@query(
    "bit_difference",
    _NEXT + f" SELECT det, other, CAST(bit_count(xor(det, other)) AS INTEGER) AS distance, array_to_string({bits_sql('(other & ~det)', 12)}, ',') AS made, array_to_string({bits_sql('(det & ~other)', 12)}, ',') AS gone FROM pairs WHERE other IS NOT NULL",
)
def bit_difference(spark, d):  # noqa: ANN001, ANN201
    rows = S.ranked(basis(spark, d).withColumn("zero", F.lit(0)), "zero", "det")
    other = rows.select((F.col("position") - 1).alias("position"), F.col("det").alias("other"))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    return rows.join(other, "position").select(
        "det", "other", B.hamming("det", "other").alias("distance"), text(B.created("other", "det", 12)).alias("made"), text(B.created("det", "other", 12)).alias("gone")
    )


@query(
    "bit_parity",
    HOPS[12] + " SELECT ket, i, a, 1 - 2 * CAST(bit_count(ket & (((1::BIGINT << greatest(i, a)) - 1) & ~((1::BIGINT << (least(i, a) + 1)) - 1))) & 1 AS INTEGER) AS parity, 1 - 2 * CAST(bit_count(ket & ((1::BIGINT << i) - 1)) & 1 AS INTEGER) AS jw FROM hops",
)
def bit_parity(spark, d):  # noqa: ANN001, ANN201
    moves = basis(spark, d).select(F.col("det").alias("ket"), F.explode(B.sites("det", 12)).alias("i"), F.col("det")).withColumn("a", F.explode(B.sites("det", 12, 0)))
    return moves.select("ket", "i", "a", B.parity("ket", F.col("i"), F.col("a")).alias("parity"), B.string_sign("ket", F.col("i")).alias("jw"))


@query("bit_words", f"WITH {basis_sql(16)} SELECT det, det & 31 AS w0, (det >> 5) & 31 AS w1, (det >> 10) & 31 AS w2, det >> 15 AS w3, det & 255 AS v0, det >> 8 AS v1 FROM basis")
def bit_words(spark, d):  # noqa: ANN001, ANN201
    five = B.words_from_text(B.to_text("det", 16), 16, 5)
    eight = B.change_word_bits(five, 16, 5, 8)
    return basis(spark, d, 16).select("det", *[five[i].alias(f"w{i}") for i in range(4)], *[eight[i].alias(f"v{i}") for i in range(2)])


@query("bit_word_order", f"WITH {basis_sql(16)}, w AS (SELECT det, det & 255 AS low, det >> 8 AS high FROM basis) SELECT det, row_number() OVER (ORDER BY high, low) AS place FROM w")
def bit_word_order(spark, d):  # noqa: ANN001, ANN201
    """The place of every state."""
    words = B.words_from_text(B.to_text("det", 16), 16, 8)
    rows = basis(spark, d, 16).select("det", B.word_order(words).alias("w"), F.lit(0).alias("zero"))
    return S.ranked(rows, "zero", "w").select("det", (F.col("position") + 1).alias("place"))


@query("bit_word_order_whole", f"WITH {basis_sql(16)}, w AS (SELECT det, det & 255 AS low, det >> 8 AS high FROM basis) SELECT det, row_number() OVER (ORDER BY high, low) AS place FROM w")
def bit_word_order_whole(spark, d):  # noqa: ANN001, ANN201
    return bit_word_order(spark, d)


@query("file_names", "SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS padded, 'bin' AS ext, 'wf.' || o_orderkey AS stem FROM orders")
def file_names(spark, d):  # noqa: ANN001, ANN201
    name = F.concat(F.lit("wf."), F.col("o_orderkey"), F.lit(".bin"))
    return table(spark, d, "orders").select("o_orderkey", B.padded("o_orderkey", 12).alias("padded"), B.extension(name).alias("ext"), B.without_extension(name).alias("stem"))


@query("pair_indexes", f"{with_sites(12)} SELECT b.det, CAST(sum((t.i * (t.i - 1)) // 2 + s.i) AS BIGINT) AS total FROM basis b, sites s, sites t WHERE s.i < t.i AND (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 1 GROUP BY b.det")
def pair_indexes(spark, d):  # noqa: ANN001, ANN201
    pairs = basis(spark, d).select("det", F.explode(B.sites("det", 12)).alias("i")).withColumn("j", F.explode(B.sites("det", 12))).filter("i < j")
    return pairs.groupBy("det").agg(F.sum(B.pair_index(F.col("i"), F.col("j"))).alias("total"))


# -- joins ----------------------------------------------------------------------


@query("join_hop_edges", HOPS[12] + " SELECT bra, ket, i, a FROM edges")
def join_hop_edges(spark, d):  # noqa: ANN001, ANN201
    return J.hop_edges(basis(spark, d), 12).select("bra", "ket", "i", "a")


@query("join_hamming_2_4", f"WITH {basis_sql(12)} SELECT a.det AS bra, CAST(bit_count(xor(a.det, b.det)) AS INTEGER) AS distance, count(*) AS n FROM basis a, basis b WHERE bit_count(xor(a.det, b.det)) IN (2, 4) GROUP BY 1, 2")
def join_hamming(spark, d):  # noqa: ANN001, ANN201
    """Each pair shares as many deletion keys as there are ways to delete the difference: one."""
    return J.hamming_edges(basis(spark, d), (2, 4)).groupBy("bra", "distance").agg(F.count("*").alias("n"))


@query("join_generate_lookup", HOPS[16] + " SELECT bra, count(*) AS n FROM edges GROUP BY bra")
def join_generate_lookup(spark, d):  # noqa: ANN001, ANN201
    return J.hop_edges(basis(spark, d, 16), 16).groupBy("bra").agg(F.count("*").alias("n"))


@query("join_half_map", HALVED + " SELECT x.adet, x.bdet, y.n AS n_a, z.n AS n_b FROM halved x JOIN (SELECT adet, count(*) AS n FROM halved GROUP BY adet) y USING (adet) JOIN (SELECT bdet, count(*) AS n FROM halved GROUP BY bdet) z USING (bdet)")
def join_half_map(spark, d):  # noqa: ANN001, ANN201
    a, b = B.half_states(basis(spark, d), 6)
    return halved(spark, d).join(a.withColumnRenamed("n", "n_a"), "adet").join(b.withColumnRenamed("n", "n_b"), "bdet").select("adet", "bdet", "n_a", "n_b")


@query("join_tensor_basis", HALVED + ", a AS (SELECT DISTINCT adet FROM halved), b AS (SELECT DISTINCT bdet FROM halved) SELECT adet, bdet, " + " | ".join(f"(((adet >> {i}) & 1) << {2 * i}) | (((bdet >> {i}) & 1) << {2 * i + 1})" for i in range(6)) + " AS det FROM a, b")
def join_tensor_basis(spark, d):  # noqa: ANN001, ANN201
    a, b = B.half_states(basis(spark, d), 6)
    return G.product_states(a, b, 6)


@query("join_tensor_basis_whole", HALVED + ", a AS (SELECT DISTINCT adet FROM halved), b AS (SELECT DISTINCT bdet FROM halved) SELECT adet, bdet, " + " | ".join(f"(((adet >> {i}) & 1) << {2 * i}) | (((bdet >> {i}) & 1) << {2 * i + 1})" for i in range(6)) + " AS det FROM a, b")
def join_tensor_basis_whole(spark, d):  # noqa: ANN001, ANN201
    """Every alpha half with every beta half; join_tensor_basis has a quarter of them, as its SQL does."""
    a, b = B.half_states(basis(spark, d), 6)
    return G.product_states(a, b, 6)


_SAVED = f"WITH {basis_sql(12)}, saved AS (SELECT det, c FROM basis WHERE c % 3 <> 0 UNION ALL SELECT CAST(range AS BIGINT), 7 FROM range(10))"


@query("join_checkpoint_match", _SAVED + " SELECT b.det, CAST(coalesce(s.c, 0) AS DOUBLE) AS c FROM basis b LEFT JOIN saved s USING (det)")
def join_checkpoint_match(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    saved = own.filter("c % 3 <> 0").unionByName(spark.range(10).select(F.col("id").alias("det"), F.lit(7).cast("bigint").alias("c")))
    return J.match_checkpoint(own, saved.withColumn("c", F.col("c").cast("double")))


_CHILDREN = HOPS[12] + ", own AS (SELECT det FROM basis WHERE c % 2 = 0), kids AS (SELECT DISTINCT h.bra AS det FROM hops h JOIN own o ON o.det = h.ket)"


@query("join_external_children", _CHILDREN + " SELECT det FROM kids WHERE det NOT IN (SELECT det FROM own)")
def join_external_children(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d).filter("c % 2 = 0").select("det")
    kids = X.half_moves(own, 12).select(F.col("bra").alias("det")).distinct()
    return J.outside(kids, own)


@query("join_internal_children", _CHILDREN + " SELECT det FROM kids WHERE det IN (SELECT det FROM own)")
def join_internal_children(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d).filter("c % 2 = 0").select("det")
    kids = X.half_moves(own, 12).select(F.col("bra").alias("det")).distinct()
    return Z.inside(kids, own)


# -- aggregation ------------------------------------------------------------------


@query("entry_rayleigh", HOPS[12] + ", y AS (SELECT e.bra AS det, sum(e.c) AS y FROM edges e GROUP BY e.bra) SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(b.c * y.y) AS BIGINT) AS top, CAST(sum(b.c * b.c) AS BIGINT) AS bottom FROM basis b JOIN y USING (det)")
def entry_rayleigh(spark, d):  # noqa: ANN001, ANN201
    """<v|Hv> and <v|v> of the hopping operator."""
    own = basis(spark, d)
    y = J.lookup(J.hop_edges(own, 12), own).groupBy(F.col("bra").alias("det")).agg(F.sum("c").alias("y"))
    return own.join(y, "det").agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("y")).alias("top"), F.sum(F.col("c") * F.col("c")).alias("bottom"))


@query("agg_inner_product", "SELECT a.label AS label, round(sum(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 3) AS squares FROM embeddings a GROUP BY a.label")
def agg_inner_product(spark, d):  # noqa: ANN001, ANN201
    sq = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.sum(sq), 3).alias("squares"))


@query("agg_normalize", f"WITH {basis_sql(12)}, s AS (SELECT sqrt(CAST(sum(c * c) AS DOUBLE)) AS size FROM basis) SELECT det, round(c / size, 9) AS c FROM basis, s")
def agg_normalize(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.apply import normalized

    return normalized(basis(spark, d)).select("det", F.round("c", 9).alias("c"))


@query("agg_mult_hopping", HOPS[16] + " SELECT bra, CAST(sum(c) AS BIGINT) AS y FROM edges GROUP BY bra")
def agg_mult_hopping(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d, 16)
    return J.lookup(J.hop_edges(own, 16), own).groupBy("bra").agg(F.sum("c").alias("y"))


@query("agg_mult_hamming", f"WITH {basis_sql(12)} SELECT a.det AS bra, CAST(sum(b.c) AS BIGINT) AS y FROM basis a JOIN basis b ON bit_count(xor(a.det, b.det)) = 2 GROUP BY a.det")
def agg_mult_hamming(spark, d):  # noqa: ANN001, ANN201
    return O.neighbours_sum(basis(spark, d), 2)


@query("agg_occupation", f"{with_sites(12)} SELECT CAST(s.i // 2 AS INTEGER) AS orbital, CAST(s.i % 2 AS INTEGER) AS spin, CAST(sum(c * c) AS BIGINT) AS n FROM basis b, sites s WHERE (b.det >> s.i) & 1 = 1 GROUP BY s.i")
def agg_occupation(spark, d):  # noqa: ANN001, ANN201
    return O.occupation(basis(spark, d), 12)


@query("agg_marginal_alpha", HALVED + " SELECT adet, CAST(sum(c * c) AS BIGINT) AS p FROM halved GROUP BY adet")
def agg_marginal_alpha(spark, d):  # noqa: ANN001, ANN201
    return O.marginal(halved(spark, d), "adet")


@query("agg_marginal_beta", HALVED + " SELECT bdet, CAST(sum(c * c) AS BIGINT) AS p FROM halved GROUP BY bdet")
def agg_marginal_beta(spark, d):  # noqa: ANN001, ANN201
    return O.marginal(halved(spark, d), "bdet")


_CUT = f"{with_sites(12)}, cut AS (SELECT b.c * (1 - 2 * CAST(bit_count(b.det & ((1::BIGINT << s.i) - 1)) & 1 AS BIGINT)) AS c, s.i AS p, xor(b.det, 1::BIGINT << s.i) AS rest FROM basis b, sites s WHERE (b.det >> s.i) & 1 = 1)"


@query("agg_one_rdm", _CUT + " SELECT x.p AS p, y.p AS q, CAST(sum(x.c * y.c) AS BIGINT) AS v FROM cut x JOIN cut y USING (rest) WHERE x.p % 2 = y.p % 2 GROUP BY x.p, y.p")
def agg_one_rdm(spark, d):  # noqa: ANN001, ANN201
    return O.one_rdm(basis(spark, d), 12)


_CUT2 = _CUT + ", cut2 AS (SELECT k.c * (1 - 2 * CAST(bit_count(k.rest & ((1::BIGINT << s.i) - 1)) & 1 AS BIGINT)) AS c, k.p AS p, s.i AS q, xor(k.rest, 1::BIGINT << s.i) AS rest FROM cut k, sites s WHERE s.i > k.p AND (k.rest >> s.i) & 1 = 1)"


@query("agg_two_rdm", _CUT2 + " SELECT x.p AS p, x.q AS q, y.p AS r, y.q AS s, CAST(sum(x.c * y.c) AS BIGINT) AS v FROM cut2 x JOIN cut2 y USING (rest) GROUP BY 1, 2, 3, 4")
def agg_two_rdm(spark, d):  # noqa: ANN001, ANN201
    return O.two_rdm(basis(spark, d), 12)


@query("agg_merge_weights", "SELECT (l_orderkey*31 + l_partkey*7 + l_suppkey) & 4095 AS det, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1")
def agg_merge_weights(spark, d):  # noqa: ANN001, ANN201
    key = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey")).bitwiseAND(F.lit(4095))
    return Z.merged(table(spark, d, "lineitem").withColumn("w", F.round("l_quantity").cast("bigint")), "w", key)


@query("agg_unique_masked", f"WITH {basis_sql(16)} SELECT det & 21845 AS masked, count(*) AS n FROM basis GROUP BY 1")
def agg_unique_masked(spark, d):  # noqa: ANN001, ANN201
    return Z.masked(basis(spark, d, 16), 0x5555)


@query("agg_simplify_terms", "SELECT l_suppkey % 16 AS term, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS coef FROM lineitem GROUP BY 1 HAVING abs(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)) > 0.00000001")
def agg_simplify_terms(spark, d):  # noqa: ANN001, ANN201
    sign = F.when(F.col("l_linenumber") % 2 == 0, F.lit(1).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))
    return table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("term")).agg(F.sum(sign).alias("coef")).filter(F.abs("coef") > 1e-8)


_XZ = HOPS[12] + ", kids AS (SELECT ket, bra, c AS x, c * c AS z FROM hops WHERE c % 2 = 0)"
_XZ_WHOLE = HOPS[12] + ", kids AS (SELECT ket, bra, c AS x, c * c AS z FROM hops)"


@query("agg_child_sums", _XZ_WHOLE + " SELECT bra AS child, CAST(sum(x) AS BIGINT) AS x, CAST(sum(z) AS BIGINT) AS z FROM kids GROUP BY bra")
def agg_child_sums(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.stat import child_sums

    own = basis(spark, d)
    return child_sums(X.half_moves(own, 12).join(own, "det").select("det", F.col("bra").alias("child"), F.col("c").alias("x"), (F.col("c") * F.col("c")).alias("z")))


@query("agg_two_key_merge", _XZ_WHOLE + " SELECT child, CAST(sum(x) AS BIGINT) AS x, CAST(sum(z) AS BIGINT) AS z FROM (SELECT bra AS child, ket, sum(x) AS x, sum(z) AS z FROM kids GROUP BY bra, ket) GROUP BY child")
def agg_two_key_merge(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.stat import two_key_merge

    own = basis(spark, d)
    return two_key_merge(X.half_moves(own, 12).join(own, "det").select("det", F.col("bra").alias("child"), F.col("c").alias("x"), (F.col("c") * F.col("c")).alias("z")))


@query("agg_child_sums_whole", _XZ_WHOLE + " SELECT bra AS child, CAST(sum(x) AS BIGINT) AS x, CAST(sum(z) AS BIGINT) AS z FROM kids GROUP BY bra")
def agg_child_sums_whole(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.stat import child_sums

    own = basis(spark, d)
    return child_sums(X.half_moves(own, 12).join(own, "det").select("det", F.col("bra").alias("child"), F.col("c").alias("x"), (F.col("c") * F.col("c")).alias("z")))


@query("agg_two_key_merge_whole", _XZ_WHOLE + " SELECT child, CAST(sum(x) AS BIGINT) AS x, CAST(sum(z) AS BIGINT) AS z FROM (SELECT bra AS child, ket, sum(x) AS x, sum(z) AS z FROM kids GROUP BY bra, ket) GROUP BY child")
def agg_two_key_merge_whole(spark, d):  # noqa: ANN001, ANN201
    """All states are parents; in agg_two_key_merge those of an even c are, as in its SQL."""
    from quorbit.operators.stat import two_key_merge

    own = basis(spark, d)
    return two_key_merge(X.half_moves(own, 12).join(own, "det").select("det", F.col("bra").alias("child"), F.col("c").alias("x"), (F.col("c") * F.col("c")).alias("z")))


@query(
    "agg_u_statistic",
    _XZ + ", sums AS (SELECT bra, sum(x) AS x, sum(z) AS z FROM kids GROUP BY bra) SELECT CAST(count(*) AS BIGINT) AS external, round(sum(CAST(x * x - z AS DOUBLE)) / 90, 3) AS variance FROM sums WHERE bra NOT IN (SELECT det FROM basis WHERE c % 2 = 0)",
)
def agg_u_statistic(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.stat import child_sums

    own = basis(spark, d).filter("c % 2 = 0")
    sums = child_sums(X.half_moves(own, 12).join(own, "det").select("det", F.col("bra").alias("child"), F.col("c").alias("x"), (F.col("c") * F.col("c")).alias("z")))
    external = J.outside(sums.withColumnRenamed("child", "det"), own)
    return external.agg(F.count("*").alias("external"), F.round(F.sum((F.col("x") * F.col("x") - F.col("z")).cast("double")) / 90, 3).alias("variance"))


@query(
    "agg_exact_external",
    _XZ + ", sums AS (SELECT bra, sum(x) AS x FROM kids GROUP BY bra) SELECT CAST(count(*) AS BIGINT) AS external, CAST(sum(x * x) AS BIGINT) AS variance FROM sums WHERE bra NOT IN (SELECT det FROM basis WHERE c % 2 = 0)",
)
def agg_exact_external(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d).filter("c % 2 = 0")
    sums = X.half_moves(own, 12).join(own, "det").groupBy("bra").agg(F.sum("c").alias("x"))
    return J.outside(sums.withColumnRenamed("bra", "det"), own).agg(F.count("*").alias("external"), F.sum(F.col("x") * F.col("x")).alias("variance"))


_BATCH = "WITH batches AS (SELECT event_type AS calculation_id, user_id % 20 AS batch_id, avg(value) AS v FROM events GROUP BY 1, 2), drawn AS (SELECT event_type AS calculation_id, count(*) AS sample_count FROM events GROUP BY 1)"


@query(
    "agg_batch_summary",
    _BATCH + " SELECT calculation_id, count(*) AS batch_count, CAST(any_value(sample_count) AS BIGINT) AS samples, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(coalesce(stddev_samp(v), 0) / sqrt(count(*)), 6) AS se FROM batches JOIN drawn USING (calculation_id) GROUP BY 1",
)
def agg_batch_summary(spark, d):  # noqa: ANN001, ANN201
    """Batches of events; a calculation's sample count is one for all of its batches."""
    events = table(spark, d, "events").withColumn("calculation_id", F.col("event_type"))
    rows = events.groupBy("calculation_id", (F.col("user_id") % 20).alias("batch_id")).agg(F.avg("value").alias("variance_estimate"))
    rows = rows.join(events.groupBy("calculation_id").agg(F.count("*").alias("sample_count")), "calculation_id")
    none = {"format_version": F.lit(1), "observable": F.lit("v"), "pt2_estimate": F.lit(None).cast("double"), "heatbath_cutoff": F.lit(0.0), "reference_energy": F.lit(0.0), "elapsed_seconds": F.lit(0.0)}
    out = summary.summarize(rows.withColumns(none))
    r = lambda x, n: F.round(x, 6).alias(n)
    return out.select("calculation_id", "batch_count", F.col("sample_count").alias("samples"), r("variance_mean", "mean"), r("variance_sample_stddev", "sd"), r("variance_standard_error", "se"))


@query("agg_diagnostics", "SELECT user_id % 20 AS batch_id, event_type AS metric, count(*) AS rank_count, min(value) AS low, round(avg(value), 6) AS mean, max(value) AS high, round(CASE WHEN avg(value) <> 0 THEN max(value) / avg(value) END, 6) AS ratio FROM events GROUP BY 1, 2")
def agg_diagnostics(spark, d):  # noqa: ANN001, ANN201
    rows = table(spark, d, "events").select((F.col("user_id") % 20).alias("batch_id"), F.lit("profile").alias("kind"), F.col("event_type").alias("metric"), "value")
    out = summary.diagnostics(rows, ("batch_id", "kind", "metric"))
    return out.select("batch_id", "metric", "rank_count", F.col("min").alias("low"), F.round("mean", 6).alias("mean"), F.col("max").alias("high"), F.round("max_over_mean", 6).alias("ratio"))


@query("agg_totals", f"WITH {basis_sql(16)} SELECT count(*) AS n, CAST(sum(c) AS BIGINT) AS total, CAST(max(abs(c)) AS BIGINT) AS greatest, CAST(max(det) AS BIGINT) AS last FROM basis")
def agg_totals(spark, d):  # noqa: ANN001, ANN201
    return Z.totals(basis(spark, d, 16))


@query("agg_task_cost", HALVED + ", n AS (SELECT adet, count(*) AS k FROM halved GROUP BY adet), m AS (SELECT bdet, count(*) AS k FROM halved GROUP BY bdet) SELECT CAST(sum(n.k * m.k) AS BIGINT) AS cost FROM halved JOIN n USING (adet) JOIN m USING (bdet)")
def agg_task_cost(spark, d):  # noqa: ANN001, ANN201
    return Z.task_cost(halved(spark, d))


# -- windows, order, selection ------------------------------------------------------


@query("window_ranking", f"WITH {basis_sql(16)} SELECT det, c, row_number() OVER (ORDER BY c DESC, det) - 1 AS position FROM basis")
def window_ranking(spark, d):  # noqa: ANN001, ANN201
    return S.ranked(basis(spark, d, 16)).select("det", "c", "position")


@query("window_running_offset", HALVED + " SELECT adet, bdet, c, CAST(coalesce(sum(c) OVER (PARTITION BY adet ORDER BY bdet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM halved")
def window_running_offset(spark, d):  # noqa: ANN001, ANN201
    return S.running_sum(halved(spark, d).select("adet", "bdet", "c"), "c", "bdet", "adet")


@query("window_weight_cut", f"WITH {basis_sql(12)}, w AS (SELECT det, c * c AS p, coalesce(sum(c * c) OVER (ORDER BY c * c DESC, det ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(c * c) OVER () AS whole FROM basis) SELECT det, CAST(p AS BIGINT) AS p FROM w WHERE before <= 0.75 * whole")
def window_weight_cut(spark, d):  # noqa: ANN001, ANN201
    return S.weight_cut(basis(spark, d).select("det", (F.col("c") * F.col("c")).alias("p")), "p", "det", 0.75)


@query("window_sorted_check", "SELECT l_orderkey, CAST(sum(CASE WHEN before >= l_partkey THEN 1 ELSE 0 END) AS BIGINT) AS wrong FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey DESC) AS before FROM lineitem) GROUP BY 1")
def window_sorted_check(spark, d):  # noqa: ANN001, ANN201
    place = F.struct("l_linenumber", -F.col("l_partkey"))
    return S.is_sorted(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", place.alias("place")), "l_partkey", "place", "l_orderkey")


@query("window_equal_ranges", f"WITH {basis_sql(16)} SELECT det, CAST(ntile(7) OVER (ORDER BY det) - 1 AS INTEGER) AS shard FROM basis")
def window_equal_ranges(spark, d):  # noqa: ANN001, ANN201
    return S.equal_ranges(basis(spark, d, 16), 7).select("det", "shard")


@query("window_round_robin", f"WITH {basis_sql(16)} SELECT det, CAST((row_number() OVER (ORDER BY c DESC, det) - 1) % 5 AS INTEGER) AS shard FROM basis")
def window_round_robin(spark, d):  # noqa: ANN001, ANN201
    return S.in_shards(basis(spark, d, 16), 5).select("det", "shard")


@query("sort_unique", "SELECT DISTINCT (l_orderkey*31 + l_partkey*7 + l_suppkey) & 65535 AS det FROM lineitem ORDER BY det")
def sort_unique(spark, d):  # noqa: ANN001, ANN201
    key = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey")).bitwiseAND(F.lit(65535))
    return Z.sorted_unique(table(spark, d, "lineitem").select(key.alias("det")))


@query("sort_merge_runs", f"WITH {basis_sql(12)} SELECT det FROM basis WHERE c % 2 = 0 UNION SELECT det FROM basis WHERE c % 3 = 0")
def sort_merge_runs(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d).select("det", "c")
    return Z.merged_runs([own.filter("c % 2 = 0"), own.filter("c % 3 = 0")])


@query("top_states", f"WITH {basis_sql(16)} SELECT det, c FROM basis ORDER BY c * c DESC, det LIMIT 100")
def top_states(spark, d):  # noqa: ANN001, ANN201
    return S.top_states(basis(spark, d, 16), 100)[0]


@query("top_halves", HALVED + " SELECT adet, CAST(sum(c * c) AS BIGINT) AS p FROM halved GROUP BY adet ORDER BY p DESC, adet LIMIT 10")
def top_halves(spark, d):  # noqa: ANN001, ANN201
    return S.top_halves(halved(spark, d), "adet", 10)


@query("grid_cyclic", HALVED + " SELECT adet, bdet, CAST(((dense_rank() OVER (ORDER BY adet) - 1) % 3) * 2 + (dense_rank() OVER (ORDER BY bdet) - 1) % 2 AS INTEGER) AS cell FROM halved")
def grid_cyclic(spark, d):  # noqa: ANN001, ANN201
    return S.grid_cells(halved(spark, d), 3, 2).select("adet", "bdet", "cell")


@query("filter_truncation", f"WITH {basis_sql(16)} SELECT det, c FROM basis WHERE c * c > 10000")
def filter_truncation(spark, d):  # noqa: ANN001, ANN201
    return S.truncated(basis(spark, d, 16), 10000)


@query("filter_spin_moves", HOPS[12] + " SELECT bra, ket FROM edges WHERE i % 2 = a % 2")
def filter_spin_moves(spark, d):  # noqa: ANN001, ANN201
    return J.hop_edges(basis(spark, d), 12).filter("i % 2 = a % 2").select("bra", "ket")


@query("filter_masks", f"WITH {basis_sql(16)} SELECT det, (det & ~36) | 9 AS bra FROM basis WHERE det & 36 = 36 AND det & ~36 & 9 = 0")
def filter_masks(spark, d):  # noqa: ANN001, ANN201
    det, up, down = F.col("det"), F.lit(9).cast("bigint"), F.lit(36).cast("bigint")
    return basis(spark, d, 16).filter(E.applies(det, up, down)).select("det", E.applied(det, up, down).alias("bra"))


@query("filter_important_halves", HALVED + " SELECT DISTINCT 'a' AS half, adet AS state FROM halved WHERE c * c > 5000 UNION ALL SELECT DISTINCT 'b', bdet FROM halved WHERE c * c > 5000")
def filter_important_halves(spark, d):  # noqa: ANN001, ANN201
    a, b = X.important_halves(halved(spark, d), 5000)
    return a.select(F.lit("a").alias("half"), F.col("adet").alias("state")).unionByName(b.select(F.lit("b").alias("half"), F.col("bdet").alias("state")))


@query("filter_half_counts", HALVED + " SELECT 'a' AS half, adet AS state, count(*) AS n FROM halved WHERE c * c > 5000 GROUP BY adet UNION ALL SELECT 'b', bdet, count(*) FROM halved WHERE c * c > 5000 GROUP BY bdet")
def filter_half_counts(spark, d):  # noqa: ANN001, ANN201
    """In how many important states each half is."""
    a, b = X.important_half_counts(halved(spark, d), 5000)
    return a.select(F.lit("a").alias("half"), F.col("adet").alias("state"), "n").unionByName(b.select(F.lit("b").alias("half"), F.col("bdet").alias("state"), "n"))


@query("set_except", f"WITH {basis_sql(12)} SELECT det FROM basis EXCEPT SELECT det FROM basis WHERE c % 2 = 0")
def set_except(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    return J.outside(own.select("det"), own.filter("c % 2 = 0"))


@query("set_intersect", f"WITH {basis_sql(12)} SELECT det FROM basis WHERE c % 3 = 0 INTERSECT SELECT det FROM basis WHERE c % 2 = 0")
def set_intersect(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    return own.filter("c % 3 = 0").select("det").intersect(own.filter("c % 2 = 0").select("det"))


@query("set_bag_append", f"WITH {basis_sql(12)} SELECT det FROM basis UNION ALL SELECT det FROM basis WHERE c % 2 = 0")
def set_bag_append(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    return Z.appended([own, own.filter("c % 2 = 0")])


# -- generation and elements ----------------------------------------------------------


def fock_sql(m: int) -> str:
    """All half-filled states of m sites with what line items put on them."""
    return f"WITH {basis_sql(m)} SELECT CAST(r.range AS BIGINT) AS det, CAST(coalesce(b.c, 0) AS DOUBLE) AS c FROM range({1 << m}) r LEFT JOIN basis b ON b.det = r.range WHERE bit_count(r.range) = {m // 2}"


def fock_wave(spark: SparkSession, d: str, m: int) -> DataFrame:
    saved = basis(spark, d, m).withColumn("c", F.col("c").cast("double"))
    return J.match_checkpoint(G.fock_space(spark, m, m // 2), saved)


@query("gen_fock_space", fock_sql(16))
def gen_fock_space(spark, d):  # noqa: ANN001, ANN201
    return fock_wave(spark, d, 16)


@query("gen_singles", HOPS[12] + " SELECT ket AS det, bra FROM hops")
def gen_singles(spark, d):  # noqa: ANN001, ANN201
    return X.half_moves(basis(spark, d), 12)


@query("gen_doubles", f"{with_sites(12)} SELECT xor(xor(xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i), 1::BIGINT << u.i), 1::BIGINT << v.i) AS bra, count(*) AS n FROM basis b, sites s, sites t, sites u, sites v WHERE s.i < t.i AND u.i < v.i AND (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 1 AND (b.det >> u.i) & 1 = 0 AND (b.det >> v.i) & 1 = 0 GROUP BY 1")
def gen_doubles(spark, d):  # noqa: ANN001, ANN201
    return X.half_moves(basis(spark, d), 12, 2).groupBy("bra").agg(F.count("*").alias("n"))


@query("gen_singles_extended", HOPS[12] + " SELECT det FROM basis WHERE c > 100 UNION SELECT bra FROM hops WHERE c > 100")
def gen_singles_extended(spark, d):  # noqa: ANN001, ANN201
    return X.singles_extended(basis(spark, d).filter("c > 100"), 12)


@query("gen_start_vector", f"WITH {basis_sql(12)} SELECT det, CASE WHEN det = (SELECT min(det) FROM basis) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM basis")
def gen_start_vector(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.apply import start_vector

    return start_vector(basis(spark, d))


_BONDS = [(i, (i + 1) % 12) for i in range(12)]
_BOND_SQL = "bonds(i, j) AS (VALUES " + ", ".join(f"({i}, {j})" for i, j in _BONDS) + ")"


def _bond_terms(spark: SparkSession) -> DataFrame:
    return term_table(spark, parse_operator(G.bond_model(_BONDS, 1.0, 2.0)))


@query("element_diagonal", f"WITH {basis_sql(12)}, {_BOND_SQL} SELECT b.det, CAST(sum(2 * ((b.det >> i) & 1) * ((b.det >> j) & 1)) AS DOUBLE) AS h FROM basis b, bonds GROUP BY b.det")
def element_diagonal(spark, d):  # noqa: ANN001, ANN201
    return E.operator_diagonal(basis(spark, d), _bond_terms(spark))


@query(
    "element_operator_edges",
    f"WITH {basis_sql(12)}, {_BOND_SQL}, moves AS (SELECT b.det AS ket, xor(xor(b.det, 1::BIGINT << i), 1::BIGINT << j) AS bra FROM basis b, bonds WHERE ((b.det >> i) & 1) + ((b.det >> j) & 1) = 1) "
    "SELECT m.bra, m.ket, CAST(-1.0 AS DOUBLE) AS h FROM moves m JOIN basis b2 ON b2.det = m.bra UNION ALL SELECT * FROM (SELECT b.det AS bra, b.det AS ket, CAST(sum(2 * ((b.det >> i) & 1) * ((b.det >> j) & 1)) AS DOUBLE) AS h FROM basis b, bonds GROUP BY b.det) WHERE h <> 0",
)
def element_operator_edges(spark, d):  # noqa: ANN001, ANN201
    return E.operator_edges(basis(spark, d), _bond_terms(spark), False)


def _chain(spark: SparkSession) -> E.Integrals:
    one, two = G.hubbard(6, 1.0, 4.0, True)
    return E.integral_tables(spark, 6, 0.5, one, two)


_HUB = f"{with_sites(12)}, orb(o) AS (SELECT CAST(range AS INTEGER) FROM range(6))"


@query("element_slater_diagonal", _HUB + " SELECT b.det, CAST(0.5 + sum(4 * ((b.det >> (2 * o)) & 1) * ((b.det >> (2 * o + 1)) & 1)) AS DOUBLE) AS h FROM basis b, orb GROUP BY b.det")
def element_slater_diagonal(spark, d):  # noqa: ANN001, ANN201
    return E.diagonal(basis(spark, d), _chain(spark))


@query(
    "element_slater_edges",
    _HUB + " SELECT b2.det AS bra, b.det AS ket, CAST(-1.0 * (1 - 2 * CAST(bit_count(b.det & (((1::BIGINT << greatest(s.i, t.i)) - 1) & ~((1::BIGINT << (least(s.i, t.i) + 1)) - 1))) & 1 AS INTEGER)) AS DOUBLE) AS h FROM basis b, sites s, sites t, basis b2 "
    "WHERE s.i % 2 = t.i % 2 AND (abs(s.i - t.i) = 2 OR abs(s.i - t.i) = 10) AND (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 0 AND b2.det = xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i) "
    "UNION ALL SELECT b.det, b.det, CAST(0.5 + sum(4 * ((b.det >> (2 * o)) & 1) * ((b.det >> (2 * o + 1)) & 1)) AS DOUBLE) FROM basis b, orb GROUP BY b.det",
)
def element_slater_edges(spark, d):  # noqa: ANN001, ANN201
    return E.integral_edges(basis(spark, d), _chain(spark))


@query(
    "expand_operator_heatbath",
    f"WITH {basis_sql(12)}, {_BOND_SQL}, p AS (SELECT det, c FROM basis WHERE c * c > 10000), kids AS (SELECT xor(xor(p.det, 1::BIGINT << i), 1::BIGINT << j) AS det FROM p, bonds WHERE ((p.det >> i) & 1) + ((p.det >> j) & 1) = 1 AND abs(p.c) > 120) SELECT det FROM p UNION SELECT det FROM kids",
)
def expand_operator_heatbath(spark, d):  # noqa: ANN001, ANN201
    return X.operator_expansion(basis(spark, d), _bond_terms(spark), False, 120.0, 10000)


@query(
    "expand_integral_heatbath",
    _HUB + ", kids AS (SELECT xor(xor(b.det, 1::BIGINT << s.i), 1::BIGINT << t.i) AS det FROM basis b, sites s, sites t WHERE abs(b.c) > 100 AND s.i % 2 = t.i % 2 AND (abs(s.i - t.i) = 2 OR abs(s.i - t.i) = 10) AND (b.det >> s.i) & 1 = 1 AND (b.det >> t.i) & 1 = 0) SELECT det FROM basis UNION SELECT det FROM kids",
)
def expand_integral_heatbath(spark, d):  # noqa: ANN001, ANN201
    return X.integral_expansion(basis(spark, d), _chain(spark), 100.0)


@query(
    "element_pairs",
    _HUB + ", pairs AS (SELECT b.det AS ket, b2.det AS bra FROM basis b JOIN basis b2 ON b2.det = xor(b.det, 5) OR b2.det = xor(b.det, 1365)) "
    "SELECT bra, ket, CAST(CASE WHEN bit_count(xor(bra, ket)) = 2 THEN -1.0 * (1 - 2 * CAST((ket >> 1) & 1 AS INTEGER)) ELSE 0.0 END AS DOUBLE) AS h FROM pairs",
)
def element_pairs(spark, d):  # noqa: ANN001, ANN201
    own = basis(spark, d)
    other = own.select(F.col("det").alias("bra"))
    near = own.select(F.col("det").alias("ket"), F.explode(F.array(F.col("det").bitwiseXOR(F.lit(5)), F.col("det").bitwiseXOR(F.lit(1365)))).alias("bra")).join(other, "bra")
    return E.pair_elements(near, _chain(spark))


@query("complex_squares", "SELECT vec_id, round(embedding[1]::DOUBLE * embedding[1]::DOUBLE + embedding[2]::DOUBLE * embedding[2]::DOUBLE, 6) AS square, round(embedding[1]::DOUBLE * embedding[3]::DOUBLE + embedding[2]::DOUBLE * embedding[4]::DOUBLE, 6) AS re, round(embedding[1]::DOUBLE * embedding[4]::DOUBLE - embedding[2]::DOUBLE * embedding[3]::DOUBLE, 6) AS im FROM embeddings")
def complex_squares(spark, d):  # noqa: ANN001, ANN201
    from quorbit.functions import complex as C

    x = C.make(F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1)))
    y = C.make(F.get("embedding", F.lit(2)), F.get("embedding", F.lit(3)))
    product = C.times(C.conjugate(x), y)
    return table(spark, d, "embeddings").select("vec_id", F.round(C.square(x), 6).alias("square"), F.round(product["re"], 6).alias("re"), F.round(product["im"], 6).alias("im"))


@query("energy_deltas", "SELECT event_id, event_type, value, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS delta FROM events")
def energy_deltas(spark, d):  # noqa: ANN001, ANN201
    found = Z.deltas(table(spark, d, "events"), "value", ["ts", "event_id"], "event_type")
    return found.select("event_id", "event_type", "value", F.round("delta", 6).alias("delta"))


# -- results without an SQL form ------------------------------------------------------


@query("sample_counts")
def sample_counts(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.stat import sample_counts as draw

    return draw(basis(spark, d).withColumn("c", F.col("c").cast("double")), 10_000, 7)


@query("sample_invariants", f"WITH {basis_sql(12)} SELECT CAST(10000 AS BIGINT) AS draws, CAST(0 AS BIGINT) AS strangers, CAST(sum(c) AS BIGINT) AS weight, CAST(0 AS BIGINT) AS far FROM basis")
def sample_invariants(spark, d):  # noqa: ANN001, ANN201
    """What holds for any draw: the number of draws, no state from elsewhere, weights that are the states' own, and no count more than six deviations off."""
    from quorbit.operators.stat import sample_counts as draw

    own = basis(spark, d).withColumn("c", F.col("c").cast("double"))
    found = own.join(draw(own, 10_000, 7, per_part=200).select("det", "p", "n", F.lit(1).alias("drawn")), "det", "full").select("det", "c", "p", "n")
    share = F.col("c") / F.lit(float(own.agg(F.sum("c")).first()[0]))
    far = F.abs(F.coalesce("n", F.lit(0)) - 10_000 * share) > 6 * F.sqrt(10_000 * share) + 1
    wrong = F.col("c").isNull() | (F.abs(F.coalesce("p", share) - share) > 1e-9)
    return found.agg(F.sum("n").alias("draws"), F.count_if(wrong).alias("strangers"), F.sum("c").cast("bigint").alias("weight"), F.count_if(far).alias("far"))


@query("shuffle_invariants", f"WITH {basis_sql(12)} SELECT count(*) AS n, count(*) AS places, count(*) - 1 AS last, min(det) AS first, TRUE AS moved FROM basis")
def shuffle_invariants(spark, d):  # noqa: ANN001, ANN201
    """A permutation in which the first state stays and others do not keep their order."""
    found = S.shuffled(basis(spark, d), 3)
    first = F.max(F.when(F.col("position") == 0, F.col("det"))).alias("first")
    moved = (F.abs(F.corr(F.col("position").cast("double"), F.col("det").cast("double"))) < 0.5).alias("moved")
    return found.agg(F.count("*").alias("n"), F.count_distinct("position").alias("places"), F.max("position").alias("last"), first, moved)


@query("solve_ground_state")
def solve_ground_state(spark, d):  # noqa: ANN001, ANN201
    """Davidson on the bond model within the table's states: energy, residual and steps."""
    from quorbit.operators.solve import ground_state

    own = basis(spark, d, 8).select("det")
    bonds = [(i, (i + 1) % 8) for i in range(8)]
    edges = cut(E.operator_edges(own, term_table(spark, parse_operator(G.bond_model(bonds, 1.0, 2.0))), False))
    found = ground_state(edges, own, eps=1e-4, block=12, restarts=3)
    return spark.createDataFrame([(found.energy, found.residual, len(found.history))], "energy double, residual double, steps int")


@query("solve_lanczos")
def solve_lanczos(spark, d):  # noqa: ANN001, ANN201
    from quorbit.operators.solve import ground_state

    own = basis(spark, d, 8).select("det")
    bonds = [(i, (i + 1) % 8) for i in range(8)]
    edges = cut(E.operator_edges(own, term_table(spark, parse_operator(G.bond_model(bonds, 1.0, 2.0))), False))
    found = ground_state(edges, own, "lanczos", eps=1e-8, most=40)
    return spark.createDataFrame([(found.energy, found.residual, len(found.history))], "energy double, residual double, steps int")


@query("shuffled_states")
def shuffled_states(spark, d):  # noqa: ANN001, ANN201
    return S.shuffled(basis(spark, d), 3).select("det", "position")

"""Matrix elements: ladder terms on states, and Slater-Condon rules from integral tables.

Terms of models and all integrals are tables; they are broadcast where a count
shows ``MOST_TERMS`` rows at most, and shuffled beyond that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.functions import complex as X
from quorbit.session import cut

MOST_TERMS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast, if a count shows that it is small; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.count() <= MOST_TERMS else df


def applies(det: Column, create: Column, annihilate: Column, k: B.Narrow | None = None) -> Column:
    """Whether a normal-ordered term leaves something: what it removes is there, and what it adds is free."""
    k = k or B.Narrow()
    return k.holds(det, annihilate) & k.apart(k.minus(det, annihilate), create)


def applied(det: Column, create: Column, annihilate: Column, k: B.Narrow | None = None) -> Column:
    k = k or B.Narrow()
    return k.join(k.minus(det, annihilate), create)


def term_sign(det: Column, ops: Column, fermion: bool, k: B.Narrow | None = None) -> Column:
    """Sign of a product on a state: the rightmost operator acts first."""
    if not fermion:
        return F.lit(1)
    k = k or B.Narrow()
    done = F.aggregate(
        F.reverse(ops),
        F.struct(det.alias("s"), F.lit(1).alias("sign")),
        lambda a, op: F.struct(k.flip(a["s"], op["site"]).alias("s"), (a["sign"] * k.string_sign(a["s"], op["site"])).cast("int").alias("sign")),
    )
    return done["sign"]


def meet(states: DataFrame, terms: DataFrame, det: str = "det") -> DataFrame:
    """Each state with each term whose annihilated sites it holds.

    An equi-join on the lowest and the highest of these sites, -1 for terms that
    annihilate nothing; so only terms that share them are held against the mask,
    and no plan pairs all states with all terms.
    """
    k = B.keys(states, det)
    n = F.col("annihilate")
    low, high = k.ends(n)
    keyed = terms.withColumn("low", low).withColumn("high", high)
    held = k.sites(det)
    pairs = F.flatten(F.transform(held, lambda p: F.transform(F.filter(held, lambda q: q >= p), lambda q: F.struct(p.cast("int").alias("low"), q.cast("int").alias("high")))))
    none = F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high")))
    placed = states.withColumn("place", F.explode(F.concat(pairs, none))).select(*states.columns, "place.low", "place.high")
    return placed.join(small(keyed), ["low", "high"]).filter(k.holds(F.col(det), n)).drop("low", "high")


def apply_terms(states: DataFrame, terms: DataFrame, fermion: bool, det: str = "det") -> DataFrame:
    """Each state with each term that applies: the state's columns, bra, term_id, h = coef x sign, which is complex where ``coef`` is."""
    k, d = B.keys(states, det), F.col(det)
    joined = meet(states, terms, det).filter(applies(d, F.col("create"), F.col("annihilate"), k))
    h = X.scaled(F.col("coef"), term_sign(d, F.col("ops"), fermion, k), X.is_complex(terms, "coef"))
    return joined.withColumn("bra", applied(d, F.col("create"), F.col("annihilate"), k)).withColumn("h", h).drop("create", "annihilate", "ops", "coef", "is_diag")


def operator_edges(basis: DataFrame, terms: DataFrame, fermion: bool) -> DataFrame:
    """(bra, ket, h) of an operator within a basis, diagonal included."""
    made = apply_terms(basis.select("det"), terms, fermion).groupBy("bra", "det").agg(X.total("h", X.is_complex(terms, "coef")).alias("h"))
    return made.join(basis.select(F.col("det").alias("bra")), "bra").select("bra", F.col("det").alias("ket"), "h")


def operator_diagonal(basis: DataFrame, terms: DataFrame) -> DataFrame:
    """(det, h): the coefficients of diagonal terms whose sites are all occupied, real as the operator is Hermitian; a normal-ordered diagonal product has the sign +1."""
    coef = F.col("coef.re") if X.is_complex(terms, "coef") else F.col("coef")
    hit = meet(basis.select("det"), terms.filter("is_diag").select(coef.alias("coef"), "annihilate"))
    sums = hit.groupBy("det").agg(F.sum("coef").alias("h"))
    return basis.select("det").join(sums, "det", "left").select("det", F.coalesce("h", F.lit(0.0)).alias("h"))


@dataclass(frozen=True)
class Integrals:
    """Spin-orbital tables; spin-orbital 2i + s is orbital i with spin s (0 alpha, 1 beta).

    one(p, q, v); direct(p, q, v) = J - [same spin] K for p < q; single(i, a, j, v) adds
    v for an occupied j; double(i, j, a, b, v), i < j, a < b, spin-conserving, v != 0;
    lookup(i, j, moves) has a pair's doubles as an array (w, v, a, b), w = |v|,
    greatest first; two(p, q, r, s, v) = (pq|rs) for orders of all places. Each is
    checkpointed, counted once, and marked for broadcast where that shows it is small.
    """

    core: float
    norb: int
    one: DataFrame
    two: DataFrame
    direct: DataFrame
    single: DataFrame
    double: DataFrame
    lookup: DataFrame


def places(two: DataFrame) -> DataFrame:
    """(left, right, p, q, r, s, v) in all eight places of equal value, once each; left and right are the spins of pq and of rs."""
    orders = [("left", "right", *o) for o in ("pqrs", "qprs", "pqsr", "qpsr")] + [("right", "left", *o) for o in ("rspq", "srpq", "rsqp", "srqp")]
    names = ("left", "right", "p", "q", "r", "s")
    made = F.array_distinct(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(o, names, strict=True)]) for o in orders]))
    return two.withColumn("at", F.explode(made)).select("at.*", "v").dropDuplicates(list(names))


def spin_integrals(core: float, norb: int, one: DataFrame, two: DataFrame) -> Integrals:
    """Tables from (spin, p, q, v) and (left, right, p, q, r, s, v) rows on spatial orbitals, 0-based, in any one or more of their equal places.

    A null spin stands for both. All are projections and grouped sums of the
    integrals' rows, so only integrals that are there make rows, and the driver
    holds none.
    """
    spins = lambda c: F.when(F.col(c).isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(c))
    on = lambda c, spin: (2 * F.col(c) + F.col(spin)).cast("int").alias(c)
    first = one.withColumn("spin", F.explode(spins("spin"))).withColumn("at", F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))))
    first = first.select("spin", "at.p", "at.q", "v").dropDuplicates(["spin", "p", "q"]).filter("v <> 0").select(on("p", "spin"), on("q", "spin"), "v")
    both = two.filter("v <> 0").withColumn("left", F.explode(spins("left"))).withColumn("right", F.explode(spins("right")))
    g = cut(places(both).select(on("p", "left"), on("q", "left"), on("r", "right"), on("s", "right"), "v"))

    def summed(keys: str, *parts: DataFrame) -> DataFrame:
        """Coulomb parts less exchange parts, by key, where that is not zero."""
        return parts[0].unionByName(parts[1].withColumn("v", -F.col("v"))).groupBy(*keys).agg(F.sum("v").alias("v")).filter("v <> 0")

    named = lambda df, **new: df.select(*[F.col(old).alias(k) for k, old in new.items()], "v")
    direct = summed("pq", named(g.filter("p = q and r = s and p < r"), p="p", q="r"), named(g.filter("p = s and q = r and p < q"), p="p", q="q"))
    single = summed("iaj", named(g.filter("r = s and p <> q and r <> p and r <> q"), i="q", a="p", j="r"), named(g.filter("q = r and p <> s and q <> p and q <> s"), i="s", a="p", j="q"))
    apart = g.filter("p <> q and p <> s and r <> q and r <> s and p < r")
    double = cut(summed("ijab", named(apart.filter("q < s"), i="q", j="s", a="p", b="r"), named(apart.filter("s < q"), i="s", j="q", a="p", b="r")))
    moves = F.reverse(F.sort_array(F.collect_list(F.struct(F.abs("v").alias("w"), "v", "a", "b"))))
    tables = {"one": first, "two": g, "direct": direct, "single": single, "double": double, "lookup": double.groupBy("i", "j").agg(moves.alias("moves"))}
    return Integrals(core, norb, **{k: small(t if k in ("two", "double") else cut(t)) for k, t in tables.items()})


def integral_tables(spark: SparkSession, norb: int, core: float, one: dict[tuple[int, int], float], two: dict[tuple[int, int, int, int], float], one_beta: dict | None = None, two_blocks: dict | None = None) -> Integrals:
    """Tables from spatial integrals of a small model, 0-based; (pq|rs) has one entry for its eight equal places.

    Unrestricted: ``one_beta``, and ``two_blocks`` by the pair of spins.
    """
    firsts = [(None if one_beta is None else 0, one)] + ([(1, one_beta)] if one_beta is not None else [])
    one_rows = [(s, p, q, float(v)) for s, held in firsts for (p, q), v in held.items()]
    blocks = two_blocks or {(None, None): two}
    two_rows = [(*spins, *at, float(v)) for spins, block in blocks.items() for at, v in block.items()]
    kinds = "spin int, p int, q int, v double", "left int, right int, p int, q int, r int, s int, v double"
    return spin_integrals(core, norb, spark.createDataFrame(one_rows, kinds[0]), spark.createDataFrame(two_rows, kinds[1]))


def over(moves: Column, least: Column, longest: int) -> Column:
    """How many of the moves, which go by w downwards, have a w over ``least``: by bisection, in steps that ``longest`` arrays take."""
    bounds = F.struct(F.lit(0).alias("low"), F.size(moves).alias("high"))
    middle = lambda b: F.shiftright(b["low"] + b["high"], 1)
    more = lambda b: F.get(moves, middle(b))["w"] > least
    step = lambda b, _: F.when(b["low"] >= b["high"], b).when(more(b), F.struct((middle(b) + 1).alias("low"), b["high"].alias("high"))).otherwise(F.struct(b["low"].alias("low"), middle(b).alias("high")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(longest.bit_length() + 1)), bounds, step, lambda b: b["low"])


def _occupied(states: DataFrame, width: int, name: str) -> DataFrame:
    return states.withColumn(name, F.explode(B.keys(states).sites("det", width)))


def diagonal(basis: DataFrame, ints: Integrals) -> DataFrame:
    """(det, h): core + sum of h_ii + sum over pairs of J - [same spin] K."""
    n = 2 * ints.norb
    states = basis.select("det").distinct()
    first = _occupied(states, n, "p").join(ints.one.filter("p = q").select("p", "v"), "p").select("det", "v")
    pairs = _occupied(_occupied(states, n, "p"), n, "q").filter("p < q").join(ints.direct, ["p", "q"]).select("det", "v")
    sums = first.unionByName(pairs).groupBy("det").agg(F.sum("v").alias("v"))
    return states.join(sums, "det", "left").select("det", (F.coalesce("v", F.lit(0.0)) + ints.core).alias("h"))


def singles(states: DataFrame, ints: Integrals) -> DataFrame:
    """(det, bra, i, a, h) for each spin-conserving move whose element is not zero."""
    n, k = 2 * ints.norb, B.keys(states)
    moves = _occupied(states.select("det").distinct(), n, "i").withColumn("a", F.explode(k.sites("det", n, 0))).filter("i % 2 = a % 2")
    first = moves.join(ints.one.select(F.col("p").alias("a"), F.col("q").alias("i"), "v"), ["i", "a"]).select("det", "i", "a", "v")
    rest = moves.join(ints.single, ["i", "a"]).filter(k.has("det", F.col("j"))).select("det", "i", "a", "v")
    sums = first.unionByName(rest).groupBy("det", "i", "a").agg(F.sum("v").alias("v")).filter("v <> 0")
    bra = k.flip("det", F.col("i"), F.col("a"))
    return sums.select("det", bra.alias("bra"), "i", "a", (F.col("v") * k.parity("det", F.col("i"), F.col("a"))).alias("h"))


def doubles(states: DataFrame, ints: Integrals, cutoff: Column | None = None) -> DataFrame:
    """(det, bra, i, j, a, b, h): occupied pairs looked up in the two-electron moves.

    Integral-driven: moves that no integral makes are never generated. With a
    ``cutoff`` on |v| (an expression of the state's columns), a pair's moves,
    greatest first, are cut to those over it before they become rows; so the
    only rows that go again are those whose targets are occupied.
    """
    n, k = 2 * ints.norb, B.keys(states)
    pairs = _occupied(_occupied(states, n, "i"), n, "j").filter("i < j").join(ints.lookup, ["i", "j"])
    moves = F.col("moves") if cutoff is None else F.slice("moves", 1, over(F.col("moves"), cutoff, n * n))
    hit = pairs.withColumn("_m", F.explode(moves)).select(*states.columns, "i", "j", "_m.a", "_m.b", "_m.v")
    hit = hit.filter(~k.has("det", F.col("a")) & ~k.has("det", F.col("b")))
    one = k.flip("det", F.col("i"), F.col("a"))
    # the sign of a+_a a+_b a_j a_i as two moves, i to a and then j to b
    sign = k.parity("det", F.col("i"), F.col("a")) * k.parity(one, F.col("j"), F.col("b"))
    return hit.withColumn("bra", k.flip(one, F.col("j"), F.col("b"))).withColumn("h", F.col("v") * sign).drop("v")


def integral_edges(basis: DataFrame, ints: Integrals) -> DataFrame:
    """(bra, ket, h) within a basis: diagonal, singles and doubles; more than two moves are zero."""
    off = singles(basis, ints).select("bra", "det", "h").unionByName(doubles(basis.select("det"), ints).select("bra", "det", "h"))
    off = off.join(basis.select(F.col("det").alias("bra")), "bra").select("bra", F.col("det").alias("ket"), "h")
    return diagonal(basis, ints).select(F.col("det").alias("bra"), F.col("det").alias("ket"), "h").unionByName(off)


def pair_elements(pairs: DataFrame, ints: Integrals) -> DataFrame:
    """(bra, ket, h) for given pairs; zero for pairs more than two moves apart, or whose moves no integral joins."""
    kets = pairs.select(F.col("ket").alias("det")).distinct()
    off = singles(kets, ints).select("bra", F.col("det").alias("ket"), "h").unionByName(doubles(kets, ints).select("bra", F.col("det").alias("ket"), "h"))
    same = diagonal(kets, ints).select(F.col("det").alias("bra"), F.col("det").alias("ket"), "h")
    return pairs.select("bra", "ket").join(off.unionByName(same), ["bra", "ket"], "left").select("bra", "ket", F.coalesce("h", F.lit(0.0)).alias("h"))

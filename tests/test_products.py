"""The product form, integral tables, terms of integrals, and solvers on several states."""

from __future__ import annotations

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorbit.__main__ import main
from quorbit.functions import bits as B
from quorbit.operators import algebra as A
from quorbit.operators import apply, edges, elements, expand, solve
from quorbit.operators.product import ProductOperator
from quorbit.operators.terms import integral_terms
from quorbit.plans import diag
from quorbit.session import cut
from quorbit.sources import files
from quorbit.sources import generate as G


def random_integrals(spark, n, seed=3, unrestricted=False):
    rng = np.random.default_rng(seed)
    one = lambda: {(p, q): float(rng.normal()) for p in range(n) for q in range(p + 1)}
    two = lambda: {(p, q, r, s): float(rng.normal()) for p in range(n) for q in range(p + 1) for r in range(n) for s in range(r + 1) if (p, q) >= (r, s)}
    if not unrestricted:
        return elements.integral_tables(spark, n, 0.7, one(), two())
    mixed = {(p, q, r, s): float(rng.normal()) for p in range(n) for q in range(p + 1) for r in range(n) for s in range(r + 1)}
    return elements.integral_tables(spark, n, 0.7, one(), {}, one(), {(0, 0): two(), (1, 1): two(), (0, 1): mixed})


def halves(spark, n, up, down):
    return G.fock_space(spark, n, up).withColumnRenamed("det", "adet"), G.fock_space(spark, n, down).withColumnRenamed("det", "bdet")


def dense(frame, states):
    at = {d: i for i, d in enumerate(states)}
    m = np.zeros((len(states),) * 2)
    for b, k, h in frame.select("bra", "ket", "h").collect():
        m[at[b], at[k]] += h
    return m


@pytest.mark.parametrize("unrestricted", [False, True])
def test_product_form_is_the_general_one(spark, unrestricted):
    """Also within halves that are not closed under moves, and for several vectors at once."""
    n = 4
    ints = random_integrals(spark, n, 5, unrestricted)
    alpha, beta = halves(spark, n, 2, 3)
    alpha = alpha.filter("adet <> 5")
    basis = cut(G.product_states(alpha, beta, n).select("det", F.sin(F.col("det").cast("double")).alias("c"), F.cos(F.col("det").cast("double")).alias("d")))
    made = cut(elements.integral_edges(basis, ints))
    operator = ProductOperator(alpha, beta, ints)
    got = {r["det"]: (r["c"], r["d"]) for r in operator.images(basis, ["c", "d"]).collect()}
    for k, name in enumerate(("c", "d")):
        want = {r["det"]: r["c"] for r in apply.mult(made, basis.select("det", F.col(name).alias("c"))).collect()}
        assert set(got) <= set(want) and all(got.get(d, (0, 0))[k] == pytest.approx(v, abs=1e-12) for d, v in want.items())
    want = {r["det"]: r["h"] for r in elements.diagonal(basis, ints).collect()}
    assert {r["det"]: r["h"] for r in operator.diagonal(basis).collect()} == pytest.approx(want, abs=1e-12)


def test_product_form_stores_moves_of_halves(spark):
    """With 210 halves of each spin, no table that it keeps has more rows than halves x moves; pairs are 44,100."""
    n, up = 10, 4
    one, two = G.hubbard(n, 1.0, 4.0, True)
    ints = elements.integral_tables(spark, n, 0.0, one, two)
    alpha, beta = halves(spark, n, up, up)
    operator = ProductOperator(alpha, beta, ints)
    moves = 1 + up * (n - up) + up
    assert all(t.count() <= 210 * moves for t in (*operator.alone, *operator.moves))
    wave = cut(G.product_states(alpha, beta, n).select("adet", "bdet", F.lit(1.0).alias("c")))
    image = operator.apply(wave)
    # the sum over all entries of H: hops along bonds, and a repulsion for each shared site
    assert image.count() == 210 * 210
    total = image.agg(F.sum("c")).first()[0]
    states = sorted(r[0] for r in G.fock_space(spark, n, up).collect())
    sign = lambda s, i, a: (-1) ** bin(s >> min(i, a) + 1 & (1 << abs(i - a) - 1) - 1).count("1")
    hops = sum(-sign(s, i, a) for s in states for i in range(n) for a in ((i + 1) % n, (i - 1) % n) if s >> i & 1 and not s >> a & 1)
    interleaved = lambda a, b: (-1) ** sum(1 for p in range(n) for q in range(p) if a >> p & 1 and b >> q & 1)
    shared = 4.0 * sum((a & b).bit_count() for a in states for b in states)
    assert hops != 0 and interleaved(2, 1) == -1
    # hops' signs in turn depend on both halves: by the same reordering
    phase = np.array([[interleaved(a, b) for b in states] for a in states])
    half = np.zeros((210, 210))
    for k, s in enumerate(states):
        for i in range(n):
            for a in ((i + 1) % n, (i - 1) % n):
                if s >> i & 1 and not s >> a & 1:
                    half[states.index(s ^ 1 << i ^ 1 << a), k] -= sign(s, i, a)
    blocked = half @ phase + phase @ half.T
    assert total == pytest.approx(float((blocked * phase).sum()) + shared, abs=1e-8)


def test_tensor_driver_on_the_product_form(spark):
    one, two = G.hubbard(4, 1.0, 4.0, True)
    ints = elements.integral_tables(spark, 4, 0.0, one, two)
    alpha, beta = halves(spark, 4, 2, 2)
    found = diag.tensor(alpha, beta, ints, diag.Options(eps=1e-4, block=20))
    assert found.energy == pytest.approx(-2.10274848, abs=1e-6)
    lanczos = diag.tensor(alpha, beta, ints, diag.Options(method="lanczos", eps=1e-9, block=30))
    assert lanczos.energy == pytest.approx(-2.10274848, abs=1e-7)


def test_degenerate_lowest_states(spark):
    """One electron on a ring without hops to itself: the second and third level are equal; found together, in fewer passes than one by one."""
    one, two = G.hubbard(6, 1.0, 0.0, True)
    ints = elements.integral_tables(spark, 6, 0.0, one, two)
    basis = cut(G.product_states(*halves(spark, 6, 2, 0), 6))
    made = cut(elements.integral_edges(basis, ints))
    states = sorted(r[0] for r in basis.select("det").collect())
    want = np.linalg.eigvalsh(dense(made, states))
    assert want[1] - want[0] < 1e-9  # twofold
    diagonal = elements.diagonal(basis, ints)
    starts = [apply.start_vector(basis, "random", k) for k in (1, 2, 3)]
    found = solve.davidson(made, diagonal, starts, eps=1e-6, restarts=8, block=9, wanted=3)
    assert found.energies == pytest.approx(want[:3].tolist(), abs=1e-8)
    overlap = [[apply.inner(a, b) for b in found.vectors] for a in found.vectors]
    assert np.abs(np.array(overlap) - np.eye(3)).max() < 1e-8
    for energy, vector in zip(found.energies, found.vectors, strict=True):
        rest = apply.combined([apply.mult(made, vector), vector], [1.0, -energy])
        assert apply.norm(rest) < 1e-5
    alone = sum(solve.davidson(made, diagonal, s, eps=1e-6, restarts=8, block=9).applications for s in starts)
    assert found.applications < alone


def test_restart_keeps_images(spark):
    """A restart applies nothing: the next pass is for new vectors alone."""
    basis = cut(G.fock_space(spark, 8, 4))
    made = cut(elements.operator_edges(basis, A.term_table(spark, A.parse_operator(G.bond_model([(i, i + 1) for i in range(7)], 1.0, 2.0))), False))
    found = solve.ground_state(made, basis, eps=1e-5, block=5, restarts=12, n_start=2)
    assert found.energy == pytest.approx(-3.47264341, abs=1e-7)
    assert found.applications <= len(found.history)
    with pytest.raises(ValueError, match="no room"):
        solve.ground_state(made, basis, block=2, n_start=2, restarts=2)


def test_terms_of_integrals(spark):
    """Against the integrals' own elements, in both orders of sites, and against an operator that is put together by hand."""
    ints = random_integrals(spark, 3, 7, unrestricted=True)
    basis = cut(G.product_states(*halves(spark, 3, 2, 1), 3))
    states = sorted(r[0] for r in basis.select("det").collect())
    turn, blocked = integral_terms(ints, blocked=False), integral_terms(ints)
    want = dense(elements.integral_edges(basis, ints), states)
    assert np.abs(dense(elements.operator_edges(basis, turn, True), states) - want).max() < 1e-12
    apart = cut(basis.select((F.col("adet") + F.shiftleft("bdet", 3)).alias("det")))
    made = dense(elements.operator_edges(apart, blocked, True), sorted(r[0] for r in apart.collect()))
    assert np.linalg.eigvalsh(made) == pytest.approx(np.linalg.eigvalsh(want), abs=1e-10)
    rows = blocked.orderBy("term_id").collect()
    assert [r["term_id"] for r in rows] == list(range(len(rows)))
    assert all(abs(a["coef"]) >= abs(b["coef"]) for a, b in zip(rows, rows[1:]))
    for r in rows:
        product = A.Product(tuple((op["dag"], op["site"]) for op in r["ops"]))
        assert A.normal_order(product.ops, True) == {product: 1.0} and product.diagonal == r["is_diag"]


def test_forty_orbitals_without_driver_loops(spark, tmp_path):
    """Integral rows of a file to all tables and to terms; local and long-range integrals of 40 orbitals."""
    n, rows = 40, [(0.25, 0, 0, 0, 0)]
    rows += [(1.0 / (1 + p - q), p + 1, q + 1, 0, 0) for p in range(n) for q in range(p + 1)]
    rows += [(1.0 / (1 + abs(p - r)), p + 1, p + 1, r + 1, r + 1) for p in range(n) for r in range(p + 1)]
    rows += [(0.1 / (1 + p), p + 1, q + 1, p + 1, q + 1) for p in range(n) for q in range(p)]
    files.write_fcidump(spark, str(tmp_path / "dump"), {"NORB": str(n), "NELEC": "4"}, spark.createDataFrame(rows, "v double, i int, j int, k int, l int"))
    began = time.time()
    ints = files.load_integrals(spark, str(tmp_path / "dump"))
    assert ints.core == 0.25 and ints.norb == n
    assert ints.two.count() == 4 * (n + 2 * n * (n - 1) // 2 + 4 * n * (n - 1) // 2)
    terms, size = files.fcidump_terms(spark, str(tmp_path / "dump")) if 2 * n <= 62 else (None, n)
    assert size == n and time.time() - began < 60
    v = {tuple(r[:4]): r[4] for r in ints.direct.select("p", "q", "v", "v", "v").collect()}
    assert len(v) == ints.direct.count() > 0


def test_prefix_of_moves(spark):
    """What a cutoff leaves of a pair's moves is all that becomes rows, but for moves to occupied targets."""
    ints = random_integrals(spark, 4, 9)
    wave = cut(G.product_states(*halves(spark, 4, 2, 2), 4).select("det", (F.lit(0.1) + F.col("det") % 7).alias("c")))
    limit = F.lit(3.0) / F.col("c")
    got = {tuple(r) for r in elements.doubles(wave, ints, limit).select("det", "i", "j", "a", "b").collect()}
    want = {tuple(r) for r in elements.doubles(wave, ints).filter(F.abs("h") > limit).select("det", "i", "j", "a", "b").collect()}
    assert got == want and got
    held = spark.createDataFrame([([(5.0,), (3.0,), (3.0,), (1.0,)],), ([],), ([(2.0,)],)], "moves array<struct<w: double>>")
    for least, counts in ((3.0, [1, 0, 0]), (2.9, [3, 0, 0]), (0.0, [4, 0, 1]), (9.0, [0, 0, 0])):
        assert [r[0] for r in held.select(elements.over(F.col("moves"), F.lit(least), 4)).collect()] == counts
    for cutoff in (0.5, 2.0):
        sets = [{r[0] for r in expand.integral_expansion(wave, ints, cutoff, x).collect()} for x in ("integral", "exhaustive")]
        assert sets[0] == sets[1]


def test_labels(spark):
    basis = G.fock_space(spark, 6, 3)
    for bra, ket, distance, up, down in edges.labelled(edges.hamming_edges(basis, (2, 4)), 6).collect():
        assert up == [i for i in range(6) if bra >> i & 1 and not ket >> i & 1] and down == [i for i in range(6) if ket >> i & 1 and not bra >> i & 1]
        assert len(up) + len(down) == distance
    for det, bra, i, j, a, b, spin in expand.labelled_moves(basis, 6, 2).collect():
        assert bra == det ^ 1 << i ^ 1 << j ^ 1 << a ^ 1 << b and i < j and a < b
        assert sorted((i % 2, j % 2)) == sorted((a % 2, b % 2)) and spin == (2 if i % 2 != j % 2 else i % 2)


def test_options_change_results(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    (tmp_path / "ham").write_text("\n".join(G.bond_model([(i, i + 1) for i in range(5)], 1.0, 2.0)))
    (tmp_path / "basis").write_text("".join(f"{x:06b}\n" for x in range(64) if x.bit_count() == 3))
    run = lambda *more: main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "6", "--block", "1", *more], spark)
    # a subspace of one vector: the energy is that of the start vector
    assert run("--init", "first")["energy"] == pytest.approx(4.0)
    assert run("--initial-determinant", "010101")["energy"] == pytest.approx(0.0)
    with pytest.raises(ValueError, match="0 times"):
        run("--initial-determinant", "010111")
    good = main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "6", "--block", "18", "--tolerance", "1e-6", "--out", path("out"), "--carryover", "3"], spark)
    assert run("--load", path("out/wave"))["energy"] == pytest.approx(good["energy"], abs=1e-6)
    several = main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "6", "--block", "8", "--iteration", "6", "--numivec", "3", "--tolerance", "1e-5"], spark)
    assert several["energy"] == pytest.approx(good["energy"], abs=1e-6)
    kept = lambda *more: main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "6", "--load", path("out/wave"), *more, "--out", path("next")], spark)["discarded"]
    count = lambda: spark.read.text(path("next/carryover")).count()
    top = kept("--carryover-ratio", "0.25")
    assert count() == 5
    assert kept("--carryover-ratio", "0.25", "--carryover-type", "random") > top and count() == 5
    assert 0 < kept("--carryover-type", "threshold", "--threshold", "0.05") < 1 and 0 < count() < 20


def _states(sites, occupied):
    return [sum(1 << i for i in at) for at in itertools.combinations(range(sites), occupied)]


def _shuffled(spark, act):
    """What ``act`` gives, and how many rows it wrote to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def rows():
        context.listenerBus().waitUntilEmpty()
        no = spark.sparkContext._gateway.new_array(jvm.double, 0)
        stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, no, jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    return act(), rows() - before


def test_moves_are_not_shuffled(spark):
    """252 states have 6,300 moves; but they send a row for each of five occupied sites, twice, and partial sums."""
    own = cut(spark.createDataFrame([(s, float(s % 7)) for s in _states(10, 5)], "det long, c double"))
    count, sent = _shuffled(spark, lambda: edges.hop_edges(own, 10).filter("i <> a and bra <> ket").count())
    assert count == 6300 and sent <= 2 * 5 * 252 + 100
    images = solve.hopping(10, F.lit(1.0), F.lit(0.0))
    found, sent = _shuffled(spark, lambda: {r["det"]: r["c"] for r in images(own, ["c"]).collect()})
    assert found == {a: sum(float(b % 7) for b in _states(10, 5) if (a ^ b).bit_count() == 2) for a in _states(10, 5)}
    assert sent <= 3 * 5 * 252 + 252


def test_hopping_is_the_operator_of_its_edges(spark):
    """Elements and a diagonal by site, a basis with gaps, several vectors, wide states as narrow ones."""
    held = [s for s in _states(8, 3) if s % 5]
    h, diagonal = (F.col("i") + F.col("a") + 1).cast("double"), F.lit(3.0)
    frame = cut(spark.createDataFrame([(s, float(s % 11), float(s % 3)) for s in held], "det long, c double, d double"))
    dealt = edges.hop_edges(frame, 8).select("bra", "ket", h.alias("h")).unionByName(frame.select(F.col("det").alias("bra"), F.col("det").alias("ket"), diagonal.alias("h")))
    want = {r["det"]: (r["c"], r["d"]) for r in solve.stored(dealt)(frame, ["c", "d"]).collect()}
    assert {r["det"]: (r["c"], r["d"]) for r in solve.hopping(8, h, diagonal)(frame, ["c", "d"]).collect()} == want
    wide = frame.select(F.array("det", F.lit(0).cast("long")).alias("det"), "c", "d")
    assert {r["det"][0]: (r["c"], r["d"]) for r in solve.hopping(8, h, diagonal)(wide, ["c", "d"]).collect()} == want
    with_c = edges.hop_edges(frame, 8, ["c"]).withColumn("h", h)
    plain = apply.mult(with_c.drop("c"), frame)
    assert sorted(map(tuple, apply.gathered(with_c, frame).collect())) == sorted(map(tuple, plain.collect()))


def test_keys_of_states_are_not_broadcast(spark):
    """A plan guesses the rows of keys from those of states, of which each has many."""
    own = spark.range(1 << 10).select(F.col("id").alias("det")).filter("bit_count(det) = 5")
    for made in (edges.hamming_edges(own, (2, 4)), edges.labelled(edges.hamming_edges(own, (2,)), 10)):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_few_sites_are_all_sites(spark):
    masks = [0, 1, 3, 5, 7, 1 << 61, (1 << 61) | 1, (1 << 62) - 1, 0b1011 << 20, 1 << 30, -1]
    frame = spark.createDataFrame([(m,) for m in masks], "m long")
    for width in (1, 24, 62):
        assert all(a == b for a, b in frame.select(B.few_sites("m", width), B.sites("m", width)).collect())
    plain = lambda c: frame.select(c).schema[0].dataType.elementType
    assert plain(B.few_sites("m", 24)) == plain(B.sites("m", 24))

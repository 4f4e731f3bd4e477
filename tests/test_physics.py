"""Known answers of small models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorbit.operators import algebra as A
from quorbit.operators import elements as E
from quorbit.operators import expand, observe, solve, stat
from quorbit.operators.apply import inner, normalized, start_vector
from quorbit.plans import diag
from quorbit.session import cut
from quorbit.sources import generate as G


def dense(edges, basis):
    states = sorted(r[0] for r in basis.select("det").collect())
    at = {d: i for i, d in enumerate(states)}
    m = np.zeros((len(states),) * 2)
    for b, k, h in edges.select("bra", "ket", "h").collect():
        m[at[b], at[k]] += h
    return m


@pytest.fixture(scope="module")
def ring(spark):
    one, two = G.hubbard(4, 1.0, 4.0, True)
    ints = E.integral_tables(spark, 4, 0.0, one, two)
    half = G.fock_space(spark, 4, 2)
    basis = cut(G.product_states(half.withColumnRenamed("det", "adet"), half.withColumnRenamed("det", "bdet"), 4))
    return ints, basis, cut(E.integral_edges(basis, ints))


def test_boson_chain(spark):
    op = A.parse_operator(G.bond_model([(i, i + 1) for i in range(7)], 1.0, 2.0))
    basis = G.fock_space(spark, 8, 4)
    values = np.linalg.eigvalsh(dense(E.operator_edges(basis, A.term_table(spark, op), False), basis))
    assert basis.count() == 70 and values[:2] == pytest.approx([-3.47264341, -2.56653856], abs=1e-7)


def test_hubbard_ring(ring):
    _, basis, edges = ring
    m = dense(edges, basis)
    assert basis.count() == 36 and (m != 0).sum() == 222 and np.abs(m - m.T).max() == 0
    assert np.linalg.eigvalsh(m)[:2] == pytest.approx([-2.10274848, -1.80642385], abs=1e-7)


@pytest.mark.parametrize(("method", "options"), [("davidson", {"eps": 1e-6, "block": 15, "restarts": 4}), ("lanczos", {"eps": 1e-10})])
def test_solvers_and_densities(ring, method, options):
    ints, basis, edges = ring
    found = solve.ground_state(edges, basis, method, **options)
    assert found.energy == pytest.approx(-2.10274848, abs=1e-6)
    one, two = cut(observe.one_rdm(found.vector, 8)), cut(observe.two_rdm(found.vector, 8))
    assert observe.rdm_energy(one, two, ints) == pytest.approx(found.energy, abs=1e-8)
    assert sum(r["n"] for r in observe.occupation(found.vector, 8).collect()) == pytest.approx(4)


def test_general_integrals_agree_with_the_operator_path(spark):
    """Random integrals: Slater-Condon elements against ladder terms on interleaved sites."""
    rng = np.random.default_rng(3)
    n, one, two = 3, {}, {}
    for p in range(n):
        for q in range(p + 1):
            one[p, q] = float(rng.normal())
    for p in range(n):
        for q in range(p + 1):
            for r in range(n):
                for s in range(r + 1):
                    if (p, q) >= (r, s):
                        two[p, q, r, s] = float(rng.normal())
    ints = E.integral_tables(spark, n, 0.7, one, two)
    op = A.identity() * 0.7
    h = lambda p, q: one[max(p, q), min(p, q)]

    def g(p, q, r, s):
        a, b = (max(p, q), min(p, q)), (max(r, s), min(r, s))
        return two[(*max(a, b), *min(a, b))]

    for p in range(n):
        for q in range(n):
            for s in (0, 1):
                op = op + A.create(2 * p + s) * A.annihilate(2 * q + s) * h(p, q)
            for r in range(n):
                for t in range(n):
                    for s in (0, 1):
                        for u in (0, 1):
                            op = op + A.create(2 * p + s) * A.create(2 * r + u) * A.annihilate(2 * t + u) * A.annihilate(2 * q + s) * (0.5 * g(p, q, r, t))
    alpha, beta = G.fock_space(spark, n, 2), G.fock_space(spark, n, 1)
    basis = cut(G.product_states(alpha.withColumnRenamed("det", "adet"), beta.withColumnRenamed("det", "bdet"), n))
    a, b = dense(E.integral_edges(basis, ints), basis), dense(E.operator_edges(basis, A.term_table(spark, op), True), basis)
    assert np.abs(a - b).max() < 1e-11
    wave = normalized(start_vector(basis, "random", 2))
    one_, two_ = observe.one_rdm(wave, 2 * n), observe.two_rdm(wave, 2 * n)
    c = np.array([r[1] for r in sorted(wave.select("det", "c").collect())])
    assert observe.rdm_energy(one_, two_, ints) == pytest.approx(float(c @ a @ c), abs=1e-9)


def test_expansions_agree(ring):
    ints, basis, edges = ring
    wave = solve.ground_state(edges, basis, eps=1e-4).vector.orderBy(F.desc(F.abs("c")), "det").limit(6)
    for cutoff in (0.2, 0.6):
        sets = [{r[0] for r in expand.integral_expansion(wave, ints, cutoff, v).collect()} for v in ("integral", "exhaustive")]
        assert sets[0] == sets[1]


@pytest.mark.parametrize(("cutoff", "n"), [(0.2499, 2), (0.25, 1), (0.2501, 1)])
def test_heatbath_is_strict(spark, cutoff, n):
    terms = A.term_table(spark, A.parse_operator(["0", "0.5 cdag 1 c 0"]))
    wave = spark.createDataFrame([(1, 0.5)], "det bigint, c double")
    assert expand.operator_expansion(wave, terms, True, cutoff).count() == n


def test_truncation_is_strict(spark):
    wave = spark.createDataFrame([(1, 1.0), (2, 0.5), (4, 0.25)], "det bigint, c double")
    from quorbit.operators.select import truncated

    assert [r[0] for r in truncated(wave, 0.25).collect()] == [1]


def zero_diagonal(spark):
    return spark.createDataFrame([(d, 0.0) for d in range(64)], "det bigint, h double")


def test_exact_external(spark):
    wave = spark.createDataFrame([(3, 1.0), (5, 1.0)], "det bigint, c double")
    basis = wave.select("det").filter("det = 3")
    children = spark.createDataFrame([(3, 6, 2.0), (5, 6, -0.5), (3, 3, 10.0)], "det bigint, child bigint, h double")
    found = stat.exact(wave, children, basis, zero_diagonal(spark), -2.0)
    assert found == {"external": 1, "variance": pytest.approx(2.25), "pt2": pytest.approx(-1.125)}


def test_u_statistic_is_unbiased(spark):
    """Over all outcomes of three draws, weighted by their odds, the estimate is the exact value."""
    p, amplitude, draws = (0.25, 0.75), (2.0, -0.5), 3
    basis = spark.createDataFrame([(3,)], "det bigint")
    children = spark.createDataFrame([(3, 6, 2.0), (5, 6, -0.5)], "det bigint, child bigint, h double")
    total, negative = 0.0, False
    for k in range(draws + 1):
        odds = {0: 1, 1: 3, 2: 3, 3: 1}[k] * p[0] ** k * p[1] ** (draws - k)
        sampled = spark.createDataFrame([r for r in ((3, 1.0, p[0], k), (5, 1.0, p[1], draws - k)) if r[3]], "det bigint, c double, p double, n bigint")
        found = stat.u_statistic(stat.contributions(sampled, children, 0.0, False), basis, zero_diagonal(spark), draws, -2.0)
        total += odds * found["variance"]
        negative |= found["variance"] < 0
    assert total == pytest.approx(sum(amplitude) ** 2) and negative
    with pytest.raises(ValueError, match="two samples"):
        stat.u_statistic(None, basis, None, 1, -2.0)


def test_contribution_values_and_cutoffs(spark):
    sampled = spark.createDataFrame([(3, 0.5, 0.25, 2)], "det bigint, c double, p double, n bigint")
    children = spark.createDataFrame([(3, 6, 0.5), (3, 10, 0.4)], "det bigint, child bigint, h double")
    assert [tuple(r) for r in stat.contributions(sampled, children, 0.21, True).collect()] == [(3, 6, 2.0, 2.0)]
    assert stat.contributions(sampled, children, 0.25, True).count() == 0
    assert stat.contributions(sampled, children, 0.25, False).count() == 1


def test_operator_statistics(spark):
    lines = ["0", "1 cdag 2 c 0", "1 cdag 0 c 2", "-0.5 cdag 2 c 1", "-0.5 cdag 1 c 2", "0.5 cdag 2 c 2"]
    terms = A.term_table(spark, A.parse_operator(lines))
    wave = spark.createDataFrame([(1, 0.6), (2, 0.8)], "det bigint, c double")
    stat.check_stat_wave(wave)
    children = stat.operator_children(wave, terms, True)
    diagonal = E.operator_diagonal(spark.createDataFrame([(1,), (2,), (4,)], "det bigint"), terms)
    found = stat.exact(wave, children, wave.select("det"), diagonal, -2.0)
    assert found == {"external": 1, "variance": pytest.approx(0.04), "pt2": pytest.approx(-0.016)}
    batches = stat.evaluate_batches(spark, wave, wave.select("det"), lambda s: stat.operator_children(s, terms, True), lambda s: E.operator_diagonal(s, terms), 400, 3, -2.0, 5)
    assert [b["batch_id"] for b in batches] == [0, 1, 2]
    assert np.mean([b["variance"] for b in batches]) == pytest.approx(0.04, abs=0.05)


def test_tiny_denominators_are_an_error(spark):
    wave = spark.createDataFrame([(1, 1.0)], "det bigint, c double")
    children = spark.createDataFrame([(1, 2, 0.5)], "det bigint, child bigint, h double")
    with pytest.raises(ValueError, match="denominators"):
        stat.exact(wave, children, wave.select("det"), zero_diagonal(spark), 0.0)


def test_sampling_shares(spark):
    wave = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 3.0)], "det bigint, c double")
    got = {r["det"]: r["n"] for r in stat.sample_counts(wave, 120_000, 4, 1).collect()}
    again = {r["det"]: r["n"] for r in stat.sample_counts(wave.repartition(3), 120_000, 4, 1).collect()}
    assert got == again and sum(got.values()) == 120_000 and 2 not in got
    assert got[1] / 120_000 == pytest.approx(0.25, abs=0.01)


def test_normal_order_rules():
    c, cd = A.annihilate, A.create
    assert (c(1) * cd(1)).normal_ordered() == A.identity() - cd(1) * c(1)
    assert (cd(2) * cd(1)).normal_ordered() == -(cd(1) * cd(2))
    b, bd = (lambda s: A.annihilate(s, False)), (lambda s: A.create(s, False))
    assert (bd(2) * bd(1)).normal_ordered() == bd(1) * bd(2)
    assert not (bd(1) * bd(1)).normal_ordered().terms
    assert A.spin("sz", 0) == A.identity(False) * 0.5 - bd(0) * b(0)
    assert (A.spin("sx", 0) * A.spin("sx", 0)).normal_ordered() == A.identity(False) * 0.25
    op = cd(0) * c(1) * 2.0 + cd(1) * c(1)
    assert (op + op.dagger()).normal_ordered() == (op + op.dagger()).dagger().normal_ordered()
    assert [len(x.terms) for x in op.split()] == [1, 1]


def test_inner_products(spark):
    make = lambda c: spark.createDataFrame(list(enumerate(map(float, c))), "det bigint, c double")
    assert inner(make([1, 0]), make([0, 1])) == 0 and inner(make([2, 4]), make([6, 12])) == 60
    assert inner(normalized(make([3, 4])), normalized(make([3, 4]))) == pytest.approx(1)
    with pytest.raises(ValueError):
        start_vector(make([1, 1]), "given", det=9)


def test_drivers(spark, ring):
    ints, basis, _ = ring
    halves = [basis.select(h).distinct() for h in ("adet", "bdet")]
    out = diag.tensor(*halves, ints, diag.Options(eps=1e-5, block=12, restarts=3, rdm=True, carryover=8, heatbath_cutoff=0.3))
    assert out.energy == pytest.approx(-2.10274848, abs=1e-5) and out.extra["energy"] == pytest.approx(out.energy, abs=1e-6)
    assert out.carryover.count() == 8 and 0 < out.discarded < 1 and out.expanded.count() >= 8
    chain = A.parse_operator(G.bond_model([(i, i + 1) for i in range(5)], 1.0, 2.0))
    got = diag.operators(spark, G.fock_space(spark, 6, 3), chain, 6, diag.Options(method="lanczos", eps=1e-9, block=20, carryover=5))
    want = np.linalg.eigvalsh(dense(E.operator_edges(G.fock_space(spark, 6, 3), A.term_table(spark, chain), False), G.fock_space(spark, 6, 3)))[0]
    assert got.energy == pytest.approx(want, abs=1e-7) and got.carryover.count() == 5

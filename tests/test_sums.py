"""Sums that no order changes, and draws that no number of them makes larger."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorbit.functions.exact import exact_sums
from quorbit.operators import apply, solve, stat
from quorbit.operators.algebra import parse_operator, term_table
from quorbit.operators.elements import operator_edges
from quorbit.session import cut
from quorbit.sources import generate as G


@pytest.mark.parametrize("values", [
    [random.Random(1).gauss(0, 1) * 10 ** random.Random(k).uniform(-12, 6) for k in range(3000)],
    [1e16, 1.0, -1e16, 1e-5] * 50 + [3.0, -3.0, 0.1, 0.2, 0.3],
    [1e300, -1e300, 5e299, 1e280], [5e-324, 1e-310, -3e-324], [-0.1] * 7, [0.0, -0.0], [2.0**-30, 1.0, -1.0],
])
def test_sums_are_rounded_once_and_do_not_depend_on_order(spark, values):
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    found = {exact_sums(rows.repartition(n).orderBy(F.rand(n)) if n > 1 else rows.coalesce(1), F.col("x"))[0] for n in (1, 3, 7)}
    assert found == {math.fsum(values)}
    assert math.fsum(values) == float(sum(map(Fraction, values)))


def test_several_columns_and_odd_values(spark):
    rows = spark.createDataFrame([(1.0, math.inf, None), (2.5, 1.0, None)], "x double, y double, z double")
    assert exact_sums(rows, F.col("x"), F.col("y"), F.col("z"), F.col("x") * F.col("x")) == [3.5, math.inf, 0.0, 7.25]
    assert exact_sums(rows.limit(0), F.col("x")) == [0.0]
    assert math.isnan(exact_sums(spark.createDataFrame([(math.nan,), (1.0,)], "x double"), F.col("x"))[0])


def test_a_solver_with_exact_products(spark):
    basis = cut(G.fock_space(spark, 8, 4))
    edges = cut(operator_edges(basis, term_table(spark, parse_operator(G.bond_model([(i, i + 1) for i in range(7)], 1.0, 2.0))), False))
    for method, options in (("davidson", {"eps": 1e-6, "block": 16, "restarts": 4}), ("lanczos", {"eps": 1e-9})):
        assert solve.ground_state(edges, basis, method, exact=True, **options).energy == pytest.approx(-3.47264341, abs=1e-7)
    wave = apply.start_vector(basis, "random", 3)
    assert len({apply.inner(wave.repartition(n), wave) for n in (1, 2, 5)}) == 1


def test_draws_in_two_levels(spark):
    """A billion draws at once; counts within four deviations, the same for any layout, in as many parts as states ask for."""
    rng = np.random.default_rng(5)
    weights = rng.exponential(size=400)
    wave = spark.createDataFrame([(k, float(w) * (-1) ** k) for k, w in enumerate(weights)] + [(1000, 0.0)], "det bigint, c double")
    draws = 10**9
    got = {r["det"]: (r["n"], r["p"]) for r in stat.sample_counts(wave, draws, 3, per_part=50).collect()}
    assert sum(n for n, _ in got.values()) == draws and 1000 not in got
    for k, share in enumerate(weights / weights.sum()):
        n, p = got[k]
        assert p == pytest.approx(share, rel=1e-9) and abs(n - draws * share) < 5 * math.sqrt(draws * share)
    off = [(got[k][0] - draws * s) / math.sqrt(draws * s * (1 - s)) for k, s in enumerate(weights / weights.sum())]
    assert sum(abs(x) < 2 for x in off) > 0.9 * len(off) and 0.8 < np.std(off) < 1.2
    again = {r["det"]: r["n"] for r in stat.sample_counts(wave.repartition(5), draws, 3, per_part=50).collect()}
    assert again == {k: n for k, (n, _) in got.items()}
    other = {r["det"]: r["n"] for r in stat.sample_counts(wave, draws, 3, 1, per_part=50).collect()}
    assert other != again
    with pytest.raises(ValueError, match="two samples"):
        stat.sample_counts(wave, 1, 3)

"""Queries over all rows, against plain Python."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from quorbit.plans import catalog


def found(spark, small, name):
    return [r.asDict() for r in entry.queries()[name](spark, small).collect()]


def test_tensor_basis_has_every_pair_of_halves(spark, small):
    half = lambda det, offset: sum((det >> (2 * i + offset) & 1) << i for i in range(6))
    dets = [r["det"] for r in catalog.basis(spark, small).collect()]
    spread = lambda x: sum((x >> i & 1) << (2 * i) for i in range(6))
    want = {(a, b, spread(a) | spread(b) << 1) for a in {half(x, 0) for x in dets} for b in {half(x, 1) for x in dets}}
    got = [(r["adet"], r["bdet"], r["det"]) for r in found(spark, small, "join_tensor_basis_whole")]
    assert len(got) == len(want) and set(got) == want
    assert any(a >= 32 for a, _, _ in got) and any(b >= 32 for _, b, _ in got)


def test_word_order_places_every_state(spark, small):
    dets = [r["det"] for r in catalog.basis(spark, small, 16).collect()]
    want = {det: place for place, det in enumerate(sorted(dets, key=lambda x: (x >> 8, x & 255)), 1)}
    got = found(spark, small, "bit_word_order_whole")
    assert len(got) == len(want) > 100 and {r["det"]: r["place"] for r in got} == want


@pytest.mark.parametrize("name", ["agg_child_sums_whole", "agg_two_key_merge_whole"])
def test_child_sums_take_all_parents(spark, small, name):
    wave = {r["det"]: r["c"] for r in catalog.basis(spark, small).collect()}
    want = defaultdict(lambda: (0, 0))
    for det, c in wave.items():
        for i in range(12):
            for a in range(12):
                if det >> i & 1 and not det >> a & 1:
                    child = det ^ 1 << i ^ 1 << a
                    want[child] = (want[child][0] + c, want[child][1] + c * c)
    assert any(c % 2 for c in wave.values())
    assert {r["child"]: (r["x"], r["z"]) for r in found(spark, small, name)} == want

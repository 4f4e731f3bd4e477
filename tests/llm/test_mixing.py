"""Mixing against a plain version of targets and of the reduction tree."""

from __future__ import annotations

import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from quorbit.llm import mixing

SCHEMA = "doc_id bigint, text string, source string"


def rows(df):
    return [tuple(r) for r in df.collect()]


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Sources in order, nulls last; the excess over three times a size goes round by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    whole, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = whole - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return {s: share.get(s, 3.0 * sizes[s]) for s in order}
        capped |= above


def hashed(*values):
    """Spark's xxhash64 of int and long columns, unsigned."""
    h = 42
    for kind, v in values:
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), h)
    return h


def plain_rounding(members, seed, block):
    """(position, size, mass) to 0 or 1, by the tree."""
    up, level, span = {}, sorted(members), block
    last = max(p for p, _, _ in members)
    while True:
        blocks, carried = {}, []
        for m in level:
            blocks.setdefault(m[0] // span, []).append(m)
        for _, held in sorted(blocks.items()):
            carry = None
            for x in sorted(held):
                if carry is None:
                    carry = x
                    continue
                (p, s, m), (q, t, n) = carry, x
                chance = (hashed(("<i", seed), ("<q", p), ("<q", q)) >> 11) * 2.0**-53
                a, b = min(s - m, n), min(t - n, m)
                if chance * (a + b) < b:
                    m, n = (s if s - m <= n else m + n), (0.0 if n <= s - m else n - (s - m))
                else:
                    m, n = (0.0 if m <= t - n else m - (t - n)), (t if t - n <= m else n + m)
                carry = None
                for y in ((p, s, m), (q, t, n)):
                    if 0 < y[2] < y[1]:
                        carry = y
                    else:
                        up[y[0]] = int(y[2] > 0)
            if carry:
                carried.append(carry)
        level = carried
        if span > last:
            break
        span *= block
    for p, s, m in level:
        up[p] = int(2 * m >= s)
    return up


def test_rounding_is_the_tree(spark):
    rng = random.Random(2)
    members = [(k % 3, p, float(rng.randint(1, 900)), 0.0) for p, k in enumerate(sorted(rng.choices(range(3), k=900)))]
    members = [(g, p, s, s * rng.choice([0.25, 1 / 3, 0.9])) for g, p, s, _ in members]
    frame = spark.createDataFrame(members, "group int, position bigint, size double, mass double")
    got = {r["position"]: r["up"] for r in mixing.rounded(frame.repartition(5), 11, 8).collect()}
    assert sorted(got) == list(range(900))
    for g in range(3):
        own = [(p, s, m) for k, p, s, m in members if k == g]
        assert {p: got[p] for p, _, _ in own} == plain_rounding(own, 11, 8)
        assert abs(sum(s * got[p] - m for p, s, m in own)) <= max(s for _, s, _ in own) / 2 + 1e-6


def test_each_document_has_its_chance(spark):
    """Over many seeds a document is taken as often as its probability says."""
    sizes, share, tries = [3.0, 50.0, 7.0, 20.0, 20.0, 1.0, 90.0, 5.0, 12.0, 40.0, 33.0, 8.0], 0.3, 3000
    taken = [0] * len(sizes)
    for seed in range(tries):
        for p, up in plain_rounding([(p, s, s * share) for p, s in enumerate(sizes)], seed, 4).items():
            taken[p] += up
    # the last one is rounded to the nearer end, not by chance
    assert all(abs(t / tries - share) < 0.07 for t in taken)


def test_hard_rows(hard_docs, hard_rows, no_docs, clashing):
    sizes = {}
    for _, text, _, source, _ in hard_rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    want = plain_targets(sizes)
    found = rows(mixing.op11(hard_docs).select("doc_id", "size", "source_size", "target", "taken"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    expected = [(i, size_of(t), sizes[s], pytest.approx(want[s])) for i, t, _, s, _ in hard_rows]
    assert [r[:4] for r in sorted(found, key=key)] == sorted(expected, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert all(taken % size == 0 and taken <= 3 * size if size else taken == 0 for _, size, _, _, taken in found)
    again = rows(mixing.op11(clashing(hard_docs).repartition(3)).select("doc_id", "size", "source_size", "target", "taken"))
    assert sorted(again, key=key) == sorted(found, key=key)
    assert rows(mixing.op11(no_docs)) == []
    assert {r[4] for r in rows(mixing.op11(hard_docs.filter("doc_id in (3, 4, 5)")).select("doc_id", "size", "source_size", "target", "taken"))} == {0}


def test_one_source_of_most_rows_and_small_ones_at_their_end(spark):
    """Targets are met within a document, small sources stop at three times their size, and files do not matter."""
    rng = random.Random(8)
    docs = [(i, " ".join(["w"] * min(900, int(rng.lognormvariate(3, 1)) + 1)), "hot") for i in range(3000)]
    docs += [(5000 + i, " ".join(["w"] * rng.randint(1, 30)), f"s{i % 7}") for i in range(700)]
    docs += [(9000, "a b c", "tiny"), (9001, "", "empty"), (9002, None, None), (9003, "x y", None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    sizes, longest = {}, {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + size_of(text)
        longest[source] = max(longest.get(source, 0), size_of(text))
    want = plain_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    mixed = mixing.mix(frame).cache()
    taken = dict(rows(mixed.groupBy("source").agg(F.sum("taken"))))
    assert {s: t for s, t in rows(mixed.select("source", "target").distinct())} == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in want)
    assert taken["tiny"] == 9 and taken["empty"] == 0 and taken[None] == 6
    order = lambda df: sorted(rows(df.select("doc_id", "taken")))
    assert order(mixing.mix(frame.repartition(9).sortWithinPartitions(F.desc("text")))) == order(mixed)
    repeated = mixing.mixture(frame, mixed).groupBy("doc_id").agg(F.count("*").alias("copies"))
    assert sorted(rows(repeated)) == sorted(rows(mixed.filter("copies > 0").select("doc_id", "copies")))


def test_a_document_repeated_many_times(spark):
    docs = [(1, "one two three", "a")] * 500 + [(2, "four five", "a")] * 3 + [(3, "six " * 400, "b")]
    mixed = mixing.mix(spark.createDataFrame(docs, SCHEMA)).cache()
    assert mixed.count() == 504
    for source, target, taken in rows(mixed.groupBy("source").agg(F.first("target"), F.sum("taken"))):
        assert abs(taken - target) <= (2 if source == "a" else 200)

"""Product codes against plain whole-number arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quorbit.llm import registry, vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def rows(df):
    return [tuple(r) for r in df.collect()]


def floor_scaled(x):
    return math.floor(x * 1024) if abs(x) < 2**52 else int(x) * 1024


def plain(vectors):
    kept = [(i, [floor_scaled(x) for x in v], lab) for i, v, lab in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    span, start = width // 4, [r for r in kept[:256] if len(r[1]) == width]
    books = [[r[1][p * span : (p + 1) * span] for r in start] for p in range(4)]
    fit = [r for r in kept if len(r[1]) == width]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(c, x, strict=True)), e) for e, c in enumerate(book))

    for _ in range(4):
        for p, book in enumerate(books):
            sums = {}
            for _, v, _ in fit:
                x = v[p * span : (p + 1) * span]
                sums.setdefault(nearest(book, x)[1], []).append(x)
            for e, xs in sums.items():
                book[e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = []
    for i, v, lab in kept:
        found = [nearest(b, v[p * span : (p + 1) * span]) for p, b in enumerate(books)] if len(v) == width else None
        coded.append((i, "".join(f"{e:02x}" for _, e in found) if found else None, min(2**63 - 1, sum(d for d, _ in found)) if found else None, lab))
    sums = {}
    for _, _, error, lab in coded:
        if error is not None:
            sums[lab] = sums.get(lab, 0) + error
    return [(i, code, error, min(2**63 - 1, sums[lab]) if lab in sums else None, digest) for i, code, error, lab in coded]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, repr(r))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("n, width, spread", [(700, 16, 0.4), (300, 8, 30.0), (40, 4, 1.0)])
def test_codes_of_clusters(spark, n, width, spread):
    rng = random.Random(n)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(12)]
    vectors = [(i, [c + rng.gauss(0, 0.2) * spread for c in rng.choice(centres)], rng.choice([None, 1, 1, 1, 2])) for i in rng.sample(range(10 * n), n)]
    vectors += [(i, v, 3) for i, v, _ in vectors[:20]]  # repeated ids, and ties of distance
    same(rows(vector_codes.op13(spark.createDataFrame(vectors, SCHEMA))), plain(vectors))


def test_hard_rows(spark):
    """Nulls anywhere, non-finite components, other lengths, equal vectors, numbers beyond int64, clashing names, many copies of one."""
    rng = random.Random(1)
    vectors = [(i, [rng.uniform(-2, 2) for _ in range(8)], i % 3) for i in range(60)]
    vectors += [(500, None, 1), (501, [], 1), (502, [1.0] * 7, 2), (503, [1.0, None, *[0.0] * 6], 1), (504, [math.nan] * 8, 1), (505, [math.inf, *[0.0] * 7], 1), (506, [-math.inf] * 8, None)]
    vectors += [(None, [0.5] * 8, None), (None, None, None), (None, [0.25] * 8, 1), (7, [0.1] * 8, None)]
    vectors += [(600 + i, [-3.0, 0.0] * 4, 5) for i in range(300)]
    vectors += [(900, [1e18, *[0.0] * 7], 6), (901, [1e300, -1e300, *[1.0] * 6], 6), (902, [-4e15] * 8, 7)]
    frame = spark.createDataFrame(vectors, SCHEMA)
    want = plain(vectors)
    same(rows(vector_codes.op13(frame)), want)
    clashing = frame.select("*", *[F.lit("clash").alias(c) for c in ("vector", "key", "n", "cell", "place", "code", "error", "salt", "VEC_ID ")])
    same(rows(vector_codes.op13(clashing.repartition(7))), want)


def test_no_rows_and_unequal_parts(spark):
    assert rows(vector_codes.op13(spark.createDataFrame([], SCHEMA))) == []
    assert rows(vector_codes.op13(spark.createDataFrame([(1, None, 1)], SCHEMA))) == []
    assert [r[:4] for r in rows(vector_codes.op13(spark.createDataFrame([(1, [], 1)], SCHEMA)))] == [(1, None, None, None)]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.op13(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA))


def test_the_sql_says_the_same(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    con = duckdb.connect()
    con.register("embeddings", frame.toArrow())
    got = con.execute(registry.oracle_sql()["op13_vector_codes"])
    same(rows(vector_codes.op13(frame).select(*[c[0] for c in got.description])), got.fetchall())


def test_only_the_annulus_is_evaluated():
    """Where norms differ, few entries are looked at; and the nearest is found all the same."""
    rng = np.random.default_rng(3)
    book = (rng.normal(size=(256, 16)) * np.linspace(1, 2000, 256)[:, None]).astype(np.int64)
    parts = book[rng.integers(0, 256, 500)] + rng.integers(-3, 4, (500, 16))
    seen = []

    class Counting(vector_codes.Codebook):
        def _keys(self, parts, entries, places):
            seen.append(places.size)
            return super()._keys(parts, entries, places)

    entry, squared = Counting(book).nearest(parts)
    apart = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (entry == apart.argmin(axis=1)).all() and (squared == apart.min(axis=1)).all()
    assert sum(seen) < 0.35 * 500 * 256

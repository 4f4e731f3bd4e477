import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorbit.functions import bits as B


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_and_words(spark):
    assert one(spark, B.from_text(F.lit("10000001"), 8)) == (129,)
    assert one(spark, B.words_from_text(F.lit("10000001"), 8, 4)) == ([1, 8],)
    assert one(spark, B.words_to_text(F.array(F.lit(1).cast("long"), F.lit(8).cast("long")), 8, 4)) == ("10000001",)
    for wrong in ("1000000", "10000002", ""):
        with pytest.raises(Exception, match="not a bit string"):
            one(spark, B.from_text(F.lit(wrong), 8))


def test_interleave_known(spark):
    ten = F.lit(0b1010).cast("long")
    assert one(spark, B.interleave(ten, F.lit(0).cast("long"), 4)) == (0b01000100,)
    assert one(spark, B.interleave(F.lit(0).cast("long"), ten, 4)) == (0b10001000,)


def test_against_python(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(40), rng.getrandbits(40), rng.randrange(40), rng.randrange(40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, i int, j int")
    got = df.select(
        "a", "b", "i", "j", B.hamming("a", "b"), B.sites("a", 40), B.parity("a", F.col("i"), F.col("j")), B.string_sign("a", F.col("i")),
        B.interleave(F.col("a").bitwiseAND(F.lit(0xFFFFF)), F.col("b").bitwiseAND(F.lit(0xFFFFF)), 20), B.created("a", "b", 40),
    ).collect()
    for a, b, i, j, ham, sites, par, sign, inter, made in got:
        assert ham == (a ^ b).bit_count()
        assert sites == [k for k in range(40) if a >> k & 1]
        low, high = min(i, j), max(i, j)
        assert par == (-1) ** sum(a >> k & 1 for k in range(low + 1, high))
        assert sign == (-1) ** sum(a >> k & 1 for k in range(i))
        assert inter == sum((a >> k & 1) << (2 * k) | (b >> k & 1) << (2 * k + 1) for k in range(20))
        assert made == [k for k in range(40) if a >> k & 1 and not b >> k & 1]
    back = df.select("a", B.alpha_of(B.interleave(F.col("a").bitwiseAND(F.lit(0xFFFFF)), F.lit(0).cast("long"), 20), 20)).collect()
    assert all(x == a & 0xFFFFF for a, x in back)


def test_wide_states_order_by_the_last_word(spark):
    texts = ["1" + "0" * 79, "0" + "1" * 79, "0" * 80, "0" * 79 + "1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", B.words_from_text("t", 80).alias("w"))
    assert [r[0] for r in df.orderBy(B.word_order("w")).collect()] == sorted(texts)
    assert all(r[0] == r[1] for r in df.select("t", B.words_to_text(B.change_word_bits("w", 80, 62, 31), 80, 31)).collect())


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**63), st.integers(0, 1000))
def test_counter_random(seed, stream):
    u = B.unit_random(seed, np.full(50, stream), np.arange(50))
    assert ((u >= 0) & (u < 1)).all() and len(set(u.tolist())) == 50
    assert (u[7:] == B.unit_random(seed, np.full(43, stream), np.arange(7, 50))).all()

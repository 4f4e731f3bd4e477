"""Sums of doubles that do not depend on the order of rows.

A number is cut into whole digits below the greatest magnitude of its column, and
digits are summed as longs, which no order changes. Together they hold 126 bits, so
a sum is that of the exact numbers but for what lies 2^-73 and more below the last
bit of the greatest; it is rounded once, at the end.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the first digit and of each other one: long sums hold 2^31 rows.
FIRST, OTHER, DIGITS = 30, 32, 4


def _scaled(x: Column, bits: int) -> Column:
    """By a power of two, in two steps, as one may be out of a double's range."""
    return x * F.lit(2.0 ** (bits // 2)) * F.lit(2.0 ** (bits - bits // 2))


def _digits(x: Column, exponent: int) -> list[Column]:
    left, out = _scaled(x, FIRST - exponent), []
    for k in range(DIGITS):
        whole = F.floor(left)
        out.append(whole.cast("long"))
        left = (left - whole.cast("double")) * F.lit(2.0**OTHER) if k < DIGITS - 1 else left
    return out


def exact_sums(rows: DataFrame, *values: Column) -> list[float]:
    """The sums of columns: one aggregation for their magnitudes, one for their digits. Nulls count as nothing, no rows as 0; a sum of numbers that are not finite is that of doubles."""
    named = rows.select(*[v.cast("double").alias(f"v{k}") for k, v in enumerate(values)])
    names = named.columns
    greatest = named.agg(*[F.max(F.abs(n)) for n in names]).first()
    plain = [not g or not math.isfinite(g) for g in greatest]
    exponents = [0 if p else math.frexp(g)[1] for p, g in zip(plain, greatest, strict=True)]
    sums = []
    for name, p, e in zip(names, plain, exponents, strict=True):
        sums += [F.sum(name)] if p else [F.sum(d) for d in _digits(F.col(name), e)]
    found, out = list(named.agg(*sums).first()), []
    for p, e in zip(plain, exponents, strict=True):
        if p:
            out.append(float(found.pop(0) or 0.0))
            continue
        digits = [found.pop(0) or 0 for _ in range(DIGITS)]
        total = sum(d << OTHER * (DIGITS - 1 - k) for k, d in enumerate(digits))
        out.append(float(Fraction(total) * Fraction(2) ** (e - FIRST - OTHER * (DIGITS - 1))))
    return out

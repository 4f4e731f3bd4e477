"""Vectors on a basis: (det, c) rows, with real coefficients or complex ones (structs of re and im)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.functions import complex as X
from quorbit.functions.bits import Wide, key_random, keys, word_order
from quorbit.functions.exact import exact_sums


def _product(rows: DataFrame, a: str, b: str) -> tuple[Column, bool]:
    """The product of two columns, complex if either is, and whether it is."""
    kinds = [X.is_complex(rows, c) for c in (a, b)]
    if not any(kinds):
        return F.col(a) * F.col(b), False
    return X.times(*(X.as_complex(F.col(c), k) for c, k in zip((a, b), kinds, strict=True))), True


def inner(x: DataFrame, y: DataFrame) -> float | complex:
    """<x|y>, in which x is conjugated; the same to the last bit however rows are dealt."""
    own = X.conjugate(F.col("c")) if X.is_complex(x, "c") else F.col("c")
    joined = x.select("det", own.alias("x")).join(y.select("det", F.col("c").alias("y")), "det")
    value, of_complex = _product(joined, "x", "y")
    return complex(*exact_sums(joined, value["re"], value["im"])) if of_complex else exact_sums(joined, value)[0]


def norm(x: DataFrame) -> float:
    square = X.square(F.col("c")) if X.is_complex(x, "c") else F.col("c") * F.col("c")
    return math.sqrt(exact_sums(x, square)[0])


def scaled(x: DataFrame, factor: float | complex) -> DataFrame:
    own = X.is_complex(x, "c")
    if isinstance(factor, complex):
        return x.withColumn("c", X.times(X.as_complex(F.col("c"), own), X.make(F.lit(factor.real), F.lit(factor.imag))))
    return x.withColumn("c", X.scaled(F.col("c"), F.lit(factor), own))


def normalized(x: DataFrame) -> DataFrame:
    size = norm(x)
    if size == 0:
        raise ValueError("a zero vector has no direction")
    return scaled(x, 1 / size)


def mult(edges: DataFrame, x: DataFrame) -> DataFrame:
    """H x: edges meet the vector on the ket, and sums go by bra; every state of x is in the result."""
    return gathered(edges.join(x.select(F.col("det").alias("ket"), "c"), "ket"), x)


def gathered(edges: DataFrame, x: DataFrame) -> DataFrame:
    """H x from edges that bring their ket's ``c``: sums by bra; every state of x is in the result."""
    value, of_complex = _product(edges, "h", "c")
    found = edges.groupBy(F.col("bra").alias("det")).agg(X.total(value, of_complex).alias("hc"))
    zero = X.make(F.lit(0.0), F.lit(0.0)) if of_complex else F.lit(0.0)
    return x.select("det").join(found, "det", "left").select("det", F.coalesce("hc", zero).alias("c"))


def combined(vectors: list[DataFrame], weights: list[float | complex]) -> DataFrame:
    """Sum of weight x vector, as one grouped sum over their union."""
    parts = [scaled(v.select("det", "c"), w if isinstance(w, complex) else float(w)) for v, w in zip(vectors, weights, strict=True)]
    kinds = [X.is_complex(p, "c") for p in parts]
    total = None
    for part, kind in zip(parts, kinds, strict=True):
        part = part.withColumn("c", X.as_complex(F.col("c"), kind)) if any(kinds) else part
        total = part if total is None else total.unionByName(part)
    return total.groupBy("det").agg(X.total("c", any(kinds)).alias("c"))


def expectation(edges: DataFrame, x: DataFrame) -> float:
    """<x|H|x> / <x|x>, which is real for a Hermitian operator."""
    return complex(inner(x, mult(edges, x))).real / norm(x) ** 2


def start_vector(basis: DataFrame, kind: str = "first", seed: int = 0, det: int | list[int] | None = None) -> DataFrame:
    """Unit vector: on the first state, random by key, or on one given state, which the basis must hold once."""
    if kind == "random":
        return normalized(basis.select("det", key_random(seed, F.col("det")).alias("c")))
    wide = isinstance(keys(basis), Wide)
    if kind == "first":
        det = basis.agg(F.reverse(F.min(word_order("det"))) if wide else F.min("det")).first()[0]
    value = F.array(*[F.lit(w).cast("long") for w in det]) if wide and det is not None else F.lit(det)
    if (found := basis.filter(F.col("det") == value).count()) != 1:
        raise ValueError(f"the initial state is in the basis {found} times, not once")
    return basis.select("det", F.when(F.col("det") == value, 1.0).otherwise(0.0).alias("c"))

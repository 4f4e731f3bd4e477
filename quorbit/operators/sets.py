"""Merging, ordering and set operations on states, and figures over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(rows: DataFrame, value: str, key: Column | str = "det", name: str = "det") -> DataFrame:
    """Equal keys as one, with the sum of their values; map-side first."""
    key = F.col(key) if isinstance(key, str) else key
    return rows.groupBy(key.alias(name)).agg(F.sum(value).alias(value))


def masked(basis: DataFrame, mask: int, det: str = "det") -> DataFrame:
    """(masked, n): the distinct states under a mask, and how many states have each."""
    return basis.groupBy(F.col(det).bitwiseAND(F.lit(mask)).alias("masked")).agg(F.count("*").alias("n"))


def sorted_unique(rows: DataFrame, key: str = "det") -> DataFrame:
    """Distinct keys in order, by a range exchange after one that merges equal keys."""
    return rows.select(key).distinct().orderBy(key)


def merged_runs(runs: list[DataFrame], key: str = "det") -> DataFrame:
    """The distinct keys of several runs."""
    return appended(runs, key).distinct()


def appended(runs: list[DataFrame], key: str = "det") -> DataFrame:
    """All keys of several runs, repeated ones too."""
    out = runs[0].select(key)
    for run in runs[1:]:
        out = out.unionAll(run.select(key))
    return out


def inside(children: DataFrame, basis: DataFrame) -> DataFrame:
    """Children that the basis holds; ``edges.outside`` has the others."""
    return children.join(basis.select("det"), "det", "left_semi")


def totals(wave: DataFrame) -> DataFrame:
    """n, total, greatest, last: the number of states, the sum of the coefficients, the greatest by magnitude, and the last key."""
    return wave.agg(F.count("*").alias("n"), F.sum("c").alias("total"), F.max(F.abs("c")).alias("greatest"), F.max("det").alias("last"))


def task_cost(halved: DataFrame) -> DataFrame:
    """cost: over all states, the product of how many states share its halves, which is what pairing them costs."""
    a, b = (halved.groupBy(half).agg(F.count("*").alias(f"n_{half}")) for half in ("adet", "bdet"))
    return halved.join(a, "adet").join(b, "bdet").agg(F.sum(F.col("n_adet") * F.col("n_bdet")).alias("cost"))


def deltas(rows: DataFrame, value: str, order: list[str], by: str) -> DataFrame:
    """``delta``: the value less the one before it within a series, null for the first."""
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(*order)))


def range_owner(rows: DataFrame, starts: list, key: str = "det") -> DataFrame:
    """``owner``: which of the ranges that begin at the ascending ``starts`` holds a key; keys before the first go to it.

    ``starts`` has an entry for each range, not for each state, so it is part of
    the expression, and rows are looked up where they are.
    """
    passed = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col(key)))
    return rows.withColumn("owner", F.greatest(passed - 1, F.lit(0)))


def range_starts(sharded: DataFrame, key: str = "det", shard: str = "shard") -> list:
    """The least key of each shard of consecutive keys, in order."""
    return [r[0] for r in sharded.groupBy(shard).agg(F.min(key).alias("least")).orderBy("least").select("least").collect()]

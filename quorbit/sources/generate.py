"""Synthetic states and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.session import table


def fock_space(spark: SparkSession, width: int, particles: int) -> DataFrame:
    """All states with a number of particles, by filling sites: as many rows as there are states, not 2^width.

    The first sites' choices are dealt over tasks, and each task fills the others.
    """
    rows = spark.range(1).select(F.lit(0).cast("long").alias("det"), F.lit(-1).alias("last"))
    for k in range(particles):
        free = F.sequence(F.col("last") + 1, F.lit(width - particles + k))
        rows = rows.withColumn("site", F.explode(free)).select(F.col("det").bitwiseOR(B.bit(F.col("site"))).alias("det"), F.col("site").alias("last"))
        if k == min(2, particles - 1):
            rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "det")
    return rows.select("det")


def sampled_states(spark: SparkSession, width: int, particles: int, n: int, seed: int = 0) -> DataFrame:
    """About n distinct states of fixed weight: each row ranks its sites by hash and fills the first ones."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("id"), i).alias("h"), i.alias("i")))
    chosen = F.slice(F.array_sort(keys), 1, particles)
    det = F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(B.bit(x["i"])))
    return spark.range(n).select(det.alias("det")).distinct()


def product_states(alpha: DataFrame, beta: DataFrame, width: int) -> DataFrame:
    """(adet, bdet, det) for every pair of halves: the tensor basis, which is all pairs by definition."""
    pairs = alpha.select("adet").join(beta.select("bdet"))
    return pairs.withColumn("det", B.interleave("adet", "bdet", width) if 2 * width <= B.WORD_BITS else B.interleave_words("adet", "bdet", width))


def bond_model(edges: list[tuple[int, int]], hopping: float, repulsion: float, fermion: bool = False) -> list[str]:
    """Operator-file lines: hopping and repulsion on bonds, of hard-core bosons or fermions."""
    up, down = ("cdag", "c") if fermion else ("bdag", "b")
    lines = ["0" if fermion else "1"]
    for i, j in edges:
        lines += [f"{-hopping} {up} {i} {down} {j}", f"{-hopping} {up} {j} {down} {i}", f"{repulsion} {up} {i} {down} {i} {up} {j} {down} {j}"]
    return lines


def hubbard(sites: int, hopping: float, u: float, ring: bool) -> tuple[dict, dict]:
    """Spatial integrals of a chain or ring: one(p, q) and (pp|pp)."""
    bonds = [(i, i + 1) for i in range(sites - 1)] + ([(0, sites - 1)] if ring else [])
    return {b: -hopping for b in bonds}, {(i, i, i, i): u for i in range(sites)}


def table_basis(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """(det, c) of m sites from line items: half-filled keys, and whole quantities as weights."""
    key = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_suppkey")).bitwiseAND(F.lit((1 << m) - 1))
    rows = table(spark, sf_dir, "lineitem").select(key.alias("det"), F.round("l_quantity").cast("bigint").alias("q"))
    return rows.filter(F.bit_count("det") == m // 2).groupBy("det").agg(F.sum("q").alias("c"))

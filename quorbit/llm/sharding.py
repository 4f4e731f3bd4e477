"""Uniform shuffle into shards of exact size.

A hypergeometric communication matrix says how many rows each cell of the input
sends to each shard; within a cell a random order decides which rows these are,
and within a shard a second random order decides their slots. That is what one
uniform random permutation of all rows would give, without a global sort.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorbit.llm.columns import n_bytes, pick
from quorbit.session import cut

ROWS_PER_CELL = 50_000
#: So many cells at least, that no task holds much of a small input, and at most, that the matrix stays small (65,536 x shards).
CELLS = (256, 65_536)


def hypergeometric(chance: random.Random, good: int, bad: int, drawn: int) -> int:
    """Exact draw by inversion, outwards from the mode; about as many steps as the standard deviation."""
    least, most = max(0, drawn - bad), min(good, drawn)
    if least == most:
        return least
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low = high = min(most, max(least, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p_low = p_high = math.exp(log(good, low) + log(bad, drawn - low) - log(good + bad, drawn))
    left = chance.random() - p_low
    while left > 0 and (low > least or high < most):
        if low > least:
            p_low *= low * (bad - drawn + low) / ((good - low + 1) * (drawn - low + 1))
            low -= 1
            if (left := left - p_low) <= 0:
                return low
        if high < most:
            p_high *= (good - high) * (drawn - high) / ((high + 1) * (bad - drawn + high + 1))
            high += 1
            if (left := left - p_high) <= 0:
                return high
    return low if left <= 0 else high


def communication_matrix(cells: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sum to ``cells``, columns to ``shards``; drawn as a uniform shuffle would deal them."""
    if sum(cells) != sum(shards):
        raise ValueError("cells and shards hold different numbers of rows")
    chance, left, matrix = random.Random(seed), list(shards), []
    for size in cells:
        row, rest = [], sum(left)
        for room in left:
            rest -= room
            row.append(hypergeometric(chance, room, rest, size - sum(row)))
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def cells_for(rows: int) -> int:
    return min(CELLS[1], max(CELLS[0], -(-rows // ROWS_PER_CELL)))


def shuffle_into_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 17) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Shards differ by one row at most; slots run from 0 in each shard without a
    gap. The order depends on ids, texts and the seed alone, not on how files
    and partitions lie. Null text: size 1, checksum 0. Null ids, equal texts
    and rows that are repeated whole are rows like any other. An empty table
    gives an empty result.
    """
    text = F.col("text")
    rows = cut(
        pick(docs, doc_id=id_col, text=text_col).select(
            "doc_id",
            (n_bytes(text) + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id", text).alias("key"),
        )
    )
    total = rows.count()
    n_cells, n_parts = cells_for(total), max(32, cells_for(total) // n_shards)
    spark, id_type = docs.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    rows = rows.withColumn("cell", F.pmod("key", F.lit(n_cells)).cast("int"))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy("cell").count().collect())  # n_cells rows at most
    matrix = communication_matrix([n for _, n in sizes], [total // n_shards + (s < total % n_shards) for s in range(n_shards)], seed)
    dealt = spark.createDataFrame([(cell, list(accumulate(row))) for (cell, _), row in zip(sizes, matrix, strict=True)], "cell int, upto array<long>")

    # permute locally: the order in a cell decides which of its rows go to which shard
    place = F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "size")) - 1
    again = F.xxhash64(F.lit(seed + 1), "key", "doc_id")
    sent = cut(
        rows.withColumn("place", place)
        .join(F.broadcast(dealt), "cell")
        .withColumn("shard", F.size(F.filter("upto", lambda end: end <= F.col("place"))))
        .select("doc_id", "size", "text_crc32", "shard", again.alias("key"))
    )
    # permute again: parts of a shard follow one another, and each is in an order of its own
    sent = sent.withColumn("part", F.pmod("key", F.lit(n_parts)).cast("int"))
    ends: list[tuple[int, int, int, int]] = []
    for shard, part, n in sorted(tuple(r) for r in sent.groupBy("shard", "part").count().collect()):  # n_shards x n_parts rows at most
        before = ends[-1][2] + ends[-1][3] if ends and ends[-1][0] == shard else 0
        ends.append((shard, part, before, n))
    offsets = spark.createDataFrame([e[:3] for e in ends], "shard int, part int, before long")
    order = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "doc_id", "size"))
    return (
        sent.withColumn("order", order)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(F.col("doc_id").cast(id_type), "size", "text_crc32", "shard", slot("before", "order").alias("slot"))
    )


def slot(before: str, order: str) -> Column:
    return (F.col(before) + F.col(order) - 1).cast("long")


def op5(docs: DataFrame) -> DataFrame:
    return shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )

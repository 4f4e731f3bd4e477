"""Ranking, top-k, cumulative-weight and threshold selection, and how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorbit.functions import complex as X
from quorbit.operators.observe import marginal
from quorbit.session import cut


#: Rows of a top-k that one task merges; more are ranked in ordered parts, with the same result.
MOST_IN_ONE_TASK = 100_000


def parts_for(rows: DataFrame) -> int:
    """Ordered parts: as many as the session has for a shuffle, which is where a cluster's size and its data's are set."""
    return max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(rows: DataFrame, value: str = "c", key: str = "det", parts: int | None = None) -> DataFrame:
    """``position`` from 0 by value descending, then key.

    Rows are ranged by value into ordered parts, numbered within, and offset by
    the parts' sizes: no task holds all rows.
    """
    order = [F.desc(value), F.asc(key)]
    # checkpointed, as its two uses must see the same ranges
    ranged = cut(rows.repartitionByRange(parts or parts_for(rows), *order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").count()
    offsets = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("position", (F.coalesce("before", F.lit(0)) + F.col("inside") - 1).cast("bigint")).drop("part", "inside", "before")


def running_sum(rows: DataFrame, value: str, order: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """``before``: the sum of the rows before, 0 for the first; within each ``by``, or over all rows.

    Over all rows, sums of ordered parts come first, then sums within parts, so no
    task holds all rows. Rows of equal order add up in any order among themselves.
    """
    over = lambda w: F.coalesce(F.sum(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if by:
        return rows.withColumn("before", over(Window.partitionBy(by)))
    # checkpointed, as its two uses must see the same ranges
    ranged = cut(rows.repartitionByRange(parts or parts_for(rows), order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = ranged.withColumn("before", over(Window.partitionBy("_part")))
    return inside.join(F.broadcast(offsets), "_part").withColumn("before", F.col("before") + F.col("_before")).drop("_part", "_before")


def weight_cut(rows: DataFrame, weight: str, key: str, target: float, parts: int | None = None) -> DataFrame:
    """The shortest prefix, by weight descending, whose sum is over ``target`` of the whole.

    A row stays if the sum before it is not over the target. Sums of ordered
    parts first; then within parts.
    """
    order = [F.desc(weight), F.asc(key)]
    # checkpointed, as its two uses must see the same ranges
    ranged = cut(rows.repartitionByRange(parts or parts_for(rows), *order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("part", before.alias("w_before"), total.alias("w_all"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part").filter(F.col("w_before") + F.col("inside") <= F.lit(target) * F.col("w_all"))
    return kept.select(*rows.columns)


def truncated(wave: DataFrame, threshold: float) -> DataFrame:
    """States with |c|^2 over the threshold."""
    return wave.filter(weight_of(wave) > threshold)


def weight_of(wave: DataFrame) -> Column:
    """|c|^2 of real or complex coefficients."""
    return X.square(F.col("c")) if X.is_complex(wave, "c") else F.col("c") * F.col("c")


def top_states(wave: DataFrame, k: int) -> tuple[DataFrame, float]:
    """The k states of the greatest |c|^2, ties by key, and the weight that is left out."""
    if k > MOST_IN_ONE_TASK:
        kept = ranked(wave.withColumn("_w", weight_of(wave)), "_w").filter(F.col("position") < k).drop("_w", "position")
    else:
        kept = wave.orderBy(F.desc(weight_of(wave)), "det").limit(k)
    weights = [float(d.agg(F.sum(weight_of(d))).first()[0] or 0.0) for d in (wave, kept)]
    return kept, 1 - weights[1] / weights[0] if weights[0] else 0.0


def top_halves(wave: DataFrame, half: str, k: int) -> DataFrame:
    held = marginal(wave, half)
    if k > MOST_IN_ONE_TASK:
        return ranked(held, "p", half).filter(F.col("position") < k).drop("position")
    return held.orderBy(F.desc("p"), half).limit(k)


def in_shards(rows: DataFrame, n: int, key: str = "det") -> DataFrame:
    """``shard``: round robin by rank."""
    return ranked(rows, "c", key).withColumn("shard", F.pmod("position", F.lit(n)).cast("int"))


def equal_ranges(rows: DataFrame, n: int, key: str = "det", parts: int | None = None) -> DataFrame:
    """``shard``: n ranges of consecutive keys whose sizes differ by one at most, larger ones first."""
    total = rows.count()
    size, more = divmod(total, n)
    numbered = ranked(rows.withColumn("_none", F.lit(0)), "_none", key, parts).drop("_none")
    p = F.col("position")
    head = more * (size + 1)
    shard = F.when(p < head, F.floor(p / (size + 1))).otherwise(more + F.floor((p - head) / max(size, 1))).cast("int")
    return numbered.withColumn("shard", shard)


def grid_cells(rows: DataFrame, n_alpha: int, n_beta: int) -> DataFrame:
    """``cell``: cyclic over the ranks of the distinct halves."""
    ranks = []
    for half in ("adet", "bdet"):
        distinct = rows.select(half).distinct().withColumn("_none", F.lit(0))
        ranks.append(ranked(distinct, "_none", half).select(half, F.col("position").alias(f"{half}_rank")))
    joined = rows.join(ranks[0], "adet").join(ranks[1], "bdet")
    return joined.withColumn("cell", (F.pmod("adet_rank", F.lit(n_alpha)) * n_beta + F.pmod("bdet_rank", F.lit(n_beta))).cast("int")).drop("adet_rank", "bdet_rank")


def is_sorted(rows: DataFrame, key: str, place: str, by: str) -> DataFrame:
    """(by, wrong): rows whose key is not over the key before, for each group."""
    before = F.lag(key).over(Window.partitionBy(by).orderBy(place))
    return rows.withColumn("_before", before).groupBy(by).agg(F.sum(F.when(F.col("_before") >= F.col(key), 1).otherwise(0)).alias("wrong"))


def shuffled(rows: DataFrame, seed: int, key: str = "det", parts: int | None = None) -> DataFrame:
    """``position``: a seeded order in which the least key stays first, however rows lie."""
    first = rows.agg(F.min(key).alias("first")).first()[0]
    if first is None:
        return rows.withColumn("position", F.lit(0).cast("bigint"))
    h = F.when(F.col(key) == F.lit(first), F.lit(None)).otherwise(F.xxhash64(F.lit(seed), F.col(key)))
    return ranked(rows.withColumn("_h", F.coalesce(h, F.lit((1 << 63) - 1))), "_h", key, parts).drop("_h")

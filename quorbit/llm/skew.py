"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is split beyond this share of all rows, and so many rows; so no more than KEYS keys are.
KEYS, LEAST_ROWS = 10_000, 500


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, with the number of the key's rows on the left.

    A key of many rows goes to several tasks: its rows on the left are dealt over
    them in turn, and its row on the right goes to each. The keys that are split are
    broadcast; there are KEYS at most. ``left`` must come in the same order when it
    is read again, as a table or a checkpoint does.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    most = max(LEAST_ROWS, total // KEYS)
    parts = F.ceil(F.col(rows) / most).cast("long")
    split = right.filter(F.col(rows) > most).select(*on, parts.alias("parts"))
    dealt = left.join(F.broadcast(split), on, "left").withColumn("salt", F.coalesce(F.monotonically_increasing_id() % F.col("parts"), F.lit(0))).drop("parts")
    copied = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copied, [*on, "salt"]).drop("salt")

"""Picking columns, and the texts' common notions of word and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: the space and the characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pick(df: DataFrame, row: bool = False, **named: str) -> DataFrame:
    """The columns ``named`` (new=old), found by exact name and position.

    Other columns go, so that names which clash with an operator's own, also in
    another letter case or twice, do no harm; with ``row``, a column of that
    name holds them all, for ``unpack``. An absent column is an error.
    """
    places = {new: df.columns.index(old) for new, old in named.items()}
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    whole = [F.struct(*flat.columns).alias("row")] if row else []
    return flat.select(*(F.col(f"c{i}").alias(new) for new, i in places.items()), *whole)


def unpack(df: DataFrame, like: DataFrame, **replaced: Column) -> DataFrame:
    """The columns of ``like`` from the column ``row``, but for those that are ``replaced``, which keep their types."""
    made = []
    for i, (name, kind) in enumerate(like.dtypes):
        column = replaced[name].cast(kind) if name in replaced else F.col(f"row.c{i}")
        made.append(column.alias(name))
    return df.select(*made)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

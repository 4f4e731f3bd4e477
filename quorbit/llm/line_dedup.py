"""Repeated three-line windows.

Hashes of three consecutive lines that hold a word are compared over all
documents; every occurrence of a window but the first is a copy, and the lines
that copies cover, merged where they overlap, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.llm.columns import BLANKS, pick
from quorbit.llm.skew import spread_join
from quorbit.session import cut

SPAN = 3


def _windows(lines: Column, span: int) -> Column:
    """Of the lines that hold a word: the first line's index, the last one's and a 128-bit hash, for each window."""
    full = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(F.translate(x, BLANKS, " " * len(BLANKS))).alias("s"))),
        lambda x: x["s"] != "",
    )

    def of(held: Column) -> Column:
        at = lambda j, k: held[j + k]
        texts = lambda j: [at(j, k)["s"] for k in range(span)]
        made = F.transform(
            F.sequence(F.lit(0), F.size(held) - span),
            lambda j: F.struct(
                at(j, 0)["i"].alias("start"),
                at(j, span - 1)["i"].alias("end"),
                F.xxhash64(*texts(j)).alias("a"),
                F.xxhash64(F.lit(1), *texts(j)).alias("b"),
            ),
        )
        return F.when(F.size(held) >= span, made)

    return F.element_at(F.transform(F.array(full), of), 1)


def copied_windows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """From (id, mark, text): id, mark, start, end of each window that is not the first of its kind.

    First is the least (id, mark, start), where null ids come first; ``mark``
    tells texts of one id apart. Windows are made once, into a checkpoint; one that
    many texts share is split over tasks.
    """
    made = cut(docs.select("id", "mark", F.explode(_windows(F.split("text", "\n"), span)).alias("w")).select("id", "mark", "w.*"))
    order = F.struct("id", "mark", "start")
    first = made.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1")
    return spread_join(made, first, ["a", "b"], "n").filter(~order.eqNullSafe(F.col("first"))).select("id", "mark", "start", "end")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, row: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text without copied lines, n_lines, n_removed; with ``row``, also the whole row.

    Lines are what newlines separate; blank ones form no window and stay unless
    a copied window spans them. Lines compare without blanks at their ends.
    Texts of fewer lines than a window, and null ones, stay as they are. Rows
    that are repeated whole count as one document and share its result. Null ids
    are one id, the least; of equal windows the one of the least id, text and place
    stays. Texts of any length are read whole, within one row; an empty table gives
    an empty result; columns of other names are not looked at.
    """
    rows = pick(docs, row=row, id=id_col, text=text_col).withColumn("mark", F.xxhash64("text"))
    covered = copied_windows(rows, span).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    covered = covered.withColumnsRenamed({"id": "id_", "mark": "mark_"})
    joined = rows.join(covered, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left")
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"]))))
    # merged: the removed line numbers in order, walked along with the lines
    lines = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), lines).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(F.col("lines"), i))
    )
    return (
        joined.withColumn("gone", gone)
        .withColumn("lines", lines)
        .select(
            *(["row"] if row else []),
            F.col("id").alias("doc_id"),
            F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text"),
            F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed"),
        )
    )


def op9(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))

"""Mixing sources to target weights by pivotal rounding.

A source's target share over its size is how often each of its documents is to be
taken: some whole copies, and one more with a probability. These probabilities are
rounded dependently. Two documents with a fractional probability are paired, and
words move from one to the other, either way with odds that leave both expected
numbers as they are, until one probability is 0 or 1. The source's words do not
change, so only the last document that stays fractional departs from the target.

Pairs are made within blocks of consecutive ranks, each of which leaves one
fractional document at most; these residuals are the rows of the next level, and
so on, a reduction tree whose levels grow with the logarithm of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.llm.columns import pick
from quorbit.llm.skew import spread_join
from quorbit.operators.select import ranked
from quorbit.session import cut

#: Ranks of a block: what a node of the tree reads.
BLOCK = 64
#: Weights of sources in order, repeating, and how often a source may be repeated.
WEIGHTS, MOST = (1, 2, 3), 3


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n) rows, with ``place`` in code point order, nulls last, ``weight`` and ``target``.

    Targets are the weight times one level, but ``most`` times the size where that
    is less; the level is such that they add up to all sizes. Each step finds the
    level of those sources that were not above it, by one aggregation; steps end
    when no further one is above.
    """
    order = sources.withColumn("given", F.col("source").isNotNull().cast("int"))
    cycle = F.array(*[F.lit(w) for w in weights])
    placed = ranked(order, "given", "source").withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int"))).drop("given").withColumnRenamed("position", "place")
    cap, level, above = F.lit(most) * F.col("source_size"), 0.0, -1
    while True:
        free = F.lit(level) * F.col("weight") <= cap
        total, capped, weight, now = placed.agg(F.sum("source_size"), F.sum(F.when(~free, cap)), F.sum(F.when(free, F.col("weight"))), F.sum((~free).cast("int"))).first()
        if not total or not weight or now == above:
            break
        level, above = (total - (capped or 0)) / weight, now
    target = F.when(F.lit(level) * F.col("weight") <= cap, F.lit(level) * F.col("weight")).otherwise(cap)
    return placed.withColumn("target", target.cast("double"))


def _paired(carry: Column, x: Column, seed: int) -> Column:
    """(first, second): both documents after words have moved between them; at least one mass is 0 or the size."""
    room, left = carry["size"] - carry["mass"], x["size"] - x["mass"]
    up, down = F.least(room, x["mass"]), F.least(left, carry["mass"])
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), carry["position"], x["position"]), 11) * F.lit(2.0**-53)

    def moved(to_first: Column) -> Column:
        first = F.when(to_first, F.when(room <= x["mass"], carry["size"]).otherwise(carry["mass"] + x["mass"]))
        first = first.otherwise(F.when(carry["mass"] <= left, F.lit(0.0)).otherwise(carry["mass"] - left))
        second = F.when(to_first, F.when(x["mass"] <= room, F.lit(0.0)).otherwise(x["mass"] - room))
        second = second.otherwise(F.when(left <= carry["mass"], x["size"]).otherwise(x["mass"] + carry["mass"]))
        return F.struct(carry.withField("mass", first.cast("double")).alias("first"), x.withField("mass", second.cast("double")).alias("second"))

    return _let(chance * (up + down) < down, moved)


def _fold(members: Column, member: str, seed: int) -> Column:
    """(carry, done): the block's documents, each paired with the one that is left of those before."""
    open_ = lambda d: (d["mass"] > 0) & (d["mass"] < d["size"])
    none = F.lit(None).cast(member)
    start = F.struct(none.alias("carry"), F.array().cast(f"array<{member}>").alias("done"))

    def settle(state: Column, pair: Column) -> Column:
        first, second = pair["first"], pair["second"]
        carry = F.when(open_(first), first).when(open_(second), second).otherwise(none)
        return F.struct(carry.alias("carry"), F.concat(state["done"], F.filter(F.array(first, second), lambda d: ~open_(d))).alias("done"))

    def step(state: Column, x: Column) -> Column:
        alone = F.struct(x.alias("carry"), state["done"].alias("done"))
        return F.when(state["carry"].isNull(), alone).otherwise(_let(_paired(state["carry"], x, seed), lambda pair: settle(state, pair)))

    return F.aggregate(members, start, step)


def rounded(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``up``, 0 or 1, for (group, position, size, mass, ...) rows with 0 < mass < size.

    ``position`` numbers the rows without gaps, and consecutive ones of a group pair.
    The mass over the size is the chance of 1. Within a group the sizes of the
    rows with 1 add up to the sum of masses, but for half of one row at most: the
    last one is rounded to the nearer end.
    """
    rows = rows.select(*[F.col(c).cast("double").alias(c) if c in ("size", "mass") else F.col(c) for c in rows.columns])
    inner = [c for c in rows.columns if c != "group"]
    member = rows.select(F.struct("position", *[c for c in inner if c != "position"]).alias("m")).schema["m"].dataType.simpleString()
    last = rows.agg(F.max("position")).first()[0]
    made, level, span = [], rows.select("group", F.struct("position", *[c for c in inner if c != "position"]).alias("m")), block
    while True:
        gathered = level.groupBy("group", F.floor(F.col("m.position") / span).alias("block")).agg(F.sort_array(F.collect_list("m")).alias("members"))
        folded = cut(gathered.select("group", _fold(F.col("members"), member, seed).alias("f")).select("group", "f.carry", "f.done"))
        made.append(folded.select("group", F.explode("done").alias("m")))
        level = folded.filter("carry is not null").select("group", F.col("carry").alias("m"))
        if last is None or span > last:
            break
        span *= block
    # one document of each group at most, to the nearer end
    nearer = F.when(2 * F.col("m.mass") >= F.col("m.size"), F.col("m.size")).otherwise(F.lit(0.0))
    made.append(level.select("group", F.col("m").withField("mass", nearer).alias("m")))
    return reduce(DataFrame.unionByName, made).select("group", "m.*").withColumn("up", (F.col("mass") > 0).cast("int")).drop("mass")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: int = 23) -> DataFrame:
    """A row for each row of ``docs``: doc_id, mark, source, size, source_size, target, copies, taken.

    Size counts the words; null and blank texts have none, are taken 0 words of
    and so any number of times (0 here). Sources are ordered by code point, null
    being one source, the last; ``weights`` repeat along them. Targets share all
    words and stop at ``most`` times a source's size. ``copies`` is how often a
    document is taken, ``most`` at most: the target over the source's size, rounded
    up or down. ``mark`` is a hash of the text. Within a source, documents are paired
    in order of size, largest first, then of a hash of id and text, so the one
    that rounding is left with tends to be short. Results depend on the rows and the
    seed, not on how files and partitions lie. Null ids, ties and repeated rows
    are documents like any other; rows that are repeated whole may differ in
    copies, and which of them has more says nothing. Texts of any length are
    counted whole; an empty table gives an empty result, one without words
    targets of 0. Columns of other names are not looked at.
    """
    text = F.col("text")
    read = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = cut(read.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64("text").alias("mark"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sources = cut(targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, most))
    dealt = spread_join(rows, sources.drop("source"), ["key"], "n")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = dealt.withColumn("whole", F.floor(share).cast("long")).withColumn("mass", (share - F.col("whole")) * F.col("size"))
    dealt = dealt.select("doc_id", "mark", "source", "size", "source_size", "target", "whole", "mass", "place", "h", (F.col("mass") > 0).alias("open"))
    # equal rows get a number, so that no task sorts all rows that are repeated
    order = F.struct((-F.col("size")).alias("s"), "h", F.monotonically_increasing_id().alias("i"))
    open_ = ranked(dealt.filter("open").withColumn("order", order).withColumn("first", -F.col("place")), "first", "order")
    up = rounded(open_.select(F.col("place").alias("group"), "position", "size", "mass", "doc_id", "mark", "source", "source_size", "target", "whole"), seed)
    settled = dealt.filter("not open").withColumn("up", F.lit(0))
    columns = ["doc_id", "mark", "source", F.col("size").cast("long").alias("size"), "source_size", "target"]
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0).cast("long")
    both = [d.select(*columns, copies.alias("copies")) for d in (up, settled)]
    return both[0].unionByName(both[1]).withColumn("taken", F.col("size") * F.col("copies"))


def mixture(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: documents as often as ``mix`` takes them, with ``copy`` from 1.

    Rows that share id and text count as one document with the copies of all.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("mark", F.xxhash64("text")).dropDuplicates(["doc_id", "mark"])
    takes = mixed.groupBy(F.col("doc_id").alias("id_"), F.col("mark").alias("mark_")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    joined = rows.join(takes, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")))
    return joined.select("doc_id", "text", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def op11(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")

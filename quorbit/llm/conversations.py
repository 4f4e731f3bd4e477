"""Repair of the turn structure of conversations.

A conversation's rows are an acceptor of one path. An edit transducer keeps, reroles
or deletes each row and inserts turns; an acceptor of role sequences says which
results are conversations. The three are composed lazily, that is, states of
the composition are made when the search reaches them, and the shortest path is
found in topological order. Weights are ordered pairs of cost and label string.

Rows are ordered once over all conversations and cut into blocks of bounded size.
A block's best paths from each state it may begin in to each it may end in are
found by themselves; a conversation's blocks are then joined in order. So long
conversations are worked on in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorbit.llm.arrow import arrow_schema
from quorbit.llm.columns import pick
from quorbit.operators.select import parts_for
from quorbit.session import cut

#: Rows of a block, a power of two, as ranges of places begin at multiples of 2^33; and how many short patterns of rows a task remembers the paths of.
BLOCK, REMEMBERED = 4096, 20_000
#: Costs: a turn that keeps its fault of being cut off, another role, a deletion, an insertion.
TRUNCATED, REROLE, DELETE, INSERT = 1, 2, 3, 2
BLANK = "[\\x20\\x09-\\x0D]"

#: The acceptor of ``(s?(ua)+)?`` over role initials: state, initial, next state. 0 is the start; ENDS accept.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
STATES, ENDS = tuple(GRAMMAR), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: In a row between two others, no more insertions are of use: no shortest path comes to a role state twice there.
MOST_INSERTS = 2

Weight = tuple[int, str]


def edits(initial: str, fault: str) -> Iterator[tuple[str, str, int]]:
    """The transducer's arcs for one row: (label, initial put out or none, cost)."""
    yield "D", "", DELETE
    if fault not in "bd":
        extra = TRUNCATED if fault == "t" else 0
        yield "K", initial, extra
        for other in ROLES:
            yield "R", other, REROLE + extra


def insertions(weights: dict[int, Weight]) -> dict[int, Weight]:
    """Weights of role states before the next row, after up to MOST_INSERTS insertions: layers in topological order."""
    best, layer = dict(weights), weights
    for _ in range(MOST_INSERTS):
        made: dict[int, Weight] = {}
        for state, (cost, labels) in layer.items():
            for initial in ROLES:
                if (to := GRAMMAR[state].get(initial)) is not None:
                    weight = (cost + INSERT, labels + "I")
                    made[to] = min(weight, made.get(to, weight))
        for to, weight in made.items():
            best[to] = min(weight, best.get(to, weight))
        layer = made
    return best


def advance(weights: dict[int, Weight], initial: str, fault: str) -> dict[int, Weight]:
    """From the weights of role states before a row to those behind it."""
    made: dict[int, Weight] = {}
    arcs = tuple(edits(initial, fault))
    for state, (cost, labels) in insertions(weights).items():
        for label, out, price in arcs:
            to = GRAMMAR[state].get(out) if out else state
            if to is not None:
                weight = (cost + price, labels + label)
                made[to] = min(weight, made.get(to, weight))
    return made


@lru_cache(REMEMBERED)
def _remembered(initials: str, faults: str, start: int) -> tuple[tuple[int, Weight], ...]:
    return _paths(initials, faults, start)


def _paths(initials: str, faults: str, start: int) -> tuple[tuple[int, Weight], ...]:
    """The best weight from ``start`` to each state, over the rows of a block.

    Of paths over the same rows and of equal cost, none has labels that begin
    another's, so the least is still the least whatever follows both.
    """
    weights: dict[int, Weight] = {start: (0, "")}
    for initial, fault in zip(initials, faults, strict=True):
        weights = advance(weights, initial, fault)
    return tuple(weights.items())


def block_paths(initials: str, faults: str, starts: tuple[int, ...]) -> dict[tuple[int, int], Weight]:
    """(start, end) to weight. Patterns of a few rows come again and again and are remembered."""
    find = _remembered if len(initials) <= 16 else _paths
    return {(s, e): w for s in starts for e, w in find(initials, faults, s)}


def finish(weights: dict[int, Weight]) -> Weight:
    """The best weight that ends in an accepting state."""
    best = insertions(weights)
    return min(best[e] for e in ENDS if e in best)


def role_faults(role: Column, text: Column) -> tuple[Column, Column]:
    """A role's initial as the grammar has it ('-' for any other, also for no character), and blank 'b' or truncated 't' or '.'."""
    initial = F.substring(role, 1, 1)
    last = F.right(F.regexp_replace(text, f"{BLANK}+\\z", ""), F.lit(1))
    fault = F.when(last == "", "b").when(last.isin(".", "!", "?"), ".").otherwise("t")
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), fault


def placed(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped, with ``mark``, a hash of role and text, ``initial``, ``fault`` and ``place``, the global order.

    Ordered by conversation, turn (nulls first) and mark, in ranges of rows; ``place``
    is their number from 0 in each range, and ranges lie 2^33 apart.
    """
    role, text = F.col("role"), F.col("text")
    initial, fault = role_faults(role, text)
    mark = F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))
    # rows that are equal in all of these may go to several ranges
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("mark"), F.asc("again")]
    keyed = convs.withColumns({"mark": mark, "initial": initial, "fault": fault, "again": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(parts_for(convs), *order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("place", F.monotonically_increasing_id()).drop("again"))


def blocks(rows: DataFrame) -> DataFrame:
    """A row for each conversation and stretch of BLOCK places: its rows' places, turns, initials and faults, in order.

    ``head``: it may go on from the stretch before.
    """
    narrow = rows.select("conv_id", "turn", "dropped", "mark", "initial", "fault", "place")
    first = narrow.filter("not dropped").groupBy("conv_id", "mark").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("fresh"))
    faulty = narrow.join(first, "place", "left").withColumn("fault", F.when((F.col("fault") != "b") & F.col("fresh").isNull(), "d").otherwise(F.col("fault")))
    held = F.when(~F.col("dropped"), F.struct("place", "turn", "initial", "fault"))
    made = faulty.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(held)).alias("rows"), F.min("place").alias("least"))
    text_of = lambda name: F.array_join(F.transform("rows", lambda r: r[name]), "").alias(f"{name}s")
    turns = F.transform(F.filter("rows", lambda r: r["turn"].isNotNull()), lambda r: r["turn"])
    return made.select(
        "conv_id", "block", (F.col("least") % BLOCK == 0).alias("head"), F.transform("rows", lambda r: r["place"]).alias("places"), text_of("initial"), text_of("fault"),
        F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), F.size(F.array_distinct(turns)).cast("long").alias("turns"),
    )


PATHS = "starts array<int>, ends array<int>, costs array<long>, labels array<string>"
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = ("su", "ua", "au")


def _find_paths(table: pa.Table, kinds: pa.Schema) -> pa.Table:
    found = [block_paths(i, f, STATES if h else STATES[:1]) for i, f, h in zip(table["initials"].to_pylist(), table["faults"].to_pylist(), table["head"].to_pylist(), strict=True)]
    columns = {
        "starts": [[s for s, _ in x] for x in found], "ends": [[e for _, e in x] for x in found],
        "costs": [[c for c, _ in x.values()] for x in found], "labels": [[w for _, w in x.values()] for x in found],
    }
    for name, values in columns.items():
        table = table.append_column(name, pa.array(values, kinds.field(name).type))
    return table


def with_paths(made: DataFrame) -> DataFrame:
    schema, kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema) + ", " + PATHS, arrow_schema(PATHS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _find_paths(pa.Table.from_batches([batch]), kinds).to_batches()

    return made.mapInArrow(run, schema)


class _Conversation:
    """The blocks of one conversation, joined in order."""

    def __init__(self, conv_id):
        self.conv_id, self.weights, self.held = conv_id, {0: (0, "")}, []
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = ""

    def add(self, row: dict) -> None:
        made: dict[int, Weight] = {}
        for s, e, cost, labels in zip(row["starts"], row["ends"], row["costs"], row["labels"], strict=True):
            if s in self.weights:
                weight = (self.weights[s][0] + cost, self.weights[s][1] + labels)
                made[e] = min(weight, made.get(e, weight))
        self.weights = made
        self.held.append((row["block"], row["places"]))
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        initials, faults = self.last + row["initials"], row["faults"]
        self.illegal += sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        self.last = initials[-1:]
        self.blank, self.duplicate, self.truncated = self.blank + faults.count("b"), self.duplicate + faults.count("d"), self.truncated + faults.count("t")

    def facts(self) -> tuple:
        cost, audit = finish(self.weights)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit

    def turns_of(self, audit: str) -> Iterator[tuple]:
        """(block, places, roles, seqs): what is put out of each block; a place is null for an insertion, a role for one kept."""
        with_system = len([c for c in audit if c != "D"]) % 2
        at = out = 0
        for number, (block, held) in enumerate(self.held):
            places, roles, seqs, left = [], [], [], iter(held)
            rows, final = len(held), number == len(self.held) - 1
            while at < len(audit) and (rows or final):
                label, at = audit[at], at + 1
                place = None if label == "I" else next(left)
                rows -= label != "I"
                if label != "D":
                    places.append(place)
                    roles.append(None if label == "K" else ROLES["ua"[(out - with_system) % 2]])
                    seqs.append(out)
                    out += 1
            yield block, places, roles, seqs


def joined(found: DataFrame) -> DataFrame:
    """A row for each block, with what is put out of it; a conversation's last block has the facts, the others null.

    A conversation's blocks come to one task in order and pass one by one; what it
    holds of them is places and labels, so about as much as the audit string.
    """
    schema = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, final boolean, places array<long>, roles array<string>, seqs array<long>, {FACTS}"
    out = arrow_schema(schema)

    def rows_of(conv: _Conversation) -> Iterator[tuple]:
        facts = conv.facts()
        made = list(conv.turns_of(facts[-1]))
        for i, (_, places, roles, seqs) in enumerate(made):
            final = i == len(made) - 1
            yield (conv.conv_id, final, places, roles, seqs, *(facts if final else [None] * len(facts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, made = None, []

        def batch_of(made: list) -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [()] * len(out)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        for batch in batches:
            for row in batch.to_pylist():
                if conv is None or conv.conv_id != row["conv_id"]:
                    made += rows_of(conv) if conv else ()
                    conv = _Conversation(row["conv_id"])
                conv.add(row)
            yield batch_of(made)
            made = []
        if conv:
            yield batch_of(list(rows_of(conv)))

    return found.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def repair(convs: DataFrame, dropped: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation, and the repaired turns (conv_id, seq, role, text).

    Rows are taken by turn, null turns first; rows of one turn in the order of a
    hash of role and text, so repeated ones lie together. Null roles and texts
    count as one space. A role's initial is its first character; a role without
    characters, or of another initial, can only be reroled or deleted. Null ids are
    one conversation. Rows where the column ``dropped`` holds are left out, but
    their conversations stay; a conversation without rows has zeros and an empty
    audit. Texts of any length are read whole; a conversation of any length passes
    through one task once, as block after block, but is never held whole in one.
    An empty table gives empty results. Columns of other names are not looked at.
    """
    named = {"conv_id": id_col, "turn": turn_col, "role": role_col, "text": text_col}
    rows = pick(convs, **named, **({"dropped": dropped} if dropped else {}))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    rows = placed(rows if dropped else rows.withColumn("dropped", F.lit(False)))
    made = cut(joined(with_paths(blocks(rows))))
    audits = made.filter("final").select("conv_id", *[f.split()[0] for f in FACTS.split(", ")])
    turns = made.select("conv_id", F.explode(F.arrays_zip("places", "roles", "seqs")).alias("t")).select("conv_id", F.col("t.seqs").alias("seq"), F.col("t.places").alias("place"), F.col("t.roles").alias("new"))
    texts = rows.select("place", "role", "text")
    kept = turns.filter("place is not null").join(texts, "place").select("conv_id", "seq", F.coalesce("new", "role").alias("role"), "text")
    inserted = turns.filter("place is null").select("conv_id", "seq", F.col("new").alias("role"), F.lit("").alias("text"))
    return audits, kept.unionByName(inserted)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of a conversation's ``role:text``, joined by newlines; turns pass one by one."""
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, repaired_sha256 string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, digest = (), None
        for batch in batches:
            done = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known == (conv_id,):
                    digest.update(b"\n")
                else:
                    done += [(known[0], digest.hexdigest())] if known else []
                    known, digest = (conv_id,), hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], out[i].type) for i in range(2)], schema=out)
        if known:
            yield pa.RecordBatch.from_arrays([pa.array([known[0]], out[0].type), pa.array([digest.hexdigest()])], schema=out)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "role", "text").mapInArrow(run, schema)


def damaged(convs: DataFrame) -> DataFrame:
    """Rows with one fault each, as the crc32 of ``conv_id:turn`` modulo 20 says; ``dropped`` marks those that are to go.

    0 drops a row, 1 empties its text, 2 takes its sentence ends out, 3 repeats it,
    4 makes its role user. Nulls count as one space, also in what the crc32 is of.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = pick(convs, conv_id="conv_id", turn="turn", role="role", text="text")
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), "kind")
    return changed.withColumn("_", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("_", "kind")


def op12(convs: DataFrame) -> DataFrame:
    audits, turns = repair(damaged(convs), "dropped")
    found = digests(turns).withColumnRenamed("conv_id", "id_")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return audits.join(found, F.col("conv_id").eqNullSafe(F.col("id_")), "left").drop("id_").withColumn("repaired_sha256", F.coalesce("repaired_sha256", empty))

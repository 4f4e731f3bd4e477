"""Repair against a search over all edits, and against one over whole conversations."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from itertools import product

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quorbit.llm import conversations, registry

SCHEMA = "conv_id bigint, turn int, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def rows(df):
    return [tuple(r) for r in df.collect()]


def mark(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def damage(table):
    out, ids = [], []
    space = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in table:
        ids.append(conv)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out, set(ids)


def faults(held):
    seen, out = set(), []
    for _, _, role, text in held:
        marks = WORDY.findall(text)
        out.append("b" if not marks else "d" if (role, text) in seen else "." if marks[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def search(held, found):
    """Uniform-cost search over (row, role state) of the conversation whole, by cost and then labels."""
    steps = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    heap, done = [(0, "", 0, "0", ())], set()
    while heap:
        cost, labels, at, state, out = heapq.heappop(heap)
        if at == len(held) and state in "03":
            return cost, labels, list(out)
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if to := steps.get((state, role[0])):
                heapq.heappush(heap, (cost + 2, labels + "I", at, to, (*out, f"{role}:")))
        if at < len(held):
            _, _, role, text = held[at]
            heapq.heappush(heap, (cost + 3, labels + "D", at + 1, state, out))
            if found[at] not in "bd":
                more = int(found[at] == "t")
                if role and (to := steps.get((state, role[0]))):
                    heapq.heappush(heap, (cost + more, labels + "K", at + 1, to, (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if to := steps.get((state, new[0])):
                        heapq.heappush(heap, (cost + 2 + more, labels + "R", at + 1, to, (*out, f"{new}:{text}")))


def all_edits(held, found):
    """Every choice for every row with up to two insertions in each place: (cost, labels) of the best."""
    options = []
    for (_, _, role, _), fault in zip(held, found, strict=True):
        own = [("D", "", 3)]
        if fault not in "bd":
            more = int(fault == "t")
            own += [("K", role[:1] or "-", more), ("R", "u", 2 + more), ("R", "a", 2 + more)]
        options.append(own)
    inserts = [("", 0)] + [("".join(p), 2 * n) for n in (1, 2) for p in product("ua", repeat=n)]
    best = None
    for rows_ in product(*options):
        for gaps in product(inserts, repeat=len(held) + 1):
            roles = gaps[0][0] + "".join(r[1] + g[0] for r, g in zip(rows_, gaps[1:], strict=True))
            if GRAMMAR.fullmatch(roles):
                cost = sum(r[2] for r in rows_) + sum(g[1] for g in gaps)
                labels = "I" * len(gaps[0][0]) + "".join(r[0] + "I" * len(g[0]) for r, g in zip(rows_, gaps[1:], strict=True))
                best = min(best or (cost, labels), (cost, labels))
    return best


def plain(table):
    damaged, ids = damage(table)
    out = []
    for conv in ids:
        held = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, mark(r[2], r[3])))
        found = faults(held)
        turns = [r[1] for r in held if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] or "-" for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, labels, texts = search(held, found)
        out.append((conv, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, labels, hashlib.sha256("\n".join(texts).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0)


def made_up(n, rng, most=7):
    table = []
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut off", " \t", "", None, "Ends. \n", f"own {turn}."])
            table.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    return table


def test_the_search_is_the_best_of_all_edits():
    rng = random.Random(3)
    for _ in range(60):
        held = [(0, i, rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["a.", "b.", "c", " "])) for i in range(rng.randint(0, 3))]
        found = faults(held)
        want = search(held, found)[:2]
        assert want == all_edits(held, found)
        weights = {0: (0, "")}
        for (_, _, role, _), fault in zip(held, found, strict=True):
            weights = conversations.advance(weights, role[:1] if role[:1] in ("s", "u", "a") else "-", fault)
        assert conversations.finish(weights) == want


@pytest.mark.parametrize("block", [4096, 4])
def test_query_against_a_plain_version(spark, block, monkeypatch):
    """Also with blocks of four rows, so that conversations are cut."""
    monkeypatch.setattr(conversations, "BLOCK", block)
    table = made_up(150, random.Random(block), 12)
    found = rows(conversations.op12(spark.createDataFrame(table, SCHEMA)))
    assert sorted(found, key=key) == sorted(plain(table), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_the_sql_says_the_same(seed):
    table = made_up(150, random.Random(seed), 12) + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (777, None, "user", "A."), (777, None, "user", "A.")]
    connection = duckdb.connect()
    kinds = {"conv_id": pa.int64(), "turn": pa.int32(), "role": pa.string(), "text": pa.string()}
    connection.register("conversations", pa.table({name: pa.array([r[k] for r in table], kind) for k, (name, kind) in enumerate(kinds.items())}))
    got = connection.execute(registry.oracle_sql()["op12_conversation_repair"])
    assert [c[0] for c in got.description][:2] == ["conv_id", "gaps"]
    assert sorted(got.fetchall(), key=key) == sorted(plain(table), key=key)


def test_given_table(spark, small):
    frame = spark.read.parquet(f"{small}/conversations.parquet")
    assert sorted(rows(conversations.op12(frame)), key=key) == sorted(plain(rows(frame)), key=key)


def test_hard_rows(spark):
    """Null ids, turns, roles and texts; repeated rows; long texts; a conversation of a third of all rows; clashing names."""
    rng = random.Random(9)
    table = made_up(40, rng) + [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (77, None, "user", "A."), (77, None, "user", "A.")]
    table += [(78, 0, "user", "word " * 200_000 + "end."), (78, 1, "assistant", "é日本𓀀. \x0b")]
    table += [(79, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"turn {t}."])) for t in range(150)]
    table += [(80, 1, "user", "Same again.")] * 60
    # a conversation that loses all its rows
    gone = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table.append((gone, 0, "user", "Hi."))
    frame = spark.createDataFrame(table, SCHEMA)
    want = sorted(plain(table), key=key)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
    assert sorted(rows(conversations.op12(frame)), key=key) == want
    clashing = frame.select("*", *[F.lit("clash").alias(c) for c in ("kind", "mark", "place", "block", "dropped", "initial", "fault", "seq", "TEXT ")])
    assert sorted(rows(conversations.op12(clashing.repartition(5))), key=key) == want
    assert rows(conversations.op12(frame.limit(0))) == []


def test_repaired_turns(spark):
    """The operator's own output: conversations whose roles follow the grammar."""
    table = [(c, t, r or " ", x or " ") for c, t, r, x in made_up(60, random.Random(4))]
    audits, turns = conversations.repair(spark.createDataFrame(table, SCHEMA))
    roles = {}
    for conv, _, role, text in sorted(rows(turns)):
        roles[conv] = roles.get(conv, "") + role[0]
        assert text == "" or WORDY.search(text)
    assert all(GRAMMAR.fullmatch(r) for r in roles.values())
    assert {a[0]: len(a[-1].replace("D", "")) for a in rows(audits)} == {c: len(roles.get(c, "")) for c in {t[0] for t in table}}

"""Language-model scores by a weighted backoff automaton.

Trigrams are smoothed by interpolation with bigrams, and these with unigrams,
each through a Dirichlet prior:

    p(w | h) = (c(h w) + MASS p(w | h')) / (c(h) + MASS),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

where h' is h without its first word. That sums to one over the known words and
one unknown. As an automaton, the empty context, each word and each bigram that
was counted is a state. A counted n-gram is an arc from its context to the longest
state that ends it, of weight log p. A state without an arc for a word has a
failure arc, of weight log (MASS / (c(h) + MASS)), to its context without the first
word; the empty one has arcs for all words. A left-to-right traversal of a text
carries the state and adds up the weights.

The whole model grows with the corpus and fits in no task. So documents are
dealt into blocks of bounded size. Each block sends the sorted keys of its n-grams,
with its own counts, to ranges of the key space; a range adds up what all blocks
have and answers each with totals in the order that it asked. The block then
builds the part of the automaton that it can reach, which is bounded by the block,
and scores its documents. Beyond FAN ranges, blocks ask through sets of blocks that
merge what they ask of a group of ranges, so that a block sends FAN rows at most
and no row is small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.llm.arrow import arrow_schema
from quorbit.llm.columns import n_bytes, pick
from quorbit.llm.language_id import held_out

#: Weight of the shorter context's probability, in counts.
MASS = 50.0
#: Bytes of text in a block, and behind a range of keys, on average; and blocks and ranges at least.
BLOCK_BYTES, RANGE_BYTES, LEAST_BLOCKS, LEAST_RANGES = 12_000_000, 10_000_000, 64, 32
#: Ranges that a block asks directly.
FAN = 2048
#: Bytes of text that a task gathers before it deals them.
DEAL_BYTES = 24_000_000
#: Tokens that one lane of the traversal reads.
LANE = 512
BEGIN, END = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def word_hash(word: bytes) -> int:
    """Odd, where the keys of longer n-grams are even."""
    return xxhash.xxh64_intdigest(word, 7) | 1


class Vocabulary(dict):
    """Numbers for the words of a block, in order of appearance."""

    def __init__(self) -> None:
        super().__init__({b"\n<": BEGIN, b"\n>": END})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def ids(self, text: bytes) -> np.ndarray:
        """Begin, the words, end."""
        words = text.lower().split()
        out = np.empty(len(words) + 2, np.int32)
        out[0], out[-1] = BEGIN, END
        out[1:-1] = list(map(self.__getitem__, words))
        return out


def packed(values: np.ndarray) -> bytes:
    """64-bit values by byte planes, which compress where neighbours are alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def longer_keys(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams, from the keys without the last word and the last words' keys."""
    mixed = (shorter * _ODD) ^ (last >> np.uint64(17)) ^ (last << np.uint64(47))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
    return (mixed ^ (mixed >> np.uint64(29))) & ~_ONE


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them, in four bytes."""
    order = np.argsort(values, kind="stable").astype(np.int32)
    new = np.empty(len(values), bool)
    new[:1] = True
    inorder = values[order]
    np.not_equal(inorder[1:], inorder[:-1], out=new[1:])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return inorder[new], place


class Block:
    """A block's texts as numbers, its distinct n-grams, and their keys in the order of ``order``.

    ``pairs`` are first << 32 | second word. ``triples`` are steps of the
    traversal: (the pair before, counted from 1) << 32 | the pair; a text's first
    step has none before, and is no trigram.
    """

    def __init__(self, texts: list[bytes]):
        vocabulary = Vocabulary()
        ids = [vocabulary.ids(t) for t in texts]
        self.sizes = np.array([len(t) - 1 for t in ids], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        joined_ids = np.concatenate(ids)
        begins = self.starts + np.arange(len(ids))  # of texts among the joined numbers, which have a begin each
        del ids
        self.pairs, pair_at = numbered(np.delete(joined_ids[:-1].astype(np.int64) << 32 | joined_ids[1:], begins[1:] - 1))
        del joined_ids
        before = np.empty(len(pair_at), np.int64)
        before[1:] = pair_at[:-1] + 1
        before[self.starts] = 0
        self.triples, self.at = numbered(before << 32 | pair_at)
        del before, pair_at
        words = np.fromiter(map(word_hash, vocabulary), np.uint64, len(vocabulary))
        self.n_words, self.n_firsts = len(words), int(np.searchsorted(self.triples, 1 << 32))
        pair_keys = longer_keys(words[self.pairs >> 32], words[self.pairs & 0xFFFFFFFF])
        whole = self.triples[self.n_firsts :]
        triple_keys = longer_keys(pair_keys[(whole >> 32) - 1], words[self.pairs[whole & 0xFFFFFFFF] & 0xFFFFFFFF])
        self.keys = np.concatenate([words, pair_keys, triple_keys])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, learnt: np.ndarray) -> np.ndarray:
        """How often learnt texts have each n-gram; begins count as words here, for their state."""
        triples = np.bincount(self.at, np.repeat(learnt.astype(np.float64), self.sizes), len(self.triples))
        pairs = np.bincount(self.triples & 0xFFFFFFFF, triples, len(self.pairs))
        words = np.bincount(self.pairs & 0xFFFFFFFF, pairs, self.n_words)
        words[BEGIN] = learnt.sum()
        return np.concatenate([words, pairs, triples[self.n_firsts :]]).astype(np.int64)


class BackoffAutomaton:
    """The states, arcs and failure arcs that one block can reach.

    A state is told by its order, 0 to 2, and the words before it. ``arc[k]`` is
    the weight of the arc that a state of order k has for a step, or nan where it
    has none, and ``fail[k]`` the weight of the failure arc that is then taken.
    """

    def __init__(self, block: Block, totals: np.ndarray, tokens: int, kinds: int):
        self.word_count, pair_count, triple_count = np.split(totals, [block.n_words, block.n_words + len(block.pairs)])
        triple_count = np.concatenate([np.zeros(block.n_firsts, np.int64), triple_count])
        first, second = block.pairs >> 32, block.pairs & 0xFFFFFFFF
        self.root = (self.word_count + 0.5) / (tokens + 0.5 * (kinds + 1))
        two = (pair_count + MASS * self.root[second]) / (self.word_count[first] + MASS)
        pair, before = block.triples & 0xFFFFFFFF, np.maximum(block.triples >> 32, 1) - 1
        three = (triple_count + MASS * two[pair]) / (pair_count[before] + MASS)
        word = second[pair]
        self.arc = (np.log10(self.root)[word], counted(two, pair_count)[pair], counted(three, triple_count))
        self.fail = (None, np.log10(MASS / (self.word_count + MASS))[first[pair]], np.log10(MASS / (pair_count + MASS))[before])
        # the longest state that ends the words so far, whatever the state before
        self.reached = np.where(pair_count[pair] > 0, 2, np.where(self.word_count[word] > 0, 1, 0)).astype(np.int8)
        self.moves = self._closed()

    def _closed(self) -> np.ndarray:
        """Weight of each step from a state of each order, along failure arcs until there is an arc."""
        made = [self.arc[0]]
        for arc, fail in zip(self.arc[1:], self.fail[1:], strict=True):
            made.append(np.where(np.isnan(arc), fail + made[-1], arc))
        return np.concatenate(made)

    def traverse(self, block: Block) -> np.ndarray:
        """Log10 probability of each text, left to right.

        Texts are read side by side, in lanes of LANE tokens; where a lane goes on
        with a text, it begins in the state that its last token led to, which is the
        same from any state before.
        """
        n_steps, total = len(block.triples), np.zeros(len(block.sizes))
        pieces = -(-block.sizes // LANE)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = block.starts[owner] + number * LANE
        length = np.minimum(LANE, block.sizes[owner] - number * LANE)
        longest_first = np.argsort(-length, kind="stable")
        owner, number, at, length = (x[longest_first] for x in (owner, number, at, length))
        state = np.where(number == 0, 1, self.reached[block.at[at - 1]]).astype(np.int64)
        score = np.zeros(len(at))
        for step, n in enumerate(np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left").tolist()):
            taken = block.at[at[:n] + step]
            score[:n] += self.moves[state[:n] * n_steps + taken]
            state[:n] = self.reached[taken]
        np.add.at(total, owner, score)
        return total


def counted(p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Weights of arcs; nan where nothing was counted."""
    return np.where(count > 0, np.log10(p), np.nan)


def deal(n_blocks: int, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over (h, doc_id, learnt, text) batches that packs rows by block.

    The block follows from the hash, and for rows that are repeated whole also from
    how many of them the task has seen; so copies are spread, and a task that runs
    again deals its rows alike in whatever order it gets them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= DEAL_BYTES:
                yield pack(pa.Table.from_batches(held), seen)
                held = []
        if sum(map(len, held)):
            yield pack(pa.Table.from_batches(held), seen)

    def pack(rows: pa.Table, seen: dict[int, int]) -> pa.RecordBatch:
        blocks = np.empty(len(rows), np.int64)
        for i, h in enumerate(rows.column("h").to_pylist()):
            seen[h] = again = seen.get(h, -1) + 1
            blocks[i] = (h + again * 0x9E3779B1) % n_blocks
        order = np.argsort(blocks, kind="stable")
        found, begins = np.unique(blocks[order], return_index=True)
        cuts = np.append(begins, len(rows))
        rows = rows.take(pa.array(order)).combine_chunks()
        texts = flat(rows.column("text")).cast(pa.large_binary()).fill_null(b"")
        ends, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(rows) + 1], texts.buffers()[2] or b""
        lists = lambda name: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat(rows.column(name)))
        parts = [bytes(memoryview(data)[ends[a] : ends[b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
        sizes = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.diff(ends)))
        columns = [pa.array(found), lists("doc_id"), lists("learnt"), sizes, pa.array([pa.compress(x, codec="zstd", asbytes=True) for x in parts], pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run


def flat(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def dealt_texts(dealt: pa.Table) -> list[bytes]:
    texts = []
    for sizes, data in zip(dealt.column("sizes").to_pylist(), dealt.column("data").to_pylist(), strict=True):
        whole = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True) if sum(sizes) else b""
        at = 0
        for n in sizes:
            texts.append(whole[at : at + n])
            at += n
    return texts


def bounds(first: int, last: int, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of [first, last) of the key space begins."""
    return np.array([first + (last - first) * i // parts for i in range(parts)], np.uint64)


def cut_into(asker: int, keys: np.ndarray, n: np.ndarray, starts: np.ndarray, number: int = 0) -> pa.Table:
    """(block, part, keys, n) rows of sorted keys; each part gets one, as its answer also tells what all parts have."""
    cuts = [0, *np.searchsorted(keys, starts[1:]).tolist(), len(keys)]
    spans = list(zip(cuts, cuts[1:], strict=False))
    return pa.table(
        {
            "block": pa.array([asker] * len(spans), pa.int32()),
            "part": pa.array(range(number, number + len(spans)), pa.int32()),
            "keys": pa.array([packed(keys[a:b]) for a, b in spans], pa.binary()),
            "n": pa.array([packed(n[a:b]) for a, b in spans], pa.binary()),
        }
    )


ASKED, ANSWERED = "block int, part int, keys binary, n binary", "block int, part int, n binary, tokens long, kinds long"


def ask(dealt: pa.Table, n_parts: int) -> pa.Table:
    """A block's sorted keys and counts, cut into parts of the key space."""
    block = Block(dealt_texts(dealt))
    counts = block.counts(dealt.column("learnt").combine_chunks().flatten().to_numpy(zero_copy_only=False))
    return cut_into(dealt.column("block")[0].as_py(), block.keys[block.order], counts[block.order], bounds(0, 1 << 64, n_parts))


def summed(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and their totals; where each row's keys are among them, row after row; where rows end."""
    parts = [unpacked(x, np.uint64) for x in asked.column("keys").to_pylist()]
    counts = np.concatenate([unpacked(x, np.int64) for x in asked.column("n").to_pylist()])
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64), at, np.cumsum([len(x) for x in parts])[:-1]


def answered(asked: pa.Table, totals: np.ndarray, at: np.ndarray, ends: np.ndarray, tokens: int, kinds: int) -> pa.Table:
    """Totals for each key of each row in its order; and the part's tokens and distinct tokens."""
    same = lambda x: pa.array([x] * len(asked), pa.int64())
    made = pa.array(map(packed, np.split(totals[at], ends)), pa.binary())
    return pa.table({"block": asked.column("block"), "part": asked.column("part"), "n": made, "tokens": same(tokens), "kinds": same(kinds)})


def answer(asked: pa.Table) -> pa.Table:
    """What all blocks have, for each key of each block."""
    keys, totals, at, ends = summed(asked)
    words = (keys & _ONE == 1) & (totals > 0) & (keys != np.uint64(word_hash(b"\n<")))
    return answered(asked, totals, at, ends, int(totals[words].sum()), int(words.sum()))


def gather(asked: pa.Table, n_parts: int, n_ranges: int) -> pa.Table:
    """What a set of blocks asks of one part, merged, and cut into that part's ranges."""
    keys, totals, _, _ = summed(asked)
    part, each = asked.column("part")[0].as_py(), n_ranges // n_parts
    whole = [(i << 64) // n_parts for i in (part, part + 1)]
    return cut_into(asked.column("unit")[0].as_py(), keys, totals, bounds(*whole, each), part * each)


def spread(asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers that a set of blocks has got, for each of its blocks."""
    _, _, at, ends = summed(asked)
    tokens, kinds, totals = joined(answers)
    return answered(asked, totals, at, ends, tokens, kinds)


def joined(answers: pa.Table) -> tuple[int, int, np.ndarray]:
    """Tokens and distinct tokens of all parts, and the totals in the order of the keys."""
    order = np.argsort(answers.column("part").to_numpy())
    n = answers.column("n")
    totals = np.concatenate([unpacked(n[i].as_py(), np.int64) for i in order.tolist()])
    return *(int(answers.column(c).to_numpy().sum()) for c in ("tokens", "kinds")), totals


def exchanged(asked: DataFrame, n_blocks: int, n_parts: int, n_ranges: int) -> DataFrame:
    """Answers to all blocks. With as many parts as ranges directly, else through sets of as many blocks as there are parts."""
    if n_parts == n_ranges:
        return asked.repartitionById(n_parts, "part").groupBy("part").applyInArrow(answer, ANSWERED)
    sets = -(-n_blocks // n_parts)
    asked = asked.withColumn("unit", (F.col("block") % sets) * n_parts + F.col("part"))
    merged = asked.groupBy("unit").applyInArrow(lambda t: gather(t, n_parts, n_ranges), ASKED)
    far = merged.repartitionById(n_ranges, "part").groupBy("part").applyInArrow(answer, ANSWERED)
    return asked.groupBy("unit").cogroup(far.groupBy("block")).applyInArrow(spread, ANSWERED)


def parts_for(n_ranges: int) -> tuple[int, int]:
    """Parts that a block asks, and ranges: as many, or a multiple of the parts beyond FAN."""
    if n_ranges <= FAN:
        return n_ranges, n_ranges
    parts = min(FAN, math.isqrt(n_ranges - 1) + 1)
    return parts, -(-n_ranges // parts) * parts


def score_block(dealt: pa.Table, answers: pa.Table) -> pa.Table:
    block = Block(dealt_texts(dealt))
    tokens, kinds, in_order = joined(answers)
    totals = np.empty(len(in_order), np.int64)
    totals[block.order] = in_order
    model = BackoffAutomaton(block, totals, tokens, kinds)
    words = (block.pairs & 0xFFFFFFFF)[(block.triples & 0xFFFFFFFF)[block.at]]
    return pa.table(
        {
            "doc_id": dealt.column("doc_id").combine_chunks().flatten(),
            "n_tokens": pa.array(block.sizes),
            "n_known": pa.array(np.add.reduceat((model.word_count > 0).astype(np.int64)[words], block.starts)),
            "train_tokens": pa.array(np.full(len(block.sizes), tokens, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(model.root)[words], block.starts)),
            "score": pa.array(model.traverse(block)),
        }
    )


def lm_scores(docs: DataFrame, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows outside the held-out ``fold``. Null and empty texts are
    their end alone. Null ids and repeated rows count like any other, and rows of
    equal texts score alike. An empty table gives an empty result; columns of
    other names are not looked at. Texts are read whole: one that is longer than a
    block is a block with what falls to it besides, and its task holds about twelve
    times its bytes.
    """
    rows, learnt = pick(docs, doc_id=id_col, text=text_col), ~held_out("doc_id", fold)
    size = rows.agg(F.sum(n_bytes(F.col("text")))).first()[0] or 0
    n_blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    n_parts, n_ranges = parts_for(max(LEAST_RANGES, -(-size // RANGE_BYTES)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"block int, doc_id array<{kind}>, learnt array<boolean>, sizes array<long>, data binary"
    marked = rows.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", learnt.alias("learnt"), "text")
    # a task for each block and each range, so that none gets several by chance
    dealt = marked.mapInArrow(deal(n_blocks, arrow_schema(schema)), schema).repartitionById(n_blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(lambda t: ask(t, n_parts), ASKED)
    answers = exchanged(asked, n_blocks, n_parts, n_ranges).repartitionById(n_blocks, "block")
    return (
        dealt.groupBy("block")  # both uses of the dealt texts share one exchange
        .cogroup(answers.groupBy("block"))
        .applyInArrow(score_block, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    )


def op7(docs: DataFrame) -> DataFrame:
    return lm_scores(docs).select("doc_id", held_out("doc_id", 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

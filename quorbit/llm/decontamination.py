"""Benchmark passages in documents, through edit distance on words.

Both sides become sequences of word codes. The CGK walk copies a sequence symbol
by symbol, and after each one either stays or moves on, by a random bit that
depends on the step and the symbol; two sequences that differ by few edits fall
back into step, so that edit distance becomes Hamming distance of the copies.
Sampling a few places of the copy is then a locality-sensitive hash: windows
that agree on all sampled places of any repetition are candidates, and these
are held against the item by exact edit distance.

A window begins at an anchor, a word that a hash chooses alike on both sides, and
is as long as the item is from there on: its places are sampled from the whole
walk to the item's end, one from each of the spans that SPANS begins. So a window
and an item begin in step. An item has many anchors, and each is a fresh trial, as
is each repetition. How many repetitions there are follows from RECALL: copies
of items with as many edits as are allowed are made and looked for, and there
are as many repetitions as it takes to find that share of them at every length.

Long items are cut into pieces, and their windows end with the piece. Of an item's
pieces, one at least has no larger share of edits than the item, so what finds a
piece finds the item, at any length; the whole item is then held against the
surroundings. Where MOST_REPETITIONS do not find the share, as they may not for odd
items, the items of that length are held against whole texts, without candidates.

Items of fewer than MIN_WORDS words, of which MOST_EDITED lets none be edited,
are looked for as they are.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorbit.llm.arrow import BATCH_BYTES, map_texts
from quorbit.llm.columns import pick

#: An item is found where so large a share of its words, at most, is edited.
MOST_EDITED = 0.2
MIN_WORDS = 5
#: Words of a piece, at most.
PIECE_WORDS = 96
#: The share of copies with as many edits that the repetitions are to find, at each length; and repetitions at most, beyond which search is exact.
RECALL, MOST_REPETITIONS = 0.98, 48
#: Items, and copies of each, from which the number of repetitions is found.
TRIED_ITEMS, TRIED_COPIES = 400, 5
#: Of words, one in so many is an anchor, of an item's first two thirds; items with fewer than FEWEST of them have all words there as anchors.
ANCHOR_RATE, FEWEST = 2, 6
#: Steps at which the first spans of the walk begin; the later ones begin at twice the step of the one before.
SPANS = (1, 4)
#: Characters of benchmark text that a worker holds at once; more items are looked for in turn, in the same pass over the documents.
PASS_CHARS = 1_000_000
#: Bytes of documents that are held against one such part after the other, where there are several.
SLICE_BYTES = 16 << 20
END, OTHER = 0, 1
#: Marks that words are compared without.
ASCII_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
OTHER_MARKS = tuple(m.encode() for m in "«»“”„‘’…¿¡")
#: Characters of scripts without spaces, each of which is a word: Thai, Lao, Myanmar, Khmer, kana and Han; and marks among them.
SPACELESS = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
SPACELESS_MARKS = re.compile("[\u0e2f\u0e4f\u0e5a\u0e5b\u104a-\u104f\u17d4-\u17da\u3001-\u3003\u3008-\u3011\u3014-\u301f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20
#: Slots of the items' bags of words; the last one, of words that no item has, stays empty.
BAG = 1024


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without marks, in UTF-8; where a script has no spaces, each character is a word."""
    low = (text or "").lower()
    if not low.isascii() and SPACELESS.search(low):
        low = SPACELESS.sub(r" \g<0> ", SPACELESS_MARKS.sub(" ", low))
    raw = low.encode().translate(None, ASCII_MARKS)
    for mark in OTHER_MARKS:
        if mark in raw:
            raw = raw.replace(mark, b"")
    return raw.split()


def most_edits(n_words: int) -> int:
    return int(MOST_EDITED * n_words + 1e-9)


def find_within(pattern: list[int], text: list[int], most: int, anchored: bool = False) -> tuple[int, int] | None:
    """Least edits of ``pattern`` against any part of ``text``, and where that part ends first; bit-parallel, exact.

    ``anchored`` parts begin where the text does.
    """
    n = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    ones, high = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best, end = ones, 0, n, n, 0
    for at, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diagonal | up) & ones, up & diagonal
        score += (1 if plus & high else 0) - (1 if minus & high else 0)
        plus, minus = (plus << 1 | anchored) & ones, (minus << 1) & ones
        up, down = minus | ~(diagonal | plus) & ones, plus & diagonal
        if score < best:
            best, end = score, at
    return (best, end) if best <= most else None


def place_within(pattern: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """Least edits, and where the part with them begins and ends; of equally good ends the first, and of its beginnings the last."""
    if (found := find_within(pattern, text, most)) is None:
        return None
    edits, end = found
    _, size = find_within(pattern[::-1], text[:end][::-1], len(pattern), anchored=True)
    return edits, end - size, end


class Codes(dict):
    """Word codes; OTHER for words that no item has."""

    def __missing__(self, word: bytes) -> int:
        return OTHER


def pieces(n_words: int) -> list[tuple[int, int]]:
    """Where an item's pieces begin and end: as few as PIECE_WORDS allows, of about equal size."""
    n = max(1, -(-n_words // PIECE_WORDS))
    cuts = [n_words * i // n for i in range(n + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def spans_for(n_words: int) -> list[int]:
    """Where the spans begin, and the last one ends, for walks along so many words: a step moves on every other time."""
    made = list(SPANS)
    while made[-1] < 2 * n_words:
        made.append(2 * made[-1])
    return made


class Walks:
    """The random bits and the sampled places of each repetition's walk."""

    def __init__(self, n_codes: int, longest: int, repetitions: int, seed: int = 8):
        spans = spans_for(longest)
        chance = np.random.default_rng(seed)
        self.places = np.stack([chance.integers(spans[:-1], spans[1:]) for _ in range(repetitions)])
        self.bits = chance.integers(0, 1 << 64, (repetitions, spans[-1] // 64 + 1, n_codes), dtype=np.uint64)
        self.bits[:, :, END] = 0
        self.first = chance.integers(0, 1 << 32, (repetitions, 2, n_codes), dtype=np.uint32)

    def moves(self, r: int, step: int) -> np.ndarray:
        """0 or 1 for each code."""
        return (self.bits[r, step >> 6] >> np.uint64(step & 63) & np.uint64(1)).astype(np.int8)

    def first_slot(self, r: int, begin: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (self.first[r, 0][begin] + self.first[r, 1][second]) >> np.uint32(32 - _SLOTS)


@dataclass
class Index:
    """Items, and hash tables of their windows' sampled copies. Items of equal words are one, with the keys of all."""

    items: list[tuple[list[object], list[int]]]
    code: Codes
    anchor: np.ndarray
    walks: Walks
    recall: float = 1.0  # of the copies that were tried, at the length where it was least
    exact: list[int] = field(default_factory=list)  # items that are held against whole texts
    open: list[np.ndarray] = field(default_factory=list)  # by sample: slots of items' keys
    stop: list[np.ndarray] = field(default_factory=list)  # and of those whose item ends before the next sample
    ends: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # key -> item, offset
    bags: np.ndarray = field(default_factory=lambda: np.zeros((0, BAG + 1), bool))  # item, slot of a code -> whether the item has one there
    short: dict[bytes, dict[tuple[bytes, ...], list[object]]] = field(default_factory=dict)  # first word -> words of a short item -> its keys

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> Index:
        keys: dict[tuple[bytes, ...], list[object]] = {}
        for key, text in items:
            keys.setdefault(tuple(tokens(text)), []).append(key)
        short: dict[bytes, dict[tuple[bytes, ...], list[object]]] = {}
        for w, own in keys.items():
            if 0 < len(w) < MIN_WORDS:
                short.setdefault(w[0], {})[w] = own
        words = [(own, w) for w, own in keys.items() if len(w) >= MIN_WORDS]
        code = Codes({w: i + 2 for i, w in enumerate(sorted({w for _, ws in words for w in ws}))})
        anchor = np.zeros(len(code) + 2, bool)
        for w, c in code.items():
            anchor[c] = xxhash.xxh64_intdigest(w, 8) % ANCHOR_RATE == 0
        coded = [(own, [code[w] for w in ws]) for own, ws in words]
        parts = [(number, begin, cs[begin:end]) for number, (_, cs) in enumerate(coded) for begin, end in pieces(len(cs))]
        starts: list[list[int]] = []
        for _, _, cs in parts:
            half = range(max(1, (len(cs) * 2 + 2) // 3))
            own = [i for i in half if anchor[cs[i]]]
            if len(own) < FEWEST:
                own = list(half)
                anchor[[cs[i] for i in own]] = True
            starts.append(own)
        longest = max((len(cs) for _, _, cs in parts), default=0)
        repetitions, recall, missed = repetitions_for([cs for _, _, cs in parts], starts, anchor, longest)
        exact = sorted({number for number, _, cs in parts if len(cs).bit_length() in missed})
        made = cls(coded, code, anchor, Walks(len(anchor), longest, repetitions), recall, exact, short=short)
        n_samples = made.walks.places.shape[1]
        made.open, made.stop = ([np.zeros(1 << _SLOTS, bool) for _ in range(n_samples)] for _ in range(2))
        made.bags = np.zeros((len(coded), BAG + 1), bool)
        for number, (_, cs) in enumerate(coded):
            made.bags[number, np.array(cs) % BAG] = True
        made._fill(parts, starts)
        return made

    def _fill(self, parts: list[tuple[int, int, list[int]]], starts: list[list[int]]) -> None:
        """Enters the windows of all (item, begin, codes) pieces: their keys after each sample, up to the piece's end."""
        if not parts:
            return
        part, within, codes, at = windows([cs for _, _, cs in parts], starts)
        number, offset = np.array([p[0] for p in parts])[part], np.array([p[1] for p in parts])[part] + within
        ends: dict[int, dict[tuple[int, int], None]] = {}
        for r in range(len(self.walks.places)):
            last, final = np.full(len(number), -1), np.zeros(len(number), np.uint64)
            for sample, (place, key) in enumerate(sampled(self.walks, r, codes, at)):
                inside = codes[place] != END
                last[inside], final[inside] = sample, key[inside]
                slots = slot(key) if sample else self.walks.first_slot(r, codes[at], codes[place])
                self.open[sample][slots[inside]] = True
            for sample in range(len(self.stop)):
                self.stop[sample][slot(final[last == sample])] = True
            for k, n, o, some in zip(final.tolist(), number.tolist(), offset.tolist(), (last >= 0).tolist(), strict=True):
                if some:
                    ends.setdefault(k, {})[n, o] = None
        self.ends = {k: list(found) for k, found in ends.items()}

    def candidates(self, codes: np.ndarray) -> set[tuple[int, int, int]]:
        """(place of an anchor, place of the item's first word if nothing before it is edited, item); ``codes`` ends with an END."""
        starts = np.nonzero(self.anchor[codes])[0]
        begins = codes[starts]
        found: set[tuple[int, int, int]] = set()
        for r, places in enumerate(self.walks.places.tolist()):
            begin, at, step, key = starts, starts, 0, None
            for sample, place in enumerate(places):
                while step < place:
                    at = at + self.walks.moves(r, step)[codes[at]]
                    step += 1
                if key is None:  # most anchors end here, on a sum of two looked-up numbers
                    on = self.open[0][self.walks.first_slot(r, begins, codes[at])]
                    begin, at = begin[on], at[on]
                    key = next_key(first_key(r, codes[begin]), codes[at])
                else:
                    key = next_key(key, codes[at])
                    on = self.open[sample][slot(key)]
                    begin, at, key = begin[on], at[on], key[on]
                if not len(key):
                    break
                over = self.stop[sample][slot(key)]
                for b, k in zip(begin[over].tolist(), key[over].tolist(), strict=True):
                    found.update((b, b - offset, number) for number, offset in self.ends.get(k, ()))
        return found

    def likely(self, codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of candidates whose surroundings hold enough of the item's words, as words that are not edited are there."""
        sizes = np.array([len(cs) for _, cs in self.items], np.int64)
        most = np.array([most_edits(n) for n in sizes.tolist()], np.int64)
        slots = np.where(codes < 2, BAG, codes % BAG)
        found = np.array(sorted(self.candidates(codes)), np.int64).reshape(-1, 3)
        owner, number = np.searchsorted(begins, found[:, 0], side="right") - 1, found[:, 2]
        owner, number, b = np.unique(np.stack([owner, number, found[:, 1]], axis=1), axis=0).T
        # beginnings of one item that lie as near as its edits may move them are looked at together
        first = np.ones(len(b), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1]) | (b[1:] - b[:-1] > most[number[1:]])
        last = np.append(first[1:], True)[: len(b)]
        owner, number, low, high = owner[first], number[first], b[first], b[last]
        low = np.maximum(low - most[number], begins[owner])
        high = np.minimum(high + sizes[number] + 2 * most[number], begins[owner + 1] - 1)
        if self.exact:
            texts, items = (x.ravel() for x in np.meshgrid(np.arange(len(begins) - 1), np.array(self.exact), indexing="ij"))
            owner, number = np.append(owner, texts), np.append(number, items)
            low, high = np.append(low, begins[texts]), np.append(high, begins[texts + 1] - 1)
        alike = np.argsort(high - low, kind="stable")
        for at in range(0, len(alike), 1 << 16):
            owner_, number_, low_, high_ = (x[alike[at : at + (1 << 16)]] for x in (owner, number, low, high))
            held = np.zeros(len(low_), np.int64)
            for step in range(int((high_ - low_).max(initial=0))):
                place = low_ + step
                held += self.bags[number_, slots[np.minimum(place, len(slots) - 1)]] & (place < high_)
            keep = held >= sizes[number_] - most[number_]
            yield from zip(*(x[keep].tolist() for x in (owner_, number_, low_, high_)), strict=True)

    def short_hits(self, words: list[bytes]) -> Iterator[tuple[object, int, int]]:
        """(item key, first word, words) for each short item that a text holds as it is; the first place."""
        seen: set[tuple[bytes, ...]] = set()
        for at, word in enumerate(words):
            if (begun := self.short.get(word)) is None:
                continue
            for n in range(1, MIN_WORDS):
                item = tuple(words[at : at + n])
                if item in begun and item not in seen:
                    seen.add(item)
                    yield from ((key, at, len(item)) for key in begun[item])

    def hits(self, texts: list[list[bytes]]) -> Iterator[tuple[int, object, int, int, int]]:
        """(text, item key, edits, first word, words) for each item that a text holds; the place with the fewest edits."""
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        codes = np.full(begins[-1], END, np.int32)
        for at, t in zip(begins.tolist(), texts, strict=False):
            codes[at : at + len(t)] = list(map(self.code.__getitem__, t))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for owner, number, low, high in self.likely(codes, begins):
            pattern = self.items[number][1]
            if (got := place_within(pattern, codes[low:high].tolist(), most_edits(len(pattern)))) is not None:
                best[owner, number] = min(best.get((owner, number), (1 << 30, 0)), (got[0], low + got[1]))
        for (owner, number), (edits, begin) in sorted(best.items()):
            keys, pattern = self.items[number]
            yield from ((owner, key, edits, begin - int(begins[owner]), len(pattern)) for key in keys)
        if self.short:
            for owner, words in enumerate(texts):
                yield from ((owner, key, 0, first, n) for key, first, n in self.short_hits(words))


def first_key(r: int, codes: np.ndarray) -> np.ndarray:
    return next_key(np.full(len(codes), r + 1, np.uint64), codes)


def next_key(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    mixed = (key ^ codes.astype(np.uint64)) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - _SLOTS)).astype(np.int64)


def windows(items: list[list[int]], starts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The item, the offset in it and the place in the joined codes of each start; and these codes, with an END after each item."""
    begins = np.cumsum([0, *(len(cs) + 1 for cs in items)])
    codes = np.full(begins[-1], END, np.int64)
    for at, cs in zip(begins.tolist(), items, strict=False):
        codes[at : at + len(cs)] = cs
    number = np.repeat(np.arange(len(items)), [len(own) for own in starts])
    offset = np.array([o for own in starts for o in own], np.int64)
    return number, offset, codes, begins[number] + offset


def sampled(walks: Walks, r: int, codes: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the walks from the places ``at`` are at each sample, and their keys with it."""
    step, key = 0, first_key(r, codes[at])
    for place in walks.places[r].tolist():
        while step < place:
            at = at + walks.moves(r, step)[codes[at]]
            step += 1
        key = next_key(key, codes[at])
        yield at, key


def edited(codes: list[int], chance: np.random.Generator, edits: int) -> list[int]:
    """A copy with so many words replaced, left out, or preceded by a word that no item has."""
    kinds = dict(zip(chance.choice(len(codes), edits, replace=False).tolist(), chance.integers(0, 3, edits).tolist(), strict=True))
    made: list[int] = []
    for i, c in enumerate(codes):
        made += {None: [c], 0: [OTHER], 1: [], 2: [OTHER, c]}[kinds.get(i)]
    return made


def repetitions_for(items: list[list[int]], starts: list[list[int]], anchor: np.ndarray, longest: int) -> tuple[int, float, set[int]]:
    """The least repetitions that find RECALL of edited copies of pieces, in each class of lengths, the least class's share, and the classes that miss it.

    Copies have as many edits as are allowed. Classes go by powers of two. Of more
    than TRIED_ITEMS pieces, as many of each class are tried.
    """
    size_class = [len(cs).bit_length() for cs in items]
    chance = np.random.default_rng(9)
    tried: list[int] = []
    for c in sorted(set(size_class)):
        own = [i for i, k in enumerate(size_class) if k == c]
        tried += chance.permutation(own)[: max(1, TRIED_ITEMS // len(set(size_class)))].tolist()
    if not tried:
        return 1, 1.0, set()
    copies = [edited(items[i], chance, most_edits(len(items[i]))) for i in tried for _ in range(TRIED_COPIES)]
    walks = Walks(len(anchor), longest, MOST_REPETITIONS)
    number, _, own_codes, own_at = windows([items[i] for i in tried], [starts[i] for i in tried])
    copy, _, copy_codes, copy_at = windows(copies, [[i for i, c in enumerate(cs) if anchor[c]] for cs in copies])
    kind = np.repeat(np.array([size_class[i] for i in tried]), TRIED_COPIES)
    found = np.zeros(len(copies), bool)
    for r in range(MOST_REPETITIONS):
        final = np.zeros(len(number), np.uint64)
        for place, key in sampled(walks, r, own_codes, own_at):
            final = np.where(own_codes[place] != END, key, final)
        wanted = np.unique(final[final > 0] ^ number[final > 0].astype(np.uint64))
        for _, key in sampled(walks, r, copy_codes, copy_at):
            found[copy[np.isin(key ^ (copy // TRIED_COPIES).astype(np.uint64), wanted)]] = True
        shares = {k: float(found[kind == k].mean()) for k in set(kind.tolist())}
        if min(shares.values()) >= RECALL:
            break
    return r + 1, min(shares.values()), {k for k, share in shares.items() if share < RECALL}


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words) for each item that a document holds with MOST_EDITED edits or fewer.

    Words are lower-cased and without punctuation; in scripts without spaces each
    character is one. Null texts hold nothing; items that are null, or have no
    word, are looked for nowhere, and those of fewer than MIN_WORDS as they are.
    Repeated documents and items each have rows of their own; null ids are ids
    like any other; an empty table gives an empty result; columns of other names
    are not looked at. Whole texts are read, of any length; a text is in memory
    with its words. ``first_word`` counts from 0, for the place with the fewest
    edits, of equally good ones the first.

    Documents are read once. What is looked for is broadcast in parts of
    PASS_CHARS characters of items, or one longer item; a task makes each part, the
    driver passes on one after the other, and a worker holds one at a time, so
    none of them grows with the benchmark. Items of equal words are looked for once.
    """
    picked = pick(docs, doc_id=id_col, text=text_col)
    asked = pick(benchmark, item_id="item_id", text="text").filter("text is not null")
    kinds = [f.dataType.simpleString() for f in (picked.schema["doc_id"], asked.schema["item_id"])]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first_word int, n_words int"
    context = docs.sparkSession.sparkContext
    # unpickled in the worker, when the part's turn comes
    parts = [context.broadcast(bytes(r[0])) for r in indexes(asked).toLocalIterator()]

    def run(keys: list, texts: list) -> Iterator[tuple]:
        split = [tokens(t) for t in texts]
        for part in parts:
            if held.get("part") is not part:
                held.update(part=part, index=pickle.loads(part.value))
                vars(part).pop("_value", None)
            for i, item, edits, first, n in held["index"].hits(split):
                yield keys[i], item, edits, first, n

    held: dict[str, object] = {}
    return map_texts(picked, run, schema, SLICE_BYTES if len(parts) > 1 else BATCH_BYTES)


def indexes(asked: DataFrame) -> DataFrame:
    """(item_id, text) rows to a pickled Index for each PASS_CHARS characters; equal texts come to one."""
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = -(-total // PASS_CHARS) or 1
    rows = asked.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(n_parts)))

    def make(_: object, rows: pa.Table) -> pa.Table:
        items = sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda x: (str(x[0]), x[1]))
        return pa.table({"index": pa.array([pickle.dumps(Index.of(items))], pa.binary())})

    return rows.groupBy("part").applyInArrow(make, "index binary")


def op8(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return benchmark_hits(docs, benchmark)

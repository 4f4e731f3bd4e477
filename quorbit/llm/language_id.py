"""Language identification by cross-parsing.

A suffix automaton of each language's labelled text finds, from any place of a
text, the longest match with that language. A text is parsed greedily into such
longest matches. A language with more text has longer matches; so the number of
phrases is normalised by the logarithm of the length of the language's text, as in
the cross-parsing estimate of entropy, phrases x log2(length) / characters, and the
language of the least entropy wins.

Automata are kept as rows laid over one another in one array, so that one lookup a
character and language parses many pieces of texts at once. Pieces are first parsed
as if a phrase began with each; then each is parsed again from the state that the
piece before it ends in, until both parses are in the same state. So the cut into
pieces changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorbit.llm.arrow import map_texts
from quorbit.llm.columns import pick

#: The sample of labelled texts that is learnt from: so many different texts a language at most; where they have more characters together, an even share of each.
SAMPLE_DOCS, SAMPLE_CHARS = 48, 150_000
#: Characters of a stretch that such a share is made of. An automaton has two states a character at most, so a language's holds 300,000 or somewhat more.
STRETCH = 1_000
#: Characters of a piece, and pieces that are parsed side by side; neither changes a result.
PIECE, LANES = 1024, 4096
#: Classes of characters: what is no letter, letters that no sample has, and from 2 on the samples' letters.
GAP, OTHER = 0, 1
_TARGET = (1 << 32) - 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts the substrings of ``symbols``; state 0 is the root."""
    steps, link, longest, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p, last = last, new
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = steps[p][c]
        if longest[q] == longest[p] + 1:
            link[new] = q
            continue
        twin = len(steps)
        steps.append(dict(steps[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = link[new] = twin
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = twin
            p = link[p]
    return steps


@dataclass(frozen=True)
class Automata:
    """Each language's transitions, as rows that are laid over one another: a state is told by where its row begins.

    The entry at state + class holds owner << 32 | next state, and is the state's
    own if it is the owner. ``fresh`` has the next state of each language for a
    class at which a phrase begins. Roots own nothing, so any class begins a phrase
    there.
    """

    entries: np.ndarray
    fresh: np.ndarray
    roots: np.ndarray
    sizes: np.ndarray  # of the languages' texts

    @classmethod
    def of(cls, texts: list[list[int]], classes: int) -> Automata:
        entries, fresh, roots = [np.empty(0, np.int64)], np.empty((len(texts), classes), np.int64), []
        for k, symbols in enumerate(texts):
            steps, offset = suffix_automaton(symbols), sum(map(len, entries))
            rows = steps[1:]
            degree = np.fromiter(map(len, rows), np.int64, len(rows))
            symbol = np.fromiter(chain.from_iterable(rows), np.int64, degree.sum())
            to = np.fromiter(chain.from_iterable(map(dict.values, rows)), np.int64, degree.sum())
            place = laid_over(rows, degree, symbol, classes)
            root = int(place.max(initial=0)) + 1
            begin, owner = np.append(root, place) + offset, np.repeat(place, degree)
            own = np.full(root + classes, -1 << 32, np.int64)
            own[owner + symbol] = (owner + offset) << 32 | begin[to]
            entries.append(own)
            roots.append(root + offset)
            fresh[k] = [begin[steps[0].get(c, 0)] for c in range(classes)]
        return cls(np.concatenate(entries), fresh, np.array(roots, np.int64), np.array([len(t) for t in texts], np.int64))

    def step(self, state: np.ndarray, symbols: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where no phrase began."""
        found = self.entries.take(state + symbols)
        on = (found >> 32) == state
        return np.where(on, found & _TARGET, fresh), on


def laid_over(rows: list[dict[int, int]], degree: np.ndarray, symbol: np.ndarray, classes: int) -> np.ndarray:
    """Where each row begins, so that no two rows begin alike or use the same place; rows of many entries first.

    ``degree`` is the rows' numbers of entries, and ``symbol`` all their classes.
    """
    room = 2 * len(symbol) + 2 * len(rows) + 4 * classes + 8192
    free, unbegun = np.ones(room, bool), np.ones(room, bool)
    place = np.zeros(len(rows), np.int64)
    low = 0
    for i in np.argsort(-degree, kind="stable")[: int((degree > 1).sum())].tolist():
        width, at = 256, low
        while True:
            fits = unbegun[at : at + width].copy()
            for c in rows[i]:
                fits &= free[at + c : at + c + width]
            k = int(fits.argmax())
            if fits[k]:
                break
            at, width = at + width, 4096
        place[i] = begin = at + k
        unbegun[begin] = False
        for c in rows[i]:
            free[begin + c] = False
        low = at  # rows of one entry fill what gaps are left below
    single = np.nonzero(degree == 1)[0]
    only = symbol[(np.cumsum(degree) - degree)[single]]
    for c in np.unique(only).tolist():
        own = single[only == c]
        begins = np.nonzero(free[c:] & unbegun[: room - c])[0][: len(own)]
        place[own] = begins
        free[begins + c] = unbegun[begins] = False
    none = np.nonzero(degree == 0)[0]
    place[none] = np.nonzero(unbegun)[0][: len(none)]
    return place


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    class_of: np.ndarray  # by code point
    automata: Automata

    def codes(self, text: str) -> np.ndarray:
        """Classes of the lower-cased text, with runs of gaps as one."""
        found = self.class_of[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != GAP) | (found[:-1] != GAP)
        return found[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs, a row for each text."""
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        cuts = [(i, at) for i, codes in enumerate(texts) for at in range(0, len(codes), PIECE)]
        if not cuts or not self.languages:
            return total
        pieces = [texts[i][at : at + PIECE] for i, at in cuts]
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(-sizes, kind="stable")
        count, end = (np.empty((len(self.languages), len(pieces)), np.int64) for _ in range(2))
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            count[:, lanes], end[:, lanes] = parsed(self.automata, [pieces[p] for p in lanes.tolist()], sizes[lanes])
        count += corrections(self.automata, pieces, np.array([at > 0 for _, at in cuts]), end)
        np.add.at(total, [i for i, _ in cuts], count.T)
        return total


def parsed(automata: Automata, pieces: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin in each piece, and the state that it ends in, if a phrase begins with it; the longest pieces come first."""
    grid = np.zeros((len(pieces[0]), len(pieces)), np.int64)
    for lane, piece in enumerate(pieces):
        grid[: len(piece), lane] = piece
    state = np.repeat(automata.roots[:, None], len(sizes), axis=1)
    matched = np.zeros(state.shape, np.int64)
    for step, n in enumerate(np.searchsorted(-sizes, -np.arange(len(grid)), side="left").tolist()):
        symbols = grid[step, :n]
        state[:, :n], on = automata.step(state[:, :n], symbols, automata.fresh.take(symbols, axis=1))
        matched[:, :n] += on
    return sizes - matched, state


def corrections(automata: Automata, pieces: list[np.ndarray], follows: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What each piece's phrases change by, if it goes on in the state that the piece before it ends in.

    Both parses fall into one state after a few phrases, and are alike from there
    on. Where one does not before the piece ends, the next piece begins in yet
    another state, and is looked at again.
    """
    change, begun = np.zeros(end.shape, np.int64), np.repeat(automata.roots[:, None], len(pieces), axis=1)
    length = np.array([len(p) for p in pieces], np.int64)
    starts, joined = np.cumsum(length) - length, np.concatenate(pieces).astype(np.int64)
    while True:
        true = np.where(follows, np.roll(end, 1, axis=1), automata.roots[:, None])
        which, lanes = np.nonzero(true != begun)
        if not len(lanes):
            return change
        new, old, step = true[which, lanes], begun[which, lanes], 0
        begun[which, lanes] = new
        while len(lanes):
            on = length[lanes] > step
            if not on.all():
                end[which[~on], lanes[~on]] = new[~on]
                which, lanes, new, old = which[on], lanes[on], new[on], old[on]
            symbols = joined[starts[lanes] + step]
            fresh = automata.fresh[which, symbols]
            (new, one), (old, other) = automata.step(new, symbols, fresh), automata.step(old, symbols, fresh)
            change[which, lanes] += other.astype(np.int64) - one
            apart = new != old
            if not apart.all():
                which, lanes, new, old = which[apart], lanes[apart], new[apart], old[apart]
            step += 1


def train(samples: dict[str, list[str]]) -> Model:
    """A model of the whole texts that each language has."""
    texts = {lang: " ".join(x.lower() for x in t) for lang, t in sorted(samples.items())}
    letters = sorted({c for t in texts.values() for c in set(t) if c.isalpha()})
    class_of = np.full(0x110000, GAP, np.uint16 if len(letters) < 60_000 else np.uint32)
    class_of[np.fromiter(map(str.isalpha, map(chr, range(len(class_of)))), bool, len(class_of))] = OTHER
    class_of[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    model = Model(tuple(texts), class_of, Automata.of([], 0))
    return Model(model.languages, class_of, Automata.of([model.codes(t).tolist() for t in texts.values()], len(letters) + 2))


def predict(model: Model, texts: list[str | None]) -> Iterator[tuple[str, float]]:
    """The language with the fewest normalised phrases and how far the next one is behind, 0 to 1; of equal ones the first by name."""
    known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
    counts = model.phrases([model.codes(t) if k else np.empty(0, np.uint16) for t, k in zip(texts, known, strict=True)])
    norm = np.log2(model.automata.sizes + 1)
    for row, k in zip(counts * norm, known, strict=True):
        if not k or not model.languages:
            yield "und", 0.0
            continue
        best = int(row.argmin())
        rest = np.delete(row, best)
        yield model.languages[best], float(1 - row[best] / rest.min()) if len(rest) else 1.0


def even_share(text: Column, share: Column) -> Column:
    """The stretches of a text that hold ``share`` of it, from places at even distances; one at least, so of all lengths alike. A share of 1 or more: the text."""
    n = F.length(text)
    count = F.greatest(F.ceil(n * share / STRETCH), F.lit(1)).cast("int")
    size = F.least(n, F.ceil(n * share / count)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, F.floor(i * (n / count)).cast("int") + 1, size))
    return F.when(share >= 1, F.array(text)).otherwise(cuts)


def labelled_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """(text, lang) rows to texts, or stretches of them, by language, in order of the texts' hashes.

    Different texts of a language are taken in order of their hash, ``docs_each`` at
    most, whatever their lengths; copies count once. Where they have more than
    ``chars_each`` characters together, each gives the same share of its own, in
    stretches that lie evenly over it. Two small jobs bring the hashes, and then
    what is learnt, to the driver: ``chars_each`` characters a language, and a stretch
    for each text, at most.
    """
    named = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = named.select("lang", "h", F.length("text").alias("n")).groupBy("lang", "h").agg(F.max("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen: dict[str, dict[int, int]] = {}
    for lang, h, n in sizes.withColumn("place", place).filter(F.col("place") <= docs_each).select("lang", "h", "n").collect():
        chosen.setdefault(lang, {})[h] = n
    if not chosen:
        return {}
    wanted, share = F.lit(False), F.lit(1.0)
    for lang, found in chosen.items():
        wanted = wanted | ((F.col("lang") == lang) & F.col("h").isin(list(found)))
        if (total := sum(found.values())) > chars_each:
            share = F.when(F.col("lang") == lang, F.lit(chars_each / total)).otherwise(share)
    rows = named.filter(wanted).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", even_share(F.col("text"), share).alias("parts")).collect()
    return {lang: [p for r in sorted(rows, key=lambda r: r["h"]) if r["lang"] == lang for p in r["parts"]] for lang in sorted(chosen)}


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, lang_pred, score.

    Whole texts of any length; case is ignored, runs of what is no letter count as
    one gap. ``und`` and 0 for null texts and those without a letter, and where
    nothing was learnt. Equal phrases: the first language by name. Repeated rows
    and null ids stay; an empty table gives an empty result; columns of other names
    are not looked at.
    """
    picked = pick(docs, doc_id=id_col, text=text_col)
    rows = lambda keys, texts: ((k, *p) for k, p in zip(keys, predict(model, texts), strict=True))
    return map_texts(picked, rows, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo 5; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == fold


def op4(docs: DataFrame) -> DataFrame:
    """Learns from rows with a language outside the held-out ones; rows with a null id count by an empty one."""
    labelled = pick(docs, key="doc_id", text="text", lang="lang").filter(~held_out("key", 0))
    model = train(labelled_sample(labelled.select("text", "lang")))
    return identify(docs, model).select("doc_id", held_out("doc_id", 0).alias("held_out"), "lang_pred", "score")

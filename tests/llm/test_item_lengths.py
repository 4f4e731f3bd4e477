"""Benchmark items of every length, held against brute force; and where they are found."""

import random

import pytest

from quorbit.llm import decontamination as D

VOCABULARY = [f"w{i}" for i in range(3000)]


def rows(df):
    return [tuple(r) for r in df.collect()]


def changed(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(VOCABULARY)
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, rng.choice(VOCABULARY))
    return words


@pytest.mark.parametrize("low, high", [(1, 4), (5, 15), (16, 60), (200, 320)])
def test_recall_by_length(spark, low, high):
    """All pairs that brute force finds, at 0.9 or more, where as many words are edited as may be."""
    rng = random.Random(high)
    items = [(k, [rng.choice(VOCABULARY) for _ in range(rng.randint(low, high))]) for k in range(60)]
    docs = []
    for k in range(180):
        text = [rng.choice(VOCABULARY) for _ in range(300)]
        at = rng.randrange(len(text))
        item = items[k % 60][1]
        docs.append((k, text[:at] + changed(item, D.most_edits(len(item)) if len(item) >= D.MIN_WORDS else 0, rng) + text[at:]))
    found = rows(
        D.op8(
            spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id bigint, text string"),
            spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"),
        )
    )
    want = {(d, i): got for d, words in docs for i, item in items if (got := D.place_within(item, words, D.most_edits(len(item))))}
    assert len(want) >= 180
    assert {x[:2] for x in found} <= set(want)
    assert len(found) >= 0.9 * len(want)
    assert all(edits == want[d, i][0] for d, i, edits, _, _ in found)
    if high > 4:  # a short item may stand in several places
        assert sum(first == want[d, i][1] for d, i, _, first, _ in found) >= 0.95 * len(found)


@pytest.mark.parametrize("n_words, n_items", [(1000, 12), (2000, 8), (8000, 4)])
def test_recall_of_long_items(spark, n_words, n_items):
    """Items far longer than a piece, edited as much as may be: evenly, at random, and all in one stretch."""
    rng = random.Random(n_words)
    items = [(k, rng.choices(VOCABULARY, k=n_words - k)) for k in range(n_items)]
    docs = []
    for k, words in items:
        most, step = D.most_edits(len(words)), 5
        evenly = [rng.choice(VOCABULARY) if i % step == 2 and i // step < most else w for i, w in enumerate(words)]
        stretch = words[:50] + rng.choices(VOCABULARY, k=most) + words[50 + most :]
        for made in (evenly, changed(words, most, rng), stretch):
            docs.append((len(docs), rng.choices(VOCABULARY, k=100) + made + rng.choices(VOCABULARY, k=100)))
    beyond = [(len(docs), items[0][1][: n_words // 2])]  # half an item is no hit
    found = rows(
        D.op8(
            spark.createDataFrame([(k, " ".join(w)) for k, w in docs + beyond], "doc_id bigint, text string"),
            spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(-1, " ".join(items[0][1]))], "item_id bigint, text string"),
        )
    )
    want = {(3 * k + j, k) for k in range(n_items) for j in range(3)}
    assert {x[:2] for x in found if x[1] >= 0} <= want and len({x[:2] for x in found if x[1] >= 0}) >= 0.9 * len(want)
    assert {x[0] for x in found if x[1] == -1} == {x[0] for x in found if x[1] == 0}  # an equal item has the same hits
    assert all(edits == D.place_within(items[i][1], docs[d][1], n_words)[0] for d, i, edits, _, _ in found if i >= 0)


def test_one_piece_has_no_larger_share_of_edits():
    for n in range(D.MIN_WORDS, 2000):
        made = D.pieces(n)
        assert made[0][0] == 0 and made[-1][1] == n and all(a[1] == b[0] for a, b in zip(made, made[1:]))
        assert all(e - b <= D.PIECE_WORDS for b, e in made)
        assert sum(D.most_edits(e - b) + 1 for b, e in made) > D.most_edits(n)  # not all pieces can have more than their share


def test_items_that_candidates_miss_are_searched_exactly(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_REPETITIONS", 1)
    monkeypatch.setattr(D, "RECALL", 1.01)
    rng = random.Random(5)
    items = [(k, rng.choices(VOCABULARY, k=rng.randint(5, 200))) for k in range(20)]
    index = D.Index.of([(k, " ".join(w)) for k, w in items])
    assert index.exact == list(range(20))
    for k, words in items:
        text = rng.choices(VOCABULARY, k=40) + changed(words, D.most_edits(len(words)), rng) + rng.choices(VOCABULARY, k=40)
        assert k in {h[1] for h in index.hits([[w.encode() for w in text]])}


def test_many_parts_and_equal_items(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=30))) for k in range(40)]
    equal = [(100 + k, items[0][1].upper() + "!") for k in range(2000)]
    docs = [(k, " ".join(rng.choices(VOCABULARY, k=50)) + " " + text) for k, text in items] + [(None, None), (99, "")]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + equal + [(None, None), (5000, "")], "item_id bigint, text string")
    one = sorted(rows(D.op8(*frames)))
    assert len(one) == 2040 and {x[0] for x in one if x[1] >= 100} == {0}
    monkeypatch.setattr(D, "PASS_CHARS", 500)
    assert D.indexes(frames[1].filter("text is not null")).count() > 20
    assert sorted(rows(D.op8(*frames))) == one


def test_first_word_is_where_the_aligned_part_begins(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = {
        1: "x y alpha beta gamma delta epsilon zeta eta theta iota kappa z",
        2: "x y alpha beta new gamma delta epsilon zeta eta theta iota kappa z",  # a word put in
        3: "x y alpha beta delta epsilon zeta eta theta iota kappa z",  # a word left out
        4: "x y alpha beta other delta epsilon zeta eta theta iota kappa z",
    }
    found = rows(D.op8(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")))
    assert sorted(found) == [(1, 7, 0, 2, 10), (2, 7, 1, 2, 10), (3, 7, 1, 2, 10), (4, 7, 1, 2, 10)]


def test_windows_reach_to_the_items_end():
    """No key is made of the beginning of a long item alone: each window's last sample lies in its second half."""
    rng = random.Random(3)
    index = D.Index.of([(k, " ".join(rng.choices(VOCABULARY, k=120))) for k in range(20)])
    number, offset, codes, at = D.windows([c for _, c in index.items], [list(range(60)) for _ in index.items])
    beyond = []
    for r in range(len(index.walks.places)):
        last = at
        for place, _ in D.sampled(index.walks, r, codes, at):
            last = place * (codes[place] != D.END) + last * (codes[place] == D.END)
        beyond += ((last - at) / (120 - offset)).tolist()
    assert sum(b > 0.25 for b in beyond) > 0.95 * len(beyond) and sum(beyond) / len(beyond) > 0.5


def test_the_number_of_repetitions_follows_from_the_recall():
    rng = random.Random(4)
    items = [(k, " ".join(rng.choices(VOCABULARY, k=100))) for k in range(60)]
    index = D.Index.of(items)
    assert index.recall >= D.RECALL and 1 <= len(index.walks.places) <= D.MOST_REPETITIONS

"""What is learnt from or looked for is all of it."""

from __future__ import annotations

import random

import xxhash

from quorbit.llm import decontamination, language_id


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_language_learns_from_whole_texts():
    long_text = "ab cd " * 10_000
    model = language_id.train({"xx": [long_text, "pqr stu", long_text]})
    letters = {c for c in "abcdpqrstu" if model.class_of[ord(c)] not in (language_id.GAP, language_id.OTHER)}
    assert letters == set("abcdpqrstu") and model.automata.sizes[0] == 2 * len(long_text) + 8


def test_what_is_learnt_follows_the_lengths_of_all_texts(spark):
    """Beyond the bound on characters each text gives the same share, however long it is; none is passed over."""
    texts = {n: "".join(map(chr, random.Random(n).choices(range(0x4E00, 0x9E00), k=n))) for n in (5, 900, 12_000, 40_000, 400_000)}
    docs = spark.createDataFrame([(t, "xx") for t in texts.values()] * 2 + [("short one", "yy"), (None, "yy"), ("text", None)], "text string, lang string")
    found = language_id.labelled_sample(docs, chars_each=100_000)
    assert found["yy"] == ["short one"] and sorted(found) == ["xx", "yy"]
    share, held = 100_000 / sum(texts), {n: [] for n in texts}
    for part in found["xx"]:
        n = next(n for n, t in texts.items() if part in t and (len(part) > 5 or n == 5))
        held[n].append(texts[n].index(part))
    for n, starts in held.items():
        assert len(starts) == max(1, -(-n * share // language_id.STRETCH))
        assert [round(s * len(starts) / n) for s in sorted(starts)] == list(range(len(starts)))  # one stretch in each equal part
    assert abs(sum(map(len, found["xx"])) - 100_000) < len(found["xx"])
    assert language_id.labelled_sample(docs.filter("lang = 'xx'"), chars_each=sum(texts))["xx"] == sorted(texts.values(), key=xx64)
    assert len(language_id.labelled_sample(docs, docs_each=2)["xx"]) == 2


def xx64(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_short_items_are_found_as_they_are(spark):
    docs = spark.createDataFrame([(1, "Well, the QUICK fox; quick fox again"), (2, "the quick brown fox"), (3, "foxes quick"), (4, None), (5, "quick fox the quick red fox jumps over it")], "doc_id bigint, text string")
    items = [(1, "quick fox"), (1, "Quick fox!"), (2, "foxes"), (3, "the quick red fox"), (4, "the quick red fox jumps over"), (5, " ... "), (None, "fox")]
    found = rows(decontamination.op8(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    short = [(1, 1, 0, 2, 2), (1, 1, 0, 2, 2), (1, None, 0, 3, 1), (2, None, 0, 3, 1), (3, 2, 0, 0, 1), (5, 1, 0, 0, 2), (5, 1, 0, 0, 2), (5, None, 0, 1, 1), (5, 3, 0, 2, 4)]
    assert sorted(found, key=repr) == sorted([*short, (5, 4, 0, 2, 6)], key=repr)


def test_scripts_without_spaces_are_cut_into_characters(spark):
    item = "\u5409\u8f29\u306f\u732b\u3067\u3042\u308b\u3002\u540d\u524d\u306f\u307e\u3060\u7121\u3044"
    assert len(decontamination.tokens(item)) == len(item) - 1
    assert decontamination.tokens("Straße, «déjà» vu") == ["straße".encode(), "déjà".encode(), b"vu"]
    edited = item.replace("\u732b", "\u72ac").replace("\u3002", "")
    docs = spark.createDataFrame([(1, "\u4eca\u65e5" + item + "\u660e\u65e5"), (2, "abc" + edited), (3, item[:7]), (4, "\u732b\u3067")], "doc_id bigint, text string")
    found = rows(decontamination.op8(docs, spark.createDataFrame([(1, item), (2, "\u732b\u3067")], "item_id bigint, text string")))
    assert {(r[0], r[1], r[2]) for r in found} == {(1, 1, 0), (2, 1, 1), (1, 2, 0), (3, 2, 0), (4, 2, 0)} and len(found) == 5

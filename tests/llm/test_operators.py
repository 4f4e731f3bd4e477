"""Each operator against a plain version, and on hard rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quorbit.llm import decontamination, language_id, line_dedup, lm_scoring, pieces, quality_gam, quality_rules, sharding, simhash, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())


def rows(df):
    return [tuple(r) for r in df.collect()]


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Component ids of (id, fp) rows."""
    values = sorted({f for _, f in fps})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in fps]


# -- 1: SimHash ---------------------------------------------------------------


def test_simhash_hard_rows(hard_docs, hard_rows, clashing):
    want = plain_groups([(r[0], plain_fingerprint(r[1])) for r in hard_rows])
    assert sorted(rows(simhash.op1(hard_docs)), key=repr) == sorted(want, key=repr)
    assert sorted(rows(simhash.op1(clashing(hard_docs))), key=repr) == sorted(want, key=repr)


def test_simhash_no_rows(no_docs):
    assert rows(simhash.op1(no_docs)) == []


def test_simhash_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = rows(simhash.op1(docs))
    want = plain_groups([(i, plain_fingerprint(t)) for i, t in rows(docs.select("doc_id", "text"))])
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("groups", [8, 10, 12])
def test_links_have_the_components_of_all_pairs(spark, groups, monkeypatch):
    """Dense groups, chains, cells of many points that are not near, and points alone."""
    monkeypatch.setattr(simhash, "groups_for", lambda n: groups)
    rng = random.Random(groups)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for centre in fps[:3]:
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(50)]
    at = fps[5]
    for _ in range(12):
        at ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(at)
    low = rng.getrandbits(32)
    fps += [low | rng.getrandbits(32) << 32 for _ in range(30)]
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    links = simhash.near_links(frame)
    from quorbit.llm.components import components

    roots = dict(rows(components(links)))
    want = plain_groups([(i, f) for i, f in enumerate(fps)])
    classes = {}
    for (i, _, c), f in zip(want, fps, strict=True):
        classes.setdefault(c, set()).add(roots.get(signed(f), signed(f)))
    assert all(len(v) == 1 for v in classes.values())
    assert len({v.copy().pop() for v in classes.values()}) == len(classes)


def test_manhattan_bounds_hamming(spark):
    rng = random.Random(4)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = df.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))), "a", "b")
    for hamming, manhattan, a, b in rows(got):
        counts = [abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2)]
        assert sum(counts) == manhattan <= hamming


# -- 2: quality ---------------------------------------------------------------


def test_quality_held_out(spark, small):
    big = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_gam.op2(docs, labels)
    held = rows(scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality"))
    assert len(held) > 500
    assert sum(p == q for _, p, q in held) / len(held) > 0.97
    good, bad = [s for s, _, q in held if q == 1], [s for s, _, q in held if q == 0]
    assert np.mean([g > b for g in good[:300] for b in bad]) > 0.98


def test_quality_hard_rows(spark, hard_docs, hard_rows, no_docs, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (4, None, 0), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = rows(quality_gam.op2(clashing(hard_docs), labels))
    assert len(found) == len(hard_rows)
    assert all(0 <= s <= 1 and p == (s >= 0.3) and h == (crc(i) % 5 == 0) for i, h, s, p in found)
    assert sorted((r[0] is None, r[0] or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in hard_rows)
    assert rows(quality_gam.op2(no_docs, labels)) == []
    assert {s for _, _, s, _ in rows(quality_gam.op2(hard_docs, labels.limit(0)))} == {0.5}


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


# -- 3: URLs ------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7#x", "http://example.com/en/8?q=/x", "x://com/en/", "http://xcom/en/", "http://a.b.example.net/de/81/", "http://net/de/", "http://example.org?es/", "http://q.org/es/1", "a://b://c/d", "http://É.com/de"]
    pages = spark.createDataFrame([(i, u, "bad") for i, u in enumerate(urls)] + [(0, None, "bad"), (None, "http://x.org/1", "")], "page_id bigint, url string, HOST string")
    labels = spark.createDataFrame([(1, 0, 1), (1, None, None), (None, 0, 0), (81, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = rows(url_filter.op3(pages, labels))
    assert len(found) == len(urls) + 2
    for page, host, path, rule, verdict, *_ in found:
        if page is None:
            continue
        assert (host, path) == plain_url(urls[page])
        best = plain_rule(host, path)
        assert rule == (best.name if best else None)
        assert verdict == best.verdict if best else verdict in ("allow", "block")
    assert rows(url_filter.op3(pages.limit(0), labels)) == []
    assert len(rows(url_filter.op3(pages, labels.limit(0)))) == len(found)


def test_bad_hosts_are_blocked_and_few_labels_are_not_enough(spark):
    pages = [(i, f"http://bad.one.com/de/{i}") for i in range(60)] + [(i, f"http://good.two.com/de/{i}") for i in range(60, 300)] + [(300, "http://new.three.com/de/300")]
    labels = [(i, int(i >= 60), 0) for i in range(301)]
    labels[300] = (300, 0, 0)
    found = url_filter.url_filter(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    verdicts = {h: v for h, v in rows(found.select("host", "verdict").distinct())}
    assert verdicts == {"bad.one.com": "block", "good.two.com": "allow", "new.three.com": "allow"}


# -- 4: languages -------------------------------------------------------------


def plain_phrases(table_text, codes):
    """Greedy longest matches, by substring search."""
    text, part, n, i = "".join(map(chr, table_text)), "".join(map(chr, codes)), 0, 0
    while i < len(part):
        k = 1
        while i + k < len(part) and part[i : i + k + 1] in text:
            k += 1
        n, i = n + 1, i + k
    return n


@pytest.mark.parametrize("piece, lanes", [(37, 5), (3, 4), (1, 7), (1024, 8192)])
def test_phrases_are_longest_matches(monkeypatch, piece, lanes):
    """However texts are cut into pieces."""
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "LANES", lanes)
    rng = random.Random(2)
    learnt = {"a": ["".join(rng.choice("abcde ") for _ in range(300))], "b": ["".join(rng.choice("cdefg ") for _ in range(200))]}
    model = language_id.train(learnt)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (0, 1, 30, 37, 38, 200, 500)] + [learnt["a"][0][20:290], learnt["b"][0] * 2]
    codes = [model.codes(t) for t in texts]
    got = model.phrases(codes)
    for k, lang in enumerate(model.languages):
        own = model.codes(learnt[lang][0])
        assert got[:, k].tolist() == [plain_phrases(own, c) for c in codes]


def plain_languages(docs):
    """The query by its definition: texts of the least hashes, phrases by substring search, each times log2 of the language's length."""
    learnt = {}
    for i, text, lang in docs:
        if text is not None and lang is not None and crc(i) % 5:
            learnt.setdefault(lang, set()).add(text)
    def clean(text):
        return re.sub(r"[\W\d_]+", " ", text.lower())

    models = {}
    for lang, texts in sorted(learnt.items()):
        hashes = {}
        for t in texts:
            hashes[xx64(t)] = t
        left, taken = language_id.SAMPLE_CHARS, []
        for h in sorted(hashes)[: language_id.SAMPLE_DOCS]:
            if len(hashes[h]) <= left:
                taken.append(hashes[h])
                left -= len(hashes[h])
        models[lang] = re.sub(" +", " ", clean(" ".join(taken)))
    for i, text, _ in docs:
        if not text or not any(map(str.isalpha, text)):
            yield i, crc(i) % 5 == 0, "und", 0.0
            continue
        cost = sorted((plain_phrases(map(ord, m), map(ord, clean(text))) * math.log2(len(m) + 1), lang) for lang, m in models.items())
        yield i, crc(i) % 5 == 0, cost[0][1], 1 - cost[0][0] / cost[1][0]


def xx64(text):
    """Spark's hash of a string column, as a signed number."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_language_query_against_a_plain_version(spark, small):
    """Also with an id that several texts share, null ids, and a script of 500 letters."""
    script = [chr(0x4E00 + i) for i in range(500)]
    rng = random.Random(4)
    docs = [(r[0], r[1], r[2]) for r in rows(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(60))]
    docs = [(i, t[:1500], lang) for i, t, lang in docs]
    phrases = ["".join(rng.choices(script, k=6)) for _ in range(120)]
    docs += [(900 + k, " ".join(rng.choices(phrases, k=40)), "zz") for k in range(12)]
    docs += [(7, f"a text of its own with the number {k}", "en") for k in range(4)] + [(None, "ohne Nummer", "de"), (None, "12 34", None), (8, None, "fr")]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    order = lambda r: (repr(r[0]), r[2], r[3])
    found, want = sorted(rows(language_id.op4(frame)), key=order), sorted(plain_languages(docs), key=order)
    assert [r[:3] for r in found] == [r[:3] for r in want]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in want], rel=1e-9)
    assert sum(r[2] == "zz" for r in found) == 12


def test_language_held_out(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    found = language_id.op4(docs).join(docs, "doc_id").filter("held_out and n_chars > 40")
    right = rows(found.select(F.col("lang") == F.col("lang_pred")))
    assert len(right) > 100 and sum(r[0] for r in right) / len(right) > 0.97


def test_language_hard_rows(hard_docs, hard_rows, no_docs, clashing):
    found = rows(language_id.op4(clashing(hard_docs)))
    assert len(found) == len(hard_rows)
    texts = Counter()
    for i, held, lang, score in found:
        assert held == (crc(i) % 5 == 0) and 0 <= score <= 1
        texts[lang] += 1
    assert texts["und"] == sum(not (r[1] and any(map(str.isalpha, r[1]))) for r in hard_rows)
    assert rows(language_id.op4(no_docs)) == []
    assert {r[2] for r in rows(language_id.op4(hard_docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# -- 5: shards ----------------------------------------------------------------


def check_shards(found, n):
    sizes = Counter(r[4] for r in found)
    assert max(sizes.values(), default=0) - min((sizes[s] for s in range(8)), default=0) <= 1 and sum(sizes.values()) == n
    for s in sizes:
        assert sorted(r[5] for r in found if r[4] == s) == list(range(sizes[s]))


def test_sharding_hard_rows(hard_docs, hard_rows, no_docs, clashing):
    found = rows(sharding.op5(clashing(hard_docs)))
    check_shards(found, len(hard_rows))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in hard_rows), key=repr)
    assert sorted((r[:3] for r in found), key=repr) == want
    assert {r[3] for r in found} == {"rows"} and {r[6] for r in found} == {None}
    assert rows(sharding.op5(no_docs)) == []


def test_sharding_ignores_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once, again = (sorted(rows(sharding.op5(d))) for d in (docs, docs.repartition(7)))
    check_shards(once, docs.count())
    assert once == again


def test_matrix_margins_and_law():
    cells, shards = [5, 0, 17, 40, 1], [8, 8, 8, 8, 8, 8, 8, 7]
    totals = np.zeros((5, 8))
    for seed in range(600):
        m = np.array(sharding.communication_matrix(cells, shards, seed))
        assert m.sum(1).tolist() == cells and m.sum(0).tolist() == shards and (m >= 0).all()
        totals += m
    expected = np.outer(cells, shards) / 63
    assert np.abs(totals / 600 - expected).max() < 0.25


def test_hypergeometric_frequencies():
    chance = random.Random(1)
    got = Counter(sharding.hypergeometric(chance, 6, 9, 5) for _ in range(20000))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(got[k] / 20000 - p) < 0.015


# -- 6: pieces ----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_pieces_like_the_library(library):
    table = pieces.PieceTable(open(pieces.default_model(), "rb").read())
    rng = random.Random(6)
    marks = " ▁  aeiouthenérñ日本語\t\n\x00𓀀<s>ABC123.,!  "
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(3000)]
    vocabulary = [library.id_to_piece(i) for i in range(259, 32000)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += ["", " ", "a" * 3000, " " * 2000, "<unk>", "</s><s>", "\ufeffhi", "the" * 999]
    for t in texts:
        want = library.encode(t, add_bos=True, add_eos=True)
        ids = table.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert table.decode(ids) == library.decode(want), t


def test_pieces_of_tables(hard_docs, hard_rows, no_docs, clashing, library):
    want = []
    for i, t, *_ in hard_rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(rows(pieces.op6(clashing(hard_docs))), key=repr) == sorted(want, key=repr)
    assert rows(pieces.op6(no_docs)) == []


# -- 7: language model --------------------------------------------------------


def plain_scores(docs):
    """Counts of n-grams in dictionaries, and the interpolated probability of each token by its definition."""
    tokens = [["<b>", *WORD.findall((t or "").translate(LOWER)), "<e>"] for _, t in docs]
    count = Counter()
    for (i, _), w in zip(docs, tokens, strict=True):
        if crc(i) % 5 != 1:
            count.update(tuple(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    words = {g[0]: n for g, n in count.items() if len(g) == 1 and g != ("<b>",)}
    total = sum(words.values())
    size = total + 0.5 * (len(words) + 1)

    def p(h, w):
        if not h:
            return (words.get(w, 0) + 0.5) / size
        return (count[(*h, w)] + lm_scoring.MASS * p(h[1:], w)) / (count[h] + lm_scoring.MASS)

    for (i, _), w in zip(docs, tokens, strict=True):
        base = sum(math.log10(p((), x)) for x in w[1:])
        smooth = sum(math.log10(p(tuple(w[max(0, k - 2) : k]), w[k])) for k in range(1, len(w)))
        yield (i, crc(i) % 5 == 1, len(w) - 1, sum(x in words for x in w[1:]), total, base, smooth)


@pytest.mark.parametrize("size, fan", [(2000, 2048), (2000, 4), (10**9, 2048)])
def test_scores(hard_docs, hard_rows, no_docs, clashing, monkeypatch, size, fan):
    """Few and many blocks, asked directly and through sets of blocks; lanes that cut texts."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm_scoring, "RANGE_BYTES", 3 * size)
    monkeypatch.setattr(lm_scoring, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(lm_scoring, "LEAST_RANGES", 2)
    monkeypatch.setattr(lm_scoring, "FAN", fan)
    key = lambda r: (repr(r[0]), r[2], r[5])
    want = sorted(plain_scores([r[:2] for r in hard_rows]), key=key)
    found = sorted(rows(lm_scoring.op7(clashing(hard_docs))), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert rows(lm_scoring.op7(no_docs)) == []


def test_scores_of_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r[0]: r for r in plain_scores(rows(docs.select("doc_id", "text")))}
    found = rows(lm_scoring.op7(docs))
    assert len(found) == len(want)
    for r in found:
        assert r[:5] == want[r[0]][:5]
        assert r[5:] == pytest.approx(want[r[0]][5:], rel=1e-9)


def follow(model, block, words):
    """One step after the other along arcs and failure arcs, with the state carried, of a text of the block."""
    steps, order, score = block.at[block.starts[words] : block.starts[words] + block.sizes[words]], 1, 0.0
    for t in steps.tolist():
        while np.isnan(model.arc[order][t]):
            score += model.fail[order][t]
            order -= 1
        score += model.arc[order][t]
        pair = block.triples[t] & 0xFFFFFFFF
        order = 2 if not np.isnan(model.arc[1][t]) else 1 if model.word_count[block.pairs[pair] & 0xFFFFFFFF] else 0
    return score


def test_traversal_takes_arcs_and_failure_arcs(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LANE", 3)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))).encode() for _ in range(30)]
    block = lm_scoring.Block(texts)
    learnt = np.array([i % 3 > 0 for i in range(30)])
    totals = block.counts(learnt)
    known = [i for i in range(block.n_words) if totals[i] and i != lm_scoring.BEGIN]
    model = lm_scoring.BackoffAutomaton(block, totals, int(totals[known].sum()), len(known))
    assert model.traverse(block) == pytest.approx([follow(model, block, i) for i in range(30)], rel=1e-12)


def test_probabilities_sum_to_one():
    """Over all known words and one unknown, after every context."""
    words = [f"w{i}".encode() for i in range(5)]
    rng = random.Random(1)
    learnt = [b" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)]
    contexts = [(a, b) for a in words for b in words]
    asked = [b" ".join((*c, w)) for c in contexts for w in (*words, b"unknown")] + [b" ".join(c) for c in contexts]
    block = lm_scoring.Block(learnt + asked)
    totals = block.counts(np.array([True] * len(learnt) + [False] * len(asked)))
    known = [i for i in range(block.n_words) if totals[i] and i != lm_scoring.BEGIN]
    model = lm_scoring.BackoffAutomaton(block, totals, int(totals[known].sum()), len(known))
    third = {}
    for n, text in enumerate(asked, len(learnt)):
        steps = block.at[block.starts[n] : block.starts[n] + block.sizes[n]]
        step = int(steps[2])
        order = int(model.reached[steps[1]])
        third.setdefault(tuple(text.split()[:2]), []).append(10 ** model.moves[order * len(block.triples) + step])
    assert all(sum(p) == pytest.approx(1) for p in third.values()) and len(third) == 25


# -- 8: benchmark -------------------------------------------------------------


def plain_edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    before = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, t in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (p != t)))
        before = now
    return min(before)


def test_edit_search_is_exact():
    rng = random.Random(8)
    for _ in range(400):
        pattern, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        best = plain_edits(pattern, text)
        found = decontamination.find_within(pattern, text, len(pattern))
        assert found and found[0] == best
        assert (decontamination.find_within(pattern, text, best - 1) is None) if best else True


def edited(words, n, rng, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.6:
            words[at] = rng.choice(vocabulary)
        elif kind < 0.8 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


def test_recall_against_brute_force(spark, small):
    """Items with up to a fifth of their words edited, within documents: all that brute force finds, at 0.9 or more."""
    items = rows(spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text"))
    texts = [t.split() for _, t in rows(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(80))]
    vocabulary, rng = [w for t in texts for w in t], random.Random(5)
    docs = []
    for k, t in enumerate(texts):
        item = items[k % len(items)][1].split()
        at = rng.randrange(len(t) + 1)
        t = t[:400]
        docs.append((k, " ".join(t[:at] + edited(item, int(rng.choice([0, 0.1, 0.2]) * len(item)), rng, vocabulary) + t[at:])))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {(r[0], r[1]): r[2] for r in rows(decontamination.op8(frame, spark.createDataFrame(items, "item_id bigint, text string")))}
    want = {}
    coded = {i: decontamination.tokens(t) for i, t in items}
    for k, t in docs:
        words = decontamination.tokens(t)
        own = set(words)
        for i, p in coded.items():
            if sum(w in own for w in p) >= len(p) - decontamination.most_edits(len(p)) and (e := plain_edits(p, words)) <= decontamination.most_edits(len(p)):
                want[k, i] = e
    assert len(want) >= 80
    assert set(found) <= set(want)
    assert all(found[x] == want[x] for x in found)
    assert len(found) / len(want) >= 0.9


def test_decontamination_hard_rows(spark, hard_docs, no_docs, clashing):
    items = [(1, "A KEEPER walked, along the wall with a lamp"), (1, "A keeper walked along the wall with a lamp"), (2, None), (3, ""), (4, "two words"), (None, "before dawn small boats rocked against the stones")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(5))
    found = rows(decontamination.op8(clashing(hard_docs), bench))
    assert Counter((r[0], r[1]) for r in found) == Counter({(1, 1): 2, (2, 1): 4, (None, 1): 2, (1, None): 1, (2, None): 2, (None, None): 1})
    assert {r[2] for r in found} == {0}
    assert rows(decontamination.op8(no_docs, bench)) == []
    assert rows(decontamination.op8(hard_docs, bench.limit(0))) == []


def test_benchmark_in_parts(spark, hard_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_CHARS", 40)
    items = [(1, "a keeper walked along the wall with a lamp"), (2, "small boats rocked against the stones"), (3, "nothing like this is anywhere in the texts")]
    found = rows(decontamination.op8(hard_docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert {r[1] for r in found} == {1, 2} and len(found) == 8


# -- 9: lines -----------------------------------------------------------------


def plain_lines(docs):
    """doc -> text without later three-line windows; rows that are repeated whole are one document."""
    windows = {}
    kept = {}
    held = {}
    for doc in set(docs):
        i, t = doc
        lines = (t or "").split("\n") if t is not None else []
        full = [(k, s.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).strip(" ")) for k, s in enumerate(lines)]
        held[doc] = [x for x in full if x[1]]
        for j in range(len(held[doc]) - 2):
            windows.setdefault(tuple(x[1] for x in held[doc][j : j + 3]), []).append((i is not None, i or 0, xx(t), j, doc))
    gone = {d: set() for d in held}
    for places in windows.values():
        for *_, j, doc in sorted(places, key=lambda p: p[:4])[1:]:
            gone[doc] |= set(range(held[doc][j][0], held[doc][j + 2][0] + 1))
    for doc in held:
        t = doc[1]
        kept[doc] = (None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone[doc]), 0 if t is None else t.count("\n") + 1, len(gone[doc]))
    return kept


def xx(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_line_dedup(spark, hard_docs, hard_rows, no_docs, clashing):
    extra = [(20, "x\ny\nz\nw\nq"), (21, "y\n\n z\t\nw\nother"), (22, "a\na\na\na\na"), (23, "x\ny\nz\nw\nq\nx\ny\nz"), (24, "x\ny")]
    docs = [r[:2] for r in hard_rows] + extra
    frame = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"))
    kept = plain_lines(docs)
    want = [(i, *kept[i, t]) for i, t in docs]
    assert sorted(rows(line_dedup.line_dedup(frame)), key=repr) == sorted(want, key=repr)
    assert rows(line_dedup.op9(no_docs)) == []


# -- 10: rules ----------------------------------------------------------------


def plain_rules(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_rules(hard_docs, hard_rows, no_docs, clashing):
    found = rows(quality_rules.op10(clashing(hard_docs)))
    assert sorted((r[:7] for r in found), key=repr) == sorted(((i, *plain_rules(t)) for i, t, *_ in hard_rows), key=repr)
    assert all(not (r[6] and r[7]) for r in found)
    assert {r[7] for r in found if r[0] in (1, 2)} == {True}
    assert rows(quality_rules.op10(no_docs)) == []


def test_line_rules(spark):
    good = ["Plain prose ends with a mark.", "Short title", "", "   ", "Price was 5% lower & he left; then nothing more was said about it at all.", "12:30 they met"]
    bad = ["Home | About | News | Contact", "w*** x### y%%% z&&&", "WOW!! GREAT!! BUY!!", "© 2020 All rights reserved.", "Released under the MIT License.", "one two three four five six seven eight nine ten eleven twelve thirteen"]
    got = dict(rows(spark.createDataFrame([(x,) for x in good + bad], "line string").select("line", quality_rules.line_passes(F.col("line")))))
    assert [got[x] for x in good] == [True] * len(good)
    assert [got[x] for x in bad] == [False] * len(bad)

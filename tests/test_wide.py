"""States of more than one word, and complex operators, against narrow and dense ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorbit.__main__ import main
from quorbit.functions import bits as B
from quorbit.functions import complex as C
from quorbit.operators import algebra as A
from quorbit.operators import apply, edges, elements, expand, observe, select, solve
from quorbit.session import cut
from quorbit.sources import files
from quorbit.sources import generate as G

WIDTH = 70


def words(x, width=WIDTH):
    return [x >> at & (1 << B.WORD_BITS) - 1 for at in range(0, width, B.WORD_BITS)]


def number(w):
    return sum(x << B.WORD_BITS * k for k, x in enumerate(w))


def table(spark, states):
    return spark.createDataFrame([(words(s),) for s in states], "det array<bigint>")


def dense(made, states):
    at = {s: k for k, s in enumerate(states)}
    m = np.zeros((len(states),) * 2, complex)
    for bra, ket, h in made.select("bra", "ket", "h").collect():
        m[at[number(bra)], at[number(ket)]] += h
    return m


def test_expressions(spark):
    """Each against Python's whole numbers, on random states and sites of both words."""
    rng, k = random.Random(4), B.Wide()
    rows = []
    for _ in range(200):
        i, a = sorted(rng.sample(range(WIDTH), 2)) if rng.random() < 0.5 else rng.sample(range(WIDTH), 2)
        x, y, m = (rng.getrandbits(WIDTH) for _ in range(3))
        rows.append((words(x), words(y), words(x & m if rng.random() < 0.5 else m), i, a))
    frame = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, m array<bigint>, i int, a int")
    i, a, x, y, m = (F.col(c) for c in "iaxym")
    got = frame.select("x", "y", "m", "i", "a", k.sites("x", WIDTH), k.sites("x", WIDTH, 0), k.has("x", i), k.flip("x", i, a), k.parity("x", i, a), k.string_sign("x", i), k.differ("x", "y"), k.holds(x, m), k.minus(x, y), k.apart(x, m), k.join(x, y), *k.ends(m), B.words_to_text("x", WIDTH), B.advanced("x", WIDTH))
    for row in got.collect():
        x, y, m, i, a = number(row[0]), number(row[1]), number(row[2]), row[3], row[4]
        low, high = min(i, a), max(i, a)
        sign = lambda n: 1 - 2 * (n.bit_count() & 1)
        between, held = x & ((1 << high) - 1) & ~((1 << low + 1) - 1), [s for s in range(WIDTH) if m >> s & 1]
        want = ([s for s in range(WIDTH) if x >> s & 1], [s for s in range(WIDTH) if not x >> s & 1], bool(x >> i & 1), words(x ^ 1 << i ^ 1 << a), sign(between), sign(x & (1 << i) - 1), (x ^ y).bit_count())
        want += (x & m == m, words(x & ~y), x & m == 0, words(x | y), min(held), max(held), f"{x:070b}", words((x + 1) % (1 << WIDTH)))
        assert tuple(row[5:]) == want


def test_terms_and_edges_are_those_of_narrow_states(spark):
    """Sites 0 to 7 moved to both words, in order: the same matrix, moves, pairs and levels."""
    place = [0, 3, 40, 61, 62, 63, 65, 69]
    bonds = [(i, (i + 3) % 8) for i in range(8)] + [(i, i + 1) for i in range(7)]
    narrow = cut(G.fock_space(spark, 8, 4))
    small = sorted(r[0] for r in narrow.collect())
    move = lambda s: sum(1 << place[i] for i in range(8) if s >> i & 1)
    states = [move(s) for s in small]
    wide = cut(table(spark, states))
    own = A.term_table(spark, A.parse_operator(G.bond_model(bonds, 1.0, 2.0, True)))
    there = A.term_table(spark, A.parse_operator(G.bond_model([(place[i], place[j]) for i, j in bonds], 1.0, 2.0, True)), WIDTH)
    want = np.zeros((70, 70))
    for bra, ket, h in elements.operator_edges(narrow, own, True).collect():
        want[small.index(bra), small.index(ket)] += h
    made = cut(elements.operator_edges(wide, there, True))
    assert np.abs(dense(made, states) - want).max() == 0
    diagonal = {number(r[0]): r[1] for r in elements.operator_diagonal(wide, there).collect()}
    assert [diagonal[s] for s in states] == pytest.approx(np.diag(want).tolist())
    near = lambda t: sorted((r["distance"], r["n"]) for r in edges.hamming_edges(t, (0, 2, 4)).groupBy("distance").agg(F.count("*").alias("n")).collect())
    assert near(wide) == near(narrow)
    assert edges.hop_edges(wide, WIDTH).count() == edges.hop_edges(narrow, 8).count()
    for method, options in (("davidson", {"eps": 1e-6, "block": 18, "restarts": 4}), ("lanczos", {"eps": 1e-10, "most": 40})):
        found = solve.ground_state(made, wide, method, **options)
        assert found.energy == pytest.approx(np.linalg.eigvalsh(want)[0], abs=1e-8)
    held = observe.occupation(found.vector, WIDTH).agg(F.sum("n")).first()[0]
    assert held == pytest.approx(4) and found.vector.count() == 70
    grown = expand.operator_expansion(select.top_states(found.vector, 5)[0], there, True, 0.01)
    assert 5 < grown.count() <= 70 and expand.singles_extended(table(spark, states[:1]), WIDTH).count() == 1 + 4 * 66


def test_integrals_of_38_orbitals(spark):
    """76 spin-orbitals, of which those of four orbitals are used: levels, densities and expansions of a narrow basis."""
    place, rng = [0, 1, 30, 37], np.random.default_rng(2)
    one = {(p, q): float(rng.normal()) for p in range(4) for q in range(p + 1)}
    two = {(p, q, r, s): float(rng.normal()) for p in range(4) for q in range(p + 1) for r in range(4) for s in range(r + 1) if (p, q) >= (r, s)}
    ints = elements.integral_tables(spark, 4, 0.3, one, two)
    there = elements.integral_tables(spark, 38, 0.3, {tuple(place[i] for i in at): v for at, v in one.items()}, {tuple(place[i] for i in at): v for at, v in two.items()})
    half = [s for s in range(16) if s.bit_count() == 2]
    move = lambda s: sum(1 << place[i] for i in range(4) if s >> i & 1)
    frame = lambda held, name: spark.createDataFrame([(s,) for s in held], f"{name} bigint")
    narrow = cut(G.product_states(frame(half, "adet"), frame(half, "bdet"), 4).select("det"))
    wide = cut(G.product_states(frame(map(move, half), "adet"), frame(map(move, half), "bdet"), 38).select("det"))
    spread = lambda a, b, n: sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(n))
    small = [spread(a, b, 4) for a in half for b in half]
    states = [spread(move(a), move(b), 38) for a in half for b in half]
    want = np.zeros((36, 36))
    for bra, ket, h in elements.integral_edges(narrow, ints).collect():
        want[small.index(bra), small.index(ket)] += h
    made = cut(elements.integral_edges(wide, there))
    assert np.abs(dense(made, states) - want).max() < 1e-12
    found = solve.ground_state(made, wide, eps=1e-7, block=18, restarts=4)
    assert found.energy == pytest.approx(np.linalg.eigvalsh(want)[0], abs=1e-9)
    densities = cut(observe.one_rdm(found.vector, 76)), cut(observe.two_rdm(found.vector, 76))
    assert observe.rdm_energy(*densities, there) == pytest.approx(found.energy, abs=1e-8)
    top = select.top_states(found.vector, 4)[0]
    sets = [{number(r[0]) for r in expand.integral_expansion(top, there, 0.3, v).collect()} for v in ("integral", "exhaustive")]
    assert sets[0] == sets[1] and sets[0] <= set(states) and len(sets[0]) > 4


def test_wide_states_in_files_and_on_the_command_line(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    place = [0, 61, 62, 69]
    states = [1 << i | 1 << j for n, i in enumerate(place) for j in place[:n]]
    (tmp_path / "basis").write_text("".join(f"{s:070b}\n" for s in states))
    read = files.read_states(spark, path("basis"), WIDTH)
    assert {number(r[0]) for r in read.collect()} == set(states)
    files.write_states(read, path("again"), WIDTH)
    assert [r[0] for r in spark.read.text(path("again")).collect()] == [f"{s:070b}" for s in sorted(states)]
    (tmp_path / "bad").write_text("01\n")
    with pytest.raises(Exception, match="not a bit string of 70"):
        files.read_states(spark, path("bad"), WIDTH).collect()
    (tmp_path / "ham").write_text("\n".join(G.bond_model(list(zip(place, place[1:])), 1.0, 2.0, True)))
    found = main(["caop", "--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "70", "--tolerance", "1e-7", "--block", "8", "--iteration", "3", "--initial-determinant", f"{states[0]:070b}", "--carryover", "2", "--out", path("out")], spark)
    chain = np.zeros((6, 6))
    small = [1 << i | 1 << j for i in range(4) for j in range(i)]
    for bra, ket, h in elements.operator_edges(spark.createDataFrame([(s,) for s in small], "det bigint"), A.term_table(spark, A.parse_operator(G.bond_model([(0, 1), (1, 2), (2, 3)], 1.0, 2.0, True))), True).collect():
        chain[small.index(bra), small.index(ket)] += h
    assert found["energy"] == pytest.approx(np.linalg.eigvalsh(chain)[0], abs=1e-7)
    assert spark.read.text(path("out/carryover")).count() == 2


@pytest.mark.parametrize("width", [70, 76, 130])
def test_records_of_wide_states(spark, tmp_path, width):
    """Packed records, most significant bit first, and words of 62 and of 20 bits."""
    rng = random.Random(width)
    states = {rng.getrandbits(width) for _ in range(50)} | {0, (1 << width) - 1}
    (tmp_path / "packed").write_bytes(b"".join(s.to_bytes((width + 7) // 8, "big") for s in sorted(states)) + (0).to_bytes((width + 7) // 8, "big"))
    assert {number(r[0]) for r in files.read_binary_states(spark, str(tmp_path / "packed"), width).collect()} == states
    for bits in (62, 20):
        cut_up = lambda s: b"".join((s >> at & (1 << bits) - 1).to_bytes(8, "little") for at in range(0, width, bits))
        (tmp_path / f"words{bits}").write_bytes(b"".join(map(cut_up, states)))
        read = files.read_word_states(spark, str(tmp_path / f"words{bits}"), width, bits)
        assert {number(r[0]) for r in read.collect()} == states and read.count() == len(states)


@pytest.mark.parametrize("method", ["davidson", "lanczos"])
def test_a_chain_with_complex_terms(spark, method):
    """Exchange along x, y and z with a term that twists: its levels are those of the dense matrix."""
    lines = ["1"]
    for i in range(5):
        j = i + 1
        lines += [f"1.0 {a} {i} {a} {j}" for a in ("sx", "sy", "sz")] + [f"0.7 sx {i} sy {j}", f"-0.7 sy {i} sx {j}"]
    terms = A.term_table(spark, A.parse_operator(lines))
    assert C.is_complex(terms, "coef")
    basis = cut(G.fock_space(spark, 6, 3))
    made = cut(elements.operator_edges(basis, terms, False))
    states = sorted(r[0] for r in basis.collect())
    m = np.zeros((20, 20), complex)
    for bra, ket, h in made.collect():
        m[states.index(bra), states.index(ket)] += complex(h["re"], h["im"])
    assert np.abs(m - m.conj().T).max() < 1e-12 and np.abs(m.imag).max() > 0.1
    options = {"eps": 1e-7, "block": 16, "restarts": 4} if method == "davidson" else {"eps": 1e-12, "most": 40}
    found = solve.ground_state(made, basis, method, **options)
    assert found.energy == pytest.approx(np.linalg.eigvalsh(m)[0], abs=1e-8)
    wave = found.vector
    assert apply.norm(wave) == pytest.approx(1.0) and apply.expectation(made, wave) == pytest.approx(found.energy, abs=1e-8)
    rest = apply.combined([apply.mult(made, wave), wave], [1.0, complex(-found.energy)])
    assert apply.norm(rest) < 1e-4
    c = np.array([complex(r["c"]["re"], r["c"]["im"]) for r in sorted(wave.collect())])
    assert apply.inner(wave, apply.scaled(wave, 2j)) == pytest.approx(2j * np.vdot(c, c))
    grown = {r[0] for r in expand.operator_expansion(wave, terms, False, 0.2).collect()}
    assert grown >= set(states)

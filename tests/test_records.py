"""Record files of wavefunctions: bytes as stated, round trips in many files and tasks, and files that are wrong."""

from __future__ import annotations

import random
import struct

import pytest
from pyspark.sql import functions as F

from quorbit.__main__ import main
from quorbit.functions import bits as B
from quorbit.sources import records


def key(state, width):
    return state if width <= B.WORD_BITS else [state >> at & (1 << B.WORD_BITS) - 1 for at in range(0, width, B.WORD_BITS)]


def words(state, width, bits):
    return b"".join((state >> at & (1 << bits) - 1).to_bytes(8, "little") for at in range(0, width, bits))


def frame(spark, rows, width, names="det"):
    state = "bigint" if width <= B.WORD_BITS else "array<bigint>"
    kind = "struct<re: double, im: double>" if isinstance(rows[0][-1], complex) else "double"
    value = lambda c: (c.real, c.imag) if isinstance(c, complex) else c
    return spark.createDataFrame([(*(key(s, width) for s in r[:-1]), value(r[-1])) for r in rows], ", ".join(f"{n} {state}" for n in names.split()) + f", c {kind}")


def known(rows):
    flat = lambda x: tuple(x) if isinstance(x, list) else complex(x["re"], x["im"]) if hasattr(x, "asDict") else x
    return sorted((tuple(map(flat, r)) for r in rows.collect()), key=lambda r: r[:-1])


@pytest.mark.parametrize(("width", "bits"), [(12, 20), (12, 5), (62, 20), (62, 64), (70, 20), (76, 62), (130, 64), (63, 1)])
def test_files_of_states(spark, tmp_path, monkeypatch, width, bits):
    """Two files by hand are read, in several tasks and batches; what is written has the same bytes a state."""
    monkeypatch.setattr(records, "IN_TASK", 7)
    monkeypatch.setattr(records, "IN_BATCH", 3)
    rng, prefix = random.Random(width + bits), str(tmp_path / "w")
    states = sorted({rng.getrandbits(width) for _ in range(40)} | {0, (1 << width) - 1})
    rows, n_words = [(s, rng.gauss(0, 1)) for s in states], -(-width // bits)
    for number, part in enumerate((rows[:25], rows[25:])):
        body = b"".join(words(s, width, bits) for s, _ in part) + struct.pack(f"<{len(part)}d", *(c for _, c in part))
        (tmp_path / f"w{number:06d}.bin").write_bytes(struct.pack("<2Q", len(part), n_words) + body)
    (tmp_path / "w0.bin").write_bytes(b"another")
    read = records.read_wave_records(spark, prefix, width, bits)
    want = known(frame(spark, rows, width))
    assert known(read) == want and read.rdd.getNumPartitions() == 7
    records.save_wave_records(read.repartition(3), str(tmp_path / "again"), width, bits)
    held = b"".join(p.read_bytes()[16:][: 8 * n_words * struct.unpack("<Q", p.read_bytes()[:8])[0]] for p in sorted(tmp_path.glob("again*")))
    assert held == b"".join(words(s, width, bits) for s in states)
    assert known(records.read_wave_records(spark, str(tmp_path / "again"), width, bits)) == want


@pytest.mark.parametrize("width", [12, 70])
def test_complex_coefficients_and_modes(spark, tmp_path, width):
    """Appended files number on; written anew, none of the old ones stays."""
    rng, prefix = random.Random(width), f"file:{tmp_path}/deep/er/w"
    rows = [(s, complex(rng.random(), -rng.random())) for s in rng.sample(range(1 << 12), 60)]
    load = lambda: records.read_wave_records(spark, prefix, width, is_complex=True)
    records.save_wave_records(frame(spark, rows[:30], width), prefix, width)
    records.save_wave_records(frame(spark, rows[30:], width), prefix, width, mode="append")
    assert known(load()) == known(frame(spark, rows, width))
    basis = frame(spark, rows[:40], width).select("det").unionAll(frame(spark, [(4097, 0.0)], width).select("det"))
    loaded = known(records.load_wave_records(spark, prefix, basis, width, is_complex=True))
    size = sum(abs(c) ** 2 for _, c in rows[:40]) ** 0.5
    assert len(loaded) == 41 and sum(abs(c) ** 2 for _, c in loaded) == pytest.approx(1)
    assert max(abs(c) for _, c in loaded) == pytest.approx(max(abs(c) for _, c in rows[:40]) / size)
    records.save_wave_records(frame(spark, rows[:5], width), prefix, width)
    assert known(load()) == known(frame(spark, rows[:5], width))
    records.save_wave_records(load().filter("false"), prefix, width)
    assert load().count() == 0
    assert sorted(p.name for p in (tmp_path / "deep/er").iterdir()) == ["w000000.bin"]


@pytest.mark.parametrize("width", [10, 70])
def test_files_of_products(spark, tmp_path, monkeypatch, width):
    """A file by hand, alpha-major; then tiles, as one task writes them, with pairs that are not there and pairs that are there twice."""
    monkeypatch.setattr(records, "IN_TASK", 10)
    monkeypatch.setattr(records, "IN_BATCH", 4)
    rng, prefix = random.Random(width), str(tmp_path / "p")
    alphas, betas = sorted(rng.sample(range(1 << 10), 9)), sorted(rng.sample(range(1 << 10), 7))
    lift = lambda s: s << width - 10
    rows = [(lift(a), lift(b), rng.gauss(0, 1)) for a in alphas for b in betas]
    n_words = -(-width // 20)
    body = b"".join(words(lift(s), width, 20) for s in [*alphas, *betas]) + struct.pack("<63d", *(r[2] for r in rows))
    (tmp_path / "p000000").write_bytes(struct.pack("<3Q", 9, 7, n_words) + body)
    (tmp_path / "p000000.bin").write_bytes(b"another form")
    read = records.read_wave_records(spark, prefix, width, product=True)
    want = known(frame(spark, rows, width, "adet bdet"))
    assert known(read) == want
    (tmp_path / "out").mkdir()
    records.save_product_records(read, str(tmp_path / "out/q"), width)
    assert known(records.read_wave_records(spark, str(tmp_path / "out/q"), width, product=True)) == want
    assert (tmp_path / "out/q000000").read_bytes() == (tmp_path / "p000000").read_bytes()
    monkeypatch.setattr(records, "MOST_IN_FILE", 12)
    some = [(a, b, 1.0) for n, (a, b, _) in enumerate(rows) if n % 3] + [(*rows[0][:2], 2.0)] * 2
    records.save_product_records(frame(spark, some, width, "adet bdet"), str(tmp_path / "out/q"), width)
    made = sorted((tmp_path / "out").iterdir())
    sizes = [struct.unpack("<2Q", p.read_bytes()[:16]) for p in made]
    assert len(made) == 9 and all(a * b <= 12 for a, b in sizes)
    found = known(records.read_wave_records(spark, str(tmp_path / "out/q"), width, product=True).filter("c <> 0"))
    assert found == known(frame(spark, [*some[:-2], (*rows[0][:2], 4.0)], width, "adet bdet"))
    loaded = records.load_product_records(spark, str(tmp_path / "out/q"), read, width)
    assert loaded.count() == 63 and loaded.agg(F.sum(F.col("c") * F.col("c"))).first()[0] == pytest.approx(1)


def test_files_that_are_wrong(spark, tmp_path):
    prefix = str(tmp_path / "w")
    with pytest.raises(Exception, match="no record files"):
        records.read_wave_records(spark, prefix, 12).collect()
    (tmp_path / "w000000.bin").write_bytes(struct.pack("<2Q", 2, 1) + bytes(16))
    with pytest.raises(Exception, match="its size is not that of"):
        records.read_wave_records(spark, prefix, 12).collect()
    (tmp_path / "w000000.bin").write_bytes(struct.pack("<2Q", 1, 1) + bytes(16))
    with pytest.raises(Exception, match="not records of 2 words"):
        records.read_wave_records(spark, prefix, 12, 10).collect()
    with pytest.raises(Exception, match="a null is no"):
        records.save_wave_records(spark.createDataFrame([(1, None)], "det bigint, c double"), prefix, 12)
    assert [p.name for p in tmp_path.iterdir()] == ["w000000.bin"]


@pytest.mark.parametrize("command", ["tpb", "caop"])
def test_commands_start_from_records(spark, tmp_path, command):
    """A run of one step from what another has saved has its level."""
    path = lambda x: str(tmp_path / x)
    (tmp_path / "dump").write_text("&FCI NORB=2,NELEC=2,\n&END\n 4.0 1 1 1 1\n 4.0 2 2 2 2\n -1.0 2 1 0 0\n")
    (tmp_path / "ham").write_text("\n".join(["1", "1.0 sx 0 sx 1", "1.0 sy 0 sy 1", "0.7 sx 0 sy 1", "-0.7 sy 0 sx 1"]))
    (tmp_path / "basis").write_text("01\n10\n")
    model = ["--fcidump", path("dump"), "--dets", path("basis")] if command == "tpb" else ["--hamiltonian", path("ham"), "--basis", path("basis"), "--width", "2"]
    run = lambda *x: main([command, *model, "--tolerance", "1e-7", "--word-bits", "1", *x], spark)["energy"]
    level = run("--block", "4", "--save-records", path("wave"))
    more = [] if command == "tpb" else ["--load-complex"]
    assert run("--block", "1", "--load-records", path("wave"), *more) == pytest.approx(level, abs=1e-6)

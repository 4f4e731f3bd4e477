"""Sources, sinks, selection, summaries and the stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quorbit.operators import algebra as A
from quorbit.operators import elements as E
from quorbit.operators import edges as J
from quorbit.operators import select as S
from quorbit.operators import summary
from quorbit.sources import files
from quorbit.sources import generate as G
from quorbit.streaming.batches import follow

FCIDUMP = """&FCI NORB=2,NELEC=2,MS2=0,
 ORBSYM=1,1,
 ISYM=1,
&END
! a comment
 4.0 1 1 1 1
 4.0D+00 2 2 2 2

 0.5 2 1 1 1
 -1.0 2 1 0 0
 0.25 0 0 0 0
"""


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text(FCIDUMP)
    return str(path)


def states(rows):
    return sorted(r[0] for r in rows.collect())


def test_integrals(spark, dump, tmp_path):
    header, rows = files.read_fcidump(spark, dump)
    assert header["NORB"] == "2" and header["NELEC"] == "2" and header["ORBSYM"] == "1,1"
    assert rows.count() == 5
    kinds = {r["kind"]: r["count"] for r in files.classify(rows).groupBy("kind").count().collect()}
    assert kinds == {"scalar": 1, "one": 2, "two": 2 + 4}
    files.write_fcidump(spark, str(tmp_path / "again"), header, rows)
    again_header, again = files.read_fcidump(spark, str(tmp_path / "again"))
    assert again_header["NORB"] == "2" and sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))


def test_integrals_as_operator(spark, dump):
    """Blocked spin-orbitals of the operator path and interleaved ones of the integral path have one spectrum."""
    import numpy as np

    ints = files.load_integrals(spark, dump)
    half = G.fock_space(spark, 2, 1)
    basis = G.product_states(half.withColumnRenamed("det", "adet"), half.withColumnRenamed("det", "bdet"), 2)
    op, size = files.fcidump_operator(spark, dump)
    blocked = basis.select(F.col("adet").bitwiseOR(F.shiftleft("bdet", size)).alias("det"))

    def values(edges, own):
        at = {d: i for i, d in enumerate(states(own.select("det")))}
        m = np.zeros((len(at),) * 2)
        for b, k, h in edges.select("bra", "ket", "h").collect():
            m[at[b], at[k]] += h
        return np.linalg.eigvalsh(m)

    assert values(E.integral_edges(basis, ints), basis) == pytest.approx(values(E.operator_edges(blocked, A.term_table(spark, op), True), blocked))


def test_unrestricted_integrals(spark, dump, tmp_path):
    """A restricted model, written with spin-orbital indices, has the same tables."""
    want = files.load_integrals(spark, dump)
    lines = ["&FCI NORB=2,NELEC=2,", "&END"]
    for v, i, j, k, m in files.read_fcidump(spark, dump)[1].collect():
        up = lambda x, s: 2 * x - 1 + s
        if i == 0:
            lines.append(f"{v} 0 0 0 0")
        elif k == 0:
            lines += [f"{v} {up(i, s)} {up(j, s)} 0 0" for s in (0, 1)]
        else:
            lines += [f"{v} {up(i, s)} {up(j, s)} {up(k, t)} {up(m, t)}" for s in (0, 1) for t in (0, 1)]
            lines += [f"{v} {up(k, s)} {up(m, s)} {up(i, t)} {up(j, t)}" for s in (0, 1) for t in (0, 1)]
    (tmp_path / "u.txt").write_text("\n".join(lines))
    got = files.load_integrals(spark, str(tmp_path / "u.txt"), unrestricted=True)
    assert got.core == want.core
    for name in ("one", "direct", "single", "double"):
        assert sorted(map(tuple, getattr(got, name).collect())) == sorted(map(tuple, getattr(want, name).collect()))


def test_state_files(spark, tmp_path):
    one, two, wrong = tmp_path / "a.txt", tmp_path / "b.txt", tmp_path / "c.txt"
    one.write_text("0001\n0010\n")
    two.write_text("0100\n1000\n")
    wrong.write_text("0010\n0011\n")
    assert states(files.read_states(spark, [str(one), str(two), str(one)], 4)) == [1, 2, 4, 8]
    assert states(files.read_shards(spark, [str(one), str(two)], 4)) == [1, 2, 4, 8]
    for bad in ([str(two), str(one)], [str(one), str(wrong)]):
        with pytest.raises(ValueError, match="sorted"):
            files.read_shards(spark, bad, 4)
    (tmp_path / "d.bin").write_bytes(bytes([0b00000101, 0b11000000, 0b00000001, 0b00000000]))
    assert states(files.read_binary_states(spark, str(tmp_path / "d.bin"), 11)) == [256, 1472]
    (tmp_path / "e.bin").write_bytes((5).to_bytes(8, "little") + (1).to_bytes(8, "little") + (7).to_bytes(8, "little") + (0).to_bytes(8, "little"))
    assert states(files.read_word_states(spark, str(tmp_path / "e.bin"), 40, 20)) == [7, 5 + (1 << 20)]
    files.write_states(files.read_states(spark, str(one), 4), str(tmp_path / "out"), 4)
    assert states(files.read_states(spark, str(tmp_path / "out"), 4)) == [1, 2]
    (tmp_path / "list").write_text("x\n\ny\n")
    assert files.read_path_list(str(tmp_path / "list")) == ["x", "y"]


def test_wavefunctions(spark, tmp_path):
    basis = spark.createDataFrame([(1,), (2,), (4,)], "det bigint")
    files.save_wavefunction(spark.createDataFrame([(1, 3.0), (2, 4.0), (9, 7.0)], "det bigint, c double"), str(tmp_path / "w"))
    got = dict(map(tuple, files.load_wavefunction(spark, str(tmp_path / "w"), basis).collect()))
    assert got == {1: pytest.approx(0.6), 2: pytest.approx(0.8), 4: 0.0}
    saved = spark.createDataFrame([(1, 1, 1.0), (1, 1, 2.0), (1, 2, 4.0)], "adet bigint, bdet bigint, c double")
    files.save_wavefunction(saved, str(tmp_path / "p"))
    own = saved.select("adet", "bdet").distinct()
    assert sorted(r["c"] for r in files.load_product_wavefunction(spark, str(tmp_path / "p"), own).collect()) == pytest.approx([0.6, 0.8])
    files.write_matrix_form(saved, str(tmp_path / "m"), 2)
    assert spark.read.text(str(tmp_path / "m")).filter("value like '% # ia: 01 ib: 10'").count() == 1


def test_operator_files(spark, tmp_path):
    path = tmp_path / "h.txt"
    path.write_text("\n".join(["# a model", *G.bond_model([(0, 1)], 1.0, 2.0)]))
    op = files.read_operator(spark, str(path))
    assert not op.fermion and len(op.terms) == 3
    with pytest.raises(ValueError, match="without a site"):
        A.parse_operator(["1", "1.0 bdag 0 b"])


BATCHES = "\n".join(
    [",".join(files.BATCH_COLUMNS)]
    + [f"1,run,variance,7,{k},100,0.001,,{v},{-v},2,1,{t}" for k, v, t in ((0, 1.0, 0.2), (1, 3.0, 0.4), (2, 5.0, 0.6))]
)


def test_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(BATCHES)
    rows = files.read_batches(spark, str(tmp_path / "in"))
    got = summary.summarize(rows).first()
    assert (got["batch_count"], got["sample_count"], got["reference_energy"]) == (3, 100, None)
    assert (got["variance_mean"], got["pt2_mean"], got["variance_sample_stddev"]) == (3.0, -3.0, 2.0)
    assert got["variance_standard_error"] == pytest.approx(1.1547005383792517) and got["elapsed_seconds_total"] == pytest.approx(1.2)
    assert summary.validate(rows).count() == 0 and summary.validate(rows.union(rows)).count() == 1
    assert summary.summarize(rows.limit(1)).first()["variance_sample_stddev"] == 0.0
    files.append_batches(rows, str(tmp_path / "out"))
    files.append_batches(rows, str(tmp_path / "out"))
    assert files.read_batches(spark, str(tmp_path / "out")).count() == 6
    (tmp_path / "bad.csv").write_text(BATCHES.replace("batch_id", "batch"))
    with pytest.raises(Exception, match=r"(?i)header"):
        files.read_batches(spark, str(tmp_path / "bad.csv")).collect()


def test_stream_of_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / x) for x in ("in", "table", "summary", "state")]
    (tmp_path / "in" / "a.csv").write_text("\n".join(BATCHES.split("\n")[:3]))
    follow(spark, *paths).awaitTermination()
    assert spark.read.parquet(paths[2]).first()["batch_count"] == 2
    (tmp_path / "in" / "b.csv").write_text("\n".join([BATCHES.split("\n")[0], BATCHES.split("\n")[3]]))
    follow(spark, *paths).awaitTermination()
    assert spark.read.parquet(paths[2]).first()["batch_count"] == 3


def test_logs(spark, tmp_path):
    lines = [f'x stats: profile batch_id=1 rank={r} host="node a{r}" children={c} hits=0' for r, c in ((0, 10), (1, 30))] + ["noise", 'y stats: timing batch_id=1 rank=0 host="n" sampling=0.5']
    (tmp_path / "log").write_text("\n".join(lines))
    log = files.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 5 and {r["host"] for r in log.collect()} == {"node a0", "node a1", "n"}
    got = {r["metric"]: r for r in summary.diagnostics(log).collect()}
    assert (got["children"]["min"], got["children"]["mean"], got["children"]["max"], got["children"]["max_over_mean"]) == (10, 20, 30, 1.5)
    assert got["hits"]["max_over_mean"] is None and got["sampling"]["rank_count"] == 1


def test_selection(spark):
    rows = [(k, float((k * 7) % 23)) for k in range(200)]
    wave = spark.createDataFrame(rows, "det bigint, c double").repartition(5)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["det"]: r["position"] for r in S.ranked(wave).collect()}
    assert [d for d, _ in order] == sorted(got, key=got.get) and sorted(got.values()) == list(range(200))
    kept, left = S.top_states(wave, 10)
    assert states(kept.select("det")) == sorted(d for d, _ in order[:10])
    total = sum(c * c for _, c in rows)
    assert left == pytest.approx(1 - sum(c * c for _, c in order[:10]) / total)
    cut = states(S.weight_cut(wave.withColumn("p", F.col("c") * F.col("c")), "p", "det", 0.5).select("det"))
    want, before = [], 0.0
    for d, c in order:
        if before > 0.5 * total:
            break
        want.append(d)
        before += c * c
    assert cut == sorted(want)
    sizes = [r["count"] for r in S.equal_ranges(wave, 7).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [29, 29, 29, 29, 28, 28, 28]


def test_edges_against_all_pairs(spark):
    basis = G.fock_space(spark, 8, 4).filter("det % 3 <> 1")
    own = states(basis)
    for d in (0, 2, 4):
        got = sorted(tuple(r)[:2] for r in J.hamming_edges(basis, (d,)).collect())
        assert got == sorted((a, b) for a in own for b in own if (a ^ b).bit_count() == d)
    assert sorted((r["bra"], r["ket"]) for r in J.hop_edges(basis, 8).collect()) == sorted((a, b) for a in own for b in own if (a ^ b).bit_count() == 2)


def test_sampled_states(spark):
    got = states(G.sampled_states(spark, 20, 7, 500, 3))
    assert len(set(got)) == len(got) > 450 and all(x.bit_count() == 7 for x in got)
    assert got == states(G.sampled_states(spark, 20, 7, 500, 3).repartition(3))


def test_shuffled(spark):
    basis = G.fock_space(spark, 8, 4)
    got = {r["det"]: r["position"] for r in S.shuffled(basis, 3).collect()}
    assert got[15] == 0 and sorted(got.values()) == list(range(70)) and sorted(got, key=got.get) != sorted(got)
    assert got == {r["det"]: r["position"] for r in S.shuffled(basis.repartition(5), 3).collect()}

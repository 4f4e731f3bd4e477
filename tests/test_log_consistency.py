"""Logs against the batch table."""

import pytest
from pyspark.sql import functions as F

from quorbit.__main__ import main
from quorbit.operators import summary
from quorbit.sources import files
from quorbit.sources import generate as G

HEAD = ",".join(files.BATCH_COLUMNS)
ROW = "1,run,variance,7,{batch},{n},0.0,,1.0,,{size},1,0.5"
LOG = "# calculation ID: run\n# MPI size: {size}\n" + "".join(f'a stats: {k} batch_id=1 rank={r} host="n" {m}\n' for r in (0, 1) for k, m in (("profile", f"draws={40 + 20 * r}"), ("timing", "total=0.5")))


def test_summarize_holds_logs_against_batches(spark, tmp_path):
    path = lambda x: str(tmp_path / x)

    def run(log, size=2, n=100, batch=1):
        (tmp_path / "log").write_text(log)
        (tmp_path / "b.csv").write_text("\n".join([HEAD, ROW.format(batch=batch, n=n, size=size)]) + "\n")
        return main(["summarize", "--batches", path("b.csv"), "--out", path("s"), "--log", path("log"), "--profile-output", path("p")], spark)

    log = LOG.format(size=2)
    for wrong, says in ((dict(size=4), "MPI size"), (dict(n=101), "draw count"), (dict(batch=2), "no batch row")):
        with pytest.raises(ValueError, match=says):
            run(log, **wrong)
        assert not (tmp_path / "s").exists() and not (tmp_path / "p").exists()
    with pytest.raises(ValueError, match="MPI size"):
        run(LOG.format(size=3))
    assert run(log) == {"summaries": 1, "diagnostics": 2}
    bare = "".join(x.replace("batch_id", "calculation_id=run batch_id") + "\n" for x in log.splitlines()[2:])
    assert run(bare) == {"summaries": 1, "diagnostics": 2}


def test_headers_hold_until_the_next_run(spark, tmp_path):
    line = 'a stats: profile batch_id=1 rank=0 host="n" draws=3\n'
    (tmp_path / "log").write_text("# calculation ID: a\n# MPI size: 2\n" + line + "# FCIDUMP: x\n" + line + "# calculation ID: b\n" + line + "# MPI size: 1\n" + line)
    got = files.read_log(spark, str(tmp_path / "log"))
    assert sorted(((r["calculation_id"], r["mpi_size"]) for r in got.collect()), key=repr) == sorted([("a", 2), (None, None), ("b", None), ("b", 1)], key=repr)
    batches = spark.createDataFrame([("a", 1, 2, 3)], "calculation_id string, batch_id bigint, mpi_size int, sample_count bigint")
    assert summary.disagreements(batches, got.filter("calculation_id = 'a'")).count() == 0


def test_stat_writes_what_summarize_reads(spark, tmp_path):
    """Batch rows and log lines of a run, appended by a second one, are read, held against one another and summed up."""
    path = lambda x: str(tmp_path / x)
    (tmp_path / "ham").write_text("\n".join(G.bond_model([(i, i + 1) for i in range(5)], 1.0, 2.0)))
    spark.createDataFrame([(0b000111, 0.8), (0b001011, 0.6)], "det bigint, c double").write.parquet(path("wave"))
    run = lambda name, *more: main(["stat", "--wave", path("wave"), "--hamiltonian", path("ham"), "--samples", "40", "--batches", "2", "--reference-energy", "-3", "--calculation-id", name, "--batch-output", path("table"), "--log-output", path("log"), *more], spark)["batches"]
    both, alone = run("a"), run("b", "--observable", "variance")
    assert [b["variance"] for b in both] == [b["variance"] for b in alone] and all("pt2" in b for b in both) and not any("pt2" in b for b in alone)
    rows = files.read_batches(spark, path("table"))
    assert summary.validate(rows).count() == 0
    got = {r["calculation_id"]: r for r in summary.summarize(rows).collect()}
    assert (got["a"]["batch_count"], got["a"]["sample_count"], got["b"]["pt2_mean"]) == (2, 40, None)
    assert got["a"]["variance_mean"] == pytest.approx(sum(b["variance"] for b in both) / 2)
    log = files.read_log(spark, path("log"))
    assert summary.disagreements(rows, log).count() == 0
    value = {(r["calculation_id"], r["batch_id"], r["metric"]): r["value"] for r in log.collect()}
    for name, found in (("a", both), ("b", alone)):
        for b in found:
            assert all(value[name, b["batch_id"], k] == v for kind in ("profile", "timing") for k, v in b[kind].items())
            assert b["profile"]["draws"] == 40 and b["profile"]["parents"] == 2 and b["profile"]["generated_records"] >= b["profile"]["external_children"] > 0
    done = main(["summarize", "--batches", path("table"), "--out", path("s"), "--log", path("log"), "--profile-output", path("p")], spark)
    assert done["summaries"] == 2
    with pytest.raises(ValueError, match="denominators"):
        run("c", "--minimum-abs-denominator", "1e9")
    run("d", "--minimum-abs-denominator", "1e9", "--observable", "variance")


@pytest.mark.parametrize(("column", "value", "says"), [("format_version", "2", "format version"), ("calculation_id", "''", "empty id"), ("observable", "'pt2'", "mixed observable"), ("sample_count", "7L", "mixed sample_count"), ("heatbath_cutoff", "0.5D", "mixed heatbath_cutoff"), ("reference_energy", "-9D", "mixed reference_energy"), ("batch_id", "0L", "repeated batch")])
def test_rules_of_the_batch_table(spark, tmp_path, column, value, says):
    (tmp_path / "b.csv").write_text("\n".join([HEAD, *(ROW.format(batch=k, n=100, size=1) for k in range(3))]) + "\n")
    rows = files.read_batches(spark, str(tmp_path / "b.csv"))
    assert summary.validate(rows).count() == 0
    broken = rows.withColumn(column, F.when(F.col("batch_id") == 2, F.expr(value)).otherwise(F.col(column)))
    assert says in {r["problem"] for r in summary.validate(broken).collect()}

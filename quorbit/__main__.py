"""Command line: python -m quorbit tpb | gdb | caop | stat | gen-dets | summarize."""

from __future__ import annotations

import argparse
import json
import platform

from pyspark.sql import DataFrame, SparkSession

from quorbit.functions import complex as X
from quorbit.functions.bits import WORD_BITS
from quorbit.operators import stat, summary
from quorbit.operators.algebra import term_table
from quorbit.operators.elements import diagonal, operator_diagonal
from quorbit.plans import diag
from quorbit.sources import files
from quorbit.sources import generate as G
from quorbit.sources import records


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quorbit", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    solve = argparse.ArgumentParser(add_help=False)
    for name, kind, default in (("method", str, "davidson"), ("tolerance", float, 1e-4), ("iteration", int, 1), ("block", int, 10), ("seed", int, 1), ("max-time", float, None), ("carryover", int, 0), ("threshold", float, 0.01), ("heatbath-cutoff", float, 1e-4)):
        solve.add_argument(f"--{name}", type=kind, default=default)
    solve.add_argument("--rdm", action="store_true")
    solve.add_argument("--init", choices=diag.INITS, default="random", help="random start vectors, or one on the first state")
    solve.add_argument("--initial-determinant", help="0/1 text of the state to start from")
    solve.add_argument("--load", help="a saved wavefunction to start from")
    solve.add_argument("--load-records", help="record files to start from, by their names' beginning; of the product form with tpb")
    solve.add_argument("--load-complex", action="store_true", help="the coefficients of those records are complex")
    solve.add_argument("--save-records", help="the beginning of the names of record files that the wavefunction is written to")
    solve.add_argument("--word-bits", type=int, default=records.RECORD_BITS, help="bits of a word in record files")
    solve.add_argument("--numivec", type=int, default=1, help="start vectors, which is also how many a restart keeps")
    solve.add_argument("--carryover-type", choices=diag.CARRYOVERS, default="top")
    solve.add_argument("--carryover-ratio", type=float, help="share of the states that is carried over")
    solve.add_argument("--out", help="folder for the wavefunction, densities and the next basis")
    for name in ("tpb", "gdb"):
        own = sub.add_parser(name, parents=[solve])
        own.add_argument("--fcidump", required=True)
        own.add_argument("--dets", required=True, nargs="+", help="alpha halves (tpb), or full determinants (gdb), as 0/1 lines")
    own = sub.add_parser("caop", parents=[solve])
    own.add_argument("--hamiltonian", required=True)
    own.add_argument("--basis", required=True, nargs="+")
    own.add_argument("--width", type=int, required=True)
    own = sub.add_parser("stat")
    own.add_argument("--wave", required=True)
    own.add_argument("--fcidump")
    own.add_argument("--hamiltonian")
    own.add_argument("--samples", type=int, required=True)
    own.add_argument("--batches", type=int, default=1)
    own.add_argument("--seed", type=int, default=1)
    own.add_argument("--reference-energy", type=float, required=True)
    own.add_argument("--heatbath-cutoff", type=float, default=0.0)
    own.add_argument("--observable", choices=stat.OBSERVABLES, default="both")
    own.add_argument("--minimum-abs-denominator", type=float, default=1e-12)
    own.add_argument("--calculation-id", default="run")
    own.add_argument("--batch-output", help="batch table that the estimates are appended to")
    own.add_argument("--log-output", help="folder of lines of what each batch made, and how long it took")
    own = sub.add_parser("gen-dets")
    own.add_argument("--alpha", required=True)
    own.add_argument("--norb", type=int, required=True)
    own.add_argument("--out", required=True)
    own = sub.add_parser("summarize")
    own.add_argument("--batches")
    own.add_argument("--out")
    own.add_argument("--log", nargs="+", help="run logs; their spread over ranks goes to --profile-output, their values to --rank-output")
    own.add_argument("--profile-output")
    own.add_argument("--rank-output")
    return top


def _state(text: str | None) -> int | list[int] | None:
    """A state from its text, in words where it is wider than one."""
    value = int(text, 2) if text else None
    if value is None or len(text) <= WORD_BITS:
        return value
    return [value >> at & (1 << WORD_BITS) - 1 for at in range(0, len(text), WORD_BITS)]


def _saved(spark: SparkSession, a: argparse.Namespace, width: int, pairs: DataFrame | None = None) -> DataFrame | None:
    """(det, c) of the record files to start from; with ``pairs`` of halves and their states, of those of the product form."""
    if not a.load_records:
        return None
    if pairs is None:
        return records.read_wave_records(spark, a.load_records, width, a.word_bits, is_complex=a.load_complex)
    return records.read_wave_records(spark, a.load_records, width // 2, a.word_bits, True, a.load_complex).join(pairs, ["adet", "bdet"]).groupBy("det").agg(X.total("c", a.load_complex).alias("c"))


def _save(wave: DataFrame, a: argparse.Namespace, width: int, pairs: DataFrame | None = None) -> None:
    if a.save_records and pairs is None:
        records.save_wave_records(wave, a.save_records, width, a.word_bits)
    elif a.save_records:
        records.save_product_records(wave.join(pairs, "det"), a.save_records, width // 2, a.word_bits)


def _options(a: argparse.Namespace, saved: DataFrame | None) -> diag.Options:
    return diag.Options(a.method, a.tolerance, a.iteration, a.block, a.seed, a.max_time, a.rdm, a.carryover, a.threshold, a.heatbath_cutoff, a.init, _state(a.initial_determinant), a.load, a.numivec, a.carryover_type, a.carryover_ratio, saved)


def _report(result: diag.Result, out: str | None, width: int) -> dict:
    if out:
        files.save_wavefunction(result.solution.vector, f"{out}/wave")
        files.write_density(result.occupation, f"{out}/density")
        for name, rows in (("carryover", result.carryover), ("expanded", result.expanded)):
            if rows is not None:
                files.write_states(rows.select("det"), f"{out}/{name}", width)
        for name in ("one", "two"):
            if name in result.extra:
                files.write_density(result.extra[name], f"{out}/{name}")
    return {"energy": result.energy, "residual": result.solution.residual, "steps": len(result.solution.history), "discarded": result.discarded}


def _summaries(spark: SparkSession, a: argparse.Namespace) -> dict:
    targets = [x for x in (a.out, a.profile_output, a.rank_output) if x]
    if len(set(targets)) != len(targets):
        raise ValueError("output paths must be distinct")
    if not (a.batches and a.out or a.log and a.profile_output):
        raise ValueError("give --batches and --out, or --log and --profile-output")
    done = {}
    if a.batches:
        rows: DataFrame = files.read_batches(spark, a.batches)
        problems = [tuple(r) for r in summary.validate(rows).orderBy("calculation_id").limit(20).collect()]
        if problems:
            raise ValueError(f"the batches break the table's rules: {problems}")
        if a.log:
            problems = [tuple(r) for r in summary.disagreements(rows, files.read_log(spark, a.log)).orderBy("calculation_id", "batch_id", "problem").limit(20).collect()]
            if problems:
                raise ValueError(f"the logs and the batches disagree: {problems}")
        summary.summarize(rows).write.mode("overwrite").csv(a.out, header=True)
        done["summaries"] = spark.read.csv(a.out, header=True).count()
    if a.log:
        log = files.read_log(spark, a.log)
        summary.diagnostics(log).write.mode("overwrite").csv(a.profile_output, header=True)
        done["diagnostics"] = spark.read.csv(a.profile_output, header=True).count()
        if a.rank_output:
            log.select("calculation_id", "batch_id", "rank", "host", "kind", "metric", "value").write.mode("overwrite").csv(a.rank_output, header=True)
    return done


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quorbit").getOrCreate()
    if a.command in ("tpb", "gdb"):
        ints = files.load_integrals(spark, a.fcidump)
        width, pairs = 2 * ints.norb, None
        if a.command == "tpb":
            half = files.read_states(spark, a.dets, ints.norb, "adet")
            other = half.withColumnRenamed("adet", "bdet")
            pairs = G.product_states(half, other, ints.norb).select("adet", "bdet", "det")
            found = diag.tensor(half, other, ints, _options(a, _saved(spark, a, width, pairs)))
        else:
            found = diag.determinants(files.read_states(spark, a.dets, width), ints, _options(a, _saved(spark, a, width)))
        _save(found.solution.vector, a, width, pairs)
        out = _report(found, a.out, width)
    elif a.command == "caop":
        basis = files.read_shards(spark, a.basis, a.width) if len(a.basis) > 1 else files.read_states(spark, a.basis, a.width)
        found = diag.operators(spark, basis, files.read_operator(spark, a.hamiltonian), a.width, _options(a, _saved(spark, a, a.width)))
        _save(found.solution.vector, a, a.width)
        out = _report(found, a.out, a.width)
    elif a.command == "stat":
        wave = spark.read.parquet(a.wave).select("det", "c")
        stat.check_stat_wave(wave)
        if a.fcidump:
            ints = files.load_integrals(spark, a.fcidump)
            children, below, strict = (lambda s: stat.integral_children(s, ints)), (lambda s: diagonal(s, ints)), True
        else:
            operator = files.read_operator(spark, a.hamiltonian)
            terms = term_table(spark, operator)
            children, below, strict = (lambda s: stat.operator_children(s, terms, operator.fermion)), (lambda s: operator_diagonal(s, terms)), False
        rows = stat.evaluate_batches(spark, wave, wave.select("det"), children, below, a.samples, a.batches, a.reference_energy, a.seed, a.heatbath_cutoff, strict, a.observable, a.minimum_abs_denominator)
        if a.batch_output:
            files.append_batches(stat.batch_rows(spark, rows, a.calculation_id, a.observable, a.seed, a.samples, a.heatbath_cutoff, a.reference_energy), a.batch_output)
        if a.log_output:
            lines = [f"# calculation ID: {a.calculation_id}", "# MPI size: 1", *stat.log_lines(rows, a.calculation_id, platform.node())]
            spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("append").text(a.log_output)
        out = {"batches": rows}
    elif a.command == "gen-dets":
        half = files.read_states(spark, a.alpha, a.norb, "adet")
        made = G.product_states(half, half.withColumnRenamed("adet", "bdet"), a.norb)
        files.write_states(made, a.out, 2 * a.norb)
        out = {"states": made.count()}
    else:
        out = _summaries(spark, a)
    return out


if __name__ == "__main__":
    print(json.dumps(main()))

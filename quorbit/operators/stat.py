"""Residual variance and second-order energy outside a basis: exact, and from weighted samples.

An amplitude x of a parent on a child is c H / p / N summed over draws; z holds
the squares of single draws, which the U-statistic takes away:
(|sum x|^2 - sum z) / (N (N - 1)).
"""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quorbit.functions import complex as X
from quorbit.operators.edges import outside
from quorbit.operators.elements import Integrals, apply_terms, doubles, singles
from quorbit.session import cut, observed


#: States that one task draws from.
STATES_PER_PART = 1_000_000


def sample_counts(wave: DataFrame, draws: int, seed: int, batch: int = 0, per_part: int = STATES_PER_PART) -> DataFrame:
    """(det, c, p, n): how often ``draws`` draws with replacement, by |c|, take each state.

    Two levels: hash parts of about ``per_part`` states, as many as their number asks
    for, share the draws by a multinomial on the driver, which has one weight for
    each part; a part's states share its draws by another, a binomial draw for each
    state in order. So neither time nor memory grows with the draws. The same
    seed and batch give the same counts, however rows lie.
    """
    if draws < 2:
        raise ValueError("at least two samples are needed")
    rows = wave.select("det", "c", X.size(F.col("c"), X.is_complex(wave, "c")).cast("double").alias("w")).filter("w > 0")
    parts = max(1, -(-rows.count() // per_part))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("det"), F.lit(parts)).cast("int"))
    # added up in the order of states in each part and of parts, so the last bits are the same as well
    sums = dict(sorted((r[0], r[1]) for r in rows.groupBy("part").agg(F.sum("w")).collect()))
    weights = np.array([float(f"{w:.12e}") for w in sums.values()])
    dealt = np.random.default_rng([seed, batch]).multinomial(draws, weights / weights.sum()) if len(weights) else []
    plan = wave.sparkSession.createDataFrame([(k, int(n)) for k, n in zip(sums, dealt, strict=True)], "part int, n_part bigint")
    total = float(weights.sum())
    kind = [wave.schema[c].dataType.simpleString() for c in ("det", "c")]

    def draw(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        det = table.column("det").to_pylist()
        table = table.take(pa.array(sorted(range(len(det)), key=det.__getitem__)))
        w, n, part = table.column("w").to_numpy(), table.column("n_part")[0].as_py(), table.column("part")[0].as_py()
        taken = np.random.default_rng([seed, batch, part, 1]).multinomial(n, w / w.sum())
        out = pa.table({"det": table.column("det"), "c": table.column("c"), "p": w / total, "n": taken})
        return out.filter(pa.array(taken > 0))

    return rows.join(F.broadcast(plan), "part").groupBy("part").applyInArrow(draw, f"det {kind[0]}, c {kind[1]}, p double, n bigint")


def operator_children(sampled: DataFrame, terms: DataFrame, fermion: bool) -> DataFrame:
    """(det, child, h): parents' off-diagonal images, all terms of one parent and child summed."""
    made = apply_terms(sampled.select("det"), terms.filter("not is_diag"), fermion)
    return made.groupBy("det", F.col("bra").alias("child")).agg(F.sum("h").alias("h"))


def integral_children(sampled: DataFrame, ints: Integrals) -> DataFrame:
    one, two = singles(sampled, ints), doubles(sampled.select("det").distinct(), ints)
    return one.select("det", F.col("bra").alias("child"), "h").unionByName(two.select("det", F.col("bra").alias("child"), "h"))


def contributions(sampled: DataFrame, children: DataFrame, cutoff: float, drop_equal: bool) -> DataFrame:
    """(det, child, x, z) of (det, c, p, n) parents.

    Edges with |c h| under the cutoff go; those at it go only with
    ``drop_equal`` (integral-driven sums; operator-driven ones keep them).
    """
    ch = F.abs(F.col("c") * F.col("h"))
    kept = children.join(sampled, "det").filter(ch > cutoff if drop_equal else ch >= cutoff)
    x = F.col("c") * F.col("h") / F.col("p")
    return kept.select("det", "child", (F.col("n") * x).alias("x"), (F.col("n") * x * x).alias("z"))


def child_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("child").agg(F.sum("x").alias("x"), F.sum("z").alias("z"))


def two_key_merge(parts: DataFrame) -> DataFrame:
    """Partial sums by (child, parent) first, then by child."""
    return child_sums(parts.groupBy("child", "det").agg(F.sum("x").alias("x"), F.sum("z").alias("z")))


def _second_order(rows: DataFrame, value: Column, diagonal: DataFrame | None, energy: float, least: float) -> dict[str, float]:
    """Sums of the value, and of the value over E0 - H_aa, whose denominators must not be tiny; without a diagonal, the former alone."""
    if diagonal is None:
        got = rows.agg(F.count("*"), F.sum(value)).first()
        return {"external": got[0], "variance": float(got[1] or 0.0)}
    down = F.lit(energy) - F.col("h")
    joined = rows.withColumn("_v", value).join(diagonal.withColumnRenamed("det", "child"), "child", "left")
    bad = F.sum(F.when(F.col("h").isNull() | (F.abs(down) <= least) | F.isnan(down), 1).otherwise(0))
    got = joined.agg(F.count("*"), F.sum("_v"), F.sum(F.when(F.abs(down) > least, F.col("_v") / down)), bad).first()
    if got[3]:
        raise ValueError(f"{got[3]} denominators are too small or missing")
    return {"external": got[0], "variance": float(got[1] or 0.0), "pt2": float(got[2] or 0.0)}


def u_statistic(parts: DataFrame, basis: DataFrame, diagonal: DataFrame | None, draws: int, energy: float, least: float = 1e-12) -> dict[str, float]:
    """Estimates from one batch of sampled contributions."""
    if draws < 2:
        raise ValueError("at least two samples are needed")
    external = outside(child_sums(parts).withColumnRenamed("child", "det"), basis).withColumnRenamed("det", "child")
    return _second_order(external, (F.col("x") * F.col("x") - F.col("z")) / (draws * (draws - 1)), diagonal, energy, least)


def exact(wave: DataFrame, children: DataFrame, basis: DataFrame, diagonal: DataFrame, energy: float, cutoff: float = 0.0, least: float = 1e-12) -> dict[str, float]:
    """The same sums over all parents, without samples."""
    amplitude = children.join(wave.select("det", "c"), "det").filter(F.abs(F.col("c") * F.col("h")) >= cutoff).groupBy("child").agg(F.sum(F.col("c") * F.col("h")).alias("x"))
    external = outside(amplitude.withColumnRenamed("child", "det"), basis).withColumnRenamed("det", "child")
    return _second_order(external, F.col("x") * F.col("x"), diagonal, energy, least)


def check_stat_wave(wave: DataFrame) -> None:
    """A wavefunction for statistics is normalized within 1e-8 and holds each state once."""
    n, distinct, size = wave.agg(F.count("*"), F.count_distinct("det"), F.sum(F.col("c") * F.col("c"))).first()
    if n != distinct or abs((size or 0.0) - 1) > 1e-8:
        raise ValueError("the wavefunction holds a state twice, or is not normalized")


#: What may be estimated.
OBSERVABLES = ("both", "variance", "pt2")


def evaluate_batches(spark: SparkSession, wave: DataFrame, basis: DataFrame, children_of, diagonal_of, draws: int, batches: int, energy: float, seed: int, cutoff: float = 0.0, drop_equal: bool = False, observable: str = "both", least: float = 1e-12) -> list[dict]:  # noqa: ANN001
    """One estimate a batch; each batch's draws depend on the seed and its number alone.

    A batch's sample and its contributions are checkpointed, so neither is made twice.
    ``profile`` counts what the steps made, on the way; ``timing`` has their seconds.
    Without ``pt2`` no denominator is looked at, also no one under ``least``.
    """
    if observable not in OBSERVABLES:
        raise ValueError(f"{observable} is none of {', '.join(OBSERVABLES)}")
    known, out = {"parents": wave.count(), "membership": basis.count()}, []
    for batch in range(batches):
        began, seen = time.perf_counter(), {n: Observation(f"{n}-{batch}") for n in ("sampled", "generated")}
        sampled = cut(sample_counts(wave, draws, seed, batch).observe(seen["sampled"], F.count(F.lit(1)).alias("sampled_parents"), F.sum("n").alias("draws")))
        drawn = time.perf_counter()
        parts = cut(contributions(sampled, children_of(sampled), cutoff, drop_equal).observe(seen["generated"], F.count(F.lit(1)).alias("generated_records"), F.count_if(F.col("child").isNotNull()).alias("received_records")))
        expanded = time.perf_counter()
        diagonal = None if observable == "variance" else diagonal_of(parts.select(F.col("child").alias("det")).distinct())
        found = u_statistic(parts, basis, diagonal, draws, energy, least)
        done = time.perf_counter()
        profile = known | observed(seen["sampled"], "sampled_parents", "draws") | observed(seen["generated"], "generated_records", "received_records") | {"external_children": found["external"]}
        timing = {"sampling": drawn - began, "expansion": expanded - drawn, "reduction": done - expanded, "total": done - began}
        wanted = {k: v for k, v in found.items() if observable in ("both", k) or k == "external"}
        out.append({"batch_id": batch} | wanted | {"profile": profile, "timing": timing})
    return out


def batch_rows(spark: SparkSession, found: list[dict], calculation: str, observable: str, seed: int, draws: int, cutoff: float, energy: float) -> DataFrame:
    """Estimates as rows of a batch table; what was not asked for is blank."""
    from quorbit.sources.files import BATCH_SCHEMA

    rows = [(1, calculation, observable, seed, f["batch_id"], draws, cutoff, energy, f.get("variance"), f.get("pt2"), 1, spark.sparkContext.defaultParallelism, f["timing"]["total"]) for f in found]
    return spark.createDataFrame(rows, BATCH_SCHEMA)


def log_lines(found: list[dict], calculation: str, host: str) -> list[str]:
    """Profile and timing lines as ``read_log`` reads them. Spark's tasks are one rank, so each summary's least, mean and greatest value are one."""
    out = []
    for f in found:
        named = f'calculation_id="{calculation}" batch_id={f["batch_id"]}'
        for kind in ("profile", "timing"):
            out.append(f' stats: {kind} {named} rank=0 host="{host}" ' + " ".join(f"{k}={v!r}" for k, v in f[kind].items()))
            out += [f" stats: {kind}_summary {named} metric={k} min={v!r} mean={v!r} max={v!r}" for k, v in f[kind].items()]
    return out

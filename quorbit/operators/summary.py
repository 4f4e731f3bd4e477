"""Summaries of batches and of run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The format of batch tables, and what is the same in all batches of a calculation.
FORMAT, SETTINGS = 1, ("observable", "sample_count", "heatbath_cutoff", "reference_energy")


def _spread(x: str) -> list[Column]:
    sd = F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))
    return [F.avg(x).alias(f"{x}_mean"), sd.alias(f"{x}_sample_stddev"), (sd / F.sqrt(F.count(x))).alias(f"{x}_standard_error")]


def summarize(batches: DataFrame) -> DataFrame:
    """A row for each calculation: its settings, means, sample deviations (0 for one batch) and standard errors.

    ``validate`` says whether settings are the same in all of a calculation's
    batches, the number of samples of one batch among them; then any one is all.
    """
    named = batches.withColumnsRenamed({"variance_estimate": "variance", "pt2_estimate": "pt2"})
    return named.groupBy("calculation_id").agg(
        F.min("format_version").alias("format_version"),
        *[F.min(c).alias(c) for c in SETTINGS[:1]],
        F.count("*").alias("batch_count"),
        *[F.min(c).alias(c) for c in SETTINGS[1:]],
        *_spread("variance"),
        *_spread("pt2"),
        F.sum("elapsed_seconds").alias("elapsed_seconds_total"),
    )


def validate(batches: DataFrame) -> DataFrame:
    """(calculation_id, problem): what breaks the table's rules.

    Each calculation has an id, the one format version there is, a batch once, and
    the same settings in all batches; a setting is blank in all of them or in none.
    """
    twice = batches.groupBy("calculation_id", "batch_id").count().filter("count > 1").select("calculation_id", F.lit("repeated batch").alias("problem"))
    held = [(F.count_distinct(c) > 1) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in SETTINGS]
    problems = [F.when(wrong, F.lit(f"mixed {c}")) for c, wrong in zip(SETTINGS, held, strict=True)]
    problems.append(F.when(F.sum(F.when(F.col("format_version").eqNullSafe(F.lit(FORMAT)), 0).otherwise(1)) > 0, F.lit("format version")))
    found = batches.groupBy("calculation_id").agg(F.array(*problems).alias("found")).select("calculation_id", F.explode("found").alias("problem")).filter("problem is not null")
    nameless = batches.filter(F.coalesce("calculation_id", F.lit("")) == "").select("calculation_id", F.lit("empty id").alias("problem"))
    return twice.unionByName(found).unionByName(nameless).distinct()


def disagreements(batches: DataFrame, log: DataFrame) -> DataFrame:
    """(calculation_id, batch_id, problem): logged batches without a row in the table, or with one of another MPI size or draw count.

    A log's draws are the sum over ranks; its MPI size is the header's, or without one the number of ranks.
    """
    keys = ["calculation_id", "batch_id"]
    drawn = F.when((F.col("kind") == "profile") & (F.col("metric") == "draws"), F.col("value"))
    logged = log.groupBy(*keys).agg(F.min("mpi_size").alias("least"), F.coalesce(F.max("mpi_size"), F.count_distinct("rank")).alias("size"), F.sum(drawn).alias("draws"))
    rows = batches.select(*[F.col(k).alias(f"{k}_") for k in keys], "mpi_size", "sample_count", F.lit(1).alias("there"))
    pairs = logged.join(rows, F.col("calculation_id").eqNullSafe(F.col("calculation_id_")) & F.col("batch_id").eqNullSafe(F.col("batch_id_")), "left")
    size = ~F.col("mpi_size").eqNullSafe(F.col("size")) | (F.coalesce("least", "size") != F.col("size"))
    problem = F.when(F.col("there").isNull(), F.array(F.lit("no batch row"))).otherwise(
        F.array(F.when(size, F.lit("MPI size")), F.when(~F.col("sample_count").eqNullSafe(F.col("draws")), F.lit("draw count")))
    )
    return pairs.select(*keys, F.explode(problem).alias("problem")).filter("problem is not null").distinct()


def diagnostics(log: DataFrame, keys: tuple[str, ...] = ("calculation_id", "batch_id", "kind", "metric")) -> DataFrame:
    """Spread of each metric over ranks; ``max_over_mean`` is null where the mean is 0."""
    mean = F.avg("value")
    return log.groupBy(*keys).agg(
        F.count("*").alias("rank_count"), F.min("value").alias("min"), mean.alias("mean"), F.max("value").alias("max"), F.when(mean != 0, F.max("value") / mean).alias("max_over_mean")
    )

"""Readers and writers of the formats: integrals, state lists, operators, wavefunctions, batch tables and logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorbit.functions import bits as B
from quorbit.operators.algebra import Operator, Product, parse_operator
from quorbit.operators.apply import normalized
from quorbit.operators.edges import match_checkpoint
from quorbit.operators.elements import Integrals, spin_integrals
from quorbit.operators.terms import integral_terms
from quorbit.session import cut

BATCH_SCHEMA = (
    "format_version int, calculation_id string, observable string, base_seed bigint, batch_id bigint, sample_count bigint, "
    "heatbath_cutoff double, reference_energy double, variance_estimate double, pt2_estimate double, mpi_size int, omp_threads int, elapsed_seconds double"
)
BATCH_COLUMNS = [c.split()[0] for c in BATCH_SCHEMA.split(", ")]


# -- integrals ---------------------------------------------------------------


def read_fcidump(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """Header map, and rows (v, i, j, k, l) with 1-based indices; comments (!) and blank lines go."""
    lines = spark.read.text(path).withColumn("value", F.trim(F.regexp_replace("value", "!.*", "")))
    lines = lines.withColumn("n", F.monotonically_increasing_id()).filter("value <> ''")
    head_rows = lines.filter(F.col("value").rlike("[A-Za-z=&/]") & ~F.col("value").rlike(r"^[-+0-9.]+[eEdD]?[-+0-9]*\s+\d+\s+\d+\s+\d+\s+\d+$")).orderBy("n").select("value")
    text = " ".join(r[0] for r in head_rows.collect())  # a header of a few lines
    text = re.sub(r"&FCI|&END|/", " ", text, flags=re.I)
    header = {k.upper(): v.strip().strip(",") for k, v in re.findall(r"(\w+)\s*=\s*([^=]*?)(?=\s*,?\s*\w+\s*=|\s*$)", text)}
    parts = F.split("value", r"\s+")
    number = F.regexp_replace(parts[0], "[dD]", "e").cast("double")
    rows = lines.filter(F.col("value").rlike(r"^[-+0-9.]+[eEdD]?[-+0-9]*\s+\d+\s+\d+\s+\d+\s+\d+$"))
    return header, rows.select(number.alias("v"), *[parts[n + 1].cast("int").alias(c) for n, c in enumerate("ijkl")])


def write_fcidump(spark: SparkSession, path: str, header: dict[str, str], rows: DataFrame) -> None:
    body = rows.select(F.format_string("%.16e %d %d %d %d", "v", "i", "j", "k", "l").alias("value"))
    head = "&FCI " + "".join(f"{k}={v}," for k, v in header.items()) + " &END"
    spark.createDataFrame([(head,)], "value string").unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def classify(rows: DataFrame) -> DataFrame:
    """kind: scalar, one or two; rows of two electrons with their eight equal index places, once each."""
    kind = F.when(F.col("i") == 0, "scalar").when(F.col("k") == 0, "one").otherwise("two")
    places = F.array_distinct(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(p, "pqrs", strict=True)]) for p in ("ijkl", "jikl", "ijlk", "jilk", "klij", "lkij", "klji", "lkji")]))
    one = F.array_distinct(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(p, "pqrs", strict=True)]) for p in ("ijkl", "jikl")]))
    return rows.withColumn("kind", kind).withColumn("at", F.explode(F.when(kind == "two", places).otherwise(one))).select("kind", "at.*", "v").dropDuplicates(["kind", "p", "q", "r", "s"])


def load_integrals(spark: SparkSession, path: str, unrestricted: bool = False) -> Integrals:
    """Tables of a file's integrals; with ``unrestricted`` its indices are spin-orbitals, alpha and beta in turn. No row comes to the driver."""
    header, rows = read_fcidump(spark, path)
    rows = cut(rows)
    core = rows.filter("i = 0").agg(F.sum("v")).first()[0] or 0.0
    place = lambda c: (F.floor((F.col(c) - 1) / 2) if unrestricted else F.col(c) - 1).cast("int")
    spin = lambda c: ((F.col(c) - 1) % 2 if unrestricted else F.lit(None)).cast("int")
    one = rows.filter("i <> 0 and k = 0").select(spin("i").alias("spin"), place("i").alias("p"), place("j").alias("q"), "v")
    two = rows.filter("i <> 0 and k <> 0").select(spin("i").alias("left"), spin("k").alias("right"), *[place(c).alias(n) for c, n in zip("ijkl", "pqrs", strict=True)], "v")
    return spin_integrals(float(core), int(header["NORB"]), one, two)


def fcidump_terms(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The integrals as a table of terms on blocked spin-orbitals (alpha 0..L-1, beta L..2L-1), and L."""
    ints = load_integrals(spark, path)
    return integral_terms(ints), ints.norb


def fcidump_operator(spark: SparkSession, path: str) -> tuple[Operator, int]:
    """The same terms as an operator in Python, for models that are small enough to be one."""
    terms, size = fcidump_terms(spark, path)
    rows = terms.select("coef", "ops").collect()
    return Operator({Product(tuple((op["dag"], op["site"]) for op in r["ops"])): r["coef"] for r in rows}, True), size


# -- states ------------------------------------------------------------------


def read_states(spark: SparkSession, paths: str | list[str], width: int, name: str = "det") -> DataFrame:
    """Distinct states of 0/1 lines; other lines raise an error."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    return lines.select(state_of(F.trim("value"), width).alias(name)).distinct()


def state_of(text: Column, width: int) -> Column:
    """A state of its 0/1 text, an array of words beyond ``WORD_BITS`` sites; other texts raise an error."""
    if width <= B.WORD_BITS:
        return B.from_text(text, width)
    wrong = F.raise_error(F.concat(F.lit(f"not a bit string of {width}: "), text)).cast("array<bigint>")
    return F.when(text.rlike(f"^[01]{{{width}}}$"), B.words_from_text(text, width)).otherwise(wrong)


def text_of(det: str, width: int) -> Column:
    return B.to_text(det, width) if width <= B.WORD_BITS else B.words_to_text(det, width)


def read_shards(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    """States of ordered shards, files or folders, which must be sorted in each, in order from one to the next, and without duplicates.

    A state's place is its shard, its file by name, the file's block and the line
    in it. Neighbours are compared within each block of a file, then the ends of
    blocks with one another; so a large file is checked by many tasks.
    """
    out = None
    for number, path in enumerate(paths):
        lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
        held = lines.select(state_of(F.trim("value"), width).alias("det"), F.struct(F.lit(number).alias("shard"), "file_path", "file_block_start").alias("block"), "line")
        out = held if out is None else out.unionByName(held)
    before = F.lag("det").over(Window.partitionBy("block").orderBy("line"))
    blocks = out.withColumn("before", before).groupBy("block").agg(F.min("det").alias("least"), F.max("det").alias("last"), F.max(F.coalesce(F.col("before") >= F.col("det"), F.lit(False))).alias("wrong"))
    ends = blocks.orderBy("block").select("least", "last", "wrong").collect()  # a row for each block of a file
    if any(e["wrong"] for e in ends) or any(a["last"] >= b["least"] for a, b in zip(ends, ends[1:], strict=False)):
        raise ValueError("the shards are not sorted, or hold a state twice")
    return out.select("det")


def read_records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(record) of a fixed number of bytes; files split at records, so one large file is read by many tasks."""
    return spark.sparkContext.binaryRecords(path, size).map(lambda r: (r,)).toDF("record binary")


def read_binary_states(spark: SparkSession, path: str, width: int, name: str = "det") -> DataFrame:
    """Distinct states of packed records of (width + 7) // 8 bytes, most significant bit first; arrays of words beyond ``WORD_BITS`` sites."""
    size = (width + 7) // 8
    records = read_records(spark, path, size)
    if width > B.WORD_BITS:
        bits = F.concat(*[F.lpad(F.conv(F.hex(F.substring("record", k, 1)), 16, 2), 8, "0") for k in range(1, size + 1)])
        return records.select(B.words_from_text(F.right(bits, F.lit(width)), width).alias(name)).distinct()
    return records.select(F.conv(F.hex("record"), 16, 10).cast("long").alias(name)).distinct()


def read_word_states(spark: SparkSession, path: str, width: int, word_bits: int = B.WORD_BITS, name: str = "det") -> DataFrame:
    """Distinct states of raw records: little-endian 8-byte words of ``word_bits`` bits, 62 at most, least significant word first; arrays of words beyond ``WORD_BITS`` sites."""
    records = read_records(spark, path, 8 * -(-width // word_bits))
    word = lambda n: F.conv(F.hex(F.concat(*[F.substring("record", 8 * n + k, 1) for k in range(8, 0, -1)])), 16, 10).cast("long")
    if width > B.WORD_BITS:
        words = F.array(*[word(n) for n in range(-(-width // word_bits))])
        return records.select((words if word_bits == B.WORD_BITS else B.change_word_bits(words, width, word_bits, B.WORD_BITS)).alias(name)).distinct()
    total = word(0)
    for n in range(1, -(-width // word_bits)):
        total = total.bitwiseOR(F.shiftleft(word(n), n * word_bits))
    return records.select(total.alias(name)).distinct()


def write_states(basis: DataFrame, path: str, width: int) -> None:
    basis.select(text_of("det", width).alias("value")).orderBy("value").write.mode("overwrite").text(path)


def read_path_list(path: str) -> list[str]:
    with open(path) as file:
        return [line.strip() for line in file if line.strip()]


# -- operators and wavefunctions ----------------------------------------------


def read_operator(spark: SparkSession, path: str) -> Operator:
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()  # a model's terms, not data
    return parse_operator(lines)


def save_wavefunction(wave: DataFrame, path: str) -> None:
    wave.write.mode("overwrite").parquet(path)


def load_wavefunction(spark: SparkSession, path: str, basis: DataFrame) -> DataFrame:
    """On the basis, normalized: missing states are zero, others' coefficients go."""
    return normalized(match_checkpoint(basis, spark.read.parquet(path)))


def load_product_wavefunction(spark: SparkSession, path: str, basis: DataFrame) -> DataFrame:
    """As above for (adet, bdet, c); saved duplicates add up."""
    return product_on_basis(spark.read.parquet(path), basis)


def product_on_basis(saved: DataFrame, basis: DataFrame) -> DataFrame:
    saved = saved.groupBy("adet", "bdet").agg(F.sum("c").alias("c"))
    on_basis = basis.select("adet", "bdet").join(saved, ["adet", "bdet"], "left").na.fill({"c": 0.0})
    size = on_basis.agg(F.sqrt(F.sum(F.col("c") * F.col("c")))).first()[0]
    return on_basis.withColumn("c", F.col("c") / F.lit(size))


def write_matrix_form(wave: DataFrame, path: str, width: int) -> None:
    """``value # ia: alpha ib: beta`` lines, alpha-major."""
    line = F.format_string("%.16e # ia: %s ib: %s", F.col("c"), B.to_text("adet", width), B.to_text("bdet", width))
    wave.orderBy("adet", "bdet").select(line.alias("value")).write.mode("overwrite").text(path)


def write_density(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=" ")


# -- batch tables and logs ----------------------------------------------------


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The 13-column table; a header that differs is an error, blanks are null."""
    return spark.read.csv(path, schema=BATCH_SCHEMA, header=True, enforceSchema=False, mode="FAILFAST")


def append_batches(rows: DataFrame, path: str) -> None:
    rows.select(*BATCH_COLUMNS).write.mode("append").csv(path, header=True)


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(calculation_id, batch_id, rank, host, kind, metric, value, mpi_size) from statistic lines of run logs.

    The calculation, where a line does not name it, and the MPI size are those of the run's header lines above, null without.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    told = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), at.alias("at"))
    told = told.filter(F.col("value").rlike(r"stats: (profile|timing) |^# (FCIDUMP|calculation ID|MPI size):"))
    header = lambda x: F.when(F.col("value").rlike(x), F.regexp_extract("value", x, 1))
    above = Window.partitionBy("file").orderBy("at")
    runs = told.withColumn("run", F.count(F.when(F.col("value").rlike("^# (FCIDUMP|calculation ID):"), 1)).over(above))
    above = Window.partitionBy("file", "run").orderBy("at")
    named = runs.withColumn("named", F.last(header(r"^# calculation ID: (.+?)\r?$"), True).over(above)).withColumn("mpi_size", F.last(header(r"^# MPI size: (\d+)\r?$"), True).over(above).cast("int"))
    lines = named.filter(F.col("value").rlike(r"stats: (profile|timing) "))
    pairs = F.regexp_extract_all("value", F.lit(r'(\w+)=("[^"]*"|\S+)'), F.lit(0))
    kv = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(F.regexp_replace(p, r"^\w+=", ""), '"', ""))))
    rows = lines.select(F.regexp_extract("value", r"stats: (profile|timing) ", 1).alias("kind"), kv.alias("kv"), "named", "mpi_size")
    named = rows.select(F.coalesce(F.col("kv")["calculation_id"], "named").alias("calculation_id"), F.col("kv")["batch_id"].cast("bigint").alias("batch_id"), F.col("kv")["rank"].cast("int").alias("rank"), F.col("kv")["host"].alias("host"), "kind", "mpi_size", F.explode("kv").alias("metric", "text"))
    return named.filter(~F.col("metric").isin("calculation_id", "batch_id", "rank", "host")).select("calculation_id", "batch_id", "rank", "host", "kind", "metric", F.col("text").cast("double").alias("value"), "mpi_size")

"""Session settings shared by tests, bench and scripts."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A single-JVM session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only where that is unset, as in tests on one machine, a temporary folder is
    used.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"quorbit-{os.getpid()}-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def observed(observation: Observation, *names: str) -> dict[str, int]:
    """What an observation has counted; 0 where the planner found its branch empty and so didn't run it."""
    try:
        held = observation.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        held = {}
    return {n: int(held.get(n) or 0) for n in names}


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """As ``cut``, dealt by ``key`` such that joins on it find the rows in place.

    A checkpoint keeps how its rows are dealt only where the plan is fixed before
    it runs, so adaptive planning is off while it is made.
    """
    conf = df.sparkSession.conf
    dealt, adaptive = df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key), conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(dealt)
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder that this engine wrote, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

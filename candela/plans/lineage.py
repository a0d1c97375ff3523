"""Cuts of lineage, in the folder that spark.checkpoint.dir names for driver and executors alike."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that the session was given.

    Without either, a session on this machine alone gets a folder of its own, which is fit for tests; on a
    cluster, whose executors couldn't read it, that is a RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="candela-"))
        found = _OWN[0]
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage. Executors may be lost afterwards: the files are in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once, written as Parquet in the shared folder and read again, so that later steps read the columns they need."""
    path = fresh_path(df.sparkSession, name)
    # zstd's buffers are freed with each file; snappy's stay outside the heap until some collection.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings the operators assume, and lineage cutting for iterative work."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes of bytecode; let Spark split such stages.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Plans here are built from many small expressions; recording a Python call site for
    # each one costs more than the expression itself.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "stintwise", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; the cluster's own submit options still apply."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A private temporary folder stands in only where the whole of Spark is one machine, as in
    tests; on a cluster a missing setting is an error, as executors would not see the files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_stintwise_folder", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
    folder = tempfile.mkdtemp(prefix="stintwise-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark._stintwise_folder = folder
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed. Every call has a folder
    of its own; the shared folder's owner clears it with the other checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stintwise/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

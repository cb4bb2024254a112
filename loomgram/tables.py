"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary one if the driver is the only executor; on a cluster each executor would write to a
    disk of its own, so that this is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomgram-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, kind: str = "files") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


#: Seconds of a write from which on its shuffles are given back early, and after how many.
LONG, LATER = 5, 2


def keep(df: DataFrame, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    options are further ones of the Parquet writer.

    Used in place of ``checkpoint()``, which computes its input twice.
    """
    spark = df.sparkSession
    path = scratch(spark, "kept")
    began = time.monotonic()
    df.write.option("compression", "zstd").options(**options).parquet(path)
    if time.monotonic() - began >= LONG:
        timer = threading.Timer(LATER, released, [spark])
        timer.daemon = True
        timer.start()
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which a driver with memory to spare does rarely; until then the shuffles of
    all tables written so far are on the executors' disks together. Just after a write its plan is still referred to.
    """
    with contextlib.suppress(Exception):  # the session may have ended
        spark.sparkContext._jvm.java.lang.System.gc()

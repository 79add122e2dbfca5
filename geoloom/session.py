"""Session helpers: a tuned local session, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "geoloom", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested with.

    On a cluster the caller passes its own session; nothing in the engine
    depends on these values.
    """
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", _own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _own_folder() -> str:
    """A folder for checkpoints of local sessions, removed when Python ends."""
    folder = tempfile.mkdtemp(prefix="geoloom-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; a local session that names none gets one of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(shared or _own_folder())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    release(df.sparkSession)
    return kept


def release(spark: SparkSession) -> None:
    """Collect the driver's garbage: plans and broadcasts of finished jobs, which would else fill its heap, and with them
    shuffle files that nothing refers to, which are kept until then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows over all cores, by their key if they have one, before each of them makes many: a few files would keep a few cores busy."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)

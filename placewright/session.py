"""Session settings that every job relies on, and a reliable checkpoint."""

from __future__ import annotations

import gc
import re
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("placewright")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Test tables are tiny: keep all cores busy instead of filling partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share, for checkpoints and tables between stages.

    ``spark.checkpoint.dir`` is read from the session. Where it is not set, a
    temporary folder serves a local master, as in tests; on a cluster that folder
    would be one machine's own, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="placewright-ckpt-")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session's machines share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the driver's cleaner drop the shuffle files of plans that a checkpoint has cut off and nobody refers to.

    Spark does so by itself when the driver next collects its garbage, which on a
    driver with little to do can be long after the disks are full. What one
    collection frees lets go of more, so it takes a few.
    """
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.25)

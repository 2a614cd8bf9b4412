"""Tables that cut lineage, in the folder that the cluster's session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir; one of our own only in local mode where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="checkpoints")
    sc.setCheckpointDir(shared)


#: Rows of a checkpoint's file, if the number of rows is known.
FILE_ROWS = 1 << 18


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which survives the loss of executors.

    rows: that df has no more rows than this; a short table then goes to few files, whatever the number of partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)

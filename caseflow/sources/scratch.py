"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from caseflow.session import settings

# What a write shuffled is of no use once the table is there: free the executors' disks.
_FREE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the checkpoint folder the cluster shares.

    The session names that folder in ``spark.checkpoint.dir``. Where it is unset a
    master within one process gets one of its own; any other must name one, since a
    folder on one machine is lost with the machine and unseen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caseflow-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/caseflow-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back, for plans that use it several times.

    Unlike a cache the table survives lost executors, and later reads prune columns.
    The folder stays, since results still to be computed read it; see ``discard``.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    with settings(spark, _FREE):
        df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Remove the folders of staged tables whose every reader has written its result.

    For steps between two stages; a table that something returned still reads must stay.
    """
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

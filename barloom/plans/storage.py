"""Cutting lineage at tables that several branches of one result read."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files behind one task of a step that keeps its whole part of the rows.
TASK_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``, which every
    executor can read. Only a local session without the setting gets a folder of its own; on a
    cluster each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table once and continue from what was written.

    A lost executor then costs its own tasks and nothing upstream. Written as Parquet, the
    table keeps column pruning and its size is known to the planner.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def files_of(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of every file that a table reads."""
    jvm, sc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext
    conf, out = sc._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        s = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, s.getLen(), s.getModificationTime()))
    return out


def dealt(df: DataFrame, *keys: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows dealt by key to as many tasks as the files behind them ask for, so that a task's share
    does not grow with the table. The session's number of shuffle partitions is the least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = sum(n for _, n, _ in files_of(df))
    return df.repartition(max(least, -(-size // task_bytes)), *keys)

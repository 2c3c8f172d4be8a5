"""The folder that the driver and all executors share."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input of one task, in bytes as stored, where a shuffle follows whose rows are several times as large.
TASK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or own_dir()).rstrip("/")


@functools.cache
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Tasks for a shuffle of `rows`: one for each `task_bytes` of the files they come from, at least as many as there are cores.

    Only lengths of files are read. A fixed number of tasks would make each larger as the input grows.
    """
    spark, found = rows.sparkSession, [unquote(f) for f in rows.inputFiles()]
    size = spark.read.format("binaryFile").load(found).agg(F.sum("length")).first()[0] if found else 0
    return max(spark.sparkContext.defaultParallelism, -(-(size or 0) // task_bytes))

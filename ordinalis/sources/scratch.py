"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir. A temporary folder where that is unset, on one machine; on a cluster executors would not see it, so there it is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ordinalis-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many intermediate tables of this process are there, for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Deletes the intermediate tables of this process, those made since and but for the last ones, and returns how many; results that were not
    written elsewhere are lost with them."""
    gone = _made[since : len(_made) - but]
    del _made[since : len(_made) - but]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and no executor's loss takes it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

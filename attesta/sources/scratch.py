"""Tables that a job writes on its way, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session on this machine alone may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='attesta-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """The session's own part of the shared folder."""
    return f"{shared_dir(spark)}/attesta/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this session has written to the shared folder; results not yet read from there are lost."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

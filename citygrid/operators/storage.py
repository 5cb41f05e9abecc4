"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a single machine (tests) gets a temporary one; a cluster has no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_WRITTEN: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder for a table that clear() takes away."""
    _WRITTEN.append(f"{shared_dir(spark)}/cut-{uuid.uuid4().hex[:12]}")
    return _WRITTEN[-1]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read again. clear() takes the table away."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this process has cut so far, and says how many: once the results that read them have been written or collected."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(bool(java(p).getFileSystem(conf).delete(java(p), True)) for p in paths)

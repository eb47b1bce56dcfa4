"""Tables that cut lineage and outlive lost executors, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session (as in tests) has a folder of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster[...] has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        session = spark.sparkContext.applicationId
        if session not in _own_dirs:
            _own_dirs[session] = tempfile.mkdtemp(prefix="tidemark-")
        found = _own_dirs[session]
    return f"{found.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table, written and read again. Spark then knows its size, and broadcasts it where its own threshold allows."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the session's tables, once none of their readers is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

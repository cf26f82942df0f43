"""Tables in the folder that the driver and all executors share, to cut long plans between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a temporary folder, but only on a local master (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get()
    return where.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The table, written and read again: a lost executor costs a read, not the plan behind it."""
    path = f"{shared_dir(df.sparkSession)}/parlance-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What operators need from the session: the shared folder, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (only where that is unset and all runs in one process, as in tests) a new local folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-ckpt-"))
    return str(jsc.getCheckpointDir().get())


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder with its lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)

"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, as in tests, a local
    master gets a temp folder, and a cluster an error: there a folder of one machine is lost to the others."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_root", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark._shared_root = tempfile.mkdtemp(prefix="shared-")
    return root


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is read in fewer splits: a Parquet file of one row group is one
    task, however many cores wait. Tables of more splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(2 * cores)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and no lost executor repeats it."""
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

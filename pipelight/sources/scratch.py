"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary one is made if everything runs on this machine (tests); on a
    cluster that would be a folder that other machines don't see, and so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pipelight-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts lineage like checkpoint() does, but the copy is columnar and compressed, and a lost
    executor loses none of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pipelight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark) -> None:
    """Remove all intermediate tables; for when no DataFrame that reads one is needed any more."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/pipelight")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

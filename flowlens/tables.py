"""Cutting lineage by tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only in local mode where the session names none, as in
    tests. A cluster without one is an error, for its executors would write where nobody reads."""
    if not (folder := spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} names no folder that driver and executors share")
        spark.conf.set(SETTING, folder := tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return folder


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later steps don't run it anew, and lost executors lose nothing of it."""
    path = f"{shared(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if folder.rsplit("/", 1)[-1].startswith("cut-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

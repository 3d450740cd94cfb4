"""Profiles of past runs: one JSON document each, in a folder that Spark reads and writes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checked(profile: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", profile):
        raise ValueError("not a profile id")
    return profile


def save(summary: DataFrame, folder: str, profile: str, when: str) -> None:
    """summary has one row."""
    _checked(profile)
    summary.withColumns({"profile_id": F.lit(profile), "timestamp": F.lit(when)}).coalesce(1).write.mode("overwrite").json(f"{folder}/profile={profile}")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The latest first."""
    return spark.read.option("recursiveFileLookup", "true").json(folder).orderBy(F.desc("timestamp"))


def get(spark: SparkSession, folder: str, profile: str) -> DataFrame:
    return spark.read.json(f"{folder}/profile={_checked(profile)}")


def delete(spark: SparkSession, folder: str, profile: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/profile={_checked(profile)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

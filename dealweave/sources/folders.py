"""The folder that all executors share, and tables that end a lineage there."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; one of our own only in local mode where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or _own_folder()).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """`df` written to a new shared folder and read again: its lineage ends here, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

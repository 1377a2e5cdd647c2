"""Tables that a job writes for itself: steps of iterations, and what several queries read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def store_folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, which all executors share; where a session on one machine names none, a folder
    of its own that goes with the process; else None."""
    at, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not at and spark.sparkContext.master.split("[")[0] == "local":
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        at = "file://" + _own[app]
    return at.rstrip("/") if at else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    if not (folder := store_folder(spark)):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)

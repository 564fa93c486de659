"""Cutting lineage in loops by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which the driver and all executors see.

    Only a local session without one, as in tests, gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="treeward-")
    return _own_folder[app]


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/table-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table that is written once and read back: a lost executor re-reads it, and joins know its size."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that the whole cluster shares.

A staged table cuts lineage (iterative jobs), is computed once however often it
is read, survives lost executors and gives the optimizer real sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_PATHS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` if the session has it, else a folder of the warehouse, which is shared too.

    On a cluster a warehouse that is a local folder of this machine isn't shared: there the
    setting must be made, and its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local[") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/_staged"


def root(spark: SparkSession) -> str:
    """The folder below which this session stages; `release` deletes it."""
    app = spark.sparkContext.applicationId
    return _ROOTS.setdefault(app, f"{shared_dir(spark)}/evidentia-{app}-{uuid.uuid4().hex[:8]}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """`build()` as a staged table; tables that were staged on the way to it are deleted."""
    paths = _PATHS.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    out = stage(build(), name)
    for path in paths[before:-1]:
        _delete(spark, path)
    del paths[before:-1]
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete every table this session has staged. Results that read them must be written first."""
    app = spark.sparkContext.applicationId
    _PATHS.pop(app, None)
    if used := _ROOTS.pop(app, None):
        _delete(spark, used)

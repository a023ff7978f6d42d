"""Tables in the folder that the driver and all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_LOCAL = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share; a folder of its own only in local mode without the setting."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _OWN_DIR:
        _OWN_DIR[sc.applicationId] = tempfile.mkdtemp(prefix="strataline-")
    return _OWN_DIR[sc.applicationId]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, outlive: bool = False) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage ends there, and a lost executor costs no rework.

    Within `temporary`, the table goes when that ends; with outlive, when the scope around it does (or stays, without one).
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    if len(_scopes()) > outlive:
        _scopes()[-1 - outlive].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables made within are deleted at the end, so what leaves it must have been written with outlive."""
    _scopes().append([])
    try:
        yield
    finally:
        made = _scopes().pop()
        for path in made:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

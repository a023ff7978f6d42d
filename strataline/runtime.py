"""Make this package importable in Python workers, and run its mappers there in bounded batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Once an application: by path in local mode, as a zip of the package on a cluster whose workers don't have the path.

    Also bounds the bytes of an Arrow batch, by the same number whatever runs, so that no frame made later changes it.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    own = sc.environment.get("PYTHONPATH", "")
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), own) if p)
    if sc.master.startswith("local[") or sc.master == "local" or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(), "strataline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((ROOT / "strataline").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, rows: int = 1000) -> DataFrame:
    """mapInArrow whose function gets batches of at most `rows` rows. The bound goes with the function, not with the session."""
    ship(df.sparkSession)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return df.mapInArrow(bounded, schema)


def dealt(df: DataFrame, by: str = "id") -> DataFrame:
    """Few bytes, much work for each row: over all cores by a key, where a small file would be one partition and one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, by)

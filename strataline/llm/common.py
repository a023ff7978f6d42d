"""What the training-data operators share: table access, shared-folder tables, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.runtime import mapped  # noqa: F401
from strataline.shared import drop_path, materialize, new_path, shared_dir, temporary  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files that nothing refers to any more, after a step with large ones."""
    spark.sparkContext._jvm.System.gc()


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int = 1) -> DataFrame:
    """About `bound` rows at most, picked by a hash of the key, the same ones at every run."""
    n = rows.count()
    if n <= bound:
        return rows
    cells = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(cells)) < int(cells * bound / n))

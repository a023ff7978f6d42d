"""Volumes as a text header and a raw file of samples.

The header is read by Spark; the raw file as records of one slab (the samples of one z), which Spark splits among tasks
at any size and from any store it reaches. 16-bit samples run x fastest; 8-bit samples run y fastest. Writing, and reading
from a path that all machines mount, are the data source in `volumes`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataline.functions import exprs as E
from strataline.runtime import ship
from strataline.types import KINDS, VOXEL, Geometry, header_text  # noqa: F401

_NUMBER = r"([-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?)"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, spacing, dims, element_type, data_file of the headers at path; other keys are ignored."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    line = lambda key: F.regexp_extract("value", rf"(?m)^[^\r\n]*{key}\s*=\s*([^\r\n]*)", 1)
    numbers = lambda key, kind: F.transform(F.regexp_extract_all(line(key), F.lit(_NUMBER), 1), lambda v: F.regexp_replace(v, ",", ".").cast(kind))
    word = lambda key: F.nullif(F.regexp_extract(line(key), r"^(\S+)", 1), F.lit(""))
    return text.select("path", numbers("ElementSpacing", "double").alias("spacing"), numbers("DimSize", "int").alias("dims"), word("ElementType").alias("element_type"), word("ElementDataFile").alias("data_file"))


def geometry(header) -> Geometry:
    """Of a header row; a header without three spacings and dimensions or with another element type is an error."""
    if (header.element_type or "").upper() not in KINDS:
        raise ValueError(f"element type {header.element_type!r} is not supported")
    return Geometry(tuple(header.spacing[:3]), tuple(header.dims[:3]))


def read_volume(spark: SparkSession, header_path: str, raw_path: str, vol_id: str = "volume") -> tuple[Geometry, DataFrame]:
    """The geometry, and a table of voxels (vol_id, x, y, z, v). The raw file is named, not followed from the header."""
    head = read_headers(spark, header_path).first()
    g, kind = geometry(head), KINDS[head.element_type.upper()]
    a, b, c = g.dims
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = np.tile(np.arange(a), b), np.repeat(np.arange(b), a)
        for batch in batches:
            for k, raw in zip(batch["k"], batch["payload"]):
                v = np.frombuffer(raw, kind)
                slab = v.reshape(b, a) if kind.itemsize == 2 else v.reshape(a, b).T
                yield pd.DataFrame({"vol_id": vol_id, "x": x, "y": y, "z": k, "v": slab.reshape(-1).astype(np.int32)})

    records = spark.sparkContext.newAPIHadoopFile(
        raw_path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(a * b * kind.itemsize)},
    )
    return g, spark.createDataFrame(records, "k long, payload binary").filter(F.col("k") < c).mapInPandas(run, VOXEL)


def resampled(spark: SparkSession, fld, target: Geometry, r: Sequence[float], t: Sequence[float]) -> DataFrame:
    """i, j, k, value of a new grid: the field at R p + t, places outside moved to its border, values clamped to 16 bits."""
    from strataline.sources.fields import lattice

    moved = E.apply_rigid(list(r), list(t), E.xyz())
    placed = lattice(spark, target).select("i", "j", "k", *(E.clamp(v, 0.0, float(b)).alias(c) for v, c, b in zip(moved, "xyz", fld.geometry.bounds)))
    return fld.attach(placed, "value").select("i", "j", "k", E.clamp(F.col("value"), 0.0, 65535.0).alias("value"))


def is_rotation(r: Sequence[float], tolerance: float = 1e-6) -> bool:
    m = np.array(r, float).reshape(3, 3)
    return bool(np.abs(m @ m.T - np.eye(3)).max() < tolerance and math.isclose(np.linalg.det(m), 1, abs_tol=tolerance))

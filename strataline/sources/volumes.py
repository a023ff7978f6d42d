"""`volume`: a Spark data source for a header and a raw file of samples on a path that all machines mount.

    volumes.register(spark)
    voxels = spark.read.format("volume").load("macro.mhd")                     # vol_id, x, y, z, v
    volumes.save(voxels, geometry, "out.mhd", "MET_UCHAR")

Reading plans one partition for each group of slabs (the samples of one z) of about `group_bytes`; with `from_z` and `to_z`
(the first beyond), other slabs are not read. 16-bit samples run x fastest, 8-bit samples y fastest. Writing needs no order and
no driver: the file is laid out at its full size beside its place, each task puts the runs of samples it holds where
they belong, and the commit renames the file and writes the header. A task that runs again writes the same bytes to the same
place; an abort leaves what was there before. Samples that no row gives are 0.

Options: `raw` (default: what the header names, beside it), `vol_id`, `group_bytes`, `from_z`, `to_z`; for writing `dims`, `spacing`, `element_type`.
For a store that cannot write at a place, read with `metaimage.read_volume`.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataline.functions import exprs as E
from strataline.runtime import ship
from strataline.types import KINDS, VOXEL, Geometry, header_text

GROUP_BYTES = 8 << 20


def parsed_header(text: str) -> tuple[Geometry, str, str]:
    """Geometry, element type and data file; decimal commas are read as points."""
    found = dict(re.findall(r"(?m)^[^\S\r\n]*(\w+)[^\S\r\n]*=[^\S\r\n]*([^\r\n]*)", text))
    numbers = lambda key: [float(v.replace(",", ".")) for v in re.findall(r"[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?", found.get(key, ""))]
    kind = found.get("ElementType", "").strip().upper()
    if kind not in KINDS:
        raise ValueError(f"element type {kind!r} is not supported")
    return Geometry(tuple(numbers("ElementSpacing")[:3]), tuple(int(v) for v in numbers("DimSize")[:3])), kind, found.get("ElementDataFile", "").strip()


def local_path(path: str) -> str:
    return re.sub(r"^file:(//)?(?=/)", "", path)


def place(g: Geometry, kind: str, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The number of a sample in the raw file."""
    a, b, _ = g.dims
    return z * (a * b) + (y * a + x if KINDS[kind].itemsize == 2 else x * b + y)


@dataclass
class _Slabs(InputPartition):
    first: int
    last: int


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.header = local_path(options["path"])
        with open(self.header, encoding="utf-8") as f:
            self.geometry, self.kind, named = parsed_header(f.read())
        self.raw = local_path(options.get("raw") or os.path.join(os.path.dirname(self.header), named))
        self.vol_id = options.get("vol_id", "volume")
        a, b, c = self.geometry.dims
        self.slab = a * b * KINDS[self.kind].itemsize
        self.group = max(1, int(options.get("group_bytes", GROUP_BYTES)) // self.slab)
        self.start, self.end = max(0, int(options.get("from_z", 0))), min(c, int(options.get("to_z", c)))

    def partitions(self):
        return [_Slabs(k, min(k + self.group, self.end)) for k in range(self.start, self.end, self.group)]

    def read(self, partition: _Slabs) -> Iterator[pa.RecordBatch]:
        a, b, _ = self.geometry.dims
        kind = KINDS[self.kind]
        x, y = pa.array(np.tile(np.arange(a, dtype=np.int32), b)), pa.array(np.repeat(np.arange(b, dtype=np.int32), a))
        name = pa.array([self.vol_id]).dictionary_encode().dictionary
        with open(self.raw, "rb") as f:
            f.seek(partition.first * self.slab)
            for k in range(partition.first, partition.last):
                raw = f.read(self.slab)
                if len(raw) < self.slab:
                    raise ValueError(f"{self.raw} ends within slab {k}")
                v = np.frombuffer(raw, kind)
                v = v if kind.itemsize == 2 else v.reshape(a, b).T.reshape(-1)
                ids = name.take(pa.array(np.zeros(a * b, np.int32)))
                yield pa.RecordBatch.from_arrays([ids, x, y, pa.array(np.full(a * b, k, np.int32)), pa.array(v.astype(np.int32))], ["vol_id", "x", "y", "z", "v"])


@dataclass
class _Written(WriterCommitMessage):
    samples: int


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.header = local_path(options["path"])
        numbers = lambda key, kind: tuple(kind(v) for v in options[key].split())
        self.geometry, self.kind = Geometry(numbers("spacing", float), numbers("dims", int)), options.get("element_type", "MET_USHORT")
        if self.kind not in KINDS:
            raise ValueError(f"element type {self.kind!r} is not supported")
        self.raw = local_path(options.get("raw") or os.path.splitext(self.header)[0] + ".raw")
        if not overwrite and os.path.exists(self.header):
            raise FileExistsError(self.header)
        self.draft = f"{self.raw}.{uuid.uuid4().hex}"
        with open(self.draft, "wb") as f:
            f.truncate(self.geometry.count * KINDS[self.kind].itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        kind, most, n = KINDS[self.kind], np.array(self.geometry.dims), 0
        file = os.open(self.draft, os.O_WRONLY)
        try:
            for b in iterator:
                if not b.num_rows:
                    continue
                x, y, z, v = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xyzv")
                if min(x.min(), y.min(), z.min()) < 0 or (np.array([x.max(), y.max(), z.max()]) >= most).any():
                    raise ValueError("a sample lies outside the volume")
                at = place(self.geometry, self.kind, x, y, z)
                order = np.argsort(at, kind="stable")
                at, v = at[order], np.clip(v[order], 0, np.iinfo(kind).max).astype(kind)
                cuts = np.flatnonzero(np.diff(at) != 1) + 1
                for part, first in zip(np.split(v, cuts), at[np.concatenate([[0], cuts])].tolist()):
                    os.pwrite(file, part.tobytes(), first * kind.itemsize)
                n += b.num_rows
            os.fsync(file)
        finally:
            os.close(file)
        return _Written(n)

    def commit(self, messages: list) -> None:
        os.replace(self.draft, self.raw)
        text = header_text(self.geometry, os.path.relpath(self.raw, os.path.dirname(self.header) or "."), self.kind)
        with open(f"{self.header}.draft", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{self.header}.draft", self.header)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.draft):
            os.remove(self.draft)


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return VOXEL

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(VolumeSource)


def load(spark: SparkSession, path: str, raw: str | None = None, **options) -> tuple[Geometry, DataFrame]:
    """The geometry and the voxels (vol_id, x, y, z, v)."""
    register(spark)
    with open(local_path(path), encoding="utf-8") as f:
        g, *_ = parsed_header(f.read())
    reader = spark.read.format("volume").options(**{k: str(v) for k, v in options.items()})
    return g, (reader.option("raw", raw) if raw else reader).load(path)


def save(voxels: DataFrame, g: Geometry, path: str, element_type: str = "MET_USHORT", value: str = "v") -> None:
    """A volume of x, y, z and a value, which is truncated and clamped to what the element type holds. Rows near each other in the
    file go to one task, so that they are written in long runs."""
    register(voxels.sparkSession)
    most = float(np.iinfo(KINDS[element_type].newbyteorder("=")).max)
    rows = voxels.select(*(F.col(c).cast("int").alias(c) for c in "xyz"), E.clamp(F.col(value), 0.0, most).cast("int").alias("v"))
    order = ["z", "y", "x"] if KINDS[element_type].itemsize == 2 else ["z", "x", "y"]
    sorted_rows = rows.repartitionByRange("z", order[1]).sortWithinPartitions(*order)
    out = sorted_rows.write.format("volume").mode("overwrite").option("dims", " ".join(map(str, g.dims))).option("spacing", " ".join(repr(float(s)) for s in g.spacing))
    out.option("element_type", element_type).save(path)

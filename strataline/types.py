"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

VOXEL = "vol_id string, x int, y int, z int, v int"
SAMPLE_POINT = "set string, id long, x double, y double, z double, variance double"
FEATURE_VECTOR = "set string, id long, x double, y double, z double, features array<double>"
MATCH = "micro_id long, macro_id long, similarity double"
TRANSFORM = "id long, r array<double>, t array<double>"  # r row by row
EXPERIMENT_RESULT = "macro string, test string, relative_distance double"
PIXEL = "row int, col int, a int, r int, g int, b int"

KINDS = {"MET_USHORT": np.dtype("<u2"), "MET_UCHAR": np.dtype("u1")}


@dataclass(frozen=True)
class Geometry:
    """A grid: spacing and number of samples along x, y, z. Its box is [0, spacing * (dim - 1)], ends included."""

    spacing: tuple[float, float, float]
    dims: tuple[int, int, int]

    def __post_init__(self):
        if len(self.spacing) != 3 or len(self.dims) != 3 or min(self.dims) < 1 or min(self.spacing) <= 0:
            raise ValueError("three positive spacings and three positive dimensions are needed")

    @property
    def bounds(self) -> tuple[float, float, float]:
        return tuple(s * (d - 1) for s, d in zip(self.spacing, self.dims))

    @property
    def count(self) -> int:
        a, b, c = self.dims
        return a * b * c

    @property
    def diagonal(self) -> float:
        return sum(b * b for b in self.bounds) ** 0.5


def header_text(g: Geometry, raw_name: str, element_type: str = "MET_USHORT") -> str:
    lines = [
        "ObjectType = Image", "NDims = 3", "BinaryData = True", "BinaryDataByteOrderMSB = False", "CompressedData = False",
        "TransformMatrix = 1 0 0 0 1 0 0 0 1", "Offset = 0 0 0", "CenterOfRotation = 0 0 0", "AnatomicalOrientation = RAI",
        "ElementSpacing = " + " ".join(repr(float(s)) for s in g.spacing), "DimSize = " + " ".join(map(str, g.dims)),
        f"ElementType = {element_type}", f"ElementDataFile = {raw_name}",
    ]
    return "\n".join(lines) + "\n"

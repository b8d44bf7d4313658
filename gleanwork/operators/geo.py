"""Places: documents' coordinates, bounding boxes, radii and S2 cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres.
EARTH = 6_371_010.0
LEVEL = 21


def usable(lat: Column, lon: Column) -> Column:
    """Coordinates in range; exactly (0, 0) means none."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def derive(df: DataFrame, lat: Column, lon: Column, doc_id: str = "doc_id", cells: bool = False) -> DataFrame:
    """geo rows (doc_id, lat, lon), with cell_id where asked for."""
    out = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).filter(usable(F.col("lat"), F.col("lon")))
    return with_cells(out) if cells else out


def distance(lat: Column, lon: Column, at: float, on: float) -> Column:
    """Great-circle metres to a point."""
    dp, dl = F.radians(lat - F.lit(at)), F.radians(lon - F.lit(on))
    h = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat)) * math.cos(math.radians(at)) * F.pow(F.sin(dl / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box; one whose west lies east of its east crosses the date line."""
    across = (lon >= west) | (lon <= east) if west > east else lon.between(west, east)
    return lat.between(south, north) & across


def in_radius(lat: Column, lon: Column, at: float, on: float, metres: float) -> Column:
    """Inside a circle; a latitude band in front of the distance prunes the scan."""
    band = math.degrees(metres / EARTH)
    return lat.between(at - band, at + band) & (distance(lat, lon, at, on) <= metres)


def in_cells(cell: Column, cells) -> Column:
    """Inside any of some S2 cells of whatever level: leaf ranges around their ids."""
    out = F.lit(False)
    for c in cells:
        low = c & -c
        a, b = (F.lit(str(v)).cast("decimal(20,0)") for v in (c - (low - 1), c + (low - 1)))
        out = out | cell.between(a, b)
    return out


def predicate(kind: str, args: tuple) -> Column:
    lat, lon = F.col("lat"), F.col("lon")
    if kind == "bbox":
        return in_box(lat, lon, *args)
    if kind == "near":
        return in_radius(lat, lon, *args)
    return in_cells(F.col("cell_id"), args)


# -- S2 cell ids: the sphere on a cube, each face in Hilbert order


def _hilbert_tables():
    ij_to_pos = [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]]
    turn = [1, 0, 0, 3]  # swap, none, none, invert and swap
    return np.array(ij_to_pos), np.array([[o ^ turn[p] for p in range(4)] for o in range(4)])


_POS, _TURN = _hilbert_tables()


def cell_ids(lat: np.ndarray, lon: np.ndarray, level: int = LEVEL) -> np.ndarray:
    """S2 cell ids (uint64) of points in degrees."""
    phi, theta = np.radians(lat), np.radians(lon)
    p = np.stack([np.cos(theta) * np.cos(phi), np.sin(theta) * np.cos(phi), np.sin(phi)], 1)
    axis = np.abs(p).argmax(1)
    rows = np.arange(len(p))
    face = axis + 3 * (p[rows, axis] < 0)
    x, y, z = p.T
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [y / x, -x / y, -x / z, z / x, z / y], -y / z)
        v = np.select([face == 0, face == 1, face == 2, face == 3, face == 4], [z / x, z / y, -y / z, y / x, -x / y], -x / z)
    st = lambda c: np.where(c >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(c)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(c)))
    ij = lambda s: np.clip(np.floor(s * (1 << 30)).astype(np.int64), 0, (1 << 30) - 1)
    i, j = ij(st(u)), ij(st(v))
    turn = face & 1
    out = face.astype(np.uint64)
    for k in range(29, 29 - level, -1):
        quad = ((i >> k) & 1) * 2 + ((j >> k) & 1)
        out = (out << np.uint64(2)) | _POS[turn, quad].astype(np.uint64)
        turn = _TURN[turn, _POS[turn, quad]]
    left = np.uint64(61 - 2 * level)
    return (out << left) | (np.uint64(1) << (left - np.uint64(1)))


def with_cells(df: DataFrame, level: int = LEVEL) -> DataFrame:
    """df (doc_id, lat, lon) with cell_id DECIMAL(20,0)."""

    def run(batches):
        for b in batches:
            ids = cell_ids(b.column("lat").to_numpy(zero_copy_only=False), b.column("lon").to_numpy(zero_copy_only=False), level)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.uint64()).cast(pa.decimal128(20, 0))], [*b.schema.names, "cell_id"])

    return df.mapInArrow(run, df.schema.simpleString()[7:-1] + ",cell_id:decimal(20,0)")

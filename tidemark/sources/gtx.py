"""Separation grids: GeoTIFF, and GTX: big-endian header (south, west, steps, size) and float32 rows from the south; -88.8888 is nodata."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Lattice
from . import geotiff

NODATA = -88.8888
_HEAD, _HEAD_SIZE = ">4d2i", 40


def encode(lattice: Lattice, values: np.ndarray) -> bytes:
    head = struct.pack(_HEAD, lattice.lat0, lattice.lon0, lattice.dlat, lattice.dlon, lattice.rows, lattice.cols)
    return head + np.where(np.isnan(values), NODATA, values).astype(">f4").tobytes()


def decode_head(content: bytes) -> Lattice:
    if len(content) < _HEAD_SIZE:
        raise ValueError("too short for a grid")
    return Lattice(*struct.unpack_from(_HEAD, content))


def decode(content: bytes) -> tuple[Lattice, np.ndarray]:
    """Values with NaN for nodata; an error where the file's size and header disagree."""
    lattice = decode_head(content)
    values = np.frombuffer(content, ">f4", offset=_HEAD_SIZE)
    if len(values) != lattice.rows * lattice.cols:
        raise ValueError(f"{len(values)} values for {lattice.rows} x {lattice.cols} nodes")
    values = values.astype(np.float64).reshape(lattice.rows, lattice.cols)
    return lattice, np.where(np.abs(values - NODATA) < 1e-4, np.nan, values)


def _named(path: pa.Array) -> list[tuple[str, str]]:
    """Folder and stem: the region and the layer."""
    return [(p.split("/")[-2], p.split("/")[-1].rsplit(".", 1)[0].lower()) for p in path.to_pylist()]


def _grid(path: str, content: bytes) -> tuple[Lattice, np.ndarray]:
    """Of a GTX file, or of the first band of a GeoTIFF, whose rows run from the north and whose cells' middles are the nodes."""
    if path.lower().endswith(".gtx"):
        return decode(content)
    bands, _, (x0, dx, _, y0, _, dy), nodata = geotiff.decode(content)
    values = bands[0].astype(np.float64)
    if nodata is not None:
        values = np.where(values == np.float64(np.float32(nodata)), np.nan, values)
    rows, cols = values.shape
    south = y0 + (rows - 0.5) * dy
    return Lattice(south, x0 + dx / 2, -dy, dx, rows, cols), values[::-1]


def _rows(batches):
    for batch in batches:
        paths = batch["path"].to_pylist()
        for path, (region, layer), content in zip(paths, _named(batch["path"]), batch["content"].to_pylist()):
            _, values = _grid(path, content)
            n, cols = values.shape
            lost = np.isnan(values)
            step = max(1, 1_000_000 // max(1, cols))
            for k in range(0, n, step):
                part = pa.array(values[k : k + step].reshape(-1), pa.float64(), mask=lost[k : k + step].reshape(-1))
                m = len(values[k : k + step])
                vals = pa.ListArray.from_arrays(pa.array(np.arange(0, m * cols + 1, cols, dtype=np.int32) if cols else np.zeros(m + 1, np.int32)), part)
                yield pa.RecordBatch.from_arrays([pa.array([region] * m), pa.array([layer] * m), pa.array(range(k, k + m), pa.int32()), vals], names=["region", "layer", "row", "vals"])


def _heads(batches):
    for batch in batches:
        found = [(r, k, decode_head(c) if p.lower().endswith(".gtx") else _grid(p, c)[0]) for p, (r, k), c in zip(batch["path"].to_pylist(), _named(batch["path"]), batch["content"].to_pylist())]
        cols = [[r for r, _, _ in found], [k for _, k, _ in found]] + [[getattr(h, a) for _, _, h in found] for a in ("lat0", "lon0", "dlat", "dlon", "rows", "cols")]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["region", "layer", "lat0", "lon0", "dlat", "dlon", "rows", "cols"])


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{gtx,tif,tiff}").load(pattern).select("path", "content")


def read_rows(spark: SparkSession, pattern: str) -> DataFrame:
    """region, layer, row, vals of grid files region/layer.gtx or .tif, where pattern is a folder of files or a file; one task a file."""
    return _files(spark, pattern).mapInArrow(_rows, "region string, layer string, row int, vals array<double>")


def read_lattices(spark: SparkSession, pattern: str) -> DataFrame:
    """region, layer and the header of each grid."""
    return _files(spark, pattern).mapInArrow(_heads, "region string, layer string, lat0 double, lon0 double, dlat double, dlon double, rows int, cols int")


def to_signed_longitude(rows: DataFrame, lattice: Lattice) -> tuple[DataFrame, Lattice]:
    """A grid that counts longitude from 0 to 360 as one that counts from -180: each row is cut at 180 and turned round."""
    cut = next((j for j in range(lattice.cols) if lattice.lon0 + j * lattice.dlon >= 180), lattice.cols)
    if cut == lattice.cols:
        return rows, lattice
    first = lattice.lon0 + cut * lattice.dlon - 360
    turned = F.concat(F.slice("vals", cut + 1, lattice.cols), F.slice("vals", 1, cut)) if cut else F.col("vals")
    return rows.withColumn("vals", turned), Lattice(lattice.lat0, first, lattice.dlat, lattice.dlon, lattice.rows, lattice.cols)

"""GeoTIFF: written as uncompressed float32, band by band, in one file or in files of some rows each; read in most forms."""

from __future__ import annotations

import struct
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Raster

#: Sizes and struct codes of TIFF's field types.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def _head(rows: int, cols: int, names: list[str], geotransform: tuple[float, ...], nodata: float, wkt: str, tall: int, strips: int) -> tuple[bytes, int]:
    """All that comes before the samples of bands that are apart, in strips of tall rows, and how long it is."""
    n = len(names)
    meta = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(x)}</Item>' for i, x in enumerate(names)) + "</GDALMetadata>"
    x0, dx, _, y0, _, dy = geotransform
    sizes = [min(tall, rows - k * tall) * cols * 4 for k in range(strips)]
    tags: dict[int, tuple[int, list | bytes]] = {
        256: (4, [cols]), 257: (4, [rows]), 258: (3, [32] * n), 259: (3, [1]), 262: (3, [1]), 273: (4, [0] * n * strips), 277: (3, [n]), 278: (4, [tall]), 279: (4, sizes * n), 284: (3, [2]), 339: (3, [3] * n),
        33550: (12, [dx, -dy, 0.0]), 33922: (12, [0.0, 0.0, 0.0, x0, y0, 0.0]), 34737: (2, (wkt or "unknown").encode() + b"|\0"), 42112: (2, meta.encode() + b"\0"), 42113: (2, repr(nodata).encode() + b"\0"),
    }

    def packed(kind: int, values) -> bytes:
        return values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)

    def layout(start: int) -> tuple[bytes, bytes]:
        entries, extra, at = b"", b"", start
        for tag, (kind, values) in sorted(tags.items()):
            body = packed(kind, values)
            entries += struct.pack("<HHI", tag, kind, len(body) // _SIZES[kind])
            if len(body) <= 4:
                entries += body.ljust(4, b"\0")
            else:
                body += b"\0" * (len(body) % 2)
                entries += struct.pack("<I", at)
                extra += body
                at += len(body)
        return struct.pack("<H", len(tags)) + entries + b"\0\0\0\0", extra

    start = 8 + 2 + 12 * len(tags) + 4
    begin = start + len(layout(start)[1])
    tags[273] = (4, [begin + b * rows * cols * 4 + k * tall * cols * 4 for b in range(n) for k in range(strips)])
    head, extra = layout(start)
    return b"II*\0" + struct.pack("<I", 8) + head + extra, begin


def encode(bands: list[np.ndarray], names: list[str], geotransform: tuple[float, ...], nodata: float, wkt: str = "") -> bytes:
    rows, cols = bands[0].shape
    return _head(rows, cols, names, geotransform, nodata, wkt, rows, 1)[0] + b"".join(np.ascontiguousarray(b, "<f4").tobytes() for b in bands)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, bits, n, width, last = [], [], 0, 0, 9, b""
    for byte in data:
        bits, n = (bits << 8 | byte) & 0xFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = bits >> n & (1 << width) - 1
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


#: How compressed blocks are opened, by code.
_OPENERS = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}
#: NumPy's kinds of sample formats.
_KINDS = {1: "u", 2: "i", 3: "f"}


def _block(raw: bytes, height: int, width: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """height x width x samples of an opened block, with its differences undone."""
    size = height * width * samples * kind.itemsize
    raw = raw[:size].ljust(size, b"\0")
    if predictor == 3:  # each row's bytes, by significance, are differences of bytes
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(height, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(height, kind.itemsize, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(kind.newbyteorder(">")).reshape(height, width, samples)
    block = np.frombuffer(raw, kind).reshape(height, width, samples)
    return np.cumsum(block, axis=1, dtype=kind) if predictor == 2 else block


def decode(content: bytes) -> tuple[list[np.ndarray], list[str], tuple[float, ...], float | None]:
    """Bands, names, geotransform and nodata of a classic TIFF with a geotransform.

    Strips or tiles, bands together or apart, integers or floats of 8 to 64 bits, uncompressed or by LZW, deflate or
    PackBits, with either predictor; a ValueError for anything else.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(content[:4])
    if order is None:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", content, 4)[0]
    tags: dict[int, list | bytes] = {}
    for k in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind not in _SIZES:
            continue
        length, where = _SIZES[kind] * count, at + 10 + 12 * k
        if length > 4:
            where = struct.unpack_from(order + "I", content, where)[0]
        raw = content[where : where + length]
        tags[tag] = raw if kind == 2 else list(struct.unpack(f"{order}{count}{_CODES[kind]}", raw))
    one = lambda tag, other: tags[tag][0] if tag in tags else other
    cols, rows, n, apart = tags[256][0], tags[257][0], one(277, 1), one(284, 1) == 2
    opener, predictor, bits = _OPENERS.get(one(259, 1)), one(317, 1), set(tags.get(258, [1]))
    if opener is None or predictor not in (1, 2, 3) or len(bits) > 1 or min(bits) not in (8, 16, 32, 64) or one(339, 1) not in _KINDS:
        raise ValueError(f"compression {one(259, 1)}, predictor {predictor}, {sorted(bits)} bits of format {one(339, 1)} cannot be read")
    kind = np.dtype(f"{order}{_KINDS[one(339, 1)]}{min(bits) // 8}")
    tiled = 322 in tags
    width, height = (tags[322][0], tags[323][0]) if tiled else (cols, min(one(278, rows), rows))
    across, down, planes = -(-cols // width), -(-rows // height), n if apart else 1
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    whole = np.zeros((n, rows, cols), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(starts, sizes)):
        plane, place = divmod(k, across * down)
        if not size or plane >= planes:
            continue
        y, x = place // across * height, place % across * width
        tall = height if tiled else min(height, rows - y)
        block = _block(opener(content[start : start + size]), tall, width, 1 if apart else n, kind, predictor)[: rows - y, : cols - x]
        into = whole[plane : plane + 1] if apart else whole
        into[:, y : y + block.shape[0], x : x + block.shape[1]] = block.transpose(2, 0, 1)
    items = {int(e.get("sample")): e.text or "" for e in ElementTree.fromstring(tags[42112].rstrip(b"\0").decode()) if e.get("sample")} if 42112 in tags else {}
    if 33550 not in tags or 33922 not in tags:
        raise ValueError("no geotransform")
    (dx, dy, _), (i, j, _, x0, y0, _) = tags[33550], tags[33922][:6]
    nodata = float(tags[42113].rstrip(b"\0 ")) if 42113 in tags else None
    return list(whole), [items.get(i, f"band {i + 1}") for i in range(n)], (x0 - i * dx, dx, 0.0, y0 + j * dy, 0.0, -dy), nodata


def to_tiles(cells: DataFrame, raster: Raster, bands: list[str], names: list[str], wkt: str = "", rows_per_tile: int = 256) -> DataFrame:
    """tile, content: a GeoTIFF for each stretch of rows; cells that are not there are nodata. Tiles are written side by side."""
    nodata, cols, (x0, dx, _, y0, _, dy), total = raster.nodata["elev"], raster.cols, raster.geotransform, raster.rows

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        k = int(group["tile"].iloc[0])
        rows = min(rows_per_tile, total - k * rows_per_tile)
        layers = [np.full((rows, cols), nodata, np.float32) for _ in bands]
        for layer, b in zip(layers, bands):
            layer[group["row"] - k * rows_per_tile, group["col"]] = group[b].astype(np.float32).fillna(nodata)
        return pd.DataFrame({"tile": [k], "content": [encode(layers, names, (x0, dx, 0.0, y0 + k * rows_per_tile * dy, 0.0, dy), nodata, wkt)]})

    inside = cells.where(F.col("row").between(0, total - 1) & F.col("col").between(0, cols - 1))
    return inside.select(F.floor(F.col("row") / rows_per_tile).cast("int").alias("tile"), "row", "col", *bands).groupBy("tile").applyInPandas(tile, "tile int, content binary")


def save_tiles(tiles: DataFrame, directory: str) -> list[str]:
    """Writes each tile from the task that made it, into a store that all tasks reach; returns the paths."""

    def write(batches):
        store, root = fs.FileSystem.from_uri(directory) if "://" in directory or directory.startswith("file:") else (fs.LocalFileSystem(), directory)
        for batch in batches:
            names = [f"tile-{k:06d}.tif" for k in batch["tile"].to_pylist()]
            for name, content in zip(names, batch["content"].to_pylist()):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(names)], names=["name"])

    return sorted(f"{directory}/{r['name']}" for r in tiles.mapInArrow(write, "name string").collect())


def save_single(cells: DataFrame, raster: Raster, bands: list[str], names: list[str], path: str, wkt: str = "", rows_per_strip: int = 256) -> str:
    """One GeoTIFF of all cells: strips are made by tasks and come one by one through the driver, which writes them in order.

    A classic file ends at 4 GB, which is an error here; to_tiles() has no such end.
    """
    rows, cols, n = raster.rows, raster.cols, len(bands)
    strips = -(-rows // rows_per_strip)
    tall = [min(rows_per_strip, rows - k * rows_per_strip) for k in range(strips)]
    if rows * cols * 4 * n > 0xF0000000:
        raise ValueError("too large for one file; write tiles")
    head, begin = _head(rows, cols, names, raster.geotransform, raster.nodata["elev"], wkt, rows_per_strip, strips)
    empty = np.float32(raster.nodata["elev"]).astype("<f4").tobytes()
    done = 0
    with open(path, "wb") as out:
        out.write(head)

        def put(k: int, content: bytes | None) -> None:
            whole, size = np.frombuffer(content, np.uint8) if content is not None else None, tall[k] * cols * 4
            for b in range(n):
                out.seek(begin + b * rows * cols * 4 + k * rows_per_strip * cols * 4)
                out.write(empty * (tall[k] * cols) if whole is None else whole[len(whole) - (n - b) * size : len(whole) - (n - b - 1) * size].tobytes())

        for r in to_tiles(cells, raster, bands, names, wkt, rows_per_strip).orderBy("tile").toLocalIterator():
            for k in range(done, r["tile"]):
                put(k, None)
            put(r["tile"], bytes(r["content"]))
            done = r["tile"] + 1
        for k in range(done, strips):
            put(k, None)
    return path


def _cells(batches):
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
            try:
                bands, names, gt, nodata = decode(content)
            except (ValueError, KeyError, struct.error) as e:
                raise ValueError(f"cannot read {path}: {e}") from None
            rows, cols = bands[0].shape
            flat = np.stack([b.reshape(-1) for b in bands]).astype(np.float64)
            if nodata is not None:
                flat = np.where(flat == np.float32(nodata), np.nan, flat)
            at, (x0, dx, _, y0, _, dy) = np.arange(rows * cols), gt
            for k in range(0, len(at), 65_536):
                part = at[k : k + 65_536]
                row, col = part // cols, part % cols
                values = pa.array(list(flat[:, k : k + 65_536].T), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(part)), pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(x0 + (col + 0.5) * dx), pa.array(y0 + (row + 0.5) * dy), pa.array([names] * len(part), pa.list_(pa.string())), values],
                    names=["raster", "row", "col", "x", "y", "names", "values"],
                )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """raster, row, col, x, y of a cell's middle, and the names and values of its bands, NaN for nodata."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_cells, "raster string, row int, col int, x double, y double, names array<string>, values array<double>")

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import catalog_ops as ops
from tidemark.operators.points import transform_points
from tidemark.operators.raster import Raster
from tidemark.plans.catalog import Lattice
from tidemark.sources import files, geotiff, gtx
from tidemark.sources.text import write_csv
from tidemark.streaming.points import transform_stream


@pytest.fixture
def grids(tmp_path):
    lattice = Lattice(35.0, 284.0, 0.1, 0.1, 6, 7)
    for region in ("NCcoast11", "NCinner11"):
        (tmp_path / region).mkdir()
        for k, layer in enumerate(("geoid", "tss", "mllw")):
            v = np.full((6, 7), 1.0 + k)
            v[0, 0] = np.nan
            (tmp_path / region / f"{layer}.gtx").write_bytes(gtx.encode(lattice, v))
        (tmp_path / region / "a.kml").write_text("<kml><Placemark><name>valid-transform</name><coordinates>284,35,0 285,35 285,36 284,36 284,35</coordinates></Placemark><Placemark><name>x</name><coordinates>0,0 1,1 1,0 0,0</coordinates></Placemark></kml>")
        (tmp_path / region / f"{region}.config").write_text("[a]\nreference_frame = NAD83(2011)\n[b]\nreference_geoid: core\\geoid12b\\g2012bu0.gtx\nuncertainty_tss=0.0\n")
    (tmp_path / "grid_sigma.inf").write_text("# note\nnccoast.navd88.lmsl=4.5\nnccoast.lmsl.mllw=2\nncinner.lmsl.mllw=n/a\nconus.navd88.nad83=5.0\nbad=line=x\n")
    return str(tmp_path)


def test_gtx_round_trip():
    lattice = Lattice(1.0, 2.0, 0.5, 0.25, 2, 3)
    v = np.array([[1, np.nan, 3], [4, 5, 6.5]])
    head, got = gtx.decode(gtx.encode(lattice, v))
    assert head == lattice and np.array_equal(got, v, equal_nan=True)
    for bad in (b"", gtx.encode(lattice, v)[:-4]):
        with pytest.raises(ValueError):
            gtx.decode(bad)


def test_a_directory_end_to_end(spark, grids):
    geoids = {"NCcoast11": "core\\geoid12b\\g2012bu0.gtx", "NCinner11": "core\\geoid12b\\g2012bu0.gtx"}
    cat = files.load_catalog(spark, grids, geoids)
    assert [r.name for r in cat.regions] == ["NCcoast11", "NCinner11"] and cat.sigma["NCcoast11"]["tss"] == 4.5 * 0.01 and cat.sigma["NCinner11"]["mllw"] == 0 and cat.sigma_geoid == {"geoid12b": 0.05}
    pts = spark.createDataFrame([(1, -75.7, 35.2, 10.0), (2, -76.0, 35.0, 10.0), (3, -70.0, 35.0, 10.0)], "pid long, x double, y double, z double")
    got = {r["pid"]: (r["z"], r["region_index"]) for r in transform_points(pts, cat, "ellipse", "mllw").collect()}
    assert got == {1: (-8.0, 1), 2: (None, -1), 3: (None, -1)}
    assert {r["file"] for r in files.grid_listing(spark, grids).collect()} >= {"NCcoast11/tss.gtx"} and files.grid_digests(spark, grids).count() == 6


def test_polygons_configs_and_release(spark, grids):
    polygons = files.polygons(spark, grids)
    assert polygons.count() == 4
    assert {r[0] for r in ops.regions_by_box(polygons, (284.2, 35.2, 284.3, 35.3)).collect()} == {"NCcoast11", "NCinner11"}
    assert ops.regions_by_box(polygons, (0.2, 0.1, 0.3, 0.2)).count() == 0
    assert ops.regions_by_box(polygons, (283.0, 35.4, 286.0, 35.5)).count() == 2  # edges cross, no corner inside
    ext = {r["region"]: r for r in files.external_regions(spark, grids).collect()}
    assert ext["NCcoast11"]["reference_frame"] == "NAD83(2011)" and ext["NCcoast11"]["settings"]["uncertainty_tss"] == "0.0"
    digests = files.grid_digests(spark, grids)
    releases = digests.select(F.lit("r1").alias("release"), "file", "md5").unionByName(digests.select(F.lit("r2").alias("release"), "file", F.lit("x").alias("md5")))
    assert files.release(spark, grids, releases) == "r1"
    with pytest.raises(EnvironmentError):
        files.release(spark, grids, releases.where("release = 'r2'"))
    reply = spark.createDataFrame([('{"tar_lon": "-75.5", "tar_lat": "35", "tar_height": "1.25"}',), ("bad",)], "reply string")
    assert [r["tar_height"] for r in files.parse_reply(reply).collect()] == [1.25, None]


def test_longitudes_turn(spark):
    rows = spark.createDataFrame([("r", "geoid", 0, [1.0, 2.0, 3.0, 4.0])], "region string, layer string, row int, vals array<double>")
    turned, lattice = gtx.to_signed_longitude(rows, Lattice(0.0, 179.0, 1.0, 1.0, 1, 4))
    assert turned.first()["vals"] == [2.0, 3.0, 4.0, 1.0] and lattice.lon0 == -180.0


def test_geotiff_round_trip(spark, tmp_path):
    raster = Raster((10.0, 2.0, 0.0, 50.0, 0.0, -2.0), 5, 4, {"elev": -9999.0, "unc": -9999.0})
    cells = spark.createDataFrame([(r, c, r + c / 8, 0.5) for r in range(5) for c in range(4) if (r, c) != (3, 3)], "row int, col int, elev double, unc double")
    paths = geotiff.save_tiles(geotiff.to_tiles(cells, raster, ["elev", "unc"], ["Elevation", "Uncertainty"], "WKT", rows_per_tile=2), str(tmp_path))
    assert len(paths) == 3
    got = geotiff.read_cells(spark, str(tmp_path)).collect()
    assert len(got) == 20 and got[0]["names"] == ["Elevation", "Uncertainty"]
    at = {(round((50 - r["y"] - 1) / 2), round((r["x"] - 11) / 2)): r["values"] for r in got}
    assert np.isnan(at[3, 3][0]) and at[4, 2] == [4.25, 0.5]
    (tmp_path / "bad.tif").write_bytes(b"no")
    with pytest.raises(Exception, match="cannot read"):
        geotiff.read_cells(spark, str(tmp_path / "bad.tif")).collect()


def _chunked(bands, order, tile, code, predictor, apart):
    """A TIFF with blocks, of what an encoder of its own makes."""
    n, (rows, cols), kind = len(bands), bands[0].shape, bands[0].dtype.newbyteorder(order)
    tall, wide = tile or (2, cols)
    blocks = []
    for group in [[b] for b in bands] if apart else [bands]:
        for y in range(0, rows, tall):
            for x in range(0, cols, wide):
                part = np.zeros((tall if tile else min(tall, rows - y), wide, len(group)), kind)
                for s, b in enumerate(group):
                    piece = b[y : y + tall, x : x + wide]
                    part[: piece.shape[0], : piece.shape[1], s] = piece
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(kind)
                raw = part.tobytes()
                if predictor == 3:
                    planes = part.astype(kind.newbyteorder(">")).view(np.uint8).reshape(part.shape[0], wide * len(group), kind.itemsize).transpose(0, 2, 1).reshape(part.shape[0], -1, len(group))
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
                blocks.append({1: bytes, 8: zlib.compress, 5: _lzw_codes, 32773: lambda r: b"".join(bytes([len(r[i : i + 100]) - 1]) + r[i : i + 100] for i in range(0, len(r), 100)) + b"\x80"}[code](raw))
    fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = {256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [kind.itemsize * 8] * n), 259: ("H", [code]), 277: ("H", [n]), 284: ("H", [2 if apart else 1]), 317: ("H", [predictor]), 339: ("H", [fmt] * n), 33550: ("d", [2.0, 2.0, 0.0]), 33922: ("d", [0.0, 0, 0, 10, 50, 0])}
    tags |= {322: ("I", [wide]), 323: ("I", [tall]), 324: ("I", [0] * len(blocks)), 325: ("I", [len(b) for b in blocks])} if tile else {278: ("I", [tall]), 273: ("I", [0] * len(blocks)), 279: ("I", [len(b) for b in blocks])}
    codes = {"H": 3, "I": 4, "d": 12}
    begin = 8 + 2 + 12 * len(tags) + 4
    size = sum(len(struct.pack(f"{order}{len(v)}{k}", *v)) for k, v in tags.values())
    at, starts = begin + size, []
    for b in blocks:
        starts.append(at)
        at += len(b)
    tags[324 if tile else 273] = ("I", starts)
    head, extra = struct.pack(order + "H", len(tags)), b""
    for tag, (k, v) in sorted(tags.items()):
        body = struct.pack(f"{order}{len(v)}{k}", *v)
        head += struct.pack(order + "HHI", tag, codes[k], len(v)) + (body.ljust(4, b"\0") if len(body) <= 4 else struct.pack(order + "I", begin + len(extra)))
        extra += body if len(body) > 4 else b""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return (mark + struct.pack(order + "I", 8) + head + b"\0\0\0\0" + extra).ljust(begin + size, b"\0") + b"".join(blocks)


def _lzw_codes(raw):
    bits, table, width, word = "", {bytes([i]): i for i in range(256)}, 9, b""
    bits += format(256, "09b")
    for c in raw:
        c = bytes([c])
        if word + c in table:
            word += c
            continue
        bits += format(table[word], f"0{width}b")
        table[word + c] = len(table) + 2
        if len(table) + 2 == 4094:
            bits += format(256, f"0{width}b")
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = (len(table) + 2).bit_length()
        word = c
    if word:
        bits += format(table[word], f"0{width}b")
    bits += format(257, f"0{width}b")
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("code", [1, 5, 8, 32773])
@pytest.mark.parametrize("apart", [True, False])
def test_geotiff_in_most_forms(order, tile, code, apart):
    rnd = np.random.default_rng(1)
    for kind, predictor in (("f4", 1), ("f4", 3), ("f8", 3), ("i2", 2), ("u1", 2), ("i4", 1)):
        bands = [np.round(rnd.uniform(-90 if kind[0] != "u" else 0, 90, (21, 37))).astype(kind) for _ in range(2)]
        found, names, gt, nodata = geotiff.decode(_chunked(bands, order, tile, code, predictor, apart))
        assert all(np.array_equal(a, b) for a, b in zip(bands, found)) and names == ["band 1", "band 2"] and gt == (10.0, 2.0, 0.0, 50.0, 0.0, -2.0) and nodata is None


def test_one_file_for_all_cells(spark, tmp_path):
    raster = Raster((10.0, 2.0, 0.0, 50.0, 0.0, -2.0), 9, 4, {"elev": -9999.0, "unc": -9999.0})
    cells = spark.createDataFrame([(r, c, r + c / 8, 0.5) for r in range(9) for c in range(4) if r not in (2, 3, 8)], "row int, col int, elev double, unc double")
    path = geotiff.save_single(cells, raster, ["elev", "unc"], ["Elevation", "Uncertainty"], str(tmp_path / "a.tif"), rows_per_strip=2)
    bands, names, gt, nodata = geotiff.decode((tmp_path / "a.tif").read_bytes())
    assert names == ["Elevation", "Uncertainty"] and gt == raster.geotransform and nodata == -9999.0 and path.endswith("a.tif")
    assert bands[0].shape == (9, 4) and bands[0][7, 2] == 7.25 and bands[1][7, 2] == 0.5 and (bands[0][[2, 3, 8]] == -9999).all() and (bands[1][:2] == 0.5).all()


def test_external_regions_replace_and_go(spark, grids):
    geoids = {"NCcoast11": "core\\geoid12b\\g2012bu0.gtx", "NCinner11": "core\\geoid12b\\g2012bu0.gtx"}
    import pathlib

    (pathlib.Path(grids) / "NCinner11" / "NCinner11.kml").write_text("<kml/>")
    base = files.load_catalog(spark, grids, {"NCcoast11": geoids["NCcoast11"]})
    both = files.load_catalog(spark, grids, geoids, external=(grids,))
    assert [r.name for r in both.regions] == ["NCcoast11", "NCinner11"] and both.sigma["NCinner11"]["tss"] == 0.0
    ext = files.external_catalog(spark, grids)
    assert [r.name for r in ext.regions] == ["NCinner11"] and ext.regions[0].geoid_frame() == "NAD83(2011)"
    assert [r.name for r in files.without_external(both, ext).regions] == [r.name for r in base.regions]


def test_csv_and_stream(spark, grids, tmp_path):
    cat = files.load_catalog(spark, grids, {"NCcoast11": "core\\geoid12b\\g2012bu0.gtx"})
    pts = spark.createDataFrame([(1, -75.7, 35.2, 10.0), (2, -70.0, 35.2, 1.0)], "pid long, x double, y double, z double")
    write_csv(transform_points(pts, cat, "ellipse", "mllw"), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert sorted(r[0] for r in lines)[1] == "-75.7 35.2 -8.0 0"
    pts.write.parquet(str(tmp_path / "in"))
    stream = transform_stream(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), cat, "ellipse", "mllw")
    q = stream.writeStream.format("memory").queryName("moved").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r["pid"]: r["z"] for r in spark.table("moved").collect()} == {1: -8.0, 2: None}
    with pytest.raises(ValueError):
        transform_stream(pts, cat, "ellipse", "mllw")


def test_ambiguous_sigma_fails(spark):
    lines = spark.createDataFrame([("nc.lmsl.mllw=1",)], "line string")
    regions = spark.createDataFrame([("NCa",), ("NCb",)], "region string")
    with pytest.raises(Exception, match="several regions"):
        ops.sole_sigma(ops.sigma_by_region(ops.parse_sigma(lines), regions)).collect()

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookup
from tidemark.operators.points import bin_of, edges, transform_points, transform_sampled
from tidemark.operators.raster import Raster, band_roles, stacked, transform_raster, valid_counts
from tidemark.plans.catalog import Catalog, Lattice, Region
from tidemark.plans.transform import cells_of, most_overlap, output_sigma, plan
from tidemark.session import Request


def world(spark, regions=6, same=True):
    rnd = np.random.default_rng(1)
    found, rows, values = [], [], {}
    for n in range(regions):
        grids = {}
        for k, layer in enumerate(("geoid", "tss", "mllw")):
            size = (5, 6) if same or k else (9, 11)
            lattice = Lattice(10 + 0.3 * (n % 3), 200 + 0.3 * (n // 3), 1.0 / (size[0] - 1), 1.0 / (size[1] - 1), *size)
            v = np.round(rnd.uniform(-5, 5, size), 2)
            v[rnd.random(size) < 0.06] = np.nan
            grids[layer], values[n, layer] = lattice, v
            rows += [(f"r{n}", layer, i, [None if np.isnan(x) else float(x) for x in v[i]]) for i in range(size[0])]
        found.append(Region(f"r{n}", "core\\geoid12b\\g2012bu0.gtx", grids))
    sigma = {r.name: {"tss": 0.01 * i, "mllw": 0.02} for i, r in enumerate(found)}
    return Catalog(tuple(found), spark.createDataFrame(rows, "region string, layer string, row int, vals array<double>"), sigma, {"geoid12b": 0.05}), values


def brute(cat, values, x, y, z, steps, flip):
    for n in range(len(cat.regions) - 1, -1, -1):
        out = z
        for layer, sign in steps:
            g, v = cat.regions[n].grids[layer], values[n, layer]
            fi, fj = (y - g.lat0) / g.dlat, (x - g.lon0) % 360 / g.dlon
            if fi < 0 or fi > g.rows - 1 or fj > g.cols - 1:
                out = None
                break
            i, j = min(int(fi), g.rows - 2), min(int(fj), g.cols - 2)
            t, u = fi - i, fj - j
            out += sign * ((1 - u) * (1 - t) * v[i, j] + u * (1 - t) * v[i, j + 1] + (1 - u) * t * v[i + 1, j] + u * t * v[i + 1, j + 1])
        if out is not None and not math.isnan(out):
            return round(flip * out, 3), n
    return None, -1


def cloud(n=400):
    rnd = random.Random(2)
    return [(i, -160.2 + rnd.random() * 1.9, 9.9 + rnd.random() * 1.9, rnd.uniform(-20, 20)) for i in range(n)]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("unrolled", [8, 1])
def test_points_equal_brute_force(spark, same, unrolled, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_UNROLLED", unrolled)
    cat, values = world(spark, same=same)
    rows = cloud()
    got = {r["pid"]: r for r in transform_points(spark.createDataFrame(rows, "pid long, x double, y double, z double"), cat, "ellipse", "mllw", uncertainty=True).collect()}
    seen = set()
    for i, x, y, z in rows:
        want, n = brute(cat, values, x, y, z, [("geoid", -1), ("tss", 1), ("mllw", -1)], -1)
        assert got[i]["region_index"] == n and (want is None and got[i]["z"] is None or abs(got[i]["z"] - want) < 0.0011)
        assert got[i]["unc"] is None if n < 0 else abs(got[i]["unc"] - (0.05 + 0.01 * n + 0.02)) < 1e-12
        seen.add(n)
    assert len(seen) > 4 and -1 in seen


def test_edges_missing_values_and_shuffled_grids(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    cat, values = world(spark, 1)
    values[0, "geoid"][np.isnan(values[0, "geoid"])] = 0
    rows = [(0, 200.0, 10.0, 1.0), (1, 201.0, 11.0, None), (2, -159.0, 11.0, float("nan")), (3, 201.0001, 11.0, 1.0), (4, None, 10.5, 1.0)]
    got = {r["pid"]: r for r in transform_points(spark.createDataFrame(rows, "pid long, x double, y double, z double"), cat, "ellipse", "geoid", nan=True).collect()}
    assert got[3]["region_index"] == -1 and math.isnan(got[3]["z"]) and got[4]["region_index"] == -1
    assert got[1]["region_index"] in (0, -1) and (got[2]["region_index"] == -1 or math.isnan(got[2]["z"]))


def test_plans(spark):
    cat, _ = world(spark, 2)
    assert plan(cat, "MLLW", "noaa chart datum").identity and plan(cat, "geoid", "geoid").identity
    for a, b, strict in (("geoid", "navd88", True), ("ellipse", "hrd", False)):
        with pytest.raises(ValueError):
            plan(cat, a, b, strict)
    with pytest.raises(ValueError):
        plan(Catalog((), cat.grid_rows), "ellipse", "mllw")
    with pytest.raises(KeyError):
        output_sigma(cat, "ellipse", "hrd", "r0")
    assert output_sigma(cat, "ellipse", "hrd", "r0", missing="zero") == 0.05 and output_sigma(cat, "mllw", "ellipse", "r0") == 0
    assert most_overlap([(0, 0, 2, 2), (1, 1, 3, 3), (2, 2, 4, 4), (9, 9, 9, 9)]) == 3


def test_the_plan_does_not_shuffle_points(spark):
    cat, _ = world(spark)
    df = spark.range(100).select(F.col("id").alias("pid"), (F.col("id") * 0.01 - 160).alias("x"), (F.col("id") * 0.01 + 10).alias("y"), F.lit(1.0).alias("z"))
    text = transform_points(df, cat, "ellipse", "mllw")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "NestedLoop" not in text and "BroadcastHashJoin" in text


def test_sampling(spark):
    e = edges(-75.7389, -75.7387, 0.0005)
    assert len(e) == 3 and abs(e[1] - e[0] - 0.0006) < 1e-9
    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.uniform(-75.7389, -75.7387, 200), e])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = [r[0] for r in df.select(bin_of(F.col("v"), e[0], e[1] - e[0], 3)).collect()]
    assert np.abs(np.array(got) - (np.digitize(v, e) - 1)).sum() <= 1
    cat, _ = world(spark, 1)
    pts = spark.createDataFrame([(1, 200.5, 10.5, 1.0), (2, 200.6, 10.6, 2.0), (3, float("nan"), 10.5, 1.0)], "pid long, x double, y double, z double")
    whole = {r["pid"]: r for r in transform_points(pts, cat, "ellipse", "geoid").collect()}
    near = {r["pid"]: r for r in transform_sampled(pts, cat, "ellipse", "geoid", 0.002).collect()}
    assert near[3]["z"] is None and near[3]["region_index"] == -1
    for k in (1, 2):
        assert near[k]["z"] is None or abs(near[k]["z"] - whole[k]["z"]) < 0.2
    fine = {r["pid"]: r for r in transform_sampled(pts, cat, "ellipse", "geoid", 0.0005).collect()}
    slope = max(abs(float(a)) for a in np.nan_to_num(np.concatenate([np.diff(rows_of(cat, 0), axis=0).ravel() / 0.25, np.diff(rows_of(cat, 0), axis=1).ravel() / 0.2])))
    for k in (1, 2):  # within what the surface can rise over half a bin, and rounding
        assert fine[k]["z"] is None or abs(fine[k]["z"] - whole[k]["z"]) <= slope * 0.0012 + 0.001
    assert transform_sampled(pts.where("pid = 3"), cat, "ellipse", "geoid", 0.002).collect()[0]["region_index"] == -1
    assert transform_sampled(pts.where("false"), cat, "ellipse", "geoid", 0.002).count() == 0


def rows_of(cat, n):
    found = sorted((r["row"], r["vals"]) for r in cat.grid_rows.where(f"region = 'r{n}' and layer = 'geoid'").collect())
    return np.array([[np.nan if v is None else v for v in vals] for _, vals in found])


def test_columns_of_any_name_stay(spark):
    cat, _ = world(spark)
    rows = [(*r, "a", "b", "c", "d", 7.0, "e") for r in cloud(60)]
    names = "pid long, x double, y double, z double, ord string, geoid string, _tm_held string, `a.b` string, unc double, region string"
    moved = transform_points(spark.createDataFrame(rows, names), cat, "ellipse", "mllw")
    assert moved.columns == ["pid", "x", "y", "ord", "geoid", "_tm_held", "a.b", "unc", "z", "region_index", "region"]
    plain = transform_points(spark.createDataFrame(cloud(60), "pid long, x double, y double, z double"), cat, "ellipse", "mllw")
    assert sorted(map(str, moved.select("pid", "z", "region").collect())) == sorted(map(str, plain.select("pid", "z", "region").collect()))
    assert {(r["ord"], r["_tm_held"], r["a.b"], r["unc"]) for r in moved.collect()} == {("a", "c", "d", 7.0)}


def test_many_regions_over_one_place(spark):
    lattice = Lattice(10.0, 200.0, 0.5, 0.5, 3, 3)
    regions = tuple(Region(f"r{n}", "core\\geoid12b\\g2012bu0.gtx", {"geoid": lattice}) for n in range(300))
    rows = [(f"r{n}", "geoid", i, [float(n) if n < 3 else None] * 3) for n in range(12) for i in range(3)]
    cat = Catalog(regions[:12], spark.createDataFrame(rows, "region string, layer string, row int, vals array<double>"))
    got = transform_points(spark.createDataFrame([(200.5, 10.5, 5.0)] * 2, "x double, y double, z double"), cat, "ellipse", "geoid").collect()
    assert [(r["z"], r["region_index"]) for r in got] == [(3.0, 2)] * 2
    step, cells = cells_of([(0, 0, 359.9, 80)] * 300)
    assert step > 1 and all(len(v) == 300 for v in cells.values()) and len(Catalog(regions, cat.grid_rows).within(200.2, 10.2, 200.3, 10.3).regions) == 300


def test_place_systems_and_heights(spark):
    """The published places: metres within 0.1, also where the way leads through another frame than the points'."""
    from test_geodesy import GOLDENS

    lattice = Lattice(20.0, 215.0, 1.0, 1.0, 50, 80)
    for geoid, frame in (("core\\geoid12b\\g2012bu0.gtx", "NAD83(2011)"), ("core\\xgeoid17b\\AK_17B.gtx", "ITRF2008")):
        cat = Catalog((Region("r", geoid, {"geoid": lattice}),), spark.createDataFrame([("r", "geoid", i, [2.0] * 80) for i in range(50)], "region string, layer string, row int, vals array<double>"))
        for epsg, lon, lat, east, north in GOLDENS if frame == "NAD83(2011)" else GOLDENS[:2]:
            there = transform_points(spark.createDataFrame([(lon, lat, 10.0)], "x double, y double, z double"), cat, "ellipse", "geoid", source_crs=6318, target_crs=epsg).first()
            assert abs(there["x"] - east) < 0.1 and abs(there["y"] - north) < 0.1 and (frame != "NAD83(2011)" or there["z"] == 8.0)
            back = transform_points(spark.createDataFrame([(east, north, 10.0)], "x double, y double, z double"), cat, "ellipse", "geoid", source_crs=epsg, target_crs=6318).first()
            assert abs(back["x"] - lon) < 1e-6 and abs(back["y"] - lat) < 1e-6
    same = transform_points(spark.createDataFrame([(-75.7, 35.4, 1.0), (0.0, 35.4, 1.0)], "x double, y double, z double"), cat, "geoid", "geoid", source_crs=7912, target_crs=6318).collect()
    assert 0.3 < abs(same[0]["z"] - 1.0) < 4
    gone = transform_points(spark.createDataFrame([(0.0, 35.4, 1.0)], "x double, y double, z double"), cat, "ellipse", "geoid", source_crs=6318, target_crs=26918).first()
    assert (gone["x"], gone["z"], gone["region_index"]) == (None, None, -1)
    with pytest.raises(NotImplementedError):
        transform_points(spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double"), cat, "ellipse", "geoid", source_crs=1)


def test_requests(spark):
    cat, _ = world(spark, 2)
    request = Request(cat).set_input((6318, "ellipse")).set_output("mllw")
    df = spark.createDataFrame(cloud(40), "pid long, x double, y double, z double")
    plain = transform_points(df, cat, "ellipse", "mllw", uncertainty=True)
    assert sorted(map(str, request.transform(df, uncertainty=True).collect())) == sorted(map(str, plain.collect()))
    assert [r.name for r in request.set_region_by_points(spark.createDataFrame([(-160.1, 9.9), (-159.9, 10.1)], "x double, y double")).catalog.regions] == ["r0"]
    assert request.set_input(26905).source.horizontal == 26905 and request.target.horizontal == 6318
    for bad in (Request(cat).set_input(6318), request.set_region_by_points(df.where("false")), Request(cat).set_input((6318, "ellipse"))):
        with pytest.raises(ValueError):
            bad.transform(df)
    with pytest.raises(AssertionError):
        request.set_region_by_bounds(1, 1, 1, 2, strict=True)
    observed = request.counted(plain)
    assert observed.count() == 40


def test_raster_relations(spark):
    """By the published relation final = -(elev + sep), and its uncertainties."""
    lattice = Lattice(0.0, 0.0, 1.0, 1.0, 4, 4)
    rows = [("r", "geoid", i, [2.0] * 4) for i in range(4)] + [("r", "tss", i, [1.0, None, 1.0, 1.0]) for i in range(4)] + [("r", "mllw", i, [0.5] * 4) for i in range(4)]
    cat = Catalog((Region("r", "core\\geoid12b\\g2012bu0.gtx", {k: lattice for k in ("geoid", "tss", "mllw")}),), spark.createDataFrame(rows, "region string, layer string, row int, vals array<double>"), {"r": {"tss": 0.1, "mllw": 0.046}}, {"geoid12b": 0.05})
    raster = Raster((-0.5, 1.0, 0.0, 3.5, 0.0, -1.0), 4, 5, {"elev": 1e6, "unc": 1e6, "contributor": 1e6})
    cells = [(0, 0, -10.61, 1.21, 124.0), (0, 1, -21.3, 1.43, 214.0), (0, 4, -100.0, 20.0, 5.0), (0, 2, 1e6, 1.0, 1.0), (1, 4, -100.0, 1.0, 5.0), (2, 4, 5.0, 1.0, 5.0)]
    df = spark.createDataFrame(cells, "row int, col int, elev double, unc double, contributor double")
    got = {(r["row"], r["col"]): r for r in transform_raster(df, cat, "ellipse", "mllw", raster).collect()}
    assert abs(got[0, 0]["elev"] - 12.11) < 1e-9 and abs(got[0, 0]["unc"] - 1.406) < 1e-9 and got[0, 0]["contributor"] == 124
    assert {got[k]["elev"] for k in ((0, 1), (0, 2), (0, 4))} == {1e6} and got[0, 1]["unc"] == got[0, 1]["contributor"] == 1e6
    wide = {(r["row"], r["col"]): r for r in transform_raster(df, cat, "ellipse", "mllw", raster, allow_outside=True).collect()}
    assert (wide[0, 4]["elev"], wide[0, 4]["unc"]) == (100.0, 20.0) and wide[1, 4]["unc"] == 9.0 and wide[2, 4]["unc"] == 3.0 and wide[0, 2]["elev"] == 1e6
    assert [tuple(r) for r in valid_counts(df, plan(cat, "ellipse", "mllw"), raster).collect()] == [(0, "r", 2)]
    assert stacked(df, plan(cat, "ellipse", "mllw"), raster).where("region_index = 0").count() == 2
    assert band_roles(["Depth", "elevation"]) == {"elevation": 0}


@pytest.mark.parametrize("unrolled", [8, 2, 1])
def test_equal_points_stay_apart(spark, unrolled, monkeypatch):
    monkeypatch.setattr(lookup, "MOST_UNROLLED", unrolled)
    cat, _ = world(spark)
    rows = [(x, y, z) for _, x, y, z in cloud(40)]
    got = lambda r: sorted(transform_points(spark.createDataFrame(r, "x double, y double, z double"), cat, "ellipse", "mllw").collect(), key=str)
    assert got(rows * 3) == sorted(got(rows) * 3, key=str)


def test_regions_of_both_longitude_conventions_overlap(spark):
    assert most_overlap([(200, 0, 201, 1), (-160, 0, -159, 1), (359, 0, 362, 1), (-0.5, 0, 1, 1), (1.5, 0, 3, 1)]) == 2
    lattices = [Lattice(10.0, lon, 0.5, 0.5, 3, 3) for lon in (200.0, -160.0)]
    rows = [(f"r{n}", "geoid", i, [2.0 if n == 0 else None] * 3) for n in range(2) for i in range(3)]
    regions = tuple(Region(f"r{n}", "core\\geoid12b\\g2012bu0.gtx", {"geoid": g}) for n, g in enumerate(lattices))
    cat = Catalog(regions, spark.createDataFrame(rows, "region string, layer string, row int, vals array<double>"))
    got = transform_points(spark.createDataFrame([(1, 200.5, 10.5, 5.0), (2, -159.5, 10.5, 5.0)], "pid long, x double, y double, z double"), cat, "ellipse", "geoid").collect()
    assert [(r["z"], r["region_index"]) for r in got] == [(3.0, 0)] * 2


@pytest.mark.parametrize("interp", ["bilinear", "nearest"])
def test_joins_do_not_grow_with_the_regions_over_a_place(spark, interp, monkeypatch):
    """Seven regions across longitude 0, of two frames and two lattices, some void: as by a join for each of them."""
    rnd, regions, rows = np.random.default_rng(4), [], []
    for n in range(7):
        grids = {}
        for layer, spacing in (("geoid", 0.5), ("tss", 0.1), ("mllw", 0.1)):
            lattice = Lattice(10 + 0.1 * n, (358.5 if n % 2 else -1.5) + 0.07 * n, spacing, spacing, round(3 / spacing) + 1, round(4 / spacing) + 1)
            grids[layer], v = lattice, np.round(rnd.uniform(-5, 5, (lattice.rows, lattice.cols)), 2)
            v[rnd.random(v.shape) < 0.04] = np.nan
            rows += [(f"r{n}", layer, i, [None if np.isnan(x) else float(x) for x in v[i]]) for i in range(lattice.rows) if layer != "tss" or n or i % 9]
        regions.append(Region(f"r{n}", "core\\xgeoid17b\\AK_17B.gtx" if n % 3 else "core\\geoid12b\\g2012bu0.gtx", grids))
    p = plan(Catalog(tuple(regions), spark.createDataFrame(rows, "region string, layer string, row int, vals array<double>")), "ellipse", "mllw")
    some = [(float(x), float(y)) for x, y in zip(rnd.uniform(-1.7, 3.2, 600), rnd.uniform(9.9, 13.8, 600))]
    some += [(x, y) for x in (-1.5, -1e-17, 0.0, 360.0, 359.99999999999994, 0.8, 1.6, 2.92) for y in (10.0, 10.4, 11.2, 12.8, 13.6)] + [(None, 11.0), (float("nan"), 11.0), (1.0, 1e300)]
    df = spark.createDataFrame(some, "x double, y double")
    places = {"NAD83(2011)": (F.col("x"), F.col("y")), "ITRF2008": (F.col("x") + 1e-5, F.col("y") - 1e-5)}

    def found(unrolled, small=lookup.BROADCAST_BYTES, **options):
        monkeypatch.setattr(lookup, "MOST_UNROLLED", unrolled)
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", small)
        return lookup.separations(df, p, interp, **options)

    rows_of = lambda df: sorted(map(str, df.collect()))
    text = found(4)._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashJoin") + text.count("MergeJoin") <= 3
    want = rows_of(found(99))
    assert want == rows_of(found(4)) == rows_of(found(4, small=0)) and len({r.partition("region=")[2][:4] for r in want}) == 8
    back = {"order": lambda i: (-i,), "places": places}
    assert rows_of(found(99, **back)) == rows_of(found(4, **back))

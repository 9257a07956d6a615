"""A small world of regions, grids and points derived from the supplied tables by arithmetic that any engine repeats exactly."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.raster import Raster
from .plans.catalog import GEOID_FRAMES, Catalog, Lattice, Region
from .shared import shared_dir
from .sources import files, geotiff, gtx

LAYERS = ["geoid", "tss", "mllw", "mhw", "mtl", "dtl"]
NODES, SPACING = 11, 0.05
GEOIDS = list(GEOID_FRAMES)[:2] + list(GEOID_FRAMES)[6:8] + list(GEOID_FRAMES)[14:15]
RELEASE = "grids_20201203"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x = F.lit(-76.0) + ((F.col("user_id") * 7 + F.col("event_id")) % 2000) / F.lit(1e3)
    y = F.lit(35.0) + ((F.col("event_id") * 13) % 2000) / F.lit(1e3)
    return e.select(F.col("event_id").alias("pid"), x.alias("x"), y.alias("y"), F.col("value").alias("z"))


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in metres of UTM zone 18."""
    e = table(spark, sf_dir, "events")
    x = F.lit(410000.0) + ((F.col("user_id") * 7 + F.col("event_id")) % 2000) * F.lit(90.0)
    y = F.lit(3875000.0) + ((F.col("event_id") * 13) % 2000) * F.lit(110.0)
    return e.select(F.col("event_id").alias("pid"), x.alias("x"), y.alias("y"), F.col("value").alias("z"))


def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), n).alias("region"), n).withColumn("layer", F.explode(F.array(*map(F.lit, LAYERS))))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(NODES - 1))))
    k = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")) - 1
    value = lambda j: F.when((F.col("row") * 11 + j + n) % 37 != 0, ((n * 31 + k * 17 + F.col("row") * 7 + j * 3) % 100) / F.lit(1e2))
    return rows.select("region", "layer", "row", F.transform(F.sequence(F.lit(0), F.lit(NODES - 1)), value).alias("vals"))


def corner(n: int) -> tuple[float, float]:
    return -76.05 + (n % 5) * 0.4, 34.95 + (n // 5) * 0.4


def sigma_cm(n: int, layer: int) -> int:
    return (n * 3 + layer * 2) % 11 + 1


def dense_corner(n: int) -> tuple[float, float]:
    """Corners so close that all regions overlap."""
    return -75.6 + n * 0.01, 35.4 + n * 0.01


def catalog(spark: SparkSession, sf_dir: str, keep=lambda n: True, corner=corner, geoid: str = "") -> Catalog:
    """One region for each nation, the later the higher in precedence."""
    found = []
    for r in sorted(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()):
        x0, y0 = corner(r["n_nationkey"])
        lattice = Lattice(y0, x0, SPACING, SPACING, NODES, NODES)
        if keep(r["n_nationkey"]):
            found.append(Region(f"r{r['n_nationkey']}", geoid or GEOIDS[r["n_regionkey"]], {x: lattice for x in LAYERS}, lattice.bounds()))
    sigma = {r.name: {x: sigma_cm(int(r.name[1:]), k) * 0.01 for k, x in enumerate(LAYERS) if k} for r in found}
    return Catalog(tuple(found), grid_rows(spark, sf_dir), sigma, {"geoid12b": 5 * 0.01, "xgeoid17b": 3 * 0.01, "xgeoid20b": 2 * 0.01}, RELEASE)


def raster() -> Raster:
    return Raster((-76.0, 0.013, 0.0, 37.0, 0.0, -0.002), 1000, 150, {"elev": -9999.0, "unc": -9999.0, "contributor": -1.0})


def cells(spark: SparkSession, sf_dir: str, unc: bool = True) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    elev = F.when(k % 41 == 0, F.lit(-9999.0)).otherwise(-(F.floor("o_totalprice") % 50) / F.lit(1.0) + (F.col("o_custkey") % 7) / F.lit(2.0))
    bands = [F.floor(k / 150).cast("int").alias("row"), (k % 150).cast("int").alias("col"), elev.alias("elev")]
    bands += [((F.col("o_custkey") % 40) / F.lit(8.0)).alias("unc")] if unc else []
    return o.select(*bands, (k % 5).cast("double").alias("contributor"))


# The same in DuckDB's SQL.

SQL_POINTS = """pts as (select event_id as pid, -76::double + ((user_id * 7 + event_id) % 2000) / 1e3 as x,
  35::double + ((event_id * 13) % 2000) / 1e3 as y, value as z from events)"""
SQL_REGIONS = """reg as (select n_nationkey as ord, 'r' || n_nationkey as region, n_regionkey,
  -76.05::double + (n_nationkey % 5) * 0.4::double as x0, 34.95::double + (n_nationkey // 5) * 0.4::double as y0 from nation)"""
SQL_DENSE = SQL_REGIONS.replace("-76.05::double + (n_nationkey % 5) * 0.4::double", "-75.6::double + n_nationkey * 0.01::double").replace("34.95::double + (n_nationkey // 5) * 0.4::double", "35.4::double + n_nationkey * 0.01::double")
SQL_METRIC = """met as (select event_id as pid, 410000::double + ((user_id * 7 + event_id) % 2000) * 90::double as x,
  3875000::double + ((event_id * 13) % 2000) * 110::double as y, value as z from events)"""
SQL_CELLS = """raw as (select (o_orderkey // 150)::int as row, (o_orderkey % 150)::int as col,
    case when o_orderkey % 41 = 0 then -9999::double else -(floor(o_totalprice)::bigint % 50) / 1::double + (o_custkey % 7) / 2::double end as elev,
    (o_custkey % 40) / 8::double as unc, (o_orderkey % 5)::double as contributor from orders),
cells as (select row, col, case when elev <> -9999::double then elev end as elev, unc, contributor,
    -76::double + (col + 0.5::double) * 0.013::double as x, 37::double + (row + 0.5::double) * (-0.002)::double as y from raw)"""
SQL_EAST = "fmod(fmod(x - x0, 360::double) + case when x - x0 < 0 then 360::double else 0::double end, 360::double)"
SQL_INSIDE = f"y >= y0 and y <= y0 + 10 * 0.05::double and {SQL_EAST} <= (x0 + 10 * 0.05::double) - x0"


def sql_node(layer: str, i: str, j: str) -> str:
    return f"(case when (({i}) * 11 + ({j}) + ord) % 37 = 0 then null else ((ord * 31 + {LAYERS.index(layer)} * 17 + ({i}) * 7 + ({j}) * 3) % 100) / 1e2 end)"


def sql_bilinear(layer: str) -> str:
    v = lambda a, b: sql_node(layer, f"i + {a}", f"j + {b}")
    return f"((1 - u) * (1 - t) * {v(0, 0)} + u * (1 - t) * {v(0, 1)} + (1 - u) * t * {v(1, 0)} + u * t * {v(1, 1)})"


# A small directory of grid files: regions on a lattice of sixteenths of a degree, one geoid over all, an external region.

STEP, GEOID_STEP, DIR_GEOID = 1 / 16, 1 / 4, "core\\geoid12b\\g2012bu0.gtx"
DIR_REGIONS = [f"R{n}inner" for n in range(6)] + ["EXT1"]


def dir_corner(n: int) -> tuple[float, float]:
    return (-76.0625 + (n % 3) * 0.5, 34.9375 + (n // 3) * 0.5) if n < 6 else (-75.75, 35.1875)


def _dir_grid(n: int, layer: int) -> tuple[Lattice, np.ndarray]:
    x0, y0 = dir_corner(n)
    i, j = np.mgrid[0:NODES, 0:NODES]
    values = ((n * 31 + layer * 17 + i * 7 + j * 3) % 64) / 64
    return Lattice(y0, x0, STEP, STEP, NODES, NODES), np.where((i * 11 + j + n) % 37 == 0, np.nan, values)


def write_directory(spark: SparkSession, nations: int) -> tuple[str, str]:
    """Two folders below the shared one, of regions as many as there are nations to name them, and of an external region."""
    root = f"{shared_dir(spark)}/tidemark-grids-{uuid.uuid4().hex}"
    base, other = f"{root}/grids", f"{root}/external"
    put = lambda path, content: files.write_file(spark, path, content if isinstance(content, bytes) else content.encode())
    sigmas = ["# entries", "conus.navd88.nad83=5.0", "conus.other.thing=1.0"]
    for n, name in enumerate(DIR_REGIONS):
        if n < 6 and n >= nations:
            continue
        folder = f"{base if n < 6 else other}/{name}"
        for k, layer in enumerate(("tss", "mllw")):
            lattice, values = _dir_grid(n, k)
            if n % 2:
                top = lattice.lat0 + (NODES - 0.5) * STEP
                put(f"{folder}/{layer}.tif", geotiff.encode([np.where(np.isnan(values), -9999.0, values)[::-1]], [layer], (lattice.lon0 - STEP / 2, STEP, 0.0, top, 0.0, -STEP), -9999.0))
            else:
                put(f"{folder}/{layer}.gtx", gtx.encode(lattice, values))
        x0, y0 = dir_corner(n)
        x1, y1 = x0 + 10 * STEP, y0 + 10 * STEP
        ring = " ".join(f"{x},{y},0" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))
        kind = "valid-transform area" if n != 2 else "other"
        put(f"{folder}/{name}.kml", f"<kml><Placemark><name>{kind if n < 6 else 'outline'}</name><coordinates>{ring}</coordinates></Placemark></kml>")
        sigmas += [f"r{n}.navd88.lmsl={n + 1}.5", f"r{n}.lmsl.mllw=2", f"r{n}.mllw.mhw=9"] if n < 6 else []
    put(f"{other}/EXT1/EXT1.config", f"[region]\nreference_frame = NAD83(2011)\nreference_geoid = {DIR_GEOID}\nuncertainty_tss = 0.25\nuncertainty_mllw = 0.5\n")
    i, j = np.mgrid[0:13, 0:13]
    put(f"{base}/core/geoid12b/g2012bu0.gtx", gtx.encode(Lattice(34.5, -76.5, GEOID_STEP, GEOID_STEP, 13, 13), ((i * 7 + j * 3) % 64) / 64))
    put(f"{base}/small_sigma.inf", "\n".join(sigmas))
    put(f"{base}/grids_version.txt", f"{RELEASE}\n")
    return base, other


SQL_DIRECTORY = """dreg as (select n, case when n < 6 then 'R' || n || 'inner' else 'EXT1' end as region, case when n < 6 then -76.0625::double + (n % 3) * 0.5::double else -75.75::double end as x0,
  case when n < 6 then 34.9375::double + (n // 3) * 0.5::double else 35.1875::double end as y0 from unnest(range(7)) as t(n) where n = 6 or n < (select count(*) from nation))"""

"""The query catalogue: one query per operator, with the SQL that should give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures as fx
from . import geodesy_sql as geo
from .functions import geodesy
from .functions.grid import half_even, wrap
from .operators import catalog_ops as ops
from .operators import points as pts
from .operators import raster as ras
from .plans import crs, settings, wkt
from .plans.catalog import GEOID_FRAMES, Catalog, Lattice, Region
from .plans.datums import DEFINITIONS, pipeline_text
from .plans.transform import output_sigma, plan
from .session import Request
from .shared import shared_dir
from .sources import files, geotiff, gtx
from .sources.text import write_csv

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str = "", name: str = ""):
    def put(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return put


# Points -------------------------------------------------------------------------------------------------------------

#: The steps of each request as the documentation writes them out: signs of what is added, whether z counts upwards before and after.
_WRITTEN = {
    ("ellipse", "mllw"): ("- v_geoid + v_tss - v_mllw", True, False), ("ellipse", "geoid"): ("- v_geoid", True, True), ("ellipse", "tss"): ("- v_geoid + v_tss", True, True),
    ("ellipse", "mhw"): ("- v_geoid + v_tss - v_mhw", True, False), ("ellipse", "mtl"): ("- v_geoid + v_tss - v_mtl", True, False), ("ellipse", "dtl"): ("- v_geoid + v_tss - v_dtl", True, False),
    ("mllw", "ellipse"): ("+ v_mllw - v_tss + v_geoid", False, True), ("mllw", "mhw"): ("+ v_mllw - v_mhw", False, False), ("navd88", "mllw"): ("+ v_tss - v_mllw", True, False),
    ("tss", "noaa chart datum"): ("- v_mllw", True, False), ("noaa chart height", "geoid"): ("+ v_mhw - v_tss", False, True),
}


def _sql_shift(source: str, target: str, points: str = fx.SQL_POINTS, regions: str = fx.SQL_REGIONS, lon: str = "x", lat: str = "y", z: str = "z") -> tuple[str, str, str]:
    """CTEs that end in pick (pid, ord, region, n_regionkey, zz) of covered points; z before and the rounded z after the signs."""
    steps, up_in, up_out = _WRITTEN[source, target.lower()]
    layers = list(dict.fromkeys(w[2:] for w in steps.split() if w.startswith("v_")))
    shift = (z if up_in else f"(-{z})") + " " + steps
    east, inside = fx.SQL_EAST.replace("x - x0", f"{lon} - x0"), fx.SQL_INSIDE.replace("x - x0", f"{lon} - x0").replace("y >= y0 and y <= y0", f"{lat} >= y0 and {lat} <= y0")
    ctes = f"""{points}, {regions},
cand as (select *, least(floor(({lat} - y0) / 0.05::double), 9)::bigint as i, least(floor({east} / 0.05::double), 9)::bigint as j,
    ({lat} - y0) / 0.05::double as fi, {east} / 0.05::double as fj from pts join reg on {inside}),
frac as (select *, fi - i as t, fj - j as u from cand),
vals as (select *, {', '.join(f'{fx.sql_bilinear(x)} as v_{x}' for x in layers)} from frac),
best as (select *, {shift} as zz, row_number() over (partition by pid order by ord desc) as rn from vals where {' and '.join(f'v_{x} is not null' for x in layers)}),
pick as (select * from best where rn = 1)"""
    return ctes, shift, f"round_even({'' if up_out else '-'}(zz) * 1000::double, 0) / 1000::double + 0::double"


def _sql_points(source: str, target: str, columns: str = "p.pid, {z} as z, coalesce(b.ord, -1) as region_index", tail: str = "from pts p left join pick b on p.pid = b.pid") -> str:
    ctes, _, z = _sql_shift(source, target)
    return f"with {ctes} select {columns.format(z=z)} {tail}"


def _points(source: str, target: str, **options) -> Query:
    return lambda spark, d: pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), source, target, **options).select("pid", "z", "region_index")


for _s, _t, _n in [
    ("ellipse", "mllw", "points_ellipse_to_mllw"), ("ellipse", "geoid", "points_ellipse_to_geoid"), ("ellipse", "tss", "points_ellipse_to_tss"), ("ellipse", "mhw", "points_ellipse_to_mhw"),
    ("ellipse", "mtl", "points_ellipse_to_mtl"), ("ellipse", "dtl", "points_ellipse_to_dtl"), ("mllw", "ellipse", "points_mllw_to_ellipse"), ("mllw", "mhw", "points_mllw_to_mhw"),
    ("navd88", "mllw", "points_navd88_to_mllw"), ("tss", "NOAA Chart Datum", "points_tss_to_chart_datum"), ("noaa chart height", "geoid", "points_chart_height_to_geoid"),
]:
    _query(_sql_points(_s, _t), _n)(_points(_s, _t))

_query("select event_id as pid, round_even(value * 1000::double, 0) / 1000::double + 0::double as z, 0 as region_index from events", "points_identity")(_points("geoid", "geoid"))
_query("select event_id as pid, round_even(-(-value) * 1000::double, 0) / 1000::double + 0::double as z, 0 as region_index from events", "points_synonym")(_points("mllw", "noaa chart datum"))


@_query(_sql_points("ellipse", "mllw", "coalesce(b.ord, -1) as region_index, count(*) as n", "from pts p left join pick b on p.pid = b.pid group by 1"))
def points_region_index(spark, d):
    found = pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw")
    return found.groupBy("region_index").agg(F.count(F.lit(1)).alias("n"))


@_query(_sql_points("ellipse", "mllw", "p.pid", "from pts p left join pick b on p.pid = b.pid where b.pid is null"))
def points_uncovered(spark, d):
    return pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw").where("region_index = -1").select("pid")


@_query(_sql_points("ellipse", "mllw", "count(*) as n, count(b.pid) as covered, count(distinct b.ord) as regions, min({z}) as z_min, max({z}) as z_max"))
def points_summary(spark, d):
    found = pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw")
    covered = F.col("region_index") >= 0
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_if(covered).alias("covered"), F.count_distinct(F.when(covered, F.col("region_index"))).alias("regions"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


@_query(
    _sql_points("ellipse", "mllw", "p.pid, abs(round_even((-({z}) + v_mllw - v_tss + v_geoid) * 1000::double, 0) / 1000::double - p.z) <= 0.0011::double as same", "from pts p join pick b on p.pid = b.pid"),
)
def points_roundtrip(spark, d):
    """There and back in the region that served the way there: within a millimetre of where it began."""
    cat = fx.catalog(spark, d)
    there = pts.transform_points(fx.points(spark, d).withColumn("z0", F.col("z")), cat, "ellipse", "mllw").where("region_index >= 0").drop("region_index", "region")
    back = pts.transform_points(there, cat, "mllw", "ellipse")
    return back.select("pid", (F.abs(F.col("z") - F.col("z0")) <= 0.0011).alias("same"))


_UNC = "((0::double + 0.05::double) + ((ord * 3 + 2) % 11 + 1) * 0.01::double) + ((ord * 3 + 4) % 11 + 1) * 0.01::double"


@_query(_sql_points("ellipse", "mllw", f"p.pid, case when b.pid is not null then {_UNC} end as unc"))
def points_unc_mllw(spark, d):
    return pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw", uncertainty=True).select("pid", "unc")


def _sql_matrix() -> str:
    rows = []
    for s in DEFINITIONS:
        for t in (t for t in DEFINITIONS if t not in ("lwrp2007", "hrd")):
            layer = {"noaa chart datum": "mllw", "noaa chart height": "mhw"}.get(t, t)
            x = "0::double"
            if s == "ellipse" and t != "ellipse":
                x += " + 0.05::double"
            if s in ("ellipse", "geoid", "navd88") and t not in ("ellipse", "geoid", "navd88"):
                x += " + ((n_nationkey * 3 + 2) % 11 + 1) * 0.01::double"
            if t not in ("ellipse", "geoid", "tss", "navd88"):
                x += f" + ((n_nationkey * 3 + {2 * fx.LAYERS.index(layer)}) % 11 + 1) * 0.01::double"
            rows.append(f"select '{s}' as source, '{t}' as target, 'r' || n_nationkey as region, {x} as unc from nation")
    return " union all ".join(rows)


@_query(_sql_matrix())
def points_unc_matrix(spark, d):
    cat = fx.catalog(spark, d)
    rows = [(s, t, r.name, output_sigma(cat, s, t, r.name)) for s in DEFINITIONS for t in DEFINITIONS if t not in ("lwrp2007", "hrd") for r in cat.regions]
    return spark.createDataFrame(rows, "source string, target string, region string, unc double")


_SAMPLE = 0.02


def _sql_sampled() -> str:
    """The lattice of the supplied points, -76 to -74.001 by 35 to 36.999 at the most, spelled out from the data's extents."""
    ctes, _, z = _sql_shift("ellipse", "geoid")
    inner = ctes.replace(fx.SQL_POINTS + ",", "")
    return f"""with ev as (select event_id as pid, -76::double + ((user_id * 7 + event_id) % 2000) / 1e3 as x, 35::double + ((event_id * 13) % 2000) / 1e3 as y, value as z from events),
ext as (select min(x) - 0.02::double as xa, max(x) + 0.02::double as xb, min(y) - 0.02::double as ya, max(y) + 0.02::double as yb from ev),
num as (select *, ceil((xb - xa) / 0.02::double)::bigint as nx, ceil((yb - ya) / 0.02::double)::bigint as ny from ext),
stp as (select *, (xa + 1 * (xb - xa) / (nx - 1)) - xa as sx, (ya + 1 * (yb - ya) / (ny - 1)) - ya as sy from num),
pts as (select (b * 100000 + a)::bigint as pid, xa + a * sx + 0.01::double as x, ya + b * sy + 0.01::double as y, 0::double as z
  from stp, unnest(range(nx - 1)) as r(a), unnest(range(ny - 1)) as q(b)),
{inner},
sep as (select pid, {z} as sep, ord from pick),
k as (select ev.*, xa, ya, sx, sy, nx, ny, floor((x - xa) / sx)::bigint as kx, floor((y - ya) / sy)::bigint as ky from ev, stp),
b as (select pid, z, least(case when xa + (kx + 1) * sx <= x then kx + 1 when xa + kx * sx > x then kx - 1 else kx end, nx - 1) as bx,
  least(case when ya + (ky + 1) * sy <= y then ky + 1 when ya + ky * sy > y then ky - 1 else ky end, ny - 1) as by from k)
select b.pid, sep.sep + b.z as z, coalesce(sep.ord, -1) as region_index from b left join sep on sep.pid = b.by * 100000 + b.bx"""


@_query(_sql_sampled())
def points_sampled(spark, d):
    return pts.transform_sampled(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "geoid", _SAMPLE).select("pid", "z", "region_index")


@_query(_sql_points("ellipse", "mllw", tail="from (select * from pts union all select * from pts) p left join pick b on p.pid = b.pid").replace(fx.SQL_REGIONS, fx.SQL_DENSE))
def points_dense_overlap(spark, d):
    """All regions overlap, and every point is there twice."""
    p = fx.points(spark, d)
    twice = p.unionByName(p).withColumn("ord", F.lit("x"))
    return pts.transform_points(twice, fx.catalog(spark, d, corner=fx.dense_corner), "ellipse", "mllw").select("pid", "z", "region_index")


@_query(_sql_points("ellipse", "mllw").replace("value as z from events", "case when event_id % 5 <> 0 then value else 0::double end as z from events"))
def points_missing_z(spark, d):
    p = fx.points(spark, d).withColumn("z", F.when(F.col("pid") % 5 != 0, F.col("z")))
    return pts.transform_points(p, fx.catalog(spark, d), "ellipse", "mllw").select("pid", "z", "region_index")


@_query(_sql_points("ellipse", "mllw", "p.pid, b.pid is null as lost, coalesce({z}, 0) as z"))
def points_nan(spark, d):
    """Points that no region covers are not a number in x, y and z."""
    moved = pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw", nan=True)
    return moved.select("pid", (F.isnan("x") & F.isnan("y") & F.isnan("z")).alias("lost"), F.nanvl("z", F.lit(0.0)).alias("z"))


@_query(
    f"with {fx.SQL_METRIC}, {geo.utm_inverse_ctes('met', -75)}, "
    + _sql_shift("ellipse", "mllw", "pts as (select * from geo)", lon="lon", lat="lat")[0]
    + f" select p.pid, p.x, p.y, {_sql_shift('ellipse', 'mllw')[2]} as z, coalesce(b.ord, -1) as region_index from pts p left join pick b on p.pid = b.pid"
)
def points_utm_to_mllw(spark, d):
    """Metres in, metres out: the grids are met in degrees."""
    return pts.transform_points(fx.metric_points(spark, d), fx.catalog(spark, d, geoid=fx.GEOIDS[0]), "ellipse", "mllw", source_crs=26918).select("pid", "x", "y", "z", "region_index")


@_query(
    f"with {fx.SQL_POINTS}, {geo.utm_forward_ctes('pts', -75)}, "
    + _sql_shift("ellipse", "mllw", "raw as (select 1)")[0]
    + f" select p.pid, round_even(u.east * 1000, 0) / 1000 + 0::double as x, round_even(u.north * 1000, 0) / 1000 + 0::double as y, {_sql_shift('ellipse', 'mllw')[2]} as z from utm u join pts p on u.pid = p.pid join pick b on p.pid = b.pid"
)
def points_nad83_to_utm(spark, d):
    """Degrees in, metres out, for the points that are covered."""
    moved = pts.transform_points(fx.points(spark, d), fx.catalog(spark, d, geoid=fx.GEOIDS[0]), "ellipse", "mllw", source_crs=6318, target_crs=26918)
    return moved.where("region_index >= 0").select("pid", half_even(F.col("x"), 3).alias("x"), half_even(F.col("y"), 3).alias("y"), "z")


_BY_FRAME = lambda a, b, c: f"(case when n_regionkey < 2 then {a} when n_regionkey < 4 then {b} else {c} end)"


@_query(
    f"with {fx.SQL_POINTS.replace('pts as', 'ev as')}, {geo.cartesian_ctes('ev', 'c', 'x', 'y', 'z')}, {geo.shift_ctes('c', 'm', 'ITRF2014')}, {geo.geographic_ctes('m', 'g', 'lon83', 'lat83', 'h83')}, "
    + f"{geo.cartesian_ctes('g', 'c2', 'lon83', 'lat83', 'h83')}, {geo.shift_ctes('c2', 'm2', 'ITRF2008', True)}, {geo.geographic_ctes('m2', 'g2', 'lon08', 'lat08', 'h08')}, "
    + _sql_shift("ellipse", "mllw", "pts as (select * from g2)", lon=_BY_FRAME("lon83", "lon08", "x"), lat=_BY_FRAME("lat83", "lat08", "y"), z=_BY_FRAME("h83", "h08 + (h83 - z)", "z + (h83 - z)"))[0]
    + f" select p.pid, round_even(p.lon83 * 1e7::double, 0) / 1e7::double as x, round_even(p.lat83 * 1e7::double, 0) / 1e7::double as y, {_sql_shift('ellipse', 'mllw')[2]} as z, b.ord as region_index from pts p join pick b on p.pid = b.pid"
)
def points_itrf_to_nad83(spark, d):
    """From ITRF2014 to NAD83(2011) over regions whose geoids are in three frames: each is met in its own."""
    moved = pts.transform_points(fx.points(spark, d), fx.catalog(spark, d), "ellipse", "mllw", source_crs=7912, target_crs=6318).where("region_index >= 0")
    return moved.select("pid", half_even(F.col("x"), 7).alias("x"), half_even(F.col("y"), 7).alias("y"), "z", "region_index")


@_query(
    f"with {fx.SQL_METRIC}, box as (select 0 as k, min(x) as x, min(y) as y from met union all select 1, max(x), max(y) from met), {geo.utm_inverse_ctes('box', -75)} "
    "select round_even(min(lon) * 1e7::double, 0) / 1e7::double as x_min, round_even(min(lat) * 1e7::double, 0) / 1e7::double as y_min, round_even(max(lon) * 1e7::double, 0) / 1e7::double as x_max, round_even(max(lat) * 1e7::double, 0) / 1e7::double as y_max from geo"
)
def extents_geographic(spark, d):
    """By two corners of the metric box."""
    box = pts.geographic_extents(fx.metric_points(spark, d), 26918)
    return box.select(*[half_even(F.col(c), 7).alias(c) for c in box.columns])


@_query(f"with {fx.SQL_POINTS} select min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max from pts")
def extents(spark, d):
    return pts.extents(fx.points(spark, d), nan_safe=False)


@_query(f"with {fx.SQL_POINTS} select min(x) as x_min, min(y) as y_min, max(x) as x_max, max(y) as y_max from pts where pid % 3 <> 0")
def extents_nansafe(spark, d):
    lost = F.when(F.col("pid") % 3 == 0, float("nan"))
    return pts.extents(fx.points(spark, d).withColumn("x", F.coalesce(lost, "x")))


# Rasters ------------------------------------------------------------------------------------------------------------

_SQL_SEP = f"""{fx.SQL_CELLS}, {fx.SQL_REGIONS},
cand as (select *, floor((y - y0) / 0.05::double + 0.5::double)::bigint as i, floor({fx.SQL_EAST} / 0.05::double + 0.5::double)::bigint as j from cells join reg on {fx.SQL_INSIDE}),
seps as (select row, col, elev, unc, contributor, ord, region, 0::double - {fx.sql_node('geoid', 'i', 'j')} + {fx.sql_node('tss', 'i', 'j')} - {fx.sql_node('mllw', 'i', 'j')} as sep from cand),
cnt as (select ord, region, count(*) as n from seps where sep is not null group by 1, 2),
stk as (select seps.*, row_number() over (partition by row, col order by n desc, seps.ord desc) as rn from seps join cnt on seps.ord = cnt.ord where sep is not null),
one as (select c.*, s.sep, s.ord as region_index from cells c left join stk s on c.row = s.row and c.col = s.col and s.rn = 1)"""


def _plan(spark, d):
    return plan(fx.catalog(spark, d), "ellipse", "mllw")


@_query(f"with {_SQL_SEP} select row, col, region, sep from seps")
def raster_sep_nearest(spark, d):
    cells = ras.masked(fx.cells(spark, d), fx.raster())
    return ras.region_separations(cells, _plan(spark, d), fx.raster()).where("region is not null").select("row", "col", "region", "sep")


@_query(f"with {_SQL_SEP} select region, n from cnt")
def raster_valid_counts(spark, d):
    return ras.valid_counts(ras.masked(fx.cells(spark, d), fx.raster()), _plan(spark, d), fx.raster()).select("region", "n")


@_query(f"with {_SQL_SEP} select row, col, sep, coalesce(region_index, -1) as region_index from one")
def raster_stack_largest(spark, d):
    return ras.stacked(ras.masked(fx.cells(spark, d), fx.raster()), _plan(spark, d), fx.raster()).select("row", "col", "sep", "region_index")


@_query(f"with {_SQL_SEP} select bool_and(sep is not null) as covered, count(*) filter (sep is null) as missing from one")
def raster_is_covered(spark, d):
    return ras.is_covered(ras.stacked(ras.masked(fx.cells(spark, d), fx.raster()), _plan(spark, d), fx.raster()))


def _sql_apply(source: str, target: str, allow: bool, own_unc: bool = True) -> str:
    """source and target are the ellipsoid and mllw, or the other way round, where signs of steps and directions turn."""
    there = source == "ellipse"
    if not there:
        sep_sql = _SQL_SEP.replace("0::double - " + fx.sql_node("geoid", "i", "j") + " + " + fx.sql_node("tss", "i", "j") + " - " + fx.sql_node("mllw", "i", "j"), "0::double + " + fx.sql_node("mllw", "i", "j") + " - " + fx.sql_node("tss", "i", "j") + " + " + fx.sql_node("geoid", "i", "j"))
    else:
        sep_sql = _SQL_SEP
    inside = "-1::double * (elev + sep)" if there else "-1::double * (elev - sep)"
    sigma = _UNC.replace("ord", "region_index") if there else "0::double"
    h = "elev" if there else "-elev"
    far = f"case when {h} > 0 then 3::double else 3::double - 0.06::double * ({h}) end"
    unc = "unc" if own_unc else "null::double"
    put = lambda a, b, nodata: f"coalesce(case when elev is not null and sep is not null then {a} when elev is not null and {allow} then {b} end, {nodata}::double)"
    return f"""with {sep_sql} select row, col, {put(inside, '-1::double * elev', -9999)} as elev, {put(f'coalesce({unc}, 0) + ({sigma})', f'greatest({far}, {unc})', -9999)} as unc,
  {put('contributor', 'contributor', -1)} as contributor, coalesce(region_index, -1) as region_index from one"""


def _apply(source: str, target: str, allow: bool, own_unc: bool = True) -> Query:
    return lambda spark, d: ras.transform_raster(fx.cells(spark, d, own_unc), fx.catalog(spark, d), source, target, fx.raster(), allow_outside=allow)


_query(_sql_apply("ellipse", "mllw", False), "raster_apply_up_down")(_apply("ellipse", "mllw", False))
_query(_sql_apply("mllw", "ellipse", False), "raster_apply_down_up")(_apply("mllw", "ellipse", False))
_query(_sql_apply("ellipse", "mllw", True), "raster_outside_allowed")(_apply("ellipse", "mllw", True))
_query(_sql_apply("ellipse", "mllw", False), "raster_outside_nodata")(_apply("ellipse", "mllw", False))
_query(_sql_apply("ellipse", "mllw", True, False), "raster_unc_missing_band")(_apply("ellipse", "mllw", True, False))


@_query(f"""with {fx.SQL_CELLS} select row, col, coalesce(1::double * (elev + 0::double), -9999::double) as elev,
  case when elev is null then -9999::double else unc + 0::double end as unc, case when elev is null then -1::double else contributor end as contributor, 0 as region_index from cells""")
def raster_apply_same(spark, d):
    return ras.transform_raster(fx.cells(spark, d), fx.catalog(spark, d), "navd88", "geoid", fx.raster())


@_query("select * from (values ('Elevation,Uncertainty,Contributor', 0, 1, 2), ('contributor,DEPTH,Elevation', 1, -1, 0), ('x', 0, -1, -1), ('Vertical Uncertainty,depth', 1, 0, -1)) as t(names, elevation, uncertainty, contributor)")
def band_roles(spark, d):
    names = ["Elevation,Uncertainty,Contributor", "contributor,DEPTH,Elevation", "x", "Vertical Uncertainty,depth"]
    found = [(n, ras.band_roles(n.split(","))) for n in names]
    return spark.createDataFrame([(n, *(r.get(k, -1) for k in ("elevation", "uncertainty", "contributor"))) for n, r in found], "names string, elevation int, uncertainty int, contributor int")


@_query(f"with {fx.SQL_CELLS} select -76::double as x_min, 35::double as y_min, -76::double + 150 * 0.013::double as x_max, 37::double as y_max, count(*) as cells, count(elev) as seen from cells")
def raster_extents(spark, d):
    raster = fx.raster()
    x0, y0, x1, y1 = raster.bounds()
    seen = ras.masked(fx.cells(spark, d), raster).agg(F.count(F.lit(1)).alias("cells"), F.count("elev").alias("seen"))
    return seen.select(F.lit(x0).alias("x_min"), F.lit(y0).alias("y_min"), F.lit(x1).alias("x_max"), F.lit(y1).alias("y_max"), "cells", "seen")


@_query(f"with {_SQL_SEP} select count(*) filter (elev is not null and sep is null) as missing, count(*) filter (elev is not null and sep is null and unc > case when elev > 0 then 3::double else 3::double - 0.06::double * elev end) as kept from one")
def raster_outside_counts(spark, d):
    return ras.outside_counts(ras.stacked(ras.masked(fx.cells(spark, d), fx.raster()), _plan(spark, d), fx.raster()))


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


@_query(f"with {fx.SQL_CELLS}, one as (select row, col, any_value(elev) as elev, any_value(contributor) as contributor from cells where row < 300 group by 1, 2) select row, col, elev::float::double as elev, contributor from one where elev is not null")
def geotiff_round_trip(spark, d):
    """Cells of the first 300 rows to GeoTIFF files written by tasks, and back; bands that are not there are dropped."""
    raster = replace(fx.raster(), rows=300)
    cells = ras.masked(fx.cells(spark, d, unc=False), raster).where("row < 300").dropDuplicates(["row", "col"])
    path = _scratch(spark, "tiff")
    files.write_file(spark, f"{path}/.keep", b"")
    geotiff.save_tiles(geotiff.to_tiles(cells, raster, ["elev", "contributor"], ["Elevation", "Contributor"]), path)
    back = geotiff.read_cells(spark, path)
    row = F.round((raster.geotransform[3] - F.col("y")) / -raster.geotransform[5] - 0.5).cast("int")
    elev = F.get("values", F.lit(0))
    return back.select(row.alias("row"), "col", elev.alias("elev"), F.get("values", F.lit(1)).alias("contributor")).where(~F.isnan("elev"))


@_query(f"with {fx.SQL_POINTS} select x::varchar || ' ' || y::varchar || ' ' || pid::varchar as line from pts")
def csv_export(spark, d):
    """One line for each point, without a header; columns that are not there are left out."""
    path = _scratch(spark, "csv")
    p = fx.points(spark, d)
    write_csv(p.select("x", "y", F.col("pid").alias("z")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@_query("select 'r' || n_nationkey as region, -180::double + n_nationkey as lon0, ((n_nationkey * 2 + 3) % 7)::double as first, ((n_nationkey * 2 + 2) % 7)::double as last from nation")
def grid_signed_longitude(spark, d):
    """Grids of four columns from 178 degrees: the two from 180 on come first afterwards."""
    n = F.col("n_nationkey")
    rows = fx.table(spark, d, "nation").select(F.concat(F.lit("r"), n).alias("region"), n, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: ((n * 2 + j + 1) % 7).cast("double")).alias("vals"))
    turned, lattice = gtx.to_signed_longitude(rows, Lattice(0.0, 178.0, 1.0, 1.0, 1, 4))
    return turned.select("region", (F.lit(lattice.lon0) + n).alias("lon0"), F.get("vals", F.lit(0)).alias("first"), F.get("vals", F.lit(3)).alias("last"))


# A directory of grid files ------------------------------------------------------------------------------------------

_SQL_DIR = f"""{fx.SQL_POINTS}, {fx.SQL_DIRECTORY},
use as (select * from dreg where n in (0, 1, 6)),
cand as (select *, (y - y0) * 16 as fi, (x - x0) * 16 as fj, (y - 34.5::double) * 4 as gi, (x + 76.5::double) * 4 as gj from pts join use on y >= y0 and y <= y0 + 0.625::double and x >= x0 and x <= x0 + 0.625::double),
cell as (select *, least(floor(fi), 9)::bigint as i, least(floor(fj), 9)::bigint as j, least(floor(gi), 11)::bigint as a, least(floor(gj), 11)::bigint as b from cand),
frac as (select *, fi - i as t, fj - j as u, gi - a as p, gj - b as q from cell)"""


def _sql_dir_values() -> str:
    node = lambda k, i, j: f"(case when (({i}) * 11 + ({j}) + n) % 37 = 0 then null else ((n * 31 + {k} * 17 + ({i}) * 7 + ({j}) * 3) % 64) / 64::double end)"
    grid = lambda k: " + ".join(f"{w} * {node(k, f'i + {di}', f'j + {dj}')}" for w, di, dj in (("(1 - u) * (1 - t)", 0, 0), ("u * (1 - t)", 0, 1), ("(1 - u) * t", 1, 0), ("u * t", 1, 1)))
    geoid = " + ".join(f"{w} * (((a + {di}) * 7 + (b + {dj}) * 3) % 64) / 64::double" for w, di, dj in (("(1 - q) * (1 - p)", 0, 0), ("q * (1 - p)", 0, 1), ("(1 - q) * p", 1, 0), ("q * p", 1, 1)))
    return f"""{_SQL_DIR}, found as (select pid, n, region, z - ({geoid}) + ({grid(0)}) - ({grid(1)}) as zz from frac),
pick as (select *, row_number() over (partition by pid order by n desc) as rn from found where zz is not null)"""


def _directory(spark, d) -> tuple[str, str]:
    return fx.write_directory(spark, fx.table(spark, d, "nation").count())


@_query(f"""with {_sql_dir_values()} select p.pid, round_even(-(zz) * 1000::double, 0) / 1000::double + 0::double as z, k.region,
  case when n = 6 then ((0::double + 0.05::double) + 0.25::double) + 0.5::double else ((0::double + 0.05::double) + (n + 1.5::double) * 0.01::double) + 2::double * 0.01::double end as unc
  from pts p left join pick k on p.pid = k.pid and k.rn = 1""")
def directory_to_result(spark, d):
    """A directory of GTX and GeoTIFF grids with a geoid of their own, sigmas, polygons, a release and an external directory; its regions by the points' extents; heights to chart datum."""
    base, other = _directory(spark, d)
    cat = files.load_catalog(spark, base, dict.fromkeys(fx.DIR_REGIONS, fx.DIR_GEOID), files.release(spark, base), external=(other,))
    outlines = files.polygons(spark, other)
    request = Request(cat, files.polygons(spark, base).unionByName(outlines), outlines).set_input((6318, "ellipse")).set_output("mllw")
    request = request.set_region_by_bounds(-76.0, 35.0, -74.3, 35.4)  # three regions lie north of it, one polygon has no valid name
    return request.transform(fx.points(spark, d), uncertainty=True).select("pid", "z", "region", "unc")


@_query(f"""with {fx.SQL_DIRECTORY} select 'grid' as kind, region || '/' || layer || case when n % 2 = 1 then '.tif' else '.gtx' end as item, case when n % 2 = 1 then null else 40 + 4 * 121 end::bigint as n from dreg, (values ('tss'), ('mllw')) as l(layer) where n < 6
  union all select 'polygon', region, 5 from dreg union all select 'sigma', region, 2 from dreg where n < 6
  union all values ('release', '{fx.RELEASE}', 1::bigint), ('external', 'EXT1', 2), ('by digest', 'b', 1), ('bounds', 'R0inner', 1)""")
def directory_listings(spark, d):
    """What a directory holds: grids with their lengths, polygons with their corners, sigmas, the release by file and by digests, external regions."""
    base, other = _directory(spark, d)
    row = lambda kind, item, n: (F.lit(kind).alias("kind"), item.alias("item"), n.cast("long").alias("n"))
    listed = files.grid_listing(spark, base)
    out = listed.select(*row("grid", F.col("file"), F.when(F.endswith("file", F.lit(".gtx")), F.col("length"))))
    both = files.polygons(spark, base).unionByName(files.polygons(spark, other))
    out = out.unionByName(both.select(*row("polygon", F.col("region"), F.size("ring"))))
    found = ops.sigma_by_region(files.sigma(spark, base), listed.select("region").distinct())
    out = out.unionByName(found.groupBy("region").agg(F.count(F.lit(1)).alias("c")).select(*row("sigma", F.col("region"), F.col("c"))))
    digests = files.grid_digests(spark, base)
    known = digests.select(F.lit("a").alias("release"), "file", F.reverse("md5").alias("md5")).unionByName(digests.select(F.lit("b").alias("release"), "file", "md5"))
    ext = files.external_regions(spark, other)
    cat = files.load_catalog(spark, base, dict.fromkeys(fx.DIR_REGIONS, fx.DIR_GEOID))
    few = [("release", files.release(spark, base), 1), ("by digest", ops.release_match(digests, known).first()["release"], 1), ("bounds", *[r.name for r in cat.within(-76.0, 35.0, -75.99, 35.01).regions], 1)]
    out = out.unionByName(files.external_sigmas(ext).groupBy("region").agg(F.count(F.lit(1)).alias("c")).select(*row("external", F.col("region"), F.col("c"))))
    return out.unionByName(spark.createDataFrame(few, "kind string, item string, n long"))


# Catalogue ----------------------------------------------------------------------------------------------------------

_BOX = (-75.3, 35.3, -74.9, 35.9)


def _polygons(spark, d):
    n = F.col("n_nationkey")
    x0, y0 = F.lit(-76.05) + (n % 5) * F.lit(0.4), F.lit(34.95) + F.floor(n / 5) * F.lit(0.4)
    name = F.when(n % 4 == 3, "other").otherwise("valid-transform-area")
    return fx.table(spark, d, "nation").select(F.concat(F.lit("r"), n).alias("region"), n.alias("feature"), name.alias("name"), ops.box_ring(x0, y0, x0 + 0.5, y0 + 0.5).alias("ring"))


_SQL_MEET = "x0 <= -74.9::double and x0 + 0.5::double >= -75.3::double and y0 <= 35.9::double and y0 + 0.5::double >= 35.3::double"


@_query(f"with {fx.SQL_REGIONS} select region from reg where ord % 4 <> 3 and {_SQL_MEET}")
def regions_by_bbox(spark, d):
    return ops.regions_by_box(_polygons(spark, d), _BOX)


@_query(f"with {fx.SQL_REGIONS} select region, case when ord % 4 <> 3 then 'named' else 'fallback' end as source from reg where {_SQL_MEET}")
def regions_external_fallback(spark, d):
    polygons = _polygons(spark, d)
    return ops.regions_with_fallback(polygons, polygons.where("feature % 4 = 3"), _BOX)


def _release_geoids(spark, d):
    geoid = F.get(F.array(*map(F.lit, fx.GEOIDS)), F.col("n_regionkey"))
    return fx.table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("r"), "n_nationkey").alias("region"), geoid.alias("geoid"))


def _external(spark, d):
    s = fx.table(spark, d, "supplier").where("s_nationkey % 2 = 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.concat(F.lit("r"), "s_nationkey").alias("region"), F.lit("core\\geoid12b\\g2012bu0.gtx").alias("reference_geoid"), F.lit("NAD83(2011)").alias("reference_frame"), "n")


def _regions(spark, d):
    return fx.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("region"))


_SQL_GEOID = "case n_regionkey " + " ".join(f"when {i} then '{g}'" for i, g in enumerate(fx.GEOIDS)) + " end"
_SQL_EXT = "n_nationkey in (select s_nationkey from supplier where s_nationkey % 2 = 0)"


@_query(f"select 'r' || n_nationkey as region, case when n_nationkey % 3 <> 0 then {_SQL_GEOID} when {_SQL_EXT} then 'core\\geoid12b\\g2012bu0.gtx' end as geoid from nation")
def geoid_lookup(spark, d):
    return ops.geoid_lookup(_regions(spark, d), _release_geoids(spark, d), _external(spark, d))


_SQL_FRAME = "case n_regionkey " + " ".join(f"when {i} then '{GEOID_FRAMES[g]}'" for i, g in enumerate(fx.GEOIDS)) + " end"


@_query(f"select 'r' || n_nationkey as region, case when n_nationkey % 3 <> 0 then {_SQL_FRAME} when {_SQL_EXT} then 'NAD83(2011)' end as frame from nation")
def frame_lookup(spark, d):
    return ops.frame_lookup(_regions(spark, d), _release_geoids(spark, d), ops.geoid_frames(spark), _external(spark, d))


def _sigma_lines(spark, d):
    n, p = F.col("n_nationkey"), F.col("n_regionkey")
    kinds = F.explode(F.array(F.lit(".navd88.lmsl="), F.lit(".lmsl.mllw="), F.lit(".lmsl.mhw="), F.lit(".mllw.mhw="), F.lit("=")))
    lines = fx.table(spark, d, "nation").select(n, p, kinds.alias("kind")).select(F.concat(F.lit("r"), n, F.lit("x"), "kind", F.when(n % 6 == 5, "n/a").otherwise(F.concat(F.lit(" "), p + 1, F.lit(".5 ")))).alias("line"))
    more = ["conus.navd88.nad83=5.0", "conus.xgeoid17b.itrf2008=3.0", "conus.other.thing=2.0", "# text", "a.b=c=d"]
    return lines.unionByName(lines.sparkSession.createDataFrame([(x,) for x in more], "line string"))


_SQL_SIGMA = """sig as (select 'r' || n_nationkey || 'x' as region, layer, (case when n_nationkey % 6 = 5 then 0::double else (n_regionkey + 1)::double + 0.5::double end) * 0.01::double as sigma_m
  from nation, (values ('tss'), ('mllw'), ('mhw')) as l(layer))"""


@_query(f"with {_SQL_SIGMA} select * from sig union all values ('conus', 'geoid12b', 5 * 0.01::double), ('conus', 'xgeoid17b', 3 * 0.01::double)")
def sigma_parse(spark, d):
    return ops.parse_sigma(_sigma_lines(spark, d))


def _folders(spark, d):
    return fx.table(spark, d, "nation").select(F.concat(F.lit("R"), "n_nationkey", F.lit("x"), F.lit("inner01")).alias("region"))


_SQL_MATCH = f"""with {_SQL_SIGMA}, f as (select 'R' || n_nationkey || 'xinner01' as region from nation),
m as (select sig.region as entry, f.region, layer, sigma_m from sig join f on starts_with(lower(f.region), sig.region))"""


@_query(f"{_SQL_MATCH} select entry, region, layer, sigma_m from m")
def sigma_prefix_match(spark, d):
    return ops.sole_sigma(ops.sigma_by_region(ops.parse_sigma(_sigma_lines(spark, d)), _folders(spark, d)))


@_query("""select 'r' || n_nationkey as entry, count(distinct 'R' || o.k || 'inner') as matches from nation join (select n_nationkey as k from nation) o on starts_with('r' || o.k || 'inner', 'r' || n_nationkey) group by 1 having count(*) > 1""")
def sigma_ambiguous(spark, d):
    lines = fx.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey", F.lit(".lmsl.mllw=1")).alias("line"))
    folders = fx.table(spark, d, "nation").select(F.concat(F.lit("R"), "n_nationkey", F.lit("inner")).alias("region"))
    return ops.sigma_by_region(ops.parse_sigma(lines), folders).where("matches > 1").select("entry", "matches").distinct()


def _wanted(spark, d):
    layer = F.explode(F.array(*map(F.lit, fx.LAYERS[1:4])))
    return fx.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("region"), layer.alias("layer")).withColumn("grid", F.concat("region", F.lit("\\"), "layer", F.lit(".gtx")))


def _files(spark, d):
    n, k = F.col("n_nationkey"), F.array_position(F.array(*map(F.lit, fx.LAYERS)), F.col("layer")).cast("int") - 1
    rows = fx.table(spark, d, "nation").select(n, F.explode(F.array(*map(F.lit, fx.LAYERS[1:4]))).alias("layer"))
    ext = F.get(F.array(F.lit(".gtx"), F.lit(".tif"), F.lit(".tiff"), F.lit(".asc")), ((n + k) % 4).cast("int"))
    return rows.select(F.concat(F.lit("r"), n, F.lit("/"), "layer", ext).alias("file"), F.md5(F.concat(F.lit("r"), n, "layer").cast("binary")).alias("md5"))


_SQL_FILES = """files as (select n_nationkey as n, layer, k, ['.gtx', '.tif', '.tiff', '.asc'][(n_nationkey + k) % 4 + 1] as ext, md5('r' || n_nationkey || layer) as md5
  from nation, (values ('tss', 1), ('mllw', 2), ('mhw', 3)) as l(layer, k))"""


@_query(f"with {_SQL_FILES} select 'r' || n || '\\' || layer || '.gtx' as grid, case when ext <> '.asc' then 'r' || n || '/' || layer || ext end as found from files")
def grid_extension_repair(spark, d):
    return ops.repair_extensions(_wanted(spark, d), _files(spark, d))


@_query(f"with {_SQL_FILES} select 'r' || n as region, bool_and(ext <> '.asc') as valid from files group by 1")
def grid_exists(spark, d):
    return ops.grid_exists(_wanted(spark, d), _files(spark, d))


def _releases(spark, d):
    files = _files(spark, d)
    n = F.regexp_extract("file", r"^r(\d+)/", 1).cast("int")
    as_release = lambda name, rows, md5=F.col("md5"): rows.select(F.lit(name).alias("release"), "file", md5.alias("md5"))
    return as_release("a", files.where(n % 5 != 0)).unionByName(as_release("b", files)).unionByName(as_release("c", files, F.when(n % 7 == 0, F.md5(F.col("file").cast("binary"))).otherwise(F.col("md5"))))


@_query("select 'b' as release")
def release_match(spark, d):
    return ops.release_match(_files(spark, d), _releases(spark, d))


@_query(f"""with {_SQL_FILES} select 'r' || n || '/' || layer || ext as file, case when n % 5 = 0 then 'added' else 'changed' end as change from files where n % 5 = 0 or n % 7 = 0""")
def release_diff(spark, d):
    return ops.release_diff(_releases(spark, d), "a", "c")


_SQL_OVER = "select 'r' || n_nationkey as region, 'base' as origin from nation where not " + _SQL_EXT


@_query(_SQL_OVER + " union all select distinct 'r' || s_nationkey, 'external' from supplier where s_nationkey % 2 = 0")
def external_override(spark, d):
    return ops.override(_regions(spark, d).withColumn("origin", F.lit("base")), _external(spark, d).select("region", F.lit("external").alias("origin")))


@_query(_SQL_OVER)
def external_remove(spark, d):
    return ops.removed(_regions(spark, d).withColumn("origin", F.lit("base")), _external(spark, d))


# Texts --------------------------------------------------------------------------------------------------------------

_G, _T = "'+proj=vgridshift grids=@G@'", "'+inv +proj=vgridshift grids=@R@\\tss.gtx'"
_L = lambda x: f"'+proj=vgridshift grids=@R@\\{x}.gtx'"
#: Definitions and their algebra in SQL: layers that agree place by place go, the rest of the source is turned round.
_SQL_PIPELINES = f"""with r as (select 'r' || n_nationkey as region, {"{geoid}"} as geoid from nation),
d(name, steps) as (values ('ellipse', []::varchar[]), ('geoid', [{_G}]), ('navd88', [{_G}]), ('tss', [{_G}, {_T}]), ('mllw', [{_G}, {_T}, {_L('mllw')}]), ('noaa chart datum', [{_G}, {_T}, {_L('mllw')}]),
  ('mhw', [{_G}, {_T}, {_L('mhw')}]), ('noaa chart height', [{_G}, {_T}, {_L('mhw')}]), ('mtl', [{_G}, {_T}, {_L('mtl')}]), ('dtl', [{_G}, {_T}, {_L('dtl')}]), ('lwrp2007', [{_G}, {_L('lwrp2007')}]), ('hrd', [{_G}, {_L('hrd')}])),
p as (select a.name as source, b.name as target, [a.steps[i] for i in range(1, len(a.steps) + 1) if coalesce(a.steps[i] <> b.steps[i], true)] as back,
  [b.steps[i] for i in range(1, len(b.steps) + 1) if coalesce(a.steps[i] <> b.steps[i], true)] as forth from d a, d b),
t as (select source, target, case when source <> target then array_to_string(['+proj=pipeline'] || list_reverse([case when starts_with(x, '+inv ') then substr(x, 6) else '+inv ' || x end for x in back]) || forth, ' +step ') end as text from p)
select source, target, region, replace(replace(text, '@R@', region), '@G@', geoid) as pipeline from t, r"""


@_query(_SQL_PIPELINES.replace("{geoid}", _SQL_GEOID))
def pipeline_strings(spark, d):
    """Compiled on the driver per pair of datums with placeholders, filled in per region."""
    pairs = [(s, t, pipeline_text(s, t, "@R@", "@G@")) for s in DEFINITIONS for t in DEFINITIONS]
    geoid = F.get(F.array(*map(F.lit, fx.GEOIDS)), F.col("n_regionkey"))
    regions = fx.table(spark, d, "nation").select(F.concat(F.lit("r"), "n_nationkey").alias("region"), geoid.alias("geoid"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target"), F.lit(p).cast("string").alias("p")) for s, t, p in pairs])).alias("pair")
    filled = F.replace(F.replace(F.col("pair.p"), F.lit("@R@"), F.col("region")), F.lit("@G@"), F.col("geoid"))
    return regions.select("region", "geoid", each).select("pair.source", "pair.target", "region", filled.alias("pipeline"))


_DATUMS = "[" + ", ".join(f"'{x}'" for x in DEFINITIONS) + "]"


@_query(f"""with t as (select p_partkey, p_name || ' ' || ({_DATUMS} || ['Mean', 'water'])[(p_partkey % 14 + 1)::int] as text from part),
g as (select p_partkey, text, list_filter({_DATUMS}, lambda x: contains(lower(text), x)) as found from t)
select p_partkey, len(found) as n, case when len(found) = 1 then found[1] when len(found) = 0 then '' end as datum from g""")
def datum_guess(spark, d):
    """Per row; the driver's guess_datum() fails where n is over 1."""
    names = F.array(*map(F.lit, [*DEFINITIONS, "Mean", "water"]))
    text = F.concat("p_name", F.lit(" "), F.get(names, (F.col("p_partkey") % 14).cast("int")))
    return ops.guess_datums(fx.table(spark, d, "part").select("p_partkey", text.alias("text"))).drop("text")


@_query("""select 'r' || n_nationkey as region, 'rel' || n_regionkey as vdatum, 'v1' as version, 2 as regions, ['r' || n_nationkey, 's' || n_nationkey][2] as second, 'q ' || n_nationkey as pipeline, 'NAD83(2011)' as frame from nation""")
def wkt_remark_parse(spark, d):
    n = F.col("n_nationkey")
    text = F.concat(F.lit('VERTCRS["x",REMARK["vdatum=rel'), "n_regionkey", F.lit(",library=v1,base_datum=[NAD83(2011),ITRF2008],regions=[r"), n, F.lit(", s"), n, F.lit("],pipelines=[p;q "), n, F.lit(']"]]'))
    rows = fx.table(spark, d, "nation").select(F.concat(F.lit("r"), n).alias("region"), crs.parse_remark(text).alias("m"))
    return rows.select("region", "m.vdatum", "m.version", F.size("m.regions").alias("regions"), F.get("m.regions", F.lit(1)).alias("second"), F.get("m.pipelines", F.lit(1)).alias("pipeline"), F.get("m.base_datum", F.lit(0)).alias("frame"))


_SQL_VERTCRS = """select d as datum, 'VERTCRS["' || d || '",VDATUM["' || d || '"],CS[vertical,1],AXIS["' || a || ',LENGTHUNIT["metre",1],]' as wkt from
  (select unnest(['ellipse']) as d, 'ellipsoid height (h)",up]' as a union all select unnest(['geoid', 'navd88', 'tss']), 'gravity-related height (H)",up]'
   union all select unnest(['mllw', 'noaa chart datum', 'mhw', 'noaa chart height', 'mtl', 'dtl', 'lwrp2007', 'hrd']), 'depth (D)",down]')"""


@_query(_SQL_VERTCRS)
def wkt_vertcrs_build(spark, d):
    return spark.createDataFrame([(n, crs.VerticalCrs(n).to_wkt()) for n in DEFINITIONS], "datum string, wkt string")


_G12, _A17 = "core\\geoid12b\\g2012bu0.gtx", "core\\xgeoid17b\\AK_17B.gtx"
_DERIVED = (
    'VERTCRS["Chart",BASEVERTCRS["NAD83(2011) Height",VDATUM["NAD83(2011) Height"],ID["EPSG",6319]],DERIVINGCONVERSION["up to chart",METHOD["gtx grid transformation", ID["EPSG",1084]],'
    'PARAMETERFILE["g", "core\\g.gtx", ID["maker", "first", "1/2/2012"]],PARAMETERFILE["t", "r\\t.gtx", ID["maker", "second", "3/4/2013"]]],VDATUM["Chart"],CS[vertical,1],AXIS["ellipsoid height (h)",up],LENGTHUNIT["metre",1]]'
)


def _text_cases(spark, d) -> list[tuple[str, str]]:
    """name, text of what the driver's operators on systems and settings say."""
    geoids = {"A": _G12, "B": _G12, "K": _A17}

    def error(f) -> str:
        try:
            return str(f())
        except Exception as e:
            return type(e).__name__

    pair = crs.CrsPair(geoids, "rel")
    tss, chart = (crs.VerticalCrs(n).with_pipeline("p", "A") for n in ("tss", "noaa chart datum"))
    derived = crs.DerivedVertical("Chart", "NAD83(2011) Height", "up to chart", "gtx grid transformation", (("maker", "g", "core\\g.gtx", "first", "1/2/2012"), ("maker", "t", "r\\t.gtx", "second", "3/4/2013")), "ellipsoid height (h)", "metre")
    lattice = Lattice(0.0, 0.0, 1.0, 1.0, 2, 2)
    cat = Catalog((Region("A", _G12, {"geoid": lattice}), Region("K", _A17, {"geoid": lattice})), None, {"A": {"tss": 0.25}}, {"geoid12b": 0.5, "xgeoid17b": 0.125})
    path = f"{tempfile.mkdtemp()}/own.config"
    settings.write_setting(path, "grids_path", "/g")
    settings.write_setting(path, "other_path", "/o")
    log = settings.run_log(path, f"{path}.log")
    log.warning("noted")
    return [
        ("known datum", error(lambda: plan(cat, "ellipse", "nowhere"))),
        ("between systems", crs.transformation_pipeline(tss, chart, "A", _G12)),
        ("region not in either", error(lambda: crs.transformation_pipeline(tss, chart, "Z", _G12))),
        ("bound regions", pair.set((26918, "mllw"), ["A", "B"]).vertical.regions_text),
        ("bound pipelines", pair.set((26918, "tss"), ["A"]).vertical.pipelines_text),
        ("geoid by family", pair.set((26918, "geoid"), ["A", "B"]).vertical.name),
        ("mixed geoids", error(lambda: pair.set((26918, "geoid"), ["A", "K"]))),
        ("three dimensions", str((pair.set(6319).horizontal, pair.set(6319).with_regions(["A"]).datum))),
        ("system by code", str((pair.set(5866).vertical.name, pair.set(5866).vertical.axis))),
        ("not whole", str(pair.set("mllw").is_valid)),
        ("parameter file", crs.parameter_file("maker", "g", "core\\g.gtx", "first", "1/2/2012")),
        ("conversion", crs.deriving_conversion("a to b", "asc file", [])),
        ("base", crs.base_vertical("WGS84 Height")),
        ("derived", derived.to_wkt()),
        ("derived read", str(crs.DerivedVertical.from_wkt(_DERIVED) == derived)),
        ("parameter files", "; ".join(",".join(f) for f in crs.wkt_parameter_files(_DERIVED))),
        ("remark", crs.Remark(("A",), ("p",), "rel", "v", ("NAD83(2011)",)).text()),
        ("axis", crs.coordinate_system("Depth")),
        ("compound", str([wkt.is_compound(t) for t in ('COMPOUNDCRS["c",PROJCRS["p"],VERTCRS["v"]]', 'COMPOUNDCRS["c",VERTCRS["v"],PROJCRS["p"]]', 'VERTCRS["v"]')])),
        ("pretty", wkt.pretty('VERTCRS["v, AXIS[",VDATUM["v",ID["E",1]],CS[vertical,1]]')),
        ("metadata", crs.datum_wkt("ellipse", 26914, {})),
        ("actual geoid sigma", str([output_sigma(cat, "ellipse", "tss", r, geoid_sigma="actual", missing="zero") for r in ("A", "K")])),
        ("missing sigma", error(lambda: output_sigma(cat, "ellipse", "mllw", "K"))),
        ("rising bounds", error(lambda: cat.within(1, 1, 0, 2, strict=True))),
        ("no region", error(lambda: plan(cat.only([]), "ellipse", "geoid"))),
        ("settings", str(settings.read_settings(path))),
        ("setting removed", str(settings.write_setting(path, "other_path", None))),
        ("log", open(f"{path}.log").read().split(" - ")[-1].strip()),
        ("release date", str((settings.release_date(fx.RELEASE), settings.release_date("x")))),
    ]


_EXPECTED = [
    ("known datum", "ValueError"), ("between systems", "+proj=pipeline +step +proj=vgridshift grids=A\\mllw.gtx"), ("region not in either", "NotImplementedError"), ("bound regions", "[A,B]"),
    ("bound pipelines", "[+proj=pipeline +step +proj=vgridshift grids=core\\geoid12b\\g2012bu0.gtx +step +inv +proj=vgridshift grids=A\\tss.gtx]"), ("geoid by family", "geoid12b"), ("mixed geoids", "NotImplementedError"),
    ("three dimensions", "(6318, 'ellipse')"), ("system by code", "('mllw', 'depth')"), ("not whole", "False"), ("parameter file", 'PARAMETERFILE["g", "core\\g.gtx", ID["maker", "first", "1/2/2012"]]'),
    ("conversion", 'DERIVINGCONVERSION["a to b",METHOD["asc file", ID["EPSG",1085]]]'), ("base", 'BASEVERTCRS["WGS84 Height",VDATUM["WGS84 Height"],ID["EPSG",4979]]'), ("derived", _DERIVED), ("derived read", "True"),
    ("parameter files", "maker,g,core\\g.gtx,first,1/2/2012; maker,t,r\\t.gtx,second,3/4/2013"), ("remark", 'REMARK["vdatum=rel,library=v,base_datum=[NAD83(2011)],regions=[A],pipelines=[p]"]'),
    ("axis", 'CS[vertical,1],AXIS["depth (D)",down],LENGTHUNIT["metre",1]'), ("compound", "[True, False, False]"), ("pretty", 'VERTCRS["v, AXIS[",\n  VDATUM["v",\n    ID["E",1]],\n  CS[vertical,1]]'),
    ("metadata", 'VERTCRS["ellipse",VDATUM["NAD83 / UTM zone 14N + ellipse"],CS[vertical,1],AXIS["ellipsoid height (h)",up,LENGTHUNIT["metre",1]]]'), ("actual geoid sigma", "[0.75, 0.125]"), ("missing sigma", "KeyError"),
    ("rising bounds", "AssertionError"), ("no region", "ValueError"), ("settings", "{'grids_path': '/g', 'other_path': '/o'}"), ("setting removed", "{'grids_path': '/g'}"), ("log", "noted"), ("release date", "('2020-12-03', None)"),
]


@_query("select * from (values " + ", ".join("('" + a + "', '" + b.replace("'", "''").replace("\n", "' || chr(10) || '") + "')" for a, b in _EXPECTED) + ") as t(name, text)")
def driver_texts(spark, d):
    """The driver's side: datums, systems, settings and log, against texts written out."""
    return spark.createDataFrame(_text_cases(spark, d), "name string, text string")


@_query("select r_regionkey as k, case when r_regionkey % 3 = 0 then 6318 when r_regionkey % 3 = 1 then 9000 else 26918 end as horizontal, case when r_regionkey % 3 < 2 then 'ellipse' end as datum from region")
def three_dimensional_systems(spark, d):
    codes = F.get(F.array(F.lit(6319), F.lit(7912), F.lit(26918)), (F.col("r_regionkey") % 3).cast("int"))
    rows = fx.table(spark, d, "region").select("r_regionkey", codes.alias("epsg"))
    return rows.join(ops.reduced_3d(rows.select("epsg").distinct()), "epsg").select(F.col("r_regionkey").alias("k"), "horizontal", "datum")


@_query(f"with {_SQL_FILES} select 'u' as release, 'r' || n || '/' || layer || ext as file from files where false")
def digest_table_order(spark, d):
    """No entry of a sorted table stands before one of a lower name."""
    rows = _files(spark, d).select(F.lit("u").alias("release"), "file")
    return ops.unsorted_keys(rows.withColumn("place", F.row_number().over(Window.orderBy("file"))))


@_query("select 'r' || n_nationkey as grid, case when n_nationkey % 3 = 0 then '/b' else '/a' end as found from nation")
def grid_last_directory(spark, d):
    places = _regions(spark, d).withColumnRenamed("region", "grid")
    third = F.expr("cast(substring(grid, 2) as int) % 3 = 0")
    return ops.last_found(places.select("grid", F.lit(0).alias("place"), F.lit("/a").alias("path")).unionByName(places.where(third).select("grid", F.lit(1).alias("place"), F.lit("/b").alias("path"))))


@_query("select 'f' || r_regionkey as source, k as key, case k when 'frame' then 'NAD83(2011)' when 'layer' then r_name else '0.' || r_regionkey end as value from region, (values ('frame'), ('layer'), ('unc')) as t(k)")
def ini_flatten(spark, d):
    text = F.concat(F.lit("[a]\nFrame = NAD83(2011)\nunc: 9\n\n; note\n[b]\nlayer="), "r_name", F.lit("\nunc = 0."), "r_regionkey", F.lit("\n"))
    return ops.flat_ini(fx.table(spark, d, "region").select(F.concat(F.lit("f"), "r_regionkey").alias("source"), text.alias("text")))


@_query("select (event_id % 360)::double as tar_lon, case when event_id % 7 <> 0 then (event_id % 90) / 2::double end as tar_lat, value as tar_height from events")
def json_response(spark, d):
    """Replies of the point service; a field that is no number is null."""
    lat = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 90 / 2).cast("string")).otherwise("n/a")
    reply = F.to_json(F.struct((F.col("event_id") % 360).cast("string").alias("tar_lon"), lat.alias("tar_lat"), F.col("value").cast("string").alias("tar_height"), F.lit("x").alias("other")))
    return files.parse_reply(fx.table(spark, d, "events").select(reply.alias("reply")))


# Numbers ------------------------------------------------------------------------------------------------------------

@_query(f"with {fx.SQL_POINTS} select pid, fmod(x + 720::double, 360::double) as east, fmod(fmod(x + 180::double, 360::double) + 360::double, 360::double) - 180::double as west from pts")
def lon_wrap(spark, d):
    x = F.col("x")
    return fx.points(spark, d).select("pid", wrap(x + 720.0).alias("east"), (wrap(F.pmod(x + 180.0, F.lit(360.0)) + 360.0) - 180.0).alias("west"))


@_query(f"""with {fx.SQL_POINTS}, {fx.SQL_REGIONS}, c as (select pid, ord, trunc((x - x0) / 0.05::double)::bigint as j, trunc((y - y0) / 0.05::double)::bigint as i from pts, reg where ord = 12)
select pid, case when i between 0 and 10 and j between 0 and 10 then {fx.sql_node('tss', 'i', 'j')} end as value from c""")
def cell_lookup_truncate(spark, d):
    """The node at the truncated index, of one grid; nothing beside it."""
    x0, y0 = fx.corner(12)
    rows = fx.grid_rows(spark, d).where("region = 'r12' and layer = 'tss'")
    return ops.cell_values(fx.points(spark, d), rows, Lattice(y0, x0, fx.SPACING, fx.SPACING, fx.NODES, fx.NODES)).select("pid", "value")


def _projected(epsg: int) -> Query:
    def run(spark, d):
        east, north = geodesy.PROJECTIONS[epsg].forward(F.col("x"), F.col("y"))
        return fx.points(spark, d).select("pid", half_even(east, 2).alias("east"), half_even(north, 2).alias("north"))

    return run


_QUERIES["utm_forward"] = _projected(26918)
_QUERIES["lcc_forward"] = _projected(3631)
_QUERIES["oblique_forward"] = lambda spark, d: fx.points(spark, d).select("pid", *[half_even(c, 2).alias(n) for c, n in zip(geodesy.PROJECTIONS[3468].forward(F.col("x") - 61.0, F.col("y") + 22.0), ("east", "north"))])


_CM = "round_even(east * 100, 0) / 100 + 0::double as east, round_even(north * 100, 0) / 100 + 0::double as north"
_SQL["utm_forward"] = f"with {fx.SQL_POINTS}, {geo.utm_forward_ctes('pts', -75)} select pid, {_CM} from utm"
_SQL["lcc_forward"] = f"with {fx.SQL_POINTS}, {geo.lambert_ctes('pts', '33.75::double', '-79', '36::double + 10::double / 60', '34::double + 20::double / 60', '609601.22::double', '0::double')} select pid, {_CM} from lcc"
_SQL["oblique_forward"] = f"with {fx.SQL_POINTS}, far as (select pid, x - 61 as x, y + 22 as y from pts), {geo.oblique_ctes('far')} select pid, {_CM} from om"


def _inverse(epsg: int, dx: float = 0.0, dy: float = 0.0) -> Query:
    def run(spark, d):
        there = fx.points(spark, d).withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
        east, north = geodesy.PROJECTIONS[epsg].forward(F.col("x"), F.col("y"))
        moved = there.select("pid", "x", "y", F.struct(east.alias("e"), north.alias("n")).alias("m"))
        lon, lat = geodesy.PROJECTIONS[epsg].inverse(F.col("m.e"), F.col("m.n"))
        return moved.select("pid", half_even(lon, 7).alias("lon"), half_even(lat, 7).alias("lat"))

    return run


for _n, _e, _dx, _dy in (("utm_inverse", 26918, 0, 0), ("lcc_inverse", 3631, 0, 0), ("oblique_inverse", 3468, -61, 22)):
    _query(f"with {fx.SQL_POINTS} select pid, round_even((x + {_dx}) * 1e7::double, 0) / 1e7::double as lon, round_even((y + {_dy}) * 1e7::double, 0) / 1e7::double as lat from pts", _n)(_inverse(_e, _dx, _dy))


@_query(f"with {fx.SQL_POINTS}, {geo.cartesian_ctes('pts', 'c', 'x', 'y', 'z')}, {geo.shift_ctes('c', 'm', 'ITRF2014')}, {geo.geographic_ctes('m', 'g', 'lon', 'lat', 'h')} select pid, round_even(h * 100, 0) / 100 + 0::double as h, true as returns from g")
def helmert_shift(spark, d):
    """ITRF2014 to NAD83(2011), and back to where it was."""
    p = fx.points(spark, d)
    xyz = geodesy.to_cartesian(F.col("x"), F.col("y"), F.col("z"))
    moved = p.select("pid", "x", "y", "z", F.struct(*[c.alias(n) for c, n in zip(geodesy.frame_shift(*xyz, "ITRF2014", True), "abc")]).alias("m"))
    there = geodesy.from_cartesian(F.col("m.a"), F.col("m.b"), F.col("m.c"))
    back = geodesy.from_cartesian(*geodesy.frame_shift(F.col("m.a"), F.col("m.b"), F.col("m.c"), "ITRF2014", False))
    return moved.select("pid", half_even(there[2], 2).alias("h"), (F.abs(back[2] - F.col("z")) < 0.001).alias("returns"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

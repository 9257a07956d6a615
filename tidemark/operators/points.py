"""Transforms of point clouds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.grid import half_even
from ..plans.catalog import Catalog
from ..plans.transform import TransformPlan, plan
from .lookup import by_region, private, separations, shifted


def _sigma(p: TransformPlan, at: Column, **options) -> Column:
    return by_region({i: p.sigma(r.name, **options) for i, r in p.regions}, at)


def _others(points: DataFrame, made: list[str]) -> list[Column]:
    """The columns of points that a result does not make itself."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in points.columns if c.lower() not in made]


def transform_points(
    points: DataFrame, catalog: Catalog, source: str, target: str, uncertainty: bool = False, nan: bool = False, digits: int | None = 3, strict_reference: bool = False,
    source_crs: int | None = None, target_crs: int | None = None, year: float | None = None, up: tuple[bool, bool] | None = None, **sigma_options,
) -> DataFrame:
    """points with z in the target datum, region_index, region, and unc if asked for.

    A missing z counts as 0; a depth is turned up before the steps and the result down again for a depth. Points that no
    region's grids cover get null z and unc (NaN x, y, z, unc with nan) and region_index -1. Of several regions the last
    counts. z is rounded half to even. Columns of points that are named like a result's give way to it; all others stay,
    whatever they are called.

    source_crs and target_crs are EPSG codes of the systems of x and y, target_crs by default source_crs; without them x
    and y are degrees in the frame of the grids. Grids are looked up, and z is shifted, in the frame of each region's
    geoid. x and y come back in target_crs: as they were where both are equal, else by way of the frames, and where the
    target is not in the geoid's frame z gets the difference of ellipsoid heights between source and target. They are
    null where a point is not covered and the systems differ.
    """
    p = plan(catalog, source, target, strict_reference, up)
    target_crs = source_crs if target_crs is None else target_crs
    prefix = private(points.columns)
    z = F.when(F.col("z").isNotNull(), F.col("z") if p.up_in else -F.col("z")).otherwise(0.0)
    rounded = (lambda c: half_even(c, digits)) if digits is not None else (lambda c: c)
    made = ["z", "region_index", "region", *(["unc"] if uncertainty else [])]
    moves = source_crs is not None and target_crs != source_crs
    frames = [] if source_crs is None else sorted({r.geoid_frame() for _, r in p.regions})
    here, geo = points.withColumn(f"{prefix}z", z), lambda frame: f"{prefix}geo{frames.index(frame)}"
    for frame in () if p.identity else frames:
        here = geodesy.add_geographic(here, geo(frame), source_crs, F.col("x"), F.col("y"), F.col(f"{prefix}z"), frame, year)
    if moves:
        here = geodesy.add_geographic(here, f"{prefix}to", source_crs, F.col("x"), F.col("y"), F.col(f"{prefix}z"), geodesy.frame_of(target_crs), year)
        made += ["x", "y"]
    if p.identity:
        found = here.withColumn(f"{prefix}f", F.struct(F.lit(0).alias("ord"), F.lit(None).cast("string").alias("region")))
        begin, home = F.col(f"{prefix}z"), geodesy.frame_of(source_crs) if moves else ""
    else:
        found = separations(here, p, out=f"{prefix}f", places={f: (F.col(geo(f))["x"], F.col(geo(f))["y"]) for f in frames} or None)
        begin, home = F.col(f"{prefix}z"), ""
        if frames:
            of = by_region({i: float(frames.index(r.geoid_frame())) for i, r in p.regions}, F.col(f"{prefix}f.ord"))
            begin = F.coalesce(*[F.when(of == k, F.col(geo(f))["h"]) for k, f in enumerate(frames)])
    covered = F.col(f"{prefix}f.ord").isNotNull()
    moved = begin if p.identity else shifted(begin, p, f"{prefix}f")
    if moves:
        lon, lat = F.col(f"{prefix}to")["x"], F.col(f"{prefix}to")["y"]
        x, y = geodesy.projected(target_crs, lon, lat)
        rise = F.col(f"{prefix}to")["h"] - F.col(f"{prefix}z")
        if p.identity:
            moved = moved + (rise if geodesy.frame_of(target_crs) != home else 0.0)
        else:  # a target in the geoid's frame already has its heights
            of_target = {i: float(r.geoid_frame() == geodesy.frame_of(target_crs) and target_crs in geodesy.FRAMES) for i, r in p.regions}
            moved = moved + F.when(by_region(of_target, F.col(f"{prefix}f.ord")) == 1.0, 0.0).otherwise(rise)
    values = {"z": rounded(moved if p.up_out else -moved)}
    if uncertainty:
        values["unc"] = F.lit(0.0) if p.identity else _sigma(p, F.col(f"{prefix}f.ord"), **sigma_options)
    if moves:
        values |= {"x": x, "y": y}
    elif nan:
        values |= {"x": F.col("x"), "y": F.col("y")}
        made += ["x", "y"]
    lost = F.lit(float("nan")) if nan else F.lit(None)
    whole = {c: F.when(covered, v).otherwise(lost) if nan else F.when(covered, v) for c, v in values.items()}
    whole |= {"region_index": F.coalesce(F.col(f"{prefix}f.ord"), F.lit(-1)), "region": F.col(f"{prefix}f.region")}
    placed = [n for n in ("x", "y") if n in whole]
    return found.select(*_others(points, made), *[whole[n].alias(n) for n in [*placed, "z", "region_index", "region", *(["unc"] if uncertainty else [])]])


def extents(points: DataFrame, nan_safe: bool = True) -> DataFrame:
    """x_min, y_min, x_max, y_max; nan_safe passes over points without x or y."""
    rows = points.where(~F.isnan("x") & ~F.isnan("y")) if nan_safe else points
    return rows.agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def geographic_extents(points: DataFrame, crs: int, nan_safe: bool = True) -> DataFrame:
    """x_min, y_min, x_max, y_max in NAD83(2011) degrees: those of the lower left and upper right corner alone."""
    box = extents(points, nan_safe)
    if geodesy.FRAMES.get(crs) == geodesy.NAD83:
        return box
    for name in ("min", "max"):
        box = geodesy.add_geographic(box, f"g{name}", crs, F.col(f"x_{name}"), F.col(f"y_{name}"), F.lit(0.0), geodesy.NAD83)
    return box.select(*[F.col(f"g{name}")[axis].alias(f"{axis}_{name}") for name in ("min", "max") for axis in "xy"])


def edges(low: float, high: float, distance: float) -> list[float]:
    """Bounds of the sampling lattice's bins along an axis: ceil(range / distance) of them from distance below to distance above."""
    low, high = low - distance, high + distance
    n = math.ceil((high - low) / distance)
    if n <= 1:
        raise ValueError("the sampling distance is too large for the data")
    return [low + k * (high - low) / (n - 1) for k in range(n)]


def bin_of(v: Column, low: float, step: float, n: int) -> Column:
    """The number of edges at or below v, less one; the quotient may be off by one, so the edges beside it decide."""
    at = lambda k: F.lit(low) + k * F.lit(step)
    k = F.floor((v - low) / step)
    k = F.when(at(k + 1) <= v, k + 1).when(at(k) > v, k - 1).otherwise(k)
    return F.least(k, F.lit(n - 1)).cast("int")


def transform_sampled(points: DataFrame, catalog: Catalog, source: str, target: str, distance: float) -> DataFrame:
    """Like transform_points, with the separation at the middle of each point's bin of a lattice; z is not rounded again.

    Points without x or y get null z and region -1, and so does a table that has no others. The lattice, not the points,
    meets the grids; it is joined back on the bin, broadcast while it is small.
    """
    p = plan(catalog, source, target)
    e, prefix = extents(points).first(), private(points.columns)
    others = _others(points, ["z", "region_index"])
    if e["x_min"] is None:
        return points.select(*others, F.lit(None).cast("double").alias("z"), F.lit(-1).alias("region_index"))
    ex, ey = edges(e["x_min"], e["x_max"], distance), edges(e["y_min"], e["y_max"], distance)
    sx, sy = ex[1] - ex[0], ey[1] - ey[0]
    spark = points.sparkSession
    xb, yb = f"{prefix}xb", f"{prefix}yb"
    nodes = spark.range((len(ex) - 1) * (len(ey) - 1)).select((F.col("id") % (len(ex) - 1)).cast("int").alias(xb), F.floor(F.col("id") / (len(ex) - 1)).cast("int").alias(yb))
    mid = lambda low, step, k: F.lit(low) + F.col(k) * F.lit(step) + F.lit(distance / 2)
    nodes = nodes.select(xb, yb, mid(ex[0], sx, xb).alias("x"), mid(ey[0], sy, yb).alias("y"), F.lit(0.0).alias("z"))
    sep = transform_points(nodes, catalog, source, target).select(xb, yb, F.col("z").alias(f"{prefix}sep"), F.col("region_index").alias(f"{prefix}ord"))
    small = F.broadcast if (len(ex) - 1) * (len(ey) - 1) <= 200_000 else (lambda t: t)
    there = ~F.isnan("x") & ~F.isnan("y")
    binned = points.withColumns({xb: F.when(there, bin_of(F.col("x"), ex[0], sx, len(ex))), yb: F.when(there, bin_of(F.col("y"), ey[0], sy, len(ey)))})
    z = F.col("z") if p.up_in == p.up_out else -F.col("z")
    out = binned.join(small(sep), [xb, yb], "left")
    return out.select(*others, (F.col(f"{prefix}sep") + z).alias("z"), F.coalesce(f"{prefix}ord", F.lit(-1)).alias("region_index"))

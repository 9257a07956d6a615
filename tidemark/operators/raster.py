"""Transforms of gridded surfaces, as tables of cells (row, col, elev, unc, contributor)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy
from ..functions.grid import half_even
from ..plans.catalog import Catalog
from ..plans.transform import TransformPlan, plan
from .lookup import by_region, private, separations, total_shift


@dataclass(frozen=True)
class Raster:
    """Geotransform (x of the corner, width, 0, y of the corner, 0, height) and size, with band names and their nodata.

    epsg is the system of its coordinates; without one they are degrees in the frame of the grids.
    """

    geotransform: tuple[float, ...]
    rows: int
    cols: int
    nodata: dict[str, float]
    epsg: int | None = None

    def bounds(self) -> tuple[float, float, float, float]:
        x0, dx, _, y0, _, dy = self.geotransform
        x1, y1 = x0 + self.cols * dx, y0 + self.rows * dy
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def xy(self) -> tuple[Column, Column]:
        """Of a cell's middle."""
        x0, dx, _, y0, _, dy = self.geotransform
        return F.lit(x0) + (F.col("col") + 0.5) * F.lit(dx), F.lit(y0) + (F.col("row") + 0.5) * F.lit(dy)


def band_roles(names: list[str]) -> dict[str, int]:
    """Places of the elevation, uncertainty and contributor band: a single band is the elevation; names are compared without case, depth before elevation."""
    low = [n.lower() for n in names]
    if len(low) == 1:
        return {"elevation": 0}
    wanted = {"elevation": ("depth", "elevation"), "uncertainty": ("uncertainty", "vertical uncertainty"), "contributor": ("contributor",)}
    return {role: next(low.index(n) for n in options if n in low) for role, options in wanted.items() if any(n in low for n in options)}


def masked(cells: DataFrame, raster: Raster) -> DataFrame:
    """nodata of each band becomes null."""
    return cells.withColumns({b: F.when(F.col(b) != v, F.col(b)) for b, v in raster.nodata.items() if b in cells.columns})


def _separations(cells: DataFrame, p: TransformPlan, raster: Raster, **options) -> tuple[DataFrame, str]:
    """cells with the struct of what is found at their middles, and its name."""
    prefix, (x, y) = private(cells.columns), raster.xy()
    if raster.epsg is None:
        return separations(cells, p, interp="nearest", out=f"{prefix}f", places={"": (x, y)}, **options), f"{prefix}f"
    frames = sorted({r.geoid_frame() for _, r in p.regions})
    here = cells
    for k, frame in enumerate(frames):
        here = geodesy.add_geographic(here, f"{prefix}geo{k}", raster.epsg, x, y, F.lit(0.0), frame)
    places = {frame: (F.col(f"{prefix}geo{k}")["x"], F.col(f"{prefix}geo{k}")["y"]) for k, frame in enumerate(frames)}
    return separations(here, p, interp="nearest", out=f"{prefix}f", places=places, **options), f"{prefix}f"


def region_separations(cells: DataFrame, p: TransformPlan, raster: Raster) -> DataFrame:
    """cells with ord, region and sep for every region whose grids hold the cell; sep is null where nodata is nearest."""
    found, f = _separations(cells, p, raster, each=True)
    return found.select(*cells.columns, F.col(f)["ord"].alias("ord"), F.col(f)["region"].alias("region"), total_shift(p, f).alias("sep"))


def valid_counts(cells: DataFrame, p: TransformPlan, raster: Raster) -> DataFrame:
    """ord, region, n: cells with a separation, for each region that has any."""
    return region_separations(cells.select("row", "col"), p, raster).where("sep is not null").groupBy("ord", "region").agg(F.count(F.lit(1)).alias("n"))


def stacked(cells: DataFrame, p: TransformPlan, raster: Raster, counts: dict[int, int] | None = None) -> DataFrame:
    """cells with sep, region_index, region: of several regions the one with most valid cells counts, of equals the later.

    No region can be chosen before all cells are counted, so cells are read twice: both passes are narrow, which costs less
    than to write and read again what each region gives each cell.
    """
    if counts is None:
        counts = {r["ord"]: r["n"] for r in valid_counts(cells, p, raster).collect()}
    found, f = _separations(cells, p, raster, order=lambda i: (counts.get(i, 0), i))
    return found.select(*cells.columns, total_shift(p, f).alias("sep"), F.coalesce(F.col(f)["ord"], F.lit(-1)).alias("region_index"), F.col(f)["region"].alias("region"))


def general_uncertainty(elev: Column, up: bool) -> Column:
    """3 - 0.06 h where no separation is known, 3 above zero; h counts upwards."""
    height = elev if up else -elev
    return F.when(height > 0, 3.0).otherwise(3 - 0.06 * height)


def outside_counts(stack: DataFrame, up: bool = True) -> DataFrame:
    """missing, kept: of stacked cells (elev, unc, sep) those with an elevation that no region covers, and those of them whose own uncertainty outweighs the general one."""
    missing = F.col("elev").isNotNull() & F.col("sep").isNull()
    return stack.agg(F.count_if(missing).alias("missing"), F.count_if(missing & (F.col("unc") > general_uncertainty(F.col("elev"), up))).alias("kept"))


def is_covered(stack: DataFrame) -> DataFrame:
    return stack.agg(F.coalesce(F.bool_and(F.col("sep").isNotNull()), F.lit(True)).alias("covered"), F.count_if(F.col("sep").isNull()).alias("missing"))


def transform_raster(
    cells: DataFrame, catalog: Catalog, source: str, target: str, raster: Raster, allow_outside: bool = False, uncertainty: bool = True, digits: int | None = None,
    up: tuple[bool, bool] | None = None, **sigma_options,
) -> DataFrame:
    """row, col, elev, unc, contributor (as far as there), region_index in the target datum.

    Cells without elevation are nodata in all bands. Where no region gives a separation, cells are nodata, or with
    allow_outside keep their elevation, turned to the target's direction, and get 3 - 0.06 h of uncertainty (3 above
    zero, h upwards), unless their own is larger. Elsewhere the region's uncertainty is added to their own.
    """
    p = plan(catalog, source, target, up=up)
    own = masked(cells.select("row", "col", "elev", *[b for b in ("unc", "contributor") if b in cells.columns]), raster)
    if p.identity:
        stack, sigma = own.withColumns({"sep": F.lit(0.0), "region_index": F.lit(0)}), F.lit(0.0)
    else:
        stack = stacked(own, p, raster)
        sigma = by_region({i: p.sigma(r.name, **sigma_options) for i, r in p.regions}, F.col("region_index"))
    flip = F.lit(1.0 if p.up_in == p.up_out else -1.0)
    elev, sep = F.col("elev"), F.col("sep")
    inside = flip * (elev + sep if p.up_in else elev - sep)
    has_unc, has_contributor = "unc" in cells.columns, "contributor" in cells.columns
    source_unc = F.col("unc") if has_unc else F.lit(None).cast("double")
    far = general_uncertainty(elev, p.up_in)
    seen, covered = elev.isNotNull(), sep.isNotNull()
    drop = lambda inner, outer: F.when(seen & covered, inner).when(seen & F.lit(allow_outside), outer)
    bands = {"elev": drop(inside, flip * elev)}
    if uncertainty:
        bands["unc"] = drop(F.coalesce(source_unc, F.lit(0.0)) + sigma, F.greatest(far, source_unc))
    elif has_unc:
        bands["unc"] = drop(source_unc, source_unc)
    if has_contributor:
        bands["contributor"] = drop(F.col("contributor"), F.col("contributor"))
    rounded = (lambda c: half_even(c, digits)) if digits is not None else (lambda c: c)
    nodata = lambda b: raster.nodata.get(b, raster.nodata["elev"])
    return stack.select("row", "col", *[F.coalesce(rounded(c), F.lit(nodata(b))).alias(b) for b, c in bands.items()], "region_index")

"""One object for a request: systems in and out, the regions that the data meet, and the transform of points or cells."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.catalog_ops import regions_by_box, regions_with_fallback
from .operators.points import geographic_extents, transform_points
from .operators.raster import Raster, transform_raster
from .plans.catalog import FRAMES_3D, Catalog
from .plans.crs import CrsPair
from .plans.datums import guess_datum
from .plans.settings import fail, run_log


@dataclass(frozen=True)
class Request:
    """catalog, and polygons (region, feature, name, ring) that choose its regions; external ones are those of external."""

    catalog: Catalog
    polygons: DataFrame | None = field(default=None, compare=False)
    external: DataFrame | None = field(default=None, compare=False)
    source: CrsPair = field(default_factory=CrsPair)
    target: CrsPair = field(default_factory=CrsPair)
    log: logging.Logger = field(default_factory=lambda: run_log("tidemark"), compare=False)

    def _set(self, pair: CrsPair, what) -> CrsPair:
        return replace(pair, geoids={r.name: r.geoid for r in self.catalog.regions}, release=self.catalog.release).set(what)

    def set_input(self, what) -> Request:
        """An EPSG code, a datum's name, the WKT of a vertical system, or two of these; the output's horizontal system follows the first time."""
        source = self._set(self.source, what)
        target = self.target if self.target.horizontal is not None or source.horizontal is None else self._set(self.target, source.horizontal)
        return replace(self, source=source, target=target)

    def set_output(self, what) -> Request:
        return replace(self, target=self._set(self.target, what))

    def set_region_by_bounds(self, x0: float, y0: float, x1: float, y1: float, strict: bool = False) -> Request:
        """Only the regions whose polygon meets a box in degrees, or without polygons those whose grids do."""
        if strict and not (x0 < x1 and y0 < y1):
            fail(self.log, "bounds must rise", AssertionError)
        if self.polygons is None:
            return replace(self, catalog=self.catalog.within(x0, y0, x1, y1))
        box = (x0, y0, x1, y1)
        found = regions_by_box(self.polygons, box) if self.external is None else regions_with_fallback(self.polygons, self.external, box)
        return replace(self, catalog=self.catalog.only([r["region"] for r in found.select("region").distinct().collect()]))

    def set_region_by_points(self, points: DataFrame) -> Request:
        """By the extents of points (x, y) in the input's horizontal system."""
        box = geographic_extents(points, self.source.horizontal or 6318).first()
        if box["x_min"] is None:
            return replace(self, catalog=self.catalog.only([]))
        return self.set_region_by_bounds(box["x_min"], box["y_min"], box["x_max"], box["y_max"])

    def _datums(self) -> tuple[str, str, tuple[bool, bool]]:
        if not self.catalog.regions:
            fail(self.log, "no region meets the data")
        names = [r.name for r in self.catalog.regions]
        found = []
        for end, pair in (("input", self.source), ("output", self.target)):
            bound = pair.with_regions(names) if pair.vertical else pair
            if not bound.is_valid:
                fail(self.log, f"the {end} datum is not fully given")
            found.append((bound.datum or guess_datum(bound.vertical.name), bound.is_height))
        (a, up_a), (b, up_b) = found
        return a, b, (up_a, up_b)

    def transform(self, points: DataFrame, **options) -> DataFrame:
        """transform_points() between the two systems; how many rows and how many covered ones is logged when the result is used."""
        source, target, up = self._datums()
        out = transform_points(points, self.catalog, source, target, source_crs=self.source.horizontal, target_crs=self.target.horizontal, up=up, **options)
        self.log.info("points from %s to %s in %d regions", source, target, len(self.catalog.regions))
        return out

    def counted(self, moved: DataFrame, name: str = "transformed") -> DataFrame:
        """moved, with rows and covered rows as observed metrics of whatever query uses it; they cost no pass of their own."""
        return moved.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("region_index") >= 0).alias("covered"))

    def transform_cells(self, cells: DataFrame, raster: Raster, **options) -> DataFrame:
        """transform_raster(); a raster keeps its horizontal system."""
        source, target, up = self._datums()
        flat = lambda e: FRAMES_3D.get(e, e)
        if flat(self.source.horizontal) != flat(self.target.horizontal):
            fail(self.log, "a raster's horizontal systems must be equal")
        return transform_raster(cells, self.catalog, source, target, replace(raster, epsg=self.source.horizontal), up=up, **options)

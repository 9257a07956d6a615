"""What a transform needs to know of regions, geoids, grids and uncertainties."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

#: Layers with uncertainties.
SIGMA_LAYERS = ["tss", "mhhw", "mhw", "mlw", "mllw", "dtl", "mtl"]
#: Geoid files and the frame each is given in.
GEOID_FRAMES = {
    "core\\geoid12b\\g2012bu0.gtx": "NAD83(2011)",
    "core\\geoid12b\\g2012bp0.gtx": "NAD83(2011)",
    "core\\xgeoid16b\\ak.gtx": "ITRF2008",
    "core\\xgeoid16b\\conus.gtx": "ITRF2008",
    "core\\xgeoid16b\\hi.gtx": "ITRF2008",
    "core\\xgeoid16b\\prvi.gtx": "ITRF2008",
    "core\\xgeoid17b\\AK_17B.gtx": "ITRF2008",
    "core\\xgeoid17b\\CONUS_17B.gtx": "ITRF2008",
    "core\\xgeoid17b\\PRVI_17B.gtx": "ITRF2008",
    "core\\xgeoid18b\\AK_18B.gtx": "ITRF2008",
    "core\\xgeoid18b\\CONUS_18B.gtx": "ITRF2008",
    "core\\xgeoid18b\\PRVI_18B.gtx": "ITRF2008",
    "core\\xgeoid18b\\GU_18B.gtx": "ITRF2008",
    "core\\xgeoid19b\\CONUSPAC.pc.gtx": "ITRF2008",
    "core\\xgeoid20b\\conuspac.gtx": "ITRF2014",
    "core\\xgeoid20b\\as.gtx": "ITRF2014",
    "core\\xgeoid20b\\gu.gtx": "ITRF2014",
}
GEOID_FAMILIES = ["geoid12b", "xgeoid16b", "xgeoid17b", "xgeoid18b", "xgeoid19b", "xgeoid20b"]
#: 3-D systems and their 2-D parts.
FRAMES_3D = {6319: 6318, 7911: 8999, 7912: 9000}
FRAME_NAMES = {6318: "NAD83(2011)", 8999: "ITRF2008", 9000: "ITRF2014"}


@dataclass(frozen=True)
class Lattice:
    """Nodes of a grid: its south-west node, spacing and size."""

    lat0: float
    lon0: float
    dlat: float
    dlon: float
    rows: int
    cols: int

    def bounds(self) -> tuple[float, float, float, float]:
        return self.lon0, self.lat0, self.lon0 + (self.cols - 1) * self.dlon, self.lat0 + (self.rows - 1) * self.dlat

    def node_bytes(self) -> int:
        return 8 * self.rows * self.cols


@dataclass(frozen=True)
class Region:
    name: str
    geoid: str
    grids: dict[str, Lattice] = field(hash=False)
    bounds: tuple[float, float, float, float] | None = None
    frame: str = ""

    def box(self) -> tuple[float, float, float, float]:
        """Its bounds, else those that its own grids, not the geoid's, reach together."""
        if self.bounds:
            return self.bounds
        boxes = [g.bounds() for layer, g in self.grids.items() if layer != "geoid"] or [g.bounds() for g in self.grids.values()]
        return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)

    def geoid_frame(self) -> str:
        """The frame its geoid is given in: its own setting, else the one known for the file, else NAD83(2011)."""
        return self.frame or GEOID_FRAMES.get(self.geoid.replace("/", "\\"), "NAD83(2011)")


@dataclass(frozen=True)
class Catalog:
    """regions come in order of precedence, last first; grid_rows has region, layer, row, vals array<double>, null where nodata."""

    regions: tuple[Region, ...]
    grid_rows: DataFrame
    sigma: dict[str, dict[str, float]] = field(default_factory=dict)
    sigma_geoid: dict[str, float] = field(default_factory=dict)
    release: str = ""

    def within(self, x0: float, y0: float, x1: float, y1: float, strict: bool = False) -> Catalog:
        """With the regions whose box meets one in degrees; longitudes count modulo 360. strict wants a box that has some area."""
        if strict and not (x0 < x1 and y0 < y1):
            raise AssertionError("bounds must rise")

        def meets(b: tuple[float, float, float, float]) -> bool:
            return b[1] <= y1 and b[3] >= y0 and ((x0 - b[0]) % 360 <= b[2] - b[0] or (b[0] - x0) % 360 <= x1 - x0)

        return self.only([r.name for r in self.regions if meets(r.box())])

    def only(self, names) -> Catalog:
        """With the regions of these names, in their order of precedence."""
        return replace(self, regions=tuple(r for r in self.regions if r.name in set(names)))

"""The driver's side of a transform: which steps, in which regions, with which signs and uncertainties."""

from __future__ import annotations

import math
from dataclasses import dataclass

from .catalog import Catalog, Lattice, Region
from .datums import Step, compile_steps, definition, is_height

_ABOVE = ("ellipse", "geoid", "navd88")


@dataclass(frozen=True)
class TransformPlan:
    source: str
    target: str
    steps: tuple[Step, ...]
    catalog: Catalog
    regions: tuple[tuple[int, Region], ...]  # (place in the catalog, region) of those that have all grids
    up_in: bool
    up_out: bool
    identity: bool = False

    @property
    def layers(self) -> list[str]:
        return [s.grid for s in self.steps]

    def sigma(self, region: str, **options) -> float:
        return output_sigma(self.catalog, self.source, self.target, region, **options)


def plan(catalog: Catalog, source: str, target: str, strict_reference: bool = False, up: tuple[bool, bool] | None = None) -> TransformPlan:
    """Equal datums, by one name or two, leave values as they are; strict_reference raises there, as no grid is found.

    up: whether values of source and of target count upwards, where their systems say other than the datums' names.
    """
    source, target = source.lower(), target.lower()
    definition(source), definition(target)
    steps = compile_steps(source, target) or ()
    up = up or (is_height(source), is_height(target))
    if not catalog.regions:
        raise ValueError("no region meets the data")
    if not steps:
        if strict_reference:
            raise ValueError(f"no grids lead from {source} to {target}")
        return TransformPlan(source, target, (), catalog, tuple(enumerate(catalog.regions)), *up, identity=True)
    found = tuple((i, r) for i, r in enumerate(catalog.regions) if all(s.grid in r.grids for s in steps))
    if not found:
        raise ValueError(f"no region has the grids {[s.grid for s in steps]}")
    return TransformPlan(source, target, steps, catalog, found, *up)


def output_sigma(catalog: Catalog, source: str, target: str, region: str, geoid_sigma: str = "geoid12b", missing: str = "raise") -> float:
    """Sum, not root of squares, of the geoid's, the sea surface's and the layer's uncertainty, as far as the way passes them.

    geoid_sigma: a family's name, or actual for the region's own. Ways to the ellipsoid or geoid from below count 0.
    """
    source, target = source.lower(), target.lower()
    own, total = catalog.sigma.get(region, {}), 0.0

    def of(table: dict, key: str) -> float:
        if key not in table and missing != "zero":
            raise KeyError(key)
        return table.get(key, 0.0)

    if source == "ellipse" and target != "ellipse":
        family = next(r.geoid for r in catalog.regions if r.name == region).split("\\")[1] if geoid_sigma == "actual" else geoid_sigma
        total += of(catalog.sigma_geoid, family)
    if source in _ABOVE and target not in _ABOVE:
        total += of(own, "tss")
    if target not in (*_ABOVE, "tss"):
        total += of(own, {"noaa chart datum": "mllw", "noaa chart height": "mhw"}.get(target, target))
    return total


def lattice_groups(p: TransformPlan) -> list[list[str]]:
    """The layers needed, those together that have the same lattice in every region: one lookup serves a group."""
    groups: dict[tuple[Lattice, ...], list[str]] = {}
    for layer in dict.fromkeys(p.layers):
        groups.setdefault(tuple(r.grids[layer] for _, r in p.regions), []).append(layer)
    return list(groups.values())


def most_overlap(boxes: list[tuple[float, float, float, float]], pad: float = 1e-9) -> int:
    """The largest number of boxes that share a point: it is at the corner of some box's left and some box's lower side.

    Longitudes count modulo 360, as in the lookup. Sides that meet within pad degrees count as shared.
    """
    most = 0
    for x in {b[0] for b in boxes}:
        over = [b for b in boxes if (x - b[0] + pad) % 360 <= b[2] - b[0] + 2 * pad]
        most = max([most, *(sum(c[1] - pad <= b[1] <= c[3] + pad for c in over) for b in over)])
    return most


def cells_of(boxes: list[tuple[float, float, float, float]], most: int = 20_000, pad: float = 1e-9) -> tuple[float, dict[tuple[int, int], list[int]]]:
    """The side of square cells and, for each cell (of longitudes from 0 to 360), the places of the boxes that meet it, in their order.

    The side starts at a degree and grows until the boxes list most cells or fewer in all, or cells are as wide as they get.
    """
    for step in (1.0, 2.0, 5.0, 10.0, 30.0, 90.0):
        around, out, n = round(360 / step), {}, 0
        for k, (x0, y0, x1, y1) in enumerate(boxes):
            start = x0 % 360
            wide = range(math.floor((start - pad) / step), min(math.floor((start + x1 - x0 + pad) / step), math.floor((start - pad) / step) + around) + 1)
            xs = {c % around for c in wide}
            xs |= {around} if 0 in xs else set()  # a longitude just below 0 may round to 360
            ys = range(math.floor((y0 - pad) / step), math.floor((y1 + pad) / step) + 1)
            n += len(xs) * len(ys)
            if n > most and step < 90:
                break
            for cx in xs:
                for cy in ys:
                    out.setdefault((cx, cy), []).append(k)
        else:
            return step, out
    return step, out


def fine_cells(boxes: list[tuple[float, float, float, float]], spacing: float, most: int = 20_000, pad: float = 1e-9) -> tuple[int, list[tuple[int, int, int, int]]]:
    """How many square cells there are around, and for each box the first and last column and row of cells that it meets.

    Sides start at eight times spacing and double until the boxes meet most cells or fewer in all. Columns count from
    longitude 0 to the east, modulo the cells around.
    """
    around = max(4, math.floor(360 / (8 * spacing)))
    while True:
        step, spans = 360 / around, []
        for x0, y0, x1, y1 in boxes:
            start = x0 % 360
            spans.append((math.floor((start - pad) / step), math.floor((start + x1 - x0 + pad) / step), math.floor((y0 - pad) / step), math.floor((y1 + pad) / step)))
        if around == 4 or sum((c1 - c0 + 1) * (r1 - r0 + 1) for c0, c1, r0, r1 in spans) <= most:
            return around, spans
        around = max(4, around // 2)

"""Vertical datums as ordered grid steps from the ellipsoid, and the algebra on them."""

from __future__ import annotations

from typing import NamedTuple


class Step(NamedTuple):
    """A vertical shift by a grid: forward subtracts the grid's value, inverse adds it."""

    grid: str
    inverse: bool = False

    def flipped(self) -> Step:
        return Step(self.grid, not self.inverse)


#: Stand-ins for a region's own geoid and folder.
GEOID, REGION = "GEOID", "REGION"
_G, _T = Step("geoid"), Step("tss", True)
#: The steps that lead from the ellipsoid to each datum. Callers may add their own with register_datum().
DEFINITIONS: dict[str, tuple[Step, ...]] = {
    "ellipse": (),
    "geoid": (_G,),
    "navd88": (_G,),
    "tss": (_G, _T),
    "mllw": (_G, _T, Step("mllw")),
    "noaa chart datum": (_G, _T, Step("mllw")),
    "mhw": (_G, _T, Step("mhw")),
    "noaa chart height": (_G, _T, Step("mhw")),
    "mtl": (_G, _T, Step("mtl")),
    "dtl": (_G, _T, Step("dtl")),
    "lwrp2007": (_G, Step("lwrp2007")),
    "hrd": (_G, Step("hrd")),
}


def register_datum(name: str, steps: tuple[Step, ...]) -> None:
    DEFINITIONS[name.lower()] = tuple(steps)


def definition(name: str) -> tuple[Step, ...]:
    try:
        return DEFINITIONS[name.lower()]
    except KeyError:
        raise ValueError(f"{name!r} is not a known datum: {sorted(DEFINITIONS)}") from None


def inverted(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    return tuple(s.flipped() for s in reversed(steps))


def without_common(source: tuple[Step, ...], target: tuple[Step, ...]) -> tuple[tuple[Step, ...], tuple[Step, ...]]:
    """Both definitions without the layers that they share place by place."""
    shared = {i for i, (a, b) in enumerate(zip(source, target)) if a == b}
    keep = lambda steps: tuple(s for i, s in enumerate(steps) if i not in shared)
    return keep(source), keep(target)


def compile_steps(source: str, target: str) -> tuple[Step, ...] | None:
    """From one datum to the other by way of the ellipsoid; None for the same name, empty for two names of one datum."""
    back, forth = without_common(definition(source), definition(target))
    return None if source.lower() == target.lower() else inverted(back) + forth


def step_text(step: Step, region: str, geoid: str) -> str:
    grid = geoid if step.grid == "geoid" else f"{region}\\{step.grid}.gtx"
    return ("+inv " if step.inverse else "") + f"+proj=vgridshift grids={grid}"


def pipeline_text(source: str, target: str, region: str, geoid: str) -> str | None:
    """The compiled steps as the documentation string of a transformation."""
    steps = compile_steps(source, target)
    return None if steps is None else " +step ".join(["+proj=pipeline", *(step_text(s, region, geoid) for s in steps)])


def guess_datum(text: str) -> str:
    """The one datum whose name is in the text; empty for none, an error for several."""
    found = [d for d in DEFINITIONS if d in text.lower()]
    if len(found) > 1:
        raise ValueError(f"{text!r} names several datums: {found}")
    return found[0] if found else ""


def default_axis(name: str) -> str:
    """ellipsoid height, gravity-related height, or depth: only the last points down."""
    if not name or "ellipse" in name:
        return "ellipsoid height"
    return "gravity-related height" if any(x in name for x in ("geoid", "navd88", "tss")) else "depth"


def is_height(name: str) -> bool:
    return default_axis(name.lower()) != "depth"

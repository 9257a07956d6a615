"""Coordinate reference systems: vertical systems as WKT, with the pipelines that lead to them, and the pair of both."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wkt
from .catalog import FRAME_NAMES, FRAMES_3D, GEOID_FAMILIES, GEOID_FRAMES
from .datums import DEFINITIONS, compile_steps, default_axis, guess_datum, pipeline_text

#: Words for axes and the metre, as WKT spells them.
AXES = {
    'AXIS["ellipsoid height (h)",up]': ["h", "height", "ellipsoid height", "ellipsoid height (h)"],
    'AXIS["gravity-related height (H)",up]': ["gravity-related height (h)", "gravity-related height", "up"],
    'AXIS["depth (D)",down]': ["d", "depth", "depth (d)"],
}
METRES = ["m", "meter", "metre", "meters", "metres"]
#: The library that made a remark; any word is read as the key.
VERSION_KEY, VERSION = "library", "0.2.1"
_VERSION = r"vdatum=[^,]*,\w+=([^,]*),"
#: Horizontal systems that can be named by code, and the one vertical system.
HORIZONTAL = {6318: "NAD83(2011)", 8999: "ITRF2008", 9000: "ITRF2014", **{26900 + z: f"NAD83 / UTM zone {z}N" for z in (8, 10, 14, 15, 18, 19)}}
VERTICAL = {5866: ("mllw", "depth")}


def axis_text(word: str) -> str:
    for text, words in AXES.items():
        if word.lower() in words:
            return text
    raise ValueError(f"{word!r} is no axis")


def coordinate_system(axis: str, unit: str = "m", kind: str = "vertical") -> str:
    if not (axis and unit and kind):
        raise ValueError("a coordinate system needs its kind, axis and unit")
    if kind != "vertical":
        raise NotImplementedError(f"{kind} coordinate systems")
    if unit.lower() not in METRES:
        raise NotImplementedError(f"only metres, not {unit}")
    return f'CS[vertical,1],{axis_text(axis)},LENGTHUNIT["metre",1]'


def vertical_datum(name: str) -> str:
    return f'VDATUM["{name}"]'


def parameter_file(source: str, identifier: str, path: str, description: str, date: str) -> str:
    if not all((source, identifier, path, description, date)):
        raise ValueError("a parameter file needs source, identifier, path, description and date")
    return f'PARAMETERFILE["{identifier}", "{path}", ID["{source}", "{description}", "{date}"]]'


def deriving_conversion(name: str, method: str, files: list[tuple[str, str, str, str, str]]) -> str:
    code = 1084 if "gtx" in method.lower() else 1085 if "asc" in method.lower() else None
    if code is None:
        raise NotImplementedError(f"grids by {method!r}")
    return ",".join([f'DERIVINGCONVERSION["{name}",METHOD["{method}", ID["EPSG",{code}]]', *(parameter_file(*f) for f in files)]) + "]"


def base_vertical(name: str) -> str:
    code = 6319 if "nad83" in name.lower() else 4979 if "wgs" in name.lower() else None
    if code is None:
        raise NotImplementedError(f"no code for {name!r}")
    return f'BASEVERTCRS["{name}",{vertical_datum(name)},ID["EPSG",{code}]]'


def derived_vertical(name: str, base: str, conversion: str, method: str, files: list, axis: str = "height", unit: str = "m") -> str:
    return f'VERTCRS["{name}",{base_vertical(base)},{deriving_conversion(conversion, method, files)},{vertical_datum(name)},{coordinate_system(axis, unit)}]'


def wkt_quoted(text: str, key: str) -> str:
    """The first argument of the first node of a keyword."""
    return wkt.parse(text).first(key).name()


def wkt_parameter_files(text: str) -> list[tuple[str, ...]]:
    """source, identifier, path, description, date of each parameter file."""
    out = []
    for node in wkt.parse(text).every("PARAMETERFILE"):
        (identifier, path), (source, description, date) = ([a.strip() for a in n.args if isinstance(a, str)] for n in (node, node.first("ID")))
        out.append((source, identifier, path, description, date))
    return out


@dataclass(frozen=True)
class DerivedVertical:
    """A vertical system derived from another by parameter files."""

    name: str
    base: str
    conversion: str
    method: str
    files: tuple[tuple[str, ...], ...] = ()
    axis: str = "height"
    unit: str = "m"

    def to_wkt(self) -> str:
        return derived_vertical(self.name, self.base, self.conversion, self.method, list(self.files), self.axis, self.unit)

    @classmethod
    def from_wkt(cls, text: str) -> DerivedVertical:
        one = lambda key: wkt_quoted(text, key)
        return cls(one("VERTCRS"), one("BASEVERTCRS"), one("DERIVINGCONVERSION"), one("METHOD"), tuple(wkt_parameter_files(text)), one("AXIS"), one("LENGTHUNIT"))


@dataclass(frozen=True)
class Remark:
    regions: tuple[str, ...] = ()
    pipelines: tuple[str, ...] = ()
    vdatum: str | None = None
    version: str | None = None
    base_datum: tuple[str, ...] = ()

    def text(self) -> str:
        base = f"[{','.join(self.base_datum)}]" if self.regions else "["
        return f'REMARK["vdatum={self.vdatum or ""},{VERSION_KEY}={self.version or VERSION},base_datum={base},regions=[{",".join(self.regions)}],pipelines=[{";".join(self.pipelines)}]"]'

    @classmethod
    def parse(cls, text: str) -> Remark:
        if "REMARK[" not in text:
            return cls()
        text = wkt_quoted(text, "REMARK")
        one = lambda k: m[1] if (m := re.search(k + "=([^,]*),", text)) else None

        def many(key: str, sep: str, needed: bool) -> tuple[str, ...]:
            m = re.search(key + r"=\[(.*?)\](?:,|$)", text)
            if not m and needed:
                raise ValueError(f"no {key} in {text!r}")
            return tuple(x.strip() for x in m[1].split(sep)) if m else ()

        return cls(many("regions", ",", True), many("pipelines", ";", True), one("vdatum"), m[1] if (m := re.search(_VERSION, text)) else None, many("base_datum", ",", False))


def parse_remark(crs: Column) -> Column:
    """The same per row: struct<regions, pipelines, vdatum, version, base_datum>."""
    text = F.regexp_extract(crs, 'REMARK\\["([^"]*)"', 1)
    many = lambda key, sep: F.transform(F.split(F.regexp_extract(text, key + r"=\[(.*?)\](?:,|$)", 1), sep), lambda x: F.trim(x))
    one = lambda key: F.regexp_extract(text, key + "=([^,]*),", 1)
    return F.struct(many("regions", ",").alias("regions"), many("pipelines", ";").alias("pipelines"), one("vdatum").alias("vdatum"), F.regexp_extract(text, _VERSION, 1).alias("version"), many("base_datum", ",").alias("base_datum"))


@dataclass(frozen=True)
class VerticalCrs:
    """A vertical system; axis None takes the one that goes with the name."""

    name: str
    axis: str | None = None
    unit: str = "m"
    remark: Remark = field(default_factory=Remark)

    @property
    def axis_word(self) -> str:
        return self.axis or default_axis(self.name)

    @property
    def is_height(self) -> bool:
        return "up]" in axis_text(self.axis_word)

    @property
    def datum(self) -> str:
        return "ellipse" if "ellipse" in self.name else self.name

    def with_pipeline(self, pipeline: str, region: str) -> VerticalCrs:
        """A region that is there already stays as it is."""
        if region in self.remark.regions:
            return self
        return replace(self, remark=replace(self.remark, regions=(*self.remark.regions, region), pipelines=(*self.remark.pipelines, pipeline)))

    def to_wkt(self) -> str:
        return f'VERTCRS["{self.name}",{vertical_datum(self.name)},{coordinate_system(self.axis_word, self.unit)},{self.remark.text() if self.remark.pipelines else ""}]'

    @classmethod
    def from_wkt(cls, text: str) -> VerticalCrs:
        return cls(wkt_quoted(text, "VERTCRS"), wkt_quoted(text, "AXIS"), wkt_quoted(text, "LENGTHUNIT"), Remark.parse(text))

    def pretty(self) -> str:
        return wkt.pretty(self.to_wkt())

    @property
    def regions_text(self) -> str:
        return f"[{','.join(self.remark.regions)}]"

    @property
    def pipelines_text(self) -> str:
        return f"[{';'.join(self.remark.pipelines)}]"

    def compound(self, horizontal_wkt: str) -> str:
        name = horizontal_wkt.split('"')[1]
        return f'COMPOUNDCRS["{name} + {self.name}",{horizontal_wkt},{self.to_wkt()}]'


def transformation_pipeline(source: VerticalCrs, target: VerticalCrs, region: str, geoid: str) -> str | None:
    """Both must name a datum and, but for the ellipsoid, have the region."""
    for c in (source, target):
        if c.datum.lower() not in DEFINITIONS:
            raise NotImplementedError(f"{c.datum!r} is not a known datum")
        if region not in c.remark.regions and c.datum != "ellipse":
            raise NotImplementedError(f"{c.datum!r} has no region {region!r}")
    return pipeline_text(source.datum.lower(), target.datum.lower(), region, geoid)


@dataclass(frozen=True)
class CrsPair:
    """A horizontal and a vertical system with the regions that they hold in; parts come in any order, by set()."""

    geoids: dict[str, str] = field(default_factory=dict, hash=False)
    release: str = ""
    horizontal: int | None = None
    vertical: VerticalCrs | None = None
    datum: str | None = None
    regions: tuple[str, ...] = ()

    def set(self, what: int | str | tuple, regions: list[str] = ()) -> CrsPair:
        """An EPSG code, a datum's name, the WKT of a vertical system, or two of these."""
        if isinstance(what, tuple):
            if len(what) > 2:
                raise ValueError("a horizontal and a vertical system at most")
            out = self
            for w in what:
                out = out.set(w)
            return out.with_regions(regions) if regions else out
        if not isinstance(what, (int, str)):
            raise ValueError(f"{type(what)} is no system")
        if isinstance(what, str) and what.isdigit():
            what = int(what)
        if isinstance(what, int):
            if what in FRAMES_3D:
                flat = FRAMES_3D[what]
                out = replace(self, horizontal=flat, vertical=VerticalCrs(f"{FRAME_NAMES[flat]}_ellipse"))
            elif what in VERTICAL:
                out = replace(self, vertical=VerticalCrs(*VERTICAL[what]))
            else:
                out = replace(self, horizontal=what)
        elif what.startswith("VERTCRS["):
            v = VerticalCrs.from_wkt(what)
            out = replace(self, vertical=v, regions=v.remark.regions or self.regions)
        else:
            if what.lower() not in DEFINITIONS:
                raise ValueError(f"{what!r} is not a known datum")
            out = replace(self, vertical=VerticalCrs(what, default_axis(what.lower())))
        return out.with_regions(list(regions or out.regions))

    def with_regions(self, regions: list[str]) -> CrsPair:
        """Binds the vertical system's pipelines to the regions; geoid takes the name of the one family they share."""
        out = replace(self, regions=tuple(regions))
        if not (out.vertical and regions):
            return out
        datum = guess_datum(out.vertical.name)
        if not datum:
            raise ValueError(f"{out.vertical.name!r} names no known datum")
        v = replace(out.vertical, remark=Remark(vdatum=self.release, version=VERSION, base_datum=tuple(GEOID_FRAMES[self.geoids[r]] for r in regions)))
        for r in regions:
            v = v.with_pipeline("[]" if datum == "ellipse" else pipeline_text("ellipse", datum, r, self.geoids[r]), r)
        if datum == "geoid":
            families = [g for g in GEOID_FAMILIES if any(g in p for p in v.remark.pipelines)]
            if len(families) > 1:
                raise NotImplementedError(f"several geoids: {families}")
            if not families:
                raise ValueError("no known geoid")
            v = replace(v, name=families[0])
        return replace(out, vertical=v, datum=datum)

    @property
    def is_valid(self) -> bool:
        return self.horizontal is not None and self.vertical is not None and bool(self.vertical.remark.regions) and self.datum is not None

    @property
    def is_height(self) -> bool | None:
        return self.vertical.is_height if self.is_valid else None

    def to_wkt(self) -> str | None:
        """None unless valid; a horizontal system is written by its name and code."""
        if not self.is_valid:
            return None
        kind = "GEOGCRS" if self.horizontal in FRAME_NAMES else "PROJCRS"
        return self.vertical.compound(f'{kind}["{HORIZONTAL.get(self.horizontal, f"EPSG {self.horizontal}")}",ID["EPSG",{self.horizontal}]]')


def datum_wkt(datum: str, horizontal: int, geoids: dict[str, str], release: str = "") -> str:
    """The vertical system's WKT for metadata; the ellipsoid's needs no regions, mllw is taken positive down by its code."""
    if datum == "ellipse":
        if horizontal not in HORIZONTAL:
            raise ValueError(f"unknown horizontal system {horizontal}")
        return f'VERTCRS["ellipse",VDATUM["{HORIZONTAL[horizontal]} + ellipse"],CS[vertical,1],AXIS["ellipsoid height (h)",up,LENGTHUNIT["metre",1]]]'
    pair = CrsPair(geoids, release).set((horizontal, 5866 if datum == "mllw" else datum)).with_regions(list(geoids))
    return pair.vertical.to_wkt()


def can_shift(source: str, target: str) -> bool:
    return bool(compile_steps(source, target))

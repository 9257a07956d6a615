import pytest

from tidemark.plans import datums as d
from tidemark.plans.crs import CrsPair, Remark, VerticalCrs, coordinate_system, datum_wkt, derived_vertical, transformation_pipeline, wkt_parameter_files

GEOID = "core\\geoid12b\\g2012bu0.gtx"


def steps(a, b):
    found = d.compile_steps(a, b)
    return None if found is None else [("-" if s.inverse else "") + s.grid for s in found]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("ellipse", "tss", ["geoid", "-tss"]), ("tss", "ellipse", ["tss", "-geoid"]), ("ellipse", "mllw", ["geoid", "-tss", "mllw"]), ("ellipse", "MHW", ["geoid", "-tss", "mhw"]),
        ("noaa chart datum", "ellipse", ["-mllw", "tss", "-geoid"]), ("tss", "noaa chart datum", ["mllw"]), ("navd88", "mllw", ["-tss", "mllw"]), ("mllw", "mllw", None), ("mllw", "noaa chart datum", []),
        ("mllw", "mhw", ["-mllw", "mhw"]), ("hrd", "lwrp2007", ["-hrd", "lwrp2007"]),
    ],
)
def test_compiled_steps(a, b, want):
    assert steps(a, b) == want


def test_pipeline_text():
    assert d.pipeline_text("tss", "noaa chart datum", "TXlagmat01_8301", GEOID) == "+proj=pipeline +step +proj=vgridshift grids=TXlagmat01_8301\\mllw.gtx"
    assert d.pipeline_text("ellipse", "tss", "R", GEOID) == f"+proj=pipeline +step +proj=vgridshift grids={GEOID} +step +inv +proj=vgridshift grids=R\\tss.gtx"
    assert d.pipeline_text("mhw", "mhw", "R", GEOID) is None
    with pytest.raises(ValueError):
        d.pipeline_text("mhhw", "mllw", "R", GEOID)


def test_inverse_is_its_own_inverse():
    for a in d.DEFINITIONS:
        for b in d.DEFINITIONS:
            there, back = d.compile_steps(a, b), d.compile_steps(b, a)
            assert there is None and back is None or d.inverted(there) == back


def test_guess_and_axes():
    assert d.guess_datum("NOAA Chart Datum") == "noaa chart datum" and d.guess_datum("sea") == ""
    with pytest.raises(ValueError):
        d.guess_datum("mllw and mhw")
    assert [d.is_height(x) for x in ("ellipse", "navd88", "tss", "mllw", "hrd")] == [True, True, True, False, False]


def test_registering_a_datum():
    d.register_datum("My Zero", (d.Step("geoid"), d.Step("extra")))
    try:
        assert steps("ellipse", "my zero") == ["geoid", "extra"]
    finally:
        del d.DEFINITIONS["my zero"]


WKT = 'VERTCRS["NOAA Chart Datum",VDATUM["NOAA Chart Datum"],CS[vertical,1],AXIS["gravity-related height (H)",up,LENGTHUNIT["metre",1]]]'
GEOIDS = {"TXlagmat01_8301": GEOID, "TXlaggal01_8301": GEOID, "AK": "core\\xgeoid17b\\AK_17B.gtx"}


def test_pairs_become_valid_only_when_whole():
    start = CrsPair(GEOIDS, "rel")
    only = start.set("NOAA Chart Datum")
    assert not only.is_valid and only.to_wkt() is None and not only.vertical.is_height
    bound = only.with_regions(["TXlagmat01_8301", "TXlaggal01_8301"])
    assert not bound.is_valid and bound.vertical.remark.regions == ("TXlagmat01_8301", "TXlaggal01_8301") and bound.vertical.remark.base_datum == ("NAD83(2011)",) * 2
    assert bound.set(26914).is_valid and bound.set(26914).is_height is False
    assert not start.set(26914).set(WKT).is_valid
    late = start.set(WKT).with_regions(["TXlagmat01_8301"]).set(26914)
    assert late.is_height and late.to_wkt().startswith('COMPOUNDCRS["NAD83 / UTM zone 14N + NOAA Chart Datum"')
    assert late.vertical.remark.pipelines == (f"+proj=pipeline +step +proj=vgridshift grids={GEOID} +step +inv +proj=vgridshift grids=TXlagmat01_8301\\tss.gtx +step +proj=vgridshift grids=TXlagmat01_8301\\mllw.gtx",)


def test_three_dimensional_and_odd_inputs():
    flat = CrsPair(GEOIDS).set(6319).with_regions(["TXlagmat01_8301"])
    assert flat.is_valid and flat.is_height and flat.horizontal == 6318 and flat.datum == "ellipse" and flat.vertical.remark.pipelines == ("[]",)
    with pytest.raises(ValueError):
        CrsPair().set((1, 2, 3))
    with pytest.raises(ValueError):
        CrsPair().set(1.5)
    assert CrsPair(GEOIDS).set((26915, "geoid"), ["TXlagmat01_8301"]).vertical.name == "geoid12b"
    with pytest.raises(NotImplementedError):
        CrsPair(GEOIDS).set((26915, "geoid"), ["TXlagmat01_8301", "AK"])


def test_wkt_round_trips():
    v = VerticalCrs("mllw", remark=Remark(("a", "b"), ("p", "q"), "rel", "0.2.1", ("NAD83(2011)", "ITRF2008")))
    assert VerticalCrs.from_wkt(v.to_wkt()) == VerticalCrs("mllw", "depth (D)", "metre", v.remark)
    assert Remark.parse(WKT) == Remark()
    with pytest.raises(ValueError):
        Remark.parse('REMARK["vdatum=x,pipelines=[p]"]')
    text = derived_vertical("X", "NAD83(2011) Height", "a to b", "gtx grid transformation", [("src", "id", "core\\a.gtx", "what", "1/2/2012"), ("src", "id2", "b.gtx", "w", "d")])
    assert 'ID["EPSG",1084]' in text and 'ID["EPSG",6319]' in text
    assert wkt_parameter_files(text + "]")[0] == ("src", "id", "core\\a.gtx", "what", "1/2/2012")
    for bad in (dict(axis="x"), dict(axis="")):
        with pytest.raises(ValueError):
            coordinate_system(**bad)
    with pytest.raises(NotImplementedError):
        coordinate_system("depth", "feet")


def test_transformation_between_systems():
    a, b = VerticalCrs("tss").with_pipeline("p", "R"), VerticalCrs("noaa chart datum").with_pipeline("p", "R")
    assert transformation_pipeline(a, b, "R", GEOID).endswith("R\\mllw.gtx")
    for x, y, r in ((a, b, "S"), (a, VerticalCrs("some_bs").with_pipeline("p", "R"), "R")):
        with pytest.raises(NotImplementedError):
            transformation_pipeline(x, y, r, GEOID)
    assert transformation_pipeline(VerticalCrs("NAD83(2011)_ellipse"), a, "R", GEOID)


def test_datum_wkt():
    assert 'VDATUM["NAD83 / UTM zone 14N + ellipse"]' in datum_wkt("ellipse", 26914, {})
    assert 'AXIS["depth (D)",down]' in datum_wkt("mllw", 26914, {"TXlagmat01_8301": GEOID})


def test_sigma_meets_every_region(spark):
    from tidemark.operators.catalog_ops import sigma_by_region

    sigma = spark.createDataFrame([("r", "tss", 0.1)], "region string, layer string, sigma_m double")
    regions = spark.range(10_500).selectExpr("concat('R', id) as region")
    got = sigma_by_region(sigma, regions)
    assert got.count() == 10_500 and got.first()["matches"] == 10_500

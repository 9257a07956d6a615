"""Operators on catalogue tables: regions, geoids, frames, uncertainties, grid files, releases, external regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.catalog import FRAMES_3D, GEOID_FAMILIES, GEOID_FRAMES, Lattice
from ..plans.datums import DEFINITIONS

EXTENSIONS = [".tiff", ".tif", ".gtx"]
VALID = "valid-transform"


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box as a closed ring: upper left, upper right, lower right, lower left, upper left."""
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x0, y1), corner(x1, y1), corner(x1, y0), corner(x0, y0), corner(x0, y1))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a closed ring, by the parity of the edges a ray to the right crosses."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * F.try_divide(y - e["a"]["y"], e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(pairs, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def _meets(rings: DataFrame, box: tuple[float, float, float, float]) -> Column:
    """A ring meets a box if their bounds do, and a corner of either is in the other or an edge crosses the box."""
    x0, y0, x1, y1 = map(F.lit, box)
    ring = F.col("ring")
    within = lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)
    corners = [inside_ring(x, y, ring) for x in (x0, x1) for y in (y0, y1)]
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def side(p, a, b):
        return F.signum((b[0] - a[0]) * (p["y"] - a[1]) - (b[1] - a[1]) * (p["x"] - a[0]))

    def cuts(e):
        found = F.lit(False)
        for a, b in (((x0, y0), (x1, y1)), ((x0, y1), (x1, y0))):  # an edge through a box cuts one of its diagonals
            turn = lambda q: F.signum((e["b"]["x"] - e["a"]["x"]) * (q[1] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (q[0] - e["a"]["x"]))
            found = found | ((side(e["a"], a, b) * side(e["b"], a, b) <= 0) & (turn(a) * turn(b) <= 0))
        return found

    return F.exists(ring, within) | F.exists(edges, cuts) | corners[0] | corners[1] | corners[2] | corners[3]


def regions_by_box(polygons: DataFrame, box: tuple[float, float, float, float], named: bool = True) -> DataFrame:
    """region of polygons (region, name, ring) that meet a box; named takes only features that are called a valid transform. Each once."""
    rows = polygons.where(F.startswith("name", F.lit(VALID))) if named else polygons
    return rows.where(_meets(rows, box)).select("region").distinct()


def regions_with_fallback(polygons: DataFrame, external: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """region, source: the regions that meet a box, and of external ones not among them those whose first feature does, whatever its name."""
    base = regions_by_box(polygons, box)
    first = external.groupBy("region").agg(F.min_by("ring", "feature").alias("ring"))
    late = regions_by_box(first.withColumn("name", F.lit("")), box, named=False).join(base, "region", "left_anti")
    return base.withColumn("source", F.lit("named")).unionByName(late.withColumn("source", F.lit("fallback")))


def geoid_frames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GEOID_FRAMES.items()), "geoid string, frame string")


def geoid_lookup(regions: DataFrame, release_geoids: DataFrame, external: DataFrame) -> DataFrame:
    """region, geoid: by the release's table, else by the external region's configuration; null where neither knows it."""
    ext = external.select("region", F.col("reference_geoid").alias("_ext"))
    return regions.select("region").join(release_geoids.select("region", "geoid"), "region", "left").join(ext, "region", "left").select("region", F.coalesce("geoid", "_ext").alias("geoid"))


def frame_lookup(regions: DataFrame, release_geoids: DataFrame, frames: DataFrame, external: DataFrame) -> DataFrame:
    """region, frame: through the release's geoid, else by the external region's configuration."""
    ext = external.select("region", F.col("reference_frame").alias("_ext"))
    known = release_geoids.join(frames, "geoid").select("region", "frame")
    return regions.select("region").join(known, "region", "left").join(ext, "region", "left").select("region", F.coalesce("frame", "_ext").alias("frame"))


def require(df: DataFrame, column: str, what: str) -> DataFrame:
    """df, failing with what where column is null."""
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.concat(F.lit(what), F.col("region")))).otherwise(F.col(column)))


def parse_sigma(lines: DataFrame) -> DataFrame:
    """region, layer, sigma_m of lines `region.source.target=centimetres`; a geoid's row has the geoid as layer and region conus.

    Lines with another number of = or of dots before it say nothing, nor do transformations without a use here.
    """
    side = F.split("line", "=")
    part = F.split(side[0], r"\.")
    rows = lines.where(F.size(side) == 2).where(F.size(part) == 3)
    region, source, target, value = part[0], part[1], part[2], F.trim(side[1])
    geoid = F.when((source == "navd88") & (target == "nad83"), F.lit("geoid12b")).when(source.isin(GEOID_FAMILIES), source)
    layer = F.when((source == "navd88") & (target == "lmsl"), F.lit("tss")).when(source == "lmsl", target)
    metres = F.when((region != "conus") & (value == "n/a"), F.lit(0.0)).otherwise(value.try_cast("double")) * 0.01
    return rows.select(region.alias("region"), F.when(region == "conus", geoid).otherwise(layer).alias("layer"), metres.alias("sigma_m")).where("layer is not null")


def sigma_by_region(sigma: DataFrame, regions: DataFrame) -> DataFrame:
    """entry, region, layer, sigma_m, matches: the regions whose lower-cased name starts with the entry's; an entry should match one."""
    rows = sigma.where("region <> 'conus'").select(F.col("region").alias("entry"), "layer", "sigma_m")
    starts = F.transform(F.sequence(F.lit(0), F.length("region")), lambda n: F.lower(F.substring(F.col("region"), F.lit(1), n)))
    found = rows.join(regions.select("region", F.explode(starts).alias("entry")), "entry")
    counts = found.groupBy("entry", "layer").agg(F.count_distinct("region").alias("matches"))
    return found.join(counts, ["entry", "layer"]).select("entry", "region", "layer", "sigma_m", "matches")


def sole_sigma(matched: DataFrame) -> DataFrame:
    """Of sigma_by_region's result; fails on an entry that several regions match."""
    return matched.withColumn("region", F.when(F.col("matches") > 1, F.raise_error(F.concat(F.lit("several regions match "), F.col("entry")))).otherwise(F.col("region"))).drop("matches")


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^.\\/]*$", "")


def repair_extensions(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """grid, found: the file that serves a wanted grid: itself, else its stem with the first other extension there is; null if none.

    Separators of both kinds count as one.
    """
    clean = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    have = catalog.select(clean(F.col("file")).alias("file")).distinct()
    rows = wanted.select("grid", clean(F.col("grid")).alias("path")).distinct()
    ranked = have.select("file", _stem(F.col("file")).alias("stem"), F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.regexp_extract("file", r"\.[^.\\/]*$", 0)).alias("rank"))
    found = rows.join(ranked, _stem(F.col("path")) == F.col("stem"), "left")
    ok = (F.col("file") == F.col("path")) | (F.col("rank") > 0)
    order = F.when(F.col("file") == F.col("path"), 0).otherwise(F.col("rank"))
    return found.groupBy("grid").agg(F.min_by(F.when(ok, F.col("file")), F.when(ok, order)).alias("found"))


def grid_exists(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """region, valid: whether all grids a region wants are there, in any extension; no grids at all are not valid."""
    found = repair_extensions(wanted, catalog)
    return wanted.join(found, "grid").groupBy("region").agg(F.bool_and(F.col("found").isNotNull()).alias("valid"))


def release_match(installed: DataFrame, releases: DataFrame) -> DataFrame:
    """release: those whose files and digests are exactly the installed ones: as many of each, and all of them equal."""
    mine = installed.groupBy("file").agg(F.max("md5").alias("own"))
    total = mine.agg(F.count(F.lit(1)).alias("installed"))
    both = releases.join(mine, "file", "left").groupBy("release").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("md5") == F.col("own")).alias("equal"))
    return both.join(F.broadcast(total), (F.col("listed") == F.col("installed")) & (F.col("equal") == F.col("installed"))).select("release")


def release_diff(releases: DataFrame, old: str, new: str) -> DataFrame:
    """file, change: added, removed or changed from one release to another."""
    a = releases.where(F.col("release") == old).select("file", F.col("md5").alias("a"))
    b = releases.where(F.col("release") == new).select("file", F.col("md5").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "file", "full_outer").select("file", change.alias("change")).where("change is not null")


def override(base: DataFrame, external: DataFrame, key: str = "region") -> DataFrame:
    """External rows replace the base rows of the same key."""
    return base.join(external.select(key).distinct(), key, "left_anti").unionByName(external)


def removed(base: DataFrame, external: DataFrame, key: str = "region") -> DataFrame:
    return base.join(external.select(key).distinct(), key, "left_anti")


def flat_ini(texts: DataFrame) -> DataFrame:
    """source, key, value of INI texts (source, text), sections put together; of repeated keys the last counts."""
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    rows = lines.where(~F.col("line").rlike(r"^\s*([\[;#]|$)") & F.col("line").rlike("[=:]"))
    key, value = F.lower(F.trim(F.regexp_extract("line", r"^([^=:]*)[=:]", 1))), F.trim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1))
    return rows.select("source", "at", key.alias("key"), value.alias("value")).groupBy("source", "key").agg(F.max_by("value", "at").alias("value"))


def reduced_3d(codes: DataFrame) -> DataFrame:
    """epsg, horizontal, datum: 3-D geographic systems as their 2-D part and the ellipsoid; others as they are."""
    table = F.create_map(*[F.lit(v) for kv in FRAMES_3D.items() for v in kv])
    return codes.select("epsg", F.coalesce(table[F.col("epsg")], F.col("epsg")).alias("horizontal"), F.when(table[F.col("epsg")].isNotNull(), "ellipse").alias("datum"))


def guess_datums(texts: DataFrame, column: str = "text") -> DataFrame:
    """texts with n, the number of known datums whose name is in a text, and datum, that one's name; empty for none, null for several."""
    found = F.filter(F.array(*map(F.lit, DEFINITIONS)), lambda name: F.contains(F.lower(column), name))
    n = F.size(found).cast("long")
    return texts.withColumns({"n": n, "datum": F.when(n == 1, F.get(found, F.lit(0))).when(n == 0, "")})


def cell_values(points: DataFrame, grid_rows: DataFrame, lattice: Lattice, add_360: bool = False) -> DataFrame:
    """points (x, y) with value, of one grid's node at the truncated index; null beside the grid. add_360 turns x by a whole turn first."""
    x = F.col("x") + 360.0 if add_360 else F.col("x")
    i, j = ((F.col("y") - lattice.lat0) / lattice.dlat).cast("bigint"), ((x - lattice.lon0) / lattice.dlon).cast("bigint")
    rows = grid_rows.select(F.col("row").cast("bigint").alias("_i"), F.col("vals").alias("_vals"))
    small = F.broadcast if lattice.node_bytes() <= 64 << 20 else (lambda t: t)
    found = points.join(small(rows), i == F.col("_i"), "left")
    return found.select(*[points[c] for c in points.columns], F.get("_vals", j.cast("int")).alias("value"))


def unsorted_keys(releases: DataFrame) -> DataFrame:
    """release, file: entries of digest tables that stand before an entry of a lower name; place is where each stands."""
    ahead = F.lead("file").over(Window.partitionBy("release").orderBy("place"))
    return releases.withColumn("_next", ahead).where(F.col("_next") < F.col("file")).select("release", "file")


def last_found(places: DataFrame) -> DataFrame:
    """grid, found: of the directories (place, path) that have a grid the last, as surfaces look it up; points take the first."""
    return places.groupBy("grid").agg(F.max_by("path", "place").alias("found"))

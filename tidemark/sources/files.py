"""Listings and small texts of a grid directory: grids, polygons, uncertainties, configurations, digests, release."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog_ops as ops
from ..plans.catalog import SIGMA_LAYERS, Catalog, Lattice, Region
from . import gtx

GRIDS = "*.{gtx,tif,tiff}"
SIGMA_FILES, RELEASE_FILES = "*sigma.inf", "*version.txt"
_TAIL = r"([^/]+)/([^/]+)$"


def grid_listing(spark: SparkSession, directory: str) -> DataFrame:
    """region, file (region/name), length of the grids one level below directory; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", GRIDS).load(f"{directory}/*/").select("path", "length")
    return rows.select(F.regexp_extract("path", _TAIL, 1).alias("region"), F.concat_ws("/", F.regexp_extract("path", _TAIL, 1), F.regexp_extract("path", _TAIL, 2)).alias("file"), "length")


def grid_digests(spark: SparkSession, directory: str) -> DataFrame:
    """file, md5 of the same grids."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", GRIDS).load(f"{directory}/*/")
    return rows.select(F.concat_ws("/", F.regexp_extract("path", _TAIL, 1), F.regexp_extract("path", _TAIL, 2)).alias("file"), F.md5("content").alias("md5"))


def polygons(spark: SparkSession, directory: str) -> DataFrame:
    """region (the folder), feature, name, ring of the placemarks in directory/region/*.kml."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.kml").text(f"{directory}/*/").select(F.col("_metadata.file_path").alias("path"), "value")
    mark = F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark.*?</Placemark>"), F.lit(0))).alias("feature", "mark")
    marks = rows.select(F.regexp_extract("path", _TAIL, 1).alias("region"), mark)
    name = F.trim(F.regexp_extract("mark", r"(?s)<name>(.*?)</name>", 1))
    corners = F.split(F.trim(F.regexp_extract("mark", r"(?s)<coordinates>(.*?)</coordinates>", 1)), r"\s+")
    ring = F.transform(corners, lambda c: F.struct(F.split(c, ",")[0].cast("double").alias("x"), F.split(c, ",")[1].cast("double").alias("y")))
    return marks.select("region", "feature", name.alias("name"), ring.alias("ring"))


def sigma(spark: SparkSession, directory: str) -> DataFrame:
    return ops.parse_sigma(spark.read.text(directory, pathGlobFilter=SIGMA_FILES).withColumnRenamed("value", "line"))


def configurations(spark: SparkSession, directory: str) -> DataFrame:
    """source (the region), key, value of directory/region/region.config."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.config").text(f"{directory}/*/")
    return ops.flat_ini(rows.select(F.regexp_extract("_metadata.file_path", _TAIL, 1).alias("source"), F.col("value").alias("text")))


def external_regions(spark: SparkSession, directory: str) -> DataFrame:
    """region, reference_frame, reference_geoid and settings of external regions that have both."""
    wide = configurations(spark, directory).groupBy(F.col("source").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"))
    get = lambda k: F.try_element_at("settings", F.lit(k)).alias(k)
    return wide.select("region", get("reference_frame"), get("reference_geoid"), "settings").where("reference_frame is not null and reference_geoid is not null")


def release(spark: SparkSession, directory: str, releases: DataFrame | None = None) -> str:
    """The release id on file, else the one release whose digests match; an error where none does."""
    found = [r["value"].strip() for r in spark.read.text(directory, pathGlobFilter=RELEASE_FILES).limit(1).collect()]
    if not found and releases is not None:
        found = [r["release"] for r in ops.release_match(grid_digests(spark, directory), releases).limit(2).collect()]
    if not found:
        raise EnvironmentError(f"no known release in {directory}")
    return found[0]


def external_sigmas(external: DataFrame) -> DataFrame:
    """region, layer, sigma_m of the settings uncertainty_layer of external regions, as numbers; what is no number is null."""
    each = external.select("region", F.explode("settings").alias("key", "value")).where(F.startswith("key", F.lit("uncertainty_")))
    return each.select("region", F.substring_index("key", "_", -1).alias("layer"), F.col("value").try_cast("double").alias("sigma_m"))


def external_catalog(spark: SparkSession, directory: str) -> Catalog:
    """The external regions of a directory: those with a polygon file and a configuration that names frame and geoid."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gpkg,shp,kml}").load(f"{directory}/*/").select(F.regexp_extract("path", _TAIL, 1).alias("region"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"))
    drawn = {r["region"] for r in rows.where("region = stem").select("region").distinct().collect()}
    known = external_regions(spark, directory).where(F.col("region").isin(sorted(drawn)))
    settings = {r["region"]: (r["reference_geoid"], r["reference_frame"]) for r in known.collect()}
    sigmas: dict[str, dict[str, float]] = {n: dict.fromkeys(SIGMA_LAYERS, 0.0) for n in settings}
    for r in external_sigmas(known).collect():
        sigmas[r["region"]][r["layer"]] = r["sigma_m"]
    heads = _heads(spark, f"{directory}/*/")
    regions = tuple(Region(n, g, heads.get(n, {}), frame=f) for n, (g, f) in sorted(settings.items()))
    return Catalog(regions, gtx.read_rows(spark, f"{directory}/*/").where(F.col("region").isin(sorted(settings))), sigmas)


def _heads(spark: SparkSession, pattern: str) -> dict[str, dict[str, Lattice]]:
    heads: dict[str, dict[str, Lattice]] = {}
    for r in gtx.read_lattices(spark, pattern).collect():
        heads.setdefault(r["region"], {})[r["layer"]] = Lattice(r["lat0"], r["lon0"], r["dlat"], r["dlon"], r["rows"], r["cols"])
    return heads


def _with_geoids(spark: SparkSession, directory: str, catalog: Catalog) -> Catalog:
    """Regions without a geoid grid of their own get the file that their geoid's path names below directory, as far as it is there."""
    wanted = sorted({r.geoid for r in catalog.regions if "geoid" not in r.grids})
    if not wanted:
        return catalog
    listed = spark.read.format("binaryFile").option("pathGlobFilter", GRIDS).option("recursiveFileLookup", True).load(directory).select("path")
    by_path = {g: g.replace("\\", "/") for g in wanted}
    names = F.array(*[F.lit(p) for p in by_path.values()])
    found = {r["tail"]: r["path"] for r in listed.select("path", F.get(F.filter(names, lambda n: F.endswith(F.col("path"), F.concat(F.lit("/"), n))), F.lit(0)).alias("tail")).where("tail is not null").collect()}
    heads, rows = {}, []
    for geoid, tail in by_path.items():
        if tail in found:
            one = next(iter(gtx.read_lattices(spark, found[tail]).collect()))
            heads[geoid] = Lattice(one["lat0"], one["lon0"], one["dlat"], one["dlon"], one["rows"], one["cols"])
            users = [r.name for r in catalog.regions if r.geoid == geoid and "geoid" not in r.grids]
            own = gtx.read_rows(spark, found[tail]).withColumn("region", F.explode(F.array(*[F.lit(u) for u in users]))).withColumn("layer", F.lit("geoid"))
            rows.append(own.select("region", "layer", "row", "vals"))
    regions = tuple(replace(r, grids={**r.grids, "geoid": heads[r.geoid]}) if "geoid" not in r.grids and r.geoid in heads else r for r in catalog.regions)
    grid_rows = catalog.grid_rows
    for own in rows:
        grid_rows = grid_rows.unionByName(own)
    return replace(catalog, regions=regions, grid_rows=grid_rows)


def load_catalog(spark: SparkSession, directory: str, geoids: dict[str, str], release_id: str = "", external: tuple[str, ...] = ()) -> Catalog:
    """The regions of directory that geoids names, in order of name, then those of external directories, which replace regions of their name.

    A region's grids are directory/region/layer.gtx or .tif, its geoid's the file that geoids names, core\\family\\file, below
    directory, unless its own folder has a geoid grid. Uncertainties come from the sigma files, those of external regions
    from their configurations. A directory that is not there is an error.
    """
    heads = _heads(spark, f"{directory}/*/")
    regions = tuple(Region(n, geoids[n], g) for n, g in sorted(heads.items()) if n in geoids)
    names = spark.createDataFrame([(r.name,) for r in regions], "region string")
    table = {r.name: dict.fromkeys(SIGMA_LAYERS, 0.0) for r in regions}
    lines = sigma(spark, directory)
    for r in ops.sole_sigma(ops.sigma_by_region(lines, names)).collect():
        table[r["region"]][r["layer"]] = r["sigma_m"]
    families = {r["layer"]: r["sigma_m"] for r in lines.where("region = 'conus'").collect()}
    whole = Catalog(regions, gtx.read_rows(spark, f"{directory}/*/"), table, families, release_id)
    for other in external:
        added = external_catalog(spark, other)
        new = {r.name for r in added.regions}
        kept = whole.grid_rows.where(~F.col("region").isin(sorted(new))).unionByName(added.grid_rows)
        whole = replace(whole, regions=tuple(r for r in whole.regions if r.name not in new) + added.regions, grid_rows=kept, sigma=whole.sigma | added.sigma)
    return _with_geoids(spark, directory, whole)


def without_external(catalog: Catalog, external: Catalog) -> Catalog:
    """catalog without the regions, grids and uncertainties that an external one brought."""
    gone = {r.name for r in external.regions}
    return replace(
        catalog, regions=tuple(r for r in catalog.regions if r.name not in gone), sigma={k: v for k, v in catalog.sigma.items() if k not in gone}, grid_rows=catalog.grid_rows.where(~F.col("region").isin(sorted(gone)))
    )


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One file from the driver, in whatever store path is; for small files."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def parse_reply(replies: DataFrame) -> DataFrame:
    """Longitude, latitude and height of the point service's JSON replies (reply)."""
    m = F.from_json("reply", "tar_lon string, tar_lat string, tar_height string")
    return replies.select(*[m[k].try_cast("double").alias(k) for k in ("tar_lon", "tar_lat", "tar_height")])

"""Grid shifts of points in the regions that may hold them, without a shuffle.

A region can only serve a point inside all its grids. An index of coarse cells lists, for each cell, the regions whose
box meets it, in order of precedence; one join on the cell gives a point its few candidates. How many at most hold a
point follows from how the boxes overlap, which the driver knows. Each place of the list is looked up by a join on
(region, grid row), and the first valid one counts: no row is multiplied and nothing is grouped again. The index and the
grids are broadcast while they are below BROADCAST_BYTES; beyond, the same equi-joins shuffle.

Where more regions than MOST_UNROLLED share a point, a join for each place would cost every point all of them, so finer
cells list, for each region, the part of its grids that a point of the cell needs: one join, and the first valid region
of the list counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import bilinear, nearest, wrap
from ..plans.transform import TransformPlan, cells_of, fine_cells, lattice_groups, most_overlap

BROADCAST_BYTES = 64 << 20
#: Up to this many places each get a join; where more regions overlap, all are looked up by one join on a cell.
MOST_UNROLLED = 4
#: Degrees that a place may differ by from frame to frame (some metres).
FRAME_SHIFT = 1e-4
_LATTICE = "struct<lat:double,lon:double,dlat:double,dlon:double,rows:int,cols:int>"
_REGION = f"region:string,ord:int,x0:double,y0:double,width:double,y1:double,f:int,g:array<{_LATTICE}>"


def private(columns: list[str]) -> str:
    """A prefix that none of columns begins with, so that what a plan adds meets no column of the caller."""
    prefix = "_tm_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def _box(region, layers: list[str]) -> tuple[float, float, float, float]:
    boxes = [region.grids[x].bounds() for x in layers]
    return max(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), min(b[3] for b in boxes)


def _bands(plan: TransformPlan, layers: list[str], interp: str) -> DataFrame:
    """region, i and, for each layer, the grid's row i (and i + 1 for bilinear)."""
    names = [r.name for _, r in plan.regions]
    rows = plan.catalog.grid_rows.where(F.col("region").isin(names) & F.col("layer").isin(layers))
    at = lambda i, tag: rows.select("region", F.col("layer"), (F.col("row") - i).alias("i"), F.lit(tag).alias("tag"), "vals")
    parts = at(0, "lo").unionByName(at(1, "hi")) if interp == "bilinear" else at(0, "lo")
    tags = ("lo", "hi") if interp == "bilinear" else ("lo",)
    packed = [F.max(F.when((F.col("layer") == x) & (F.col("tag") == tag), F.col("vals"))).alias(f"{x}_{tag}") for x in layers for tag in tags]
    return parts.groupBy("region", "i").agg(*packed)


Places = dict[str, tuple[Column, Column]]


def _pad(frames: list[str]) -> float:
    return 1e-9 if len(frames) == 1 else FRAME_SHIFT


def _described(plan: TransformPlan, order: Callable[[int], tuple], frames: list[str]) -> tuple[list[dict], list[tuple[float, float, float, float]]]:
    """What a lookup needs to know of each region, best by order first, and the boxes of their grids."""
    ranked = sorted(plan.regions, key=lambda ir: order(ir[0]), reverse=True)
    boxes, groups, regions = [_box(r, plan.layers) for _, r in ranked], lattice_groups(plan), []
    for (i, r), (x0, y0, x1, y1) in zip(ranked, boxes):
        lattices = [r.grids[layers[0]] for layers in groups]
        regions.append({"region": r.name, "ord": i, "x0": x0, "y0": y0, "width": x1 - x0, "y1": y1, "f": _frame(r, frames), "g": [{"lat": a.lat0, "lon": a.lon0, "dlat": a.dlat, "dlon": a.dlon, "rows": a.rows, "cols": a.cols} for a in lattices]})
    return regions, boxes


def _holds(c: Column, prefix: str) -> Column:
    """Whether the grids of region c hold the point."""
    p = F.get(f"{prefix}p", c["f"])
    return (p["y"] >= c["y0"]) & (p["y"] <= c["y1"]) & (wrap(p["x"] - c["x0"]) <= c["width"])


def _place(c: Column, g: int, prefix: str, interp: str) -> Column:
    """Row i and column j of the point in group g of region c's grids, and the shares t and u of the next ones."""
    p, here = F.get(c["g"], F.lit(g)), F.get(f"{prefix}p", c["f"])
    fi, fj = (here["y"] - p["lat"]) / p["dlat"], wrap(here["x"] - p["lon"]) / p["dlon"]
    if interp == "bilinear":
        i, j = F.least(F.floor(fi), p["rows"] - 2), F.least(F.floor(fj), p["cols"] - 2)
    else:
        i, j = F.floor(fi + 0.5), F.floor(fj + 0.5)
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), (fi - i).alias("t"), (fj - j).alias("u"))


def candidates(points: DataFrame, plan: TransformPlan, prefix: str, order: Callable[[int], tuple], frames: list[str]) -> DataFrame:
    """points with an array prefix + held of the regions whose grids hold the point, best by order first.

    points have prefix + p, an array of the place (x, y) in each of frames; a region looks in the frame of its geoid.
    """
    regions, boxes = _described(plan, order, frames)
    step, cells = cells_of(boxes, pad=_pad(frames))
    listed = [{"cx": cx, "cy": cy, "all": [regions[k] for k in held]} for (cx, cy), held in sorted(cells.items())]
    kind = f"array<struct<cx:int,cy:int,all:array<struct<{_REGION}>>>>"
    text = json.dumps(listed)
    index = points.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind))).toDF(*[prefix + c for c in ("cx", "cy", "all")])
    cell = lambda v: F.floor(v / F.lit(step)).try_cast("int")
    first = F.get(f"{prefix}p", F.lit(0))
    at = points.withColumns({f"{prefix}x": cell(wrap(first["x"])), f"{prefix}y": cell(first["y"])})
    small = F.broadcast if len(text) <= BROADCAST_BYTES else (lambda t: t)
    found = at.join(small(index), (F.col(f"{prefix}x") == F.col(f"{prefix}cx")) & (F.col(f"{prefix}y") == F.col(f"{prefix}cy")), "left")
    return found.select(*_own(points), F.filter(f"{prefix}all", lambda c: _holds(c, prefix)).alias(f"{prefix}held"))


def _windows(plan: TransformPlan, regions: list[dict], boxes: list[tuple[float, float, float, float]], interp: str, pad: float) -> tuple[DataFrame, int, bool]:
    """cx, cy and an array of the regions whose box meets the cell, in their order, with the part of each grid that a point
    of the cell needs; how many cells there are around; and whether all that is small enough to be broadcast.

    A part w has one entry for each layer: its first row i0 and column j0, and the rows.
    """
    groups, layers = lattice_groups(plan), list(dict.fromkeys(plan.layers))
    around, spans = fine_cells(boxes, min(min(a["dlat"], a["dlon"]) for r in regions for a in r["g"]), pad=pad)
    step, listed, size = 360 / around, [], 0
    for k, (r, (c0, c1, r0, r1)) in enumerate(zip(regions, spans)):
        east = [(r["x0"] - a["lon"]) % 360 for a in r["g"]]  # degrees from the lattice's first column to the box
        listed.append(r | {"k": k, "start": r["x0"] % 360, "east": east, "c0": c0, "c1": c1, "r0": r0, "r1": r1})
        nodes = sum(min(a["rows"], step / a["dlat"] + 5) * min(a["cols"], step / a["dlon"] + 5) * len(g) for a, g in zip(r["g"], groups))
        size += int(8 * nodes * (c1 - c0 + 1) * (r1 - r0 + 1))
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda t: t)
    spark = plan.catalog.grid_rows.sparkSession
    kind = f"array<struct<k:int,start:double,east:array<double>,c0:int,c1:int,r0:int,r1:int,{_REGION}>>"
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(listed)), kind)))
    cells = known.withColumn("c", F.explode(F.sequence("c0", "c1"))).withColumn("cy", F.explode(F.sequence("r0", "r1")))
    of_layer = [F.struct(F.lit(n).alias("n"), F.lit(layer).alias("layer"), F.lit(next(k for k, g in enumerate(groups) if layer in g)).alias("at")) for n, layer in enumerate(layers)]
    a, w, c, cy = F.get("g", F.col("l.at")), F.get("east", F.col("l.at")) - F.col("start"), F.col("c"), F.col("cy")
    clip = lambda v, n: F.greatest(F.lit(0), F.least(v, n - 1)).cast("int")
    first = lambda v, n: clip(F.floor(v) - 1, n)
    last = lambda v, n: clip(F.floor(v) + 2, n)
    parts = cells.withColumn("l", F.explode(F.array(*of_layer))).select(
        "k", "c", "cy", "l.n", "l.layer", "region",
        first((cy * step - a["lat"] - pad) / a["dlat"], a["rows"]).alias("i0"), last(((cy + 1) * step - a["lat"] + pad) / a["dlat"], a["rows"]).alias("i1"),
        first((c * step + w - pad) / a["dlon"], a["cols"]).alias("j0"), last(((c + 1) * step + w + pad) / a["dlon"], a["cols"]).alias("j1"),
    ).withColumn("row", F.explode(F.sequence("i0", F.greatest("i0", "i1"))))
    rows = plan.catalog.grid_rows.where(F.col("region").isin([r["region"] for r in regions]) & F.col("layer").isin(layers))
    rows = rows.groupBy("region", "layer", "row").agg(F.max("vals").alias("vals"))
    taken = parts.join(small(rows), ["region", "layer", "row"], "left").select("k", "c", "cy", "n", "i0", "j0", "row", F.slice("vals", F.col("j0") + 1, F.greatest(F.lit(0), F.col("j1") - F.col("j0") + 1)).alias("vals"))
    whole = taken.groupBy("k", "c", "cy", "n", "i0", "j0").agg(F.sort_array(F.collect_list(F.struct("row", "vals")))["vals"].alias("rows"))
    one = whole.groupBy("k", "c", "cy").agg(F.sort_array(F.collect_list(F.struct("n", "i0", "j0", "rows"))).alias("w"))
    full = one.join(F.broadcast(known), "k").select(F.pmod("c", F.lit(around)).alias("cx"), "cy", F.struct("k", "region", "ord", "x0", "y0", "width", "y1", "f", "g", "w").alias("one"))
    return full.groupBy("cx", "cy").agg(F.sort_array(F.collect_list("one")).alias("all")), around, size <= BROADCAST_BYTES


def _first_valid(points: DataFrame, plan: TransformPlan, prefix: str, order: Callable[[int], tuple], frames: list[str], interp: str) -> tuple[DataFrame, Column]:
    """points, and the struct of ord, region and values of the first region, best by order, that holds a point and has all its nodes.

    Which it is takes functions over the cell's list, that look no further once one is found; its values are computed after.
    """
    regions, boxes = _described(plan, order, frames)
    index, around, small = _windows(plan, regions, boxes, interp, _pad(frames))
    index = index.toDF(*[prefix + c for c in ("cx", "cy", "all")])
    first = F.get(f"{prefix}p", F.lit(0))
    cell = lambda v: F.floor(v / F.lit(360 / around)).try_cast("int")
    at = points.withColumns({f"{prefix}x": F.pmod(cell(wrap(first["x"])), F.lit(around)), f"{prefix}y": cell(first["y"])})
    df = at.join(F.broadcast(index) if small else index, (F.col(f"{prefix}x") == F.col(f"{prefix}cx")) & (F.col(f"{prefix}y") == F.col(f"{prefix}cy")), "left")
    groups, layers = lattice_groups(plan), list(dict.fromkeys(plan.layers))
    bound = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))  # noqa: E731  # f of v, which is computed once

    sides = ("lo", "hi") if interp == "bilinear" else ("lo",)
    of_group = {layer: f"g{g}" for g, mine in enumerate(groups) for layer in mine}

    def taken(c: Column) -> Column:
        """Where the point is in c's grids, and the rows of nodes about it, if all nodes it needs have data."""

        def rows(at: Column) -> Column:
            parts = []
            for n, layer in enumerate(layers):
                w, p = F.get(c["w"], F.lit(n)), at[of_group[layer]]
                nodes = [F.get(w["rows"], p["i"] - w["i0"] + k).alias(side) for k, side in enumerate(sides)]
                parts.append(F.struct((p["j"] - w["j0"]).alias("j"), p["t"].alias("t"), p["u"].alias("u"), *nodes).alias(f"l{n}"))
            return F.struct(c["ord"].alias("ord"), c["region"].alias("region"), *parts)

        def whole(r: Column) -> Column:
            ok = F.lit(True)
            for n in range(len(layers)):
                for side in sides:
                    for k in range(len(sides)):
                        ok = ok & F.get(r[f"l{n}"][side], r[f"l{n}"]["j"] + k).isNotNull()
            return F.when(ok, r)

        places = F.struct(*[_place(c, g, prefix, interp).alias(f"g{g}") for g in range(len(groups))])
        return bound(bound(places, rows), whole)

    part = f"struct<j:int,t:double,u:double,{','.join(f'{side}:array<double>' for side in sides)}>"
    kind = f"struct<ord:int,region:string,{','.join(f'l{n}:{part}' for n in range(len(layers)))}>"
    best = F.aggregate(f"{prefix}all", F.lit(None).cast(kind), lambda best, c: F.coalesce(best, F.when(_holds(c, prefix), taken(c))))
    df, r = df.select(*_own(points), best.alias(f"{prefix}best")), F.col(f"{prefix}best")
    value = lambda p: bilinear(p["lo"], p["hi"], p["j"], p["u"], p["t"]) if interp == "bilinear" else nearest(p["lo"], p["j"])
    return df, F.when(r.isNotNull(), F.struct(r["ord"].alias("ord"), r["region"].alias("region"), *[value(r[f"l{n}"]).alias(layer) for n, layer in enumerate(layers)]))


def _valid(found: Column, layers: list[str]) -> Column:
    ok = F.lit(True)
    for layer in layers:
        ok = ok & found[layer].isNotNull()
    return F.when(ok, found)


def _frame(region, frames: list[str]) -> int:
    return frames.index(region.geoid_frame()) if region.geoid_frame() in frames else 0


def _own(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def separations(
    points: DataFrame, plan: TransformPlan, interp: str = "bilinear", order: Callable[[int], tuple] | None = None, each: bool = False, out: str = "found", places: Places | None = None,
) -> DataFrame:
    """points and a struct out of ord, region and one value for each layer, null where no region is valid.

    places has, for each frame that geoids of the regions are given in, where to look; by default columns x and y in all
    of them. order ranks regions by their place; higher wins,
    and by default the last. each: a row for every region that holds the point instead; its struct has region and ord
    even where values are missing.
    """
    places = places or {"": (F.col("x"), F.col("y"))}
    prefix = private([*points.columns, out])
    here = points.withColumn(f"{prefix}p", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in places.values()]))
    order, frames, mine = order or (lambda i: (i,)), list(places), _own(points)
    most = 0 if each else most_overlap([_box(r, plan.layers) for _, r in plan.regions], _pad(frames))
    if most > MOST_UNROLLED:
        df, found = _first_valid(here, plan, prefix, order, frames, interp)
        return df.select(*mine, found.alias(out))
    df = candidates(here, plan, prefix, order, frames)
    groups = lattice_groups(plan)
    size = sum(r.grids[layer].node_bytes() for _, r in plan.regions for layer in set(plan.layers)) * 2
    small = F.broadcast if size <= BROADCAST_BYTES else (lambda t: t)
    own = _own(here)
    bands = []
    for layers in groups:
        rows = _bands(plan, layers, interp)
        bands.append(small(rows.toDF(*[f"{prefix}{c}" for c in rows.columns])))

    def looked_up(df: DataFrame, candidate: Column, keep: list[Column]) -> tuple[DataFrame, Column]:
        """df with columns for what candidate is in each group of grids, and the struct of its values."""
        df = df.select(*own, *keep, candidate.alias(f"{prefix}c"))
        c, values = F.col(f"{prefix}c"), {}
        cells = [_place(c, g, prefix, interp).alias(f"{prefix}at{g}") for g in range(len(groups))]
        df = df.select(*own, *keep, f"{prefix}c", *cells)
        for g, layers in enumerate(groups):
            at = F.col(f"{prefix}at{g}")
            df = df.join(bands[g], (c["region"] == F.col(f"{prefix}region")) & (at["i"] == F.col(f"{prefix}i")), "left")
            for layer in layers:
                low, high = F.col(f"{prefix}{layer}_lo"), F.col(f"{prefix}{layer}_hi") if interp == "bilinear" else None
                values[layer] = bilinear(low, high, at["j"], at["u"], at["t"]) if interp == "bilinear" else nearest(low, at["j"])
            got = F.struct(*[values[layer].alias(layer) for layer in layers]).alias(f"{prefix}v{g}")
            df = df.select(*own, *keep, f"{prefix}c", *[f"{prefix}at{k}" for k in range(g + 1, len(groups))], *[f"{prefix}v{k}" for k in range(g)], got)
        names = {layer: F.col(f"{prefix}v{g}")[layer] for g, layers in enumerate(groups) for layer in layers}
        return df, F.struct(c["ord"].alias("ord"), c["region"].alias("region"), *[names[layer].alias(layer) for layer in dict.fromkeys(plan.layers)])

    if each:
        df = df.withColumn(f"{prefix}one", F.explode_outer(f"{prefix}held"))
        df, found = looked_up(df, F.col(f"{prefix}one"), [])
        return df.select(*mine, found.alias(out))
    best: list[Column] = []
    for k in range(most):
        keep = [F.col(f"{prefix}held"), *best]
        df, found = looked_up(df, F.get(f"{prefix}held", F.lit(k)), keep)
        df = df.select(*own, *keep, _valid(found, list(dict.fromkeys(plan.layers))).alias(f"{prefix}b{k}"))
        best.append(F.col(f"{prefix}b{k}"))
    return df.select(*mine, (F.coalesce(*best) if best else F.lit(None)).alias(out))


def shifted(z: Column, plan: TransformPlan, found: str = "found") -> Column:
    """z after all steps, in their order."""
    for s in plan.steps:
        v = F.col(found)[s.grid]
        z = z + v if s.inverse else z - v
    return z


def total_shift(plan: TransformPlan, found: str = "found") -> Column:
    return shifted(F.lit(0.0), plan, found)


def by_region(values: dict[int, float], at: Column) -> Column:
    """The value of a region by its place, from one literal."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), "map<string,double>")[at.cast("string")]

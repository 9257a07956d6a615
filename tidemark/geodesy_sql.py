"""The queries' map projections and frame shifts as DuckDB expressions, written by themselves: numbers and formulas only, nothing of the engine's."""

from __future__ import annotations

# GRS 80: a, 1/f = 298.257222101, and what follows from it.
F_ = "(1 / 298.257222101::double)"
A = "6378137::double"
E2 = f"({F_} * (2 - {F_}))"
E = f"sqrt({E2})"
N = f"({F_} / (2 - {F_}))"
RADIUS = f"({A} / (1 + {N}) * (1 + {N} * {N} / 4 + pow({N}, 4) / 64))"


def utm_forward_ctes(source: str, lon0: int) -> str:
    """CTE utm (all columns of source, east, north): x, y are longitude and latitude."""
    a1, a2, a3 = f"({N} / 2 - 2 * pow({N}, 2) / 3 + 5 * pow({N}, 3) / 16)", f"(13 * pow({N}, 2) / 48 - 3 * pow({N}, 3) / 5)", f"(61 * pow({N}, 3) / 240)"
    return f"""u1 as (select *, sin(radians(y)) as sphi, radians(x - ({lon0})) as lam, 2 * sqrt({N}) / (1 + {N}) as rt from {source}),
u2 as (select *, sinh(atanh(sphi) - rt * atanh(rt * sphi)) as tt from u1),
u3 as (select *, atan2(tt, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + tt * tt)) as eta from u2),
utm as (select *, 500000::double + 0.9996::double * {RADIUS} * (eta + {a1} * cos(2 * xi) * sinh(2 * eta) + {a2} * cos(4 * xi) * sinh(4 * eta) + {a3} * cos(6 * xi) * sinh(6 * eta)) as east,
  0.9996::double * {RADIUS} * (xi + {a1} * sin(2 * xi) * cosh(2 * eta) + {a2} * sin(4 * xi) * cosh(4 * eta) + {a3} * sin(6 * xi) * cosh(6 * eta)) as north from u3)"""


def utm_inverse_ctes(source: str, lon0: int) -> str:
    """CTE geo (all columns of source, lon, lat): x, y are metres. The latitude by iteration, not by a series."""
    b1, b2, b3 = f"({N} / 2 - 2 * pow({N}, 2) / 3 + 37 * pow({N}, 3) / 96)", f"(pow({N}, 2) / 48 + pow({N}, 3) / 15)", f"(17 * pow({N}, 3) / 480)"
    steps = "\n".join(f"g{k + 1} as (select *, asin(tanh(psi + {E} * atanh({E} * sin(p{k})))) as p{k + 1} from g{k})," for k in range(4, 10))
    return f"""g1 as (select *, y / (0.9996::double * {RADIUS}) as xi0, (x - 500000::double) / (0.9996::double * {RADIUS}) as eta0 from {source}),
g2 as (select *, xi0 - ({b1} * sin(2 * xi0) * cosh(2 * eta0) + {b2} * sin(4 * xi0) * cosh(4 * eta0) + {b3} * sin(6 * xi0) * cosh(6 * eta0)) as xi,
  eta0 - ({b1} * cos(2 * xi0) * sinh(2 * eta0) + {b2} * cos(4 * xi0) * sinh(4 * eta0) + {b3} * cos(6 * xi0) * sinh(6 * eta0)) as eta from g1),
g3 as (select *, atanh(sin(xi) / cosh(eta)) as psi from g2),
g4 as (select *, asin(tanh(psi)) as p4 from g3),
{steps}
geo as (select *, {lon0} + degrees(atan2(sinh(eta), cos(xi))) as lon, degrees(p10) as lat from g10)"""


def lambert_ctes(source: str, lat0: str, lon0: str, lat1: str, lat2: str, east: str, north: str) -> str:
    """CTE lcc (all columns of source, east, north)."""
    m = lambda p: f"(cos({p}) / sqrt(1 - {E2} * sin({p}) * sin({p})))"
    t = lambda p: f"(tan(pi() / 4 - ({p}) / 2) / pow((1 - {E} * sin({p})) / (1 + {E} * sin({p})), {E} / 2))"
    p0, p1, p2 = (f"radians({v})" for v in (lat0, lat1, lat2))
    return f"""cone as (select (ln({m(p1)}) - ln({m(p2)})) / (ln({t(p1)}) - ln({t(p2)})) as n),
cone2 as (select n, {m(p1)} / (n * pow({t(p1)}, n)) as f from cone),
cone3 as (select n, f, {A} * f * pow({t(p0)}, n) as r0 from cone2),
l1 as (select s.*, n * radians(x - ({lon0})) as theta, {A} * f * pow({t('radians(y)')}, n) as r, r0 from {source} s, cone3),
lcc as (select *, {east} + r * sin(theta) as east, {north} + r0 - r * cos(theta) as north from l1)"""


def oblique_ctes(source: str) -> str:
    """CTE om (all columns of source, east, north): lat 57, lon -133 40', azimuth 323 7' 48.3685", k 0.9999, false 5000000, -5000000."""
    t = lambda p: f"(tan(pi() / 4 - ({p}) / 2) / pow((1 - {E} * sin({p})) / (1 + {E} * sin({p})), {E} / 2))"
    az, p0 = "radians(323::double + 7::double / 60 + 48.3685::double / 3600)", "radians(57::double)"
    return f"""o1 as (select sqrt(1 + {E2} * pow(cos({p0}), 4) / (1 - {E2})) as b),
o2 as (select b, {A} * b * 0.9999::double * sqrt(1 - {E2}) / (1 - {E2} * pow(sin({p0}), 2)) as a, greatest(1::double, b * sqrt(1 - {E2}) / (cos({p0}) * sqrt(1 - {E2} * pow(sin({p0}), 2)))) as d from o1),
o3 as (select *, d + sqrt(d * d - 1) as f, asin(sin({az}) / d) as gam from o2),
o4 as (select *, f * pow({t(p0)}, b) as h, -radians(133::double + 40::double / 60) - asin((f - 1 / f) / 2 * tan(gam)) / b as start from o3),
o5 as (select s.*, o4.*, h / pow({t('radians(y)')}, b) as q, b * (radians(x) - start) as trn from {source} s, o4),
o6 as (select *, (q - 1 / q) / 2 as ss, (q + 1 / q) / 2 as tt, sin(trn) as v from o5),
o7 as (select *, (-v * cos(gam) + ss * sin(gam)) / tt as w, a * atan2(ss * cos(gam) + v * sin(gam), cos(trn)) / b as along from o6),
o8 as (select *, a * ln((1 - w) / (1 + w)) / (2 * b) as across from o7),
om as (select *, 5000000::double + across * cos({az}) + along * sin({az}) as east, -5000000::double + along * cos({az}) - across * sin({az}) as north from o8)"""


#: Shifts in metres, turns in arc seconds and scale in millionths from ITRF to NAD83(2011).
SHIFTS = {"ITRF2014": ("1.0053", "-1.9092", "-0.5416", "0.0267814", "-0.0004203", "0.0109321", "0.00037"), "ITRF2008": ("0.99343", "-1.90331", "-0.52655", "0.02591467", "0.00942645", "0.01159935", "0.00171504")}


def cartesian_ctes(source: str, tag: str, lon: str, lat: str, h: str) -> str:
    """CTE tag: source with geocentric cx, cy, cz."""
    nu = f"({A} / sqrt(1 - {E2} * pow(sin(radians({lat})), 2)))"
    return f"{tag} as (select *, ({nu} + {h}) * cos(radians({lat})) * cos(radians({lon})) as cx, ({nu} + {h}) * cos(radians({lat})) * sin(radians({lon})) as cy, ({nu} * (1 - {E2}) + {h}) * sin(radians({lat})) as cz from {source})"


def shift_ctes(source: str, tag: str, frame: str, back: bool = False) -> str:
    """CTE tag: source with cx, cy, cz moved from an ITRF frame to NAD83(2011), or back."""
    tx, ty, tz, rx, ry, rz, s = (f"({v}::double)" for v in SHIFTS[frame])
    rx, ry, rz, k = *(f"({r} * pi() / 648000)" for r in (rx, ry, rz)), f"(1 + {s} / 1000000)"
    if not back:
        new = f"{tx} + {k} * (cx + {rz} * cy - {ry} * cz) as cx, {ty} + {k} * (-{rz} * cx + cy + {rx} * cz) as cy, {tz} + {k} * ({ry} * cx - {rx} * cy + cz) as cz"
        return f"{tag} as (select * exclude (cx, cy, cz), {new} from {source})"
    plain = f"select * exclude (cx, cy, cz), (cx - {tx}) / {k} as ax, (cy - {ty}) / {k} as ay, (cz - {tz}) / {k} as az from {source}"
    return f"{tag} as (select * exclude (ax, ay, az), ax - {rz} * ay + {ry} * az as cx, {rz} * ax + ay - {rx} * az as cy, -{ry} * ax + {rx} * ay + az as cz from ({plain}))"


def geographic_ctes(source: str, tag: str, lon: str, lat: str, h: str) -> str:
    """CTE tag: source without cx, cy, cz, with geographic coordinates; the latitude by fixed-point iteration."""
    steps = f"i0_{tag} as (select *, sqrt(cx * cx + cy * cy) as pp, atan2(cz, sqrt(cx * cx + cy * cy) * (1 - {E2})) as q0 from {source}),\n"
    for k in range(6):
        steps += f"i{k + 1}_{tag} as (select *, atan2(cz + {E2} * {A} / sqrt(1 - {E2} * pow(sin(q{k}), 2)) * sin(q{k}), pp) as q{k + 1} from i{k}_{tag}),\n"
    return steps + f"""{tag} as (select * exclude (cx, cy, cz, pp, q0, q1, q2, q3, q4, q5, q6), degrees(atan2(cy, cx)) as {lon}, degrees(q6) as {lat},
  pp * cos(q6) + cz * sin(q6) - {A} * sqrt(1 - {E2} * pow(sin(q6), 2)) as {h} from i6_{tag})"""

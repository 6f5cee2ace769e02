"""Queries of the develop and grade chain: lattices, gamuts, lens resampling, fringes, matrices of illuminants, dehazing."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import color as K
from photolake.operators import develop as D

from .pixels import RGB, point, rounded, shown
from .registry import query


def _shift(value: str) -> str:
    return f"round(1.23e-8 + {value}, 6)"


_CORNER = "greatest(0, least(CASE WHEN a = 1 THEN fr ELSE 1 END, CASE WHEN c = 1 THEN fg ELSE 1 END, CASE WHEN e = 1 THEN fb ELSE 1 END) - greatest(CASE WHEN a = 0 THEN fr ELSE 0 END, CASE WHEN c = 0 THEN fg ELSE 0 END, CASE WHEN e = 0 THEN fb ELSE 0 END))"


@query(f"""WITH q AS (SELECT image_id, y, x, image_id % 2 AS lut_id, {', '.join(f'least(greatest({c}, 0), 1) * 4 AS p{c}' for c in RGB)} FROM fx_rgb),
b AS (SELECT *, {', '.join(f'CAST(least(floor(p{c}), 3) AS INT) AS b{c}, p{c} - least(floor(p{c}), 3) AS f{c}' for c in RGB)} FROM q),
s AS (SELECT b.*, a, c, e, {_CORNER} AS w FROM b, (SELECT unnest([0, 1]) AS a) t1, (SELECT unnest([0, 1]) AS c) t2, (SELECT unnest([0, 1]) AS e) t3)
SELECT image_id, y, x, {', '.join(f'{_shift(f"sum(w * l.{c})")} AS {c}' for c in RGB)} FROM s JOIN fx_lut l ON l.lut_id = s.lut_id AND l.i = br + a AND l.j = bg + c AND l.k = bb + e GROUP BY 1, 2, 3""")
def lut3d_apply(spark, d):
    px = view(spark, d, "fx_rgb").withColumn("lut_id", (F.col("image_id") % 2).cast("int"))
    out = D.lut3d_apply(px, view(spark, d, "fx_lut"))
    return out.select(*D.PIXEL, *[shown(c, 6).alias(c) for c in RGB])


def _gamut(row: int, channel: str) -> str:
    parts = [f"WHEN {k} THEN {K.dot(tuple(D.gamut_matrix(p)[row].tolist()), RGB)}" for k, p in enumerate(D.GAMUTS.values())]
    return f"CASE image_id % {len(D.GAMUTS) + 1} {' '.join(parts)} ELSE {channel} END"


point("gamut_transform", rounded(**{c: _gamut(k, c) for k, c in enumerate(RGB)}))

_SIGMA = 0.8
_KERNEL = [math.exp(-0.5 * (k / _SIGMA) ** 2) for k in range(-3, 4)]
_KERNEL = [w / sum(_KERNEL) for w in _KERNEL]


@query(f"""WITH g AS (SELECT unnest(range(-3, 4)) AS o, unnest([{', '.join(f'{w!r}::DOUBLE' for w in _KERNEL)}]) AS w),
h AS (SELECT a.image_id, a.y, a.x, sum(w * b.v) AS v FROM fx_px a CROSS JOIN g JOIN fx_px b ON b.image_id = a.image_id AND b.y = a.y AND b.x = least(greatest(a.x + o, 0), 7) GROUP BY 1, 2, 3)
SELECT a.image_id, a.y, a.x, {_shift('sum(w * b.v)')} AS v FROM h a CROSS JOIN g JOIN h b ON b.image_id = a.image_id AND b.x = a.x AND b.y = least(greatest(a.y + o, 0), 7) GROUP BY 1, 2, 3""")
def gaussian_blur(spark, d):
    return D.gaussian_blur(view(spark, d, "fx_px"), "v", _SIGMA).select(*D.PIXEL, shown("blurred_v", 6).alias("v"))


_SY, _SX = D.lens_position("y", "x", (-0.12, 0.03, 0.01), (0.004, -0.006), 4.0, 8.0)


@query(f"""WITH s AS (SELECT image_id, y, x, least(greatest({_SY}, 0), 7) AS sy, least(greatest({_SX}, 0), 7) AS sx FROM fx_px),
t AS (SELECT s.*, a, b, abs(1 - a - (sy - floor(sy))) * abs(1 - b - (sx - floor(sx))) AS w FROM s, (SELECT unnest([0, 1]) AS a) p, (SELECT unnest([0, 1]) AS b) q)
SELECT t.image_id, t.y, t.x, {_shift('sum(w * p.v)')} AS v FROM t JOIN fx_px p ON p.image_id = t.image_id AND p.y = least(floor(sy) + a, 7) AND p.x = least(floor(sx) + b, 7) GROUP BY 1, 2, 3""")
def distortion_resample(spark, d):
    """Each frame through a lens model with three radial and two tangential terms."""
    lens = D.Lens((-0.12, 0.03, 0.01), (0.004, -0.006), (4.0, 4.0), 8.0)
    return D.resample(view(spark, d, "fx_px"), lens, F.lit(8), F.lit(8)).withColumn("v", shown("v", 6))


def _masked(channel: str, source: str = "fx_rgb") -> str:
    """Common tables up to m: the source with the blurred mask of a channel."""
    parts, now = [f"t AS (SELECT image_id, y, x, greatest(({channel} - 0.2) / 0.8, 0) AS v FROM {source})"], "t"
    for k, (line, along) in enumerate((("y", "x"), ("y", "x"), ("x", "y"), ("x", "y"))):
        parts.append(f"t{k} AS (SELECT a.image_id, a.{line}, a.{along}, sum(b.v) / 3 AS v FROM {now} a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) s JOIN {now} b ON b.image_id = a.image_id AND b.{line} = a.{line} AND b.{along} = least(greatest(a.{along} + s.o, 0), 7) GROUP BY 1, 2, 3)")
        now = f"t{k}"
    return "WITH " + ", ".join(parts) + f", m AS (SELECT p.*, least(greatest(t3.v, 0), 1) AS mask FROM {source} p JOIN t3 USING (image_id, y, x))"


def _blue_fringe(base: str, side: str, source: str = "fx_rgb") -> str:
    return f"{_masked('b', source)}, e AS (SELECT *, greatest(b - {base}, 0) AS over, least(mask, greatest(b - {base}, 0) * 1.16) AS mb FROM m), f AS (SELECT *, least(greatest({side} - {base}, 0), mb * 0.33) AS ms FROM e)"


def _fringe_query(name: str, base: str, side: str):
    shownd = ", ".join(f"{_shift({'b': 'b - mb', side: f'{side} - ms'}.get(c, c))} AS {c}" for c in RGB)

    def run(spark, d):
        return D.defringe_blue(view(spark, d, "fx_rgb"), base, side).select(*D.PIXEL, *[shown(c, 6).alias(c) for c in RGB])

    run.__name__ = name
    query(f"{_blue_fringe(base, side)} SELECT image_id, y, x, {shownd} FROM f")(run)


_fringe_query("defringe_purple", "g", "r")
_fringe_query("defringe_cyan", "r", "g")


@query(f"{_masked('g')}, e AS (SELECT *, greatest(g - greatest(r, b), 0) AS over, greatest(r, b) * 0.5 + (r + b) * 0.25 AS target FROM m) SELECT image_id, y, x, {_shift('r')} AS r, {_shift('g - least(greatest(g - target, 0), least(mask, over * 1.16))')} AS g, {_shift('b')} AS b FROM e")
def defringe_green(spark, d):
    return D.defringe_green(view(spark, d, "fx_rgb")).select(*D.PIXEL, *[shown(c, 6).alias(c) for c in RGB])


@query(f"{_blue_fringe('g', 'r')} SELECT image_id, count(*) FILTER (over > 1e-6 AND mb > 0) AS touched, {_shift('coalesce(avg(mb) FILTER (over > 1e-6 AND mb > 0), 0)')} AS blue, {_shift('coalesce(avg(ms) FILTER (over > 1e-6 AND mb > 0), 0)')} AS red FROM f GROUP BY 1")
def defringe_stats(spark, d):
    """Pixels that the purple fringe touches, and what it takes from them on average."""
    mean = lambda c: shown(F.coalesce(F.avg(F.when(F.col("touched"), F.col(c))), F.lit(0.0)), 6)
    out = D.defringe_blue(view(spark, d, "fx_rgb"), "g", "r").groupBy("image_id")
    return out.agg(F.count_if("touched").alias("touched"), mean("removed_b").alias("blue"), mean("removed_side").alias("red"))


_BRACKET = """WITH k AS (SELECT event_id, event_id % 4 AS camera_id, kelvin FROM fx_kelvin),
s AS (SELECT k.*, max(CASE WHEN cct <= kelvin THEN cct END) AS lo, min(CASE WHEN cct >= kelvin THEN cct END) AS hi FROM k LEFT JOIN fx_matrix USING (camera_id) GROUP BY 1, 2, 3),
t AS (SELECT event_id, camera_id, kelvin, coalesce(lo, hi) AS lo, coalesce(hi, lo) AS hi FROM s)"""


def _targets(spark, d):
    return view(spark, d, "fx_kelvin").select("event_id", (F.col("event_id") % 4).alias("camera_id"), "kelvin")


@query(f"{_BRACKET} SELECT event_id, camera_id, lo AS below, hi AS above FROM t")
def illuminant_bracket(spark, d):
    return D.with_bracket(_targets(spark, d), view(spark, d, "fx_matrix")).select("event_id", "camera_id", F.col("below.cct").alias("below"), F.col("above.cct").alias("above"))


@query(f"""{_BRACKET}, g AS (SELECT *, CASE WHEN lo = hi THEN 0 ELSE (1 / lo - 1 / kelvin) / (1 / lo - 1 / hi) END AS g FROM t)
SELECT g.event_id, {_shift('g')} AS g, {', '.join(f'{_shift(f"(1 - g) * p.m[{k + 1}] + g * q.m[{k + 1}]")} AS m{k}' for k in range(9))} FROM g LEFT JOIN fx_matrix p ON p.camera_id = g.camera_id AND p.cct = lo LEFT JOIN fx_matrix q ON q.camera_id = g.camera_id AND q.cct = hi WHERE lo IS NOT NULL""")
def mired_blend(spark, d):
    out = D.mired_blend(_targets(spark, d), view(spark, d, "fx_matrix")).where("m IS NOT NULL")
    return out.select("event_id", shown("g", 6).alias("g"), *[shown(F.col("m")[k], 6).alias(f"m{k}") for k in range(9)])


def _weighted(k: int) -> str:
    mean = f"sum(CASE WHEN b.colour = {k} THEN w * b.v END) / sum(CASE WHEN b.colour = {k} THEN w END)"
    return f"{_shift(f'CASE WHEN a.colour = {k} THEN a.v ELSE coalesce({mean}, a.v) END')} AS {RGB[k]}"


@query(f"""WITH m AS (SELECT image_id, y, x, v, colour FROM fx_px40 JOIN fx_xtrans ON y % 6 = ry AND x % 6 = rx),
o AS (SELECT *, CASE WHEN dy = 0 OR dx = 0 THEN 0.5 ELSE 0.25 END AS w FROM (SELECT unnest([-1, 0, 1]) AS dy) s, (SELECT unnest([-1, 0, 1]) AS dx) t WHERE dy <> 0 OR dx <> 0)
SELECT a.image_id, a.y, a.x, {', '.join(_weighted(k) for k in range(3))} FROM m a CROSS JOIN o JOIN m b ON a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY a.image_id, a.y, a.x, a.v, a.colour""")
def demosaic_xtrans_fast(spark, d):
    out = D.demosaic_weighted(view(spark, d, "fx_px40"), view(spark, d, "fx_xtrans"), 6)
    return out.select(*D.PIXEL, *[shown(c, 6).alias(c) for c in RGB])


_MERGED = {"min": "min(v)", "avg": "avg(v)", "blue": "max(CASE WHEN colour = 2 THEN v END)", "each": None}


def _merge_query(mode: str, how: str | None):
    merged = f"{how} OVER (PARTITION BY image_id, floor(y / 2), floor(x / 2))" if how else "v"

    def run(spark, d):
        out = D.cell_merge(D.plane_grids(view(spark, d, "fx_px40"), view(spark, d, "fx_cfa")), "v", mode)
        return out.select(F.col("frame_id").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), shown("merged", 6).alias("v"))

    run.__name__ = f"cell_merge_{mode}"
    query(f"SELECT image_id, y, x, {_shift(merged)} AS v FROM fx_px40 JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx")(run)


for _mode, _how in _MERGED.items():
    _merge_query(_mode, _how)

_NEAR = "p.image_id = q.image_id AND p.plane = q.plane AND abs(p.y - q.y) <= 8 AND abs(p.x - q.x) <= 8"


@query(f"""WITH c AS (SELECT image_id, plane, y AS py, x AS px, CAST(floor(y / 2) AS INT) AS y, CAST(floor(x / 2) AS INT) AS x, v FROM fx_px40 JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx),
k AS (SELECT p.image_id, p.plane, p.py, p.px, p.y, p.x, p.v, min(q.v) AS dark FROM c p JOIN c q ON {_NEAR} GROUP BY ALL),
m AS (SELECT p.image_id, p.plane, p.py, p.px, p.y, p.x, p.v, avg(q.v) AS mi, avg(q.dark) AS mp, avg(q.v * q.v) AS mii, avg(q.v * q.dark) AS mip FROM k p JOIN k q ON {_NEAR} GROUP BY ALL),
a AS (SELECT *, (mip - mi * mp) / (mii - mi * mi + 0.01) AS a FROM m), b AS (SELECT *, mp - a * mi AS b FROM a),
h AS (SELECT p.image_id, p.plane, p.py, p.px, p.y, p.x, p.v, least(greatest(avg(q.a) * p.v + avg(q.b), 0), 0.3) AS haze FROM b p JOIN b q ON {_NEAR} GROUP BY p.image_id, p.plane, p.py, p.px, p.y, p.x, p.v),
g AS (SELECT *, min(haze) OVER (PARTITION BY image_id, y, x) AS least_haze FROM h)
SELECT image_id, py AS y, px AS x, {_shift('greatest((v - 1) / greatest(1 - 0.5 * least_haze, 0.001) + 1, 0)')} AS v FROM g""")
def dehaze(spark, d):
    """Dark channel, guided filter, merge by cells and application on every plane of a Bayer mosaic."""
    return D.dehaze(view(spark, d, "fx_px40"), view(spark, d, "fx_cfa"), 0.5, cap=0.3).withColumn("v", shown("v", 6))

"""The two composed chains, mosaic to colours and colours to bytes, with SQL written stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import color as K
from photolake.operators import develop as D
from photolake.operators import presets
from photolake.sources.scratch import shared_dir

from .develop import _blue_fringe, _masked, _shift
from .pixels import RGB, shown
from .profiles import _BESIDE, _CORNER, _CORNERS
from .registry import query

_GAINS = (1.9, 1.0, 1.5)
_NEAR = "p.image_id = q.image_id AND p.plane = q.plane AND abs(p.y - q.y) <= 8 AND abs(p.x - q.x) <= 8"
_KEPT = "p.image_id, p.plane, p.py, p.px, p.y, p.x, p.v"


def _coloured(source: str) -> str:
    return f"(SELECT image_id, y, x, v, plane, colour FROM {source} JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx)"


def _steps(source: str) -> str:
    for k, step in enumerate(K.loca_steps(0.8, 0.6)):
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in step.items())} FROM {source}) t{k}"
    return source


def _channel(k: int) -> str:
    return f"{_shift(f'(CASE WHEN a.colour = {k} THEN a.v ELSE avg(CASE WHEN b.colour = {k} THEN b.v END) END) * {_GAINS[k]}e0')} AS {RGB[k]}"


@query(f"""WITH s AS MATERIALIZED (SELECT image_id, y, x, least(greatest(v, 0), 1) * sqrt(2) AS v FROM fx_px),
n8 AS (SELECT a.image_id, a.y, a.x, a.v, min(b.v) AS lo, max(b.v) AS hi, quantile_cont(b.v, 0.5) AS median, count(*) AS n FROM s a JOIN s b ON a.image_id = b.image_id AND abs(a.y - b.y) IN (0, 2) AND abs(a.x - b.x) IN (0, 2) AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4),
calm AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND n >= 4 AND (v > hi + 0.05 OR v < lo - 0.05) THEN median + (v - median) * 0.05 / (0.05 + abs(v - median)) ELSE v END AS v FROM n8),
c AS MATERIALIZED (SELECT image_id, plane, y AS py, x AS px, CAST(floor(y / 2) AS INT) AS y, CAST(floor(x / 2) AS INT) AS x, v FROM {_coloured("calm")} w),
k AS (SELECT {_KEPT}, min(q.v) AS dark FROM c p JOIN c q ON {_NEAR} GROUP BY ALL),
m AS (SELECT {_KEPT}, avg(q.v) AS mi, avg(q.dark) AS mp, avg(q.v * q.v) AS mii, avg(q.v * q.dark) AS mip FROM k p JOIN k q ON {_NEAR} GROUP BY ALL),
ab AS (SELECT *, mp - a * mi AS b FROM (SELECT *, (mip - mi * mp) / (mii - mi * mi + 0.01) AS a FROM m) u),
h AS (SELECT {_KEPT}, least(greatest(avg(q.a) * p.v + avg(q.b), 0), 0.3) AS haze FROM ab p JOIN ab q ON {_NEAR} GROUP BY {_KEPT}),
clear AS MATERIALIZED (SELECT image_id, py AS y, px AS x, greatest((v - 1) / greatest(1 - 0.5 * min(haze) OVER (PARTITION BY image_id, y, x), 0.001) + 1, 0) AS v FROM h),
e AS MATERIALIZED {_coloured("clear")},
near AS (SELECT a.image_id, a.y, a.x, a.v, a.colour, {_BESIDE.format(0)} AS red, {_BESIDE.format(2)} AS blue, {', '.join(f'{_CORNER.format(*o)} AS {n}' for n, o in _CORNERS.items())}
 FROM e a JOIN e b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
mended AS MATERIALIZED (SELECT image_id, y, x, colour, CASE WHEN pp + mm + pm + mp IS NOT NULL AND red + blue IS NOT NULL THEN repaired ELSE v END AS v FROM {_steps("near")})
SELECT a.image_id, a.y, a.x, {', '.join(_channel(k) for k in range(3))} FROM mended a JOIN mended b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.image_id, a.y, a.x, a.v, a.colour""")
def develop_mosaic(spark, d):
    """Mosaics to full colour in one plan, all stages on."""
    inside = F.col("y").between(2, 5) & F.col("x").between(2, 5)
    out = D.develop_mosaic(view(spark, d, "fx_px"), view(spark, d, "fx_cfa"), ev=0.5, impulse=0.05, inside=inside, dehaze_strength=0.5, cap=0.3, purple=0.8, green=0.6, gains=_GAINS)
    return out.select(*D.PIXEL, *[shown(c, 6).alias(c) for c in RGB])


_TO_WORKING = ((0.7977, 0.1352, 0.0313), (0.2880, 0.7119, 0.0001), (0.0, 0.0, 0.8249))
_PROJECTED = ", ".join(f"least(greatest({' + '.join(f'{w} * {c}' for w, c in zip(row, RGB, strict=True))}, 0), 1) AS {n}" for n, row in zip(RGB, _TO_WORKING, strict=True))


def _less_blue(base: str, side: str, source: str) -> str:
    return f"{_blue_fringe(base, side, source)} SELECT image_id, y, x, {', '.join({'b': 'b - mb AS b', side: f'{side} - ms AS {side}'}.get(c, c) for c in RGB)} FROM f"


_LESS_GREEN = f"{_masked('g', 'p2')}, e AS (SELECT *, greatest(g - greatest(r, b), 0) AS over, greatest(r, b) * 0.5 + (r + b) * 0.25 AS target FROM m) SELECT image_id, y, x, r, g - least(greatest(g - target, 0), least(mask, over * 1.16)) AS g, b FROM e"
_BYTE = "CAST(floor(least(greatest(CASE WHEN image_id % 2 = 0 THEN CASE WHEN greatest(k{c}, 1e-6) < 0.01 THEN 5.6 * greatest(k{c}, 1e-6) + 0.125 ELSE 0.241514 * log10(greatest(k{c}, 1e-6) + 0.00873) + 0.598206 END WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * power({c}, 1 / 2.4) - 0.055 END, 0), 1) * 255 + 1e-9) AS INT) AS {c}"


@query(f"""WITH p0 AS MATERIALIZED (SELECT image_id, y, x, {_PROJECTED} FROM fx_rgb),
p1 AS MATERIALIZED ({_less_blue("g", "r", "p0")}), p2 AS MATERIALIZED ({_less_blue("r", "g", "p1")}), p3 AS MATERIALIZED ({_LESS_GREEN}),
l AS (SELECT *, 0.2880402 * r + 0.7118741 * g + 0.0000857 * b AS luma FROM p3),
k AS (SELECT *, {', '.join(f'greatest((luma + ({c} - luma) * 1.25 - 0.18) * 1.1 + 0.18, 0) AS k{c}' for c in RGB)} FROM l)
SELECT image_id, y, x, {', '.join(_BYTE.format(c=c) for c in RGB)} FROM k""")
def render(spark, d):
    """Camera colours to bytes with the three fringe repairs; images of even id are graded, the others get the display curve."""
    return D.render(view(spark, d, "fx_rgb"), _TO_WORKING, F.col("image_id") % 2 == 0)


# Presets: stops and gains before the projection, the look after it; four keys, each under two looks.
_PRESETS = [(k, 0.5 * (k % 2), (1.9, 1.4)[k // 2 % 2], (1.5, 2.0)[k // 2 % 2], k >= 4) for k in range(8)]


@query(f"""WITH p(preset_id, lift, gr, gb, graded) AS (VALUES {', '.join(f'({k}, {2.0**ev!r}e0, {r}e0, {b}e0, {str(look).lower()})' for k, ev, r, b, look in _PRESETS)}),
c AS MATERIALIZED (SELECT image_id, y, x, least(greatest(v, 0), 1) AS v, colour FROM {_coloured("fx_px")} w),
d AS MATERIALIZED (SELECT a.image_id, a.y, a.x, {', '.join(f'CASE WHEN a.colour = {k} THEN a.v ELSE avg(CASE WHEN b.colour = {k} THEN b.v END) END AS {RGB[k]}0' for k in range(3))}
 FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.image_id, a.y, a.x, a.v, a.colour),
m AS (SELECT preset_id, graded, image_id, y, x, r0 * lift * gr AS r, g0 * lift AS g, b0 * lift * gb AS b FROM d, p),
q AS (SELECT preset_id, graded, image_id, y, x, {_PROJECTED} FROM m),
l AS (SELECT *, 0.2880402 * r + 0.7118741 * g + 0.0000857 * b AS luma FROM q),
k AS (SELECT *, {', '.join(f'greatest((luma + ({c} - luma) * 1.25 - 0.18) * 1.1 + 0.18, 0) AS k{c}' for c in RGB)} FROM l)
SELECT preset_id, image_id, y, x, {', '.join(_BYTE.replace("image_id % 2 = 0", "graded").format(c=c) for c in RGB)} FROM k""")
def preset_cross(spark, d):
    """Every frame under each of eight presets: developed once for each of four keys, kept, then shown under the looks."""
    rows = spark.createDataFrame(_PRESETS, "preset_id long, ev double, gain_r double, gain_b double, graded boolean")
    store = presets.DevelopedStore(spark, f"{shared_dir(spark)}/photolake/developed-{uuid.uuid4().hex}")
    return presets.render_presets(view(spark, d, "fx_px"), view(spark, d, "fx_cfa"), rows, store, _TO_WORKING)[0]

"""Queries that measure lateral colour fringes; frames of 64 × 64 pixels made of 64 embeddings each, blocks of 8 × 8."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.operators import aberration as A

from .pixels import shown
from .registry import query

TILE = 8


def _near(value: str, along: str, step: int) -> str:
    across = "x" if along == "y" else "y"
    low, high = (f"{abs(step)} PRECEDING",) * 2 if step < 0 else (f"{step} FOLLOWING",) * 2
    return f"max({value}) OVER (PARTITION BY image_id, {across} ORDER BY {along} RANGE BETWEEN {low} AND {high})"


def _both(value: str, along: str, step: int) -> str:
    return f"({_near(value, along, step)} + {_near(value, along, -step)})"


def _first(n: str) -> str:
    return f"{_near('d', n, 4)} AS d4{n}, {_near('d', n, -4)} AS dm{n}, 2*g + {_both('g', n, 2)} AS gg{n}, 2*c + {_both('c', n, 2)} AS cc{n}, {_near('g', n, 1)} - {_near('g', n, -1)} AS s{n}"


def _second(n: str) -> str:
    return f"abs(abs(d4{n} - d) + abs(d - dm{n}) - abs(d4{n} - dm{n})) AS h{n}, abs(gg{n} - cc{n}) / 4 AS l{n}, (gg{n} + cc{n}) / 4 AS u{n}"


MOMENTS = f"""m0 AS (SELECT *, c - g AS d FROM (SELECT image_id, y, x, g, CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN r WHEN y % 2 = 1 AND x % 2 = 1 THEN b END AS c FROM fx_rgb64) q),
m1 AS (SELECT *, {_first('y')}, {_first('x')} FROM m0), m2 AS (SELECT *, {_second('y')}, {_second('x')} FROM m1),
m3 AS (SELECT image_id, y, x, c, d, {_both('ly', 'y', 2)} AS low0, {_both('uy', 'y', 2)} AS up0, {_both('lx', 'x', 2)} AS low1, {_both('ux', 'x', 2)} AS up1, hy + 0.5 * {_both('hy', 'x', 2)} AS high0, hx + 0.5 * {_both('hx', 'x', 2)} AS high1, sy + 0.3 * {_both('sy', 'x', 1)} AS g0, sx + 0.3 * {_both('sx', 'y', 1)} AS g1 FROM m2),
m4 AS (SELECT image_id, y // {TILE} + 1 AS vblock, x // {TILE} + 1 AS hblock, y % 2 AS colour, 0 AS direction, d, g0 AS g, high0 * up0 / (1e-5 + 0.1 * up0 + low0) AS w FROM m3 WHERE c IS NOT NULL
 UNION ALL SELECT image_id, y // {TILE} + 1, x // {TILE} + 1, y % 2, 1, d, g1, high1 * up1 / (1e-5 + 0.1 * up1 + low1) FROM m3 WHERE c IS NOT NULL),
moments AS (SELECT image_id, vblock, hblock, colour, direction, 0.25 * sum(w * d * d) AS m0, 0.25 * 0.3125 * sum(w * g * d) AS m1, 0.25 * 0.3125 * 0.3125 * sum(w * g * g) AS m2 FROM m4 WHERE w IS NOT NULL AND g IS NOT NULL GROUP BY ALL)"""
SHIFTS = f"""{MOMENTS}, s0 AS (SELECT *, CASE WHEN m2 > 1e-10 THEN m1 / m2 ELSE 17 END AS shift, CASE WHEN m2 > 1e-10 THEN m2 / (1e-5 + m0) ELSE 0 END AS own FROM moments),
s1 AS (SELECT image_id, colour, direction, avg(shift * shift) - avg(shift) ** 2 AS variance FROM s0 WHERE abs(shift) < 2 GROUP BY ALL),
s2 AS (SELECT image_id, vblock, hblock, own AS weight FROM s0 WHERE colour = 1 AND direction = 1),
shifts AS (SELECT s0.*, weight, variance FROM s0 LEFT JOIN s2 USING (image_id, vblock, hblock) JOIN (SELECT DISTINCT image_id, colour, direction FROM s0) k USING (image_id, colour, direction) LEFT JOIN s1 USING (image_id, colour, direction))"""
GATED = f"""{SHIFTS}, size AS (SELECT image_id, max(vblock) AS nv, max(hblock) AS nh FROM shifts GROUP BY 1),
near AS (SELECT a.image_id, a.vblock, a.hblock, a.colour, a.direction, a.weight, a.variance, median(b.shift) AS shift FROM shifts a JOIN size USING (image_id) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dv) p CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dh) q
 JOIN shifts b ON b.image_id = a.image_id AND b.colour = a.colour AND b.direction = a.direction AND b.vblock = CASE WHEN a.vblock + dv = 0 THEN 2 WHEN a.vblock + dv > nv THEN nv - 1 ELSE a.vblock + dv END AND b.hblock = CASE WHEN a.hblock + dh = 0 THEN 2 WHEN a.hblock + dh > nh THEN nh - 1 ELSE a.hblock + dh END GROUP BY ALL),
gated AS (SELECT * FROM near a WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.image_id = a.image_id AND b.vblock = a.vblock AND b.hblock = a.hblock AND b.colour = a.colour AND b.shift * b.shift > 8 * b.variance))"""
KEY = "image_id, vblock, hblock, colour, direction"


def moments(spark, d):
    return A.tile_moments(view(spark, d, "fx_rgb64"), TILE)


def gated(spark, d):
    return A.gated_blocks(A.tile_shifts(moments(spark, d)))


@query(f"WITH {MOMENTS} SELECT {KEY}, round(1.23e-8 + m0, 6) AS m0, round(1.23e-8 + m1, 6) AS m1, round(1.23e-8 + m2, 6) AS m2 FROM moments")
def ca_tile_moments(spark, d):
    return moments(spark, d).select(*KEY.split(", "), *[shown(c, 6).alias(c) for c in ("m0", "m1", "m2")])


@query(f"WITH {SHIFTS} SELECT {KEY}, round(1.23e-8 + shift, 6) AS shift, round(1.23e-8 + weight, 6) AS weight, round(1.23e-8 + variance, 6) AS variance FROM shifts")
def ca_tile_shift(spark, d):
    return A.tile_shifts(moments(spark, d)).select(*KEY.split(", "), *[shown(c, 6).alias(c) for c in ("shift", "weight", "variance")])


@query(f"WITH {GATED} SELECT {KEY}, round(1.23e-8 + shift, 6) AS shift FROM gated")
def ca_block_median_gate(spark, d):
    return gated(spark, d).select(*KEY.split(", "), shown("shift", 6).alias("shift"))


@query(f"""WITH {GATED} SELECT image_id, colour, direction, count(*) AS n, p, q, round(1.23e-5 + sum(weight * power(vblock, p // 4 + q // 4) * power(hblock, p % 4 + q % 4)), 3) AS value, round(1.23e-5 + sum(weight * shift * power(vblock, p // 4) * power(hblock, p % 4)), 3) AS rhs
FROM gated CROSS JOIN (SELECT unnest(range(16)) AS p) a CROSS JOIN (SELECT unnest(range(16)) AS q) b GROUP BY ALL""")
def poly2d_normal_equations(spark, d):
    rounded = lambda c: F.round(F.lit(1.23e-5) + F.col(c), 3).alias(c)
    return A.power_sums(gated(spark, d)).select("image_id", "colour", "direction", "n", "p", "q", rounded("value"), rounded("rhs"))


# Elimination by rows on the scaled system: the matrix with its right side as a list of rows, a step a column. With fewer than 32
# blocks in a colour the system is that of the terms 1, h, v and vh, with fewer than 10 there is none.
SOLVED = f"""{GATED.replace("WITH ", "")}, counts AS (SELECT image_id, colour, direction, count(*) AS n FROM gated GROUP BY ALL),
least_of AS (SELECT image_id, least(coalesce(min(CASE WHEN colour = 0 THEN n END), 0), coalesce(min(CASE WHEN colour = 1 THEN n END), 0)) AS n FROM counts GROUP BY 1),
cells AS (SELECT image_id, colour, direction, p, q, sum(weight * power(vblock, p // 4 + q // 4) * power(hblock, p % 4 + q % 4)) AS value, sum(weight * shift * power(vblock, p // 4) * power(hblock, p % 4)) AS rhs
 FROM gated JOIN least_of x USING (image_id) CROSS JOIN (SELECT unnest(range(16)) AS p) a CROSS JOIN (SELECT unnest(range(16)) AS q) b WHERE x.n >= 32 OR (x.n >= 10 AND p IN (0, 1, 4, 5) AND q IN (0, 1, 4, 5)) GROUP BY image_id, colour, direction, p, q),
scale AS (SELECT image_id, colour, direction, p, sqrt(abs(value)) AS s FROM cells WHERE p = q),
scaled AS (SELECT c.image_id, c.colour, c.direction, c.p, list(c.value / a.s / b.s ORDER BY c.q) AS line, max(c.rhs / a.s) AS rhs FROM cells c JOIN scale a USING (image_id, colour, direction, p) JOIN scale b ON b.image_id = c.image_id AND b.colour = c.colour AND b.direction = c.direction AND b.p = c.q GROUP BY c.image_id, c.colour, c.direction, c.p),
start AS (SELECT image_id, colour, direction, list(list_append(line, rhs) ORDER BY p) AS m FROM scaled GROUP BY ALL),
steps(image_id, colour, direction, k, m) AS (SELECT image_id, colour, direction, CAST(1 AS BIGINT), m FROM start
 UNION ALL SELECT image_id, colour, direction, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda e: e / m[k][k]) ELSE list_transform(line, lambda e, j: e - line[k] / m[k][k] * m[k][j]) END) FROM steps WHERE k <= len(m)),
solved AS (SELECT t.image_id, t.colour, t.direction, a.p, t.m[CAST(row_number() OVER (PARTITION BY t.image_id, t.colour, t.direction ORDER BY a.p) AS BIGINT)][len(t.m) + 1] / a.s AS c FROM steps t JOIN scale a USING (image_id, colour, direction) WHERE t.k = len(t.m) + 1)"""


def _fits(spark, d):
    return A.solve(A.power_sums(gated(spark, d)), "bilinear")


@query(f"WITH RECURSIVE {SOLVED} SELECT image_id, colour, direction, CAST(p AS INT) AS p, round(1.23e-5 + c, 3) AS coefficient FROM solved")
def poly2d_solve(spark, d):
    """The fitted coefficients of each image, colour and direction, those of the terms of its system; none where there is no fit."""
    rows = _fits(spark, d).where("coefficients IS NOT NULL").select("image_id", "colour", "direction", F.posexplode("coefficients").alias("p", "c"))
    least = A.power_sums(gated(spark, d)).groupBy("image_id").agg(F.least(F.coalesce(F.min(F.when(F.col("colour") == 0, F.col("n"))), F.lit(0)), F.coalesce(F.min(F.when(F.col("colour") == 1, F.col("n"))), F.lit(0))).alias("n"))
    terms = rows.join(least, "image_id").where("n >= 32 OR p IN (0, 1, 4, 5)")
    return terms.select("image_id", "colour", "direction", "p", F.round(F.col("c") + 1.23e-5, 3).alias("coefficient"))


@query(f"""WITH RECURSIVE {SOLVED}, blocks AS (SELECT DISTINCT image_id, vblock, hblock FROM moments)
SELECT b.image_id, vblock, hblock, colour, direction, round(1.23e-5 + sum(c * power(vblock, p // 4) * power(hblock, p % 4)), 3) AS shift FROM blocks b JOIN solved USING (image_id) GROUP BY ALL""")
def ca_shift_vector(spark, d):
    """Shift of each block by the fitted polynomial, for both colours and directions."""
    blocks = moments(spark, d).select("image_id", "vblock", "hblock").distinct()
    out = blocks.join(_fits(spark, d).where("coefficients IS NOT NULL"), "image_id")
    return out.select(*KEY.split(", "), F.round(A.shift_at(F.col("vblock"), F.col("hblock"), F.col("coefficients")) + 1.23e-5, 3).alias("shift"))


@query("""SELECT image_id, y, x, colour, round(1.23e-8 - 2 * ((y // 8 + 0.5) / 8 - 0.5) * slider, 6) AS down, round(1.23e-8 - 2 * ((x // 8 + 0.5) / 8 - 0.5) * slider, 6) AS across
FROM fx_rgb64 CROSS JOIN (VALUES (0, 0.5), (1, -0.3)) s(colour, slider)""")
def ca_shift_vector_radial(spark, d):
    """Shift at each pixel by the radial sliders (red 0.5, blue -0.3): in proportion to the block's distance from the middle of the square frame."""
    sliders = F.explode(F.array(*[F.struct(F.lit(k).alias("colour"), F.lit(s).alias("slider")) for k, s in enumerate((0.5, -0.3))])).alias("s")
    frame = view(spark, d, "fx_rgb64").select("image_id", "y", "x", sliders)
    shift = lambda c: shown(A.radial_shift(F.floor(F.col(c) / TILE) + 1, 8, F.col("s.slider")), 6)
    return frame.select("image_id", "y", "x", F.col("s.colour").alias("colour"), shift("y").alias("down"), shift("x").alias("across"))


# Steps of red (0) and blue (2) down and across that are taken back, with their whole and broken parts in places and in lattice steps.
_STEPS = {0: (0.6, -1.3), 2: (-0.4, 0.25)}


def _parts(c: int) -> str:
    out = []
    for s in _STEPS[c]:
        out += [math.floor(s), s - math.floor(s), math.floor(-s / 2), -s / 2 - math.floor(-s / 2)]
    return f"({c}, {', '.join(f'{p!r}e0' if isinstance(p, float) else str(p) for p in out)})"


def _four(table: str, column: str, step: int, whole: tuple[str, str], broken: tuple[str, str]) -> tuple[str, str]:
    """Joins of the four places around a broken step, and their weighted sum; a place of weight 0 may be missing."""
    joins, terms = [], []
    for a in (0, 1):
        for b in (0, 1):
            n = f"{column}{a}{b}"
            joins.append(f"LEFT JOIN {table} {n} ON {n}.image_id = p.image_id AND {n}.y = p.y + {step} * ({whole[0]} + {a}) AND {n}.x = p.x + {step} * ({whole[1]} + {b})")
            weight = " * ".join(f"{f}" if k else f"(1 - {f})" for k, f in zip((a, b), broken, strict=True))
            terms.append(f"CASE WHEN {weight} > 0 THEN {weight} * {n}.{column} ELSE 0 END")
    return " ".join(joins), " + ".join(terms)


_TO, _OF_GREEN = _four("green", "g", 1, ("iy", "ix"), ("fy", "fx"))
_BACK, _OF_AMOUNT = _four("amounts", "d", 2, ("jy", "jx"), ("ky", "kx"))


@query(f"""WITH s(colour, iy, fy, jy, ky, ix, fx, jx, kx) AS (VALUES {_parts(0)}, {_parts(2)}),
m AS MATERIALIZED (SELECT image_id, y, x, v, y % 2 + x % 2 AS colour FROM fx_px40),
near AS (SELECT m.*, u.v AS u, d.v AS d, l.v AS l, r.v AS r FROM m LEFT JOIN m u ON u.image_id = m.image_id AND u.y = m.y - 1 AND u.x = m.x LEFT JOIN m d ON d.image_id = m.image_id AND d.y = m.y + 1 AND d.x = m.x
 LEFT JOIN m l ON l.image_id = m.image_id AND l.y = m.y AND l.x = m.x - 1 LEFT JOIN m r ON r.image_id = m.image_id AND r.y = m.y AND r.x = m.x + 1),
weighed AS (SELECT *, CASE WHEN u + d IS NOT NULL THEN (u + d) / 2 ELSE coalesce(u, d) END AS mv, CASE WHEN u + d IS NOT NULL THEN 1 / power(1e-5 + abs(u - d), 2) ELSE 1 END AS wv,
 CASE WHEN l + r IS NOT NULL THEN (l + r) / 2 ELSE coalesce(l, r) END AS mh, CASE WHEN l + r IS NOT NULL THEN 1 / power(1e-5 + abs(l - r), 2) ELSE 1 END AS wh FROM near),
green AS MATERIALIZED (SELECT image_id, y, x, v, colour, CASE WHEN colour = 1 THEN v WHEN mv IS NULL THEN mh WHEN mh IS NULL THEN mv ELSE (mv * wv + mh * wh) / (wv + wh) END AS g FROM weighed),
amounts AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {_OF_GREEN} - p.v AS d FROM green p JOIN s USING (colour) {_TO}),
back AS (SELECT p.image_id, p.y, p.x, p.g - ({_OF_AMOUNT}) AS v FROM green p JOIN s USING (colour) {_BACK})
SELECT m.image_id, m.y, m.x, round(1.23e-8 + coalesce(back.v, m.v), 6) AS v FROM m LEFT JOIN back USING (image_id, y, x)""")
def ca_shift_apply(spark, d):
    """Mosaics of 40 × 40 with red and blue moved back by known steps; green is interpolated at their sites first."""
    px = view(spark, d, "fx_px40")
    colour = F.col("y") % 2 + F.col("x") % 2
    step = lambda k: F.when(colour == 0, F.lit(_STEPS[0][k])).when(colour == 2, F.lit(_STEPS[2][k]))
    return A.apply_shifts(px, step(0), step(1)).withColumn("v", shown("v", 6))

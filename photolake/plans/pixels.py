"""Pixel queries over frames made of the embeddings and of line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import color as K
from photolake.functions.kernels import mean_of_three
from photolake.operators import pixels as P

from .registry import query

RGB = ("r", "g", "b")


def shown(value, digits: int):
    """Rounded after a small shift, in both engines: exact halves, which means of few pixels often are, then lie on no rounding edge."""
    return F.round(F.lit(1.23e-8) + (F.col(value) if isinstance(value, str) else value), digits)


def point(name: str, columns: dict[str, str], source: str = "fx_rgb", keep: str = "image_id, y, x", where: str = ""):
    """Registers a projection of one expression for each column; both engines get the same arithmetic."""
    text = ", ".join(f"{e} AS {n}" for n, e in columns.items())

    def run(spark, d):
        out = view(spark, d, source)
        out = out.where(where) if where else out
        return out.select(*[c.strip() for c in keep.split(",")], *[F.expr(e).alias(n) for n, e in columns.items()])

    run.__name__ = name
    query(f"SELECT {keep}, {text} FROM {source}" + (f" WHERE {where}" if where else ""))(run)


def rounded(**columns: str) -> dict[str, str]:
    return {n: f"round(1.23e-8 + {e}, 6)" for n, e in columns.items()}


point("exposure_gain", rounded(v=K.exposure("v", 1.0, 0.8, 0.2), same=K.exposure("v", None)), "fx_px")
point("exposure_bounds", rounded(low=f"least({K.clamp('r')}, {K.clamp('g')})", high=f"greatest({K.clamp('r')}, {K.clamp('g')})"))
point("baseline_exposure", rounded(v="v * CASE WHEN image_id % 3 = 0 THEN power(CAST(2 AS DOUBLE), 0.35) ELSE 1 END"), "fx_px")
point("vignette_correct", rounded(v=K.vignette("v", "y", "x")), "fx_px")
point("wb_multiply", rounded(r="r * 1.9e0", g="g * 1", b="b * coalesce(CASE WHEN image_id % 2 = 0 THEN 1.4e0 END, 1.6e0)"))
point("matrix_projection", rounded(**{n: K.dot(w, RGB) for n, w in zip(("cx", "cy", "cz"), ((0.7977, 0.1352, 0.0313), (0.2880, 0.7119, 0.0001), (0.0, 0.0, 0.8249)), strict=True)}))
point("oklab_from_xyz", {n: f"round(1.23e-8 + {e}, 4)" for n, e in zip(("l", "a", "b2"), K.oklab(RGB), strict=True)})
point("clip_to_gamut", rounded(**{n: K.clamp(n) for n in RGB}))
point("srgb_oetf", {n: f"round(1.23e-8 + {K.srgb(n)}, 4)" for n in RGB})
point("quantize_u8", {n: f"CAST(floor({K.clamp(n)} * 255) AS INT)" for n in RGB} | {"alpha": "255"})
point("gray_preview", {"gray_float": f"CAST(floor({K.clamp(K.dot(K.REC709_LUMA, RGB))} * 255) AS INT)", "gray_int": f"CAST(floor({K.dot(K.REC709_LUMA, tuple(f'floor({K.clamp(n)} * 255)' for n in RGB))} + 0.5) AS INT)"})
point("boost", rounded(**dict(zip(RGB, K.boost(RGB), strict=True))))
point("grade_gain", rounded(**{n: f"{n} * (coalesce(CASE WHEN image_id % 2 = 0 THEN 1.5e0 END, 1e0) * coalesce(CASE WHEN image_id % 3 = 0 THEN 0.8e0 END, 1e0))" for n in RGB}))
point("log_encode", {f"{n}_{i}": f"round(1.23e-8 + {K.log_encode(n, c)}, 4)" for i, c in enumerate(K.LOG_CURVES) for n in RGB})
_graded = K.boost(tuple(f"({n} * 1.2)" for n in RGB))
point("grade", {n: f"round(1.23e-8 + {K.log_encode(e, 'V-Log')}, 4)" for n, e in zip(RGB, _graded, strict=True)})
point("highlight_chroma_compress", rounded(l="r", a=(_fade := "CASE WHEN r <= 0.92 THEN {c} ELSE {c} * (1 - (({t}) * ({t}) * (3 - 2 * ({t})))) END").format(c="g", t="least((r - 0.92) / 0.08, 1)"), b2=_fade.format(c="b", t="least((r - 0.92) / 0.08, 1)")))
point("dehaze_apply", rounded(v="greatest((r - 1) / greatest(1 - 0.5 * g, 0.001) + 1, 0)"))
point("rotate_flip", {"ry": "CASE image_id % 4 WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 7 - y ELSE 7 - x END", "rx": "CASE image_id % 4 WHEN 0 THEN x WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x ELSE y END", "v": "v"}, "fx_px")
point("active_area_filter", {"v": "v"}, "fx_px", where="y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5")
_x, _y = K.kelvin_to_xy("kelvin")
point("cct_to_xy", rounded(x=_x, y=_y), "fx_kelvin", "event_id, kelvin")
point("xy_to_cct", {"cct": f"round(1.23e-8 + {K.xy_to_kelvin(_x, _y)}, 2)"}, "fx_kelvin", "event_id")
point("decimation_factor", {"factor": "CASE WHEN roi_w % width = 0 AND roi_h % height = 0 AND roi_w / width = roi_h / height THEN CAST(floor(roi_w / width) AS INT) ELSE 1 END"}, "fx_meta", "image_id")
point("focal_length_chain", {"focal": "CAST(coalesce(focal_user, focal_decoded, focal_profile, 50.0) AS DOUBLE)", "source": "CASE WHEN focal_user IS NOT NULL THEN 'user' WHEN focal_decoded IS NOT NULL THEN 'decoded' WHEN focal_profile IS NOT NULL THEN 'profile' ELSE 'default' END"}, "fx_meta", "image_id")


@query("SELECT p.image_id, p.y - crop_y AS y, p.x - crop_x AS x, v FROM fx_px p JOIN fx_meta m USING (image_id) WHERE crop_x + crop_w <= width AND crop_y + crop_h <= height AND p.y >= crop_y AND p.y < crop_y + crop_h AND p.x >= crop_x AND p.x < crop_x + crop_w")
def crop_window(spark, d):
    """Pixels of each image's crop, rebased; crops that overrun their image are left out."""
    meta = view(spark, d, "fx_meta").where("crop_x + crop_w <= width AND crop_y + crop_h <= height")
    joined = view(spark, d, "fx_px").join(meta, "image_id").where("y >= crop_y AND y < crop_y + crop_h AND x >= crop_x AND x < crop_x + crop_w")
    return joined.select("image_id", (F.col("y") - F.col("crop_y")).alias("y"), (F.col("x") - F.col("crop_x")).alias("x"), "v")


@query("SELECT image_id, y, x, v, plane, colour FROM fx_px JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx")
def cfa_plane_join(spark, d):
    return P.with_cfa(view(spark, d, "fx_px"), view(spark, d, "fx_cfa")).select("image_id", "y", "x", "v", "plane", "colour")


OFFSETS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


@query("SELECT a.image_id, a.y, a.x, round(1.23e-8 + sum(b.v), 6) AS total, count(*) AS n FROM fx_px a JOIN fx_px b ON a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY 1, 2, 3")
def neighbour_gather(spark, d):
    near = P.gather(view(spark, d, "fx_px"), OFFSETS)
    seen = F.filter("near", lambda v: v.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda a, v: a + v)
    return near.select("image_id", "y", "x", shown(total, 6).alias("total"), F.size(seen).cast("long").alias("n")).where("n > 0")


_NEAR8 = "(SELECT a.image_id, a.y, a.x, a.v, min(b.v) AS lo, max(b.v) AS hi, quantile_cont(b.v, 0.5) AS median, count(*) AS n FROM fx_px a JOIN fx_px b ON a.image_id = b.image_id AND abs(a.y - b.y) IN (0, 2) AND abs(a.x - b.x) IN (0, 2) AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4)"


@query(f"SELECT image_id, y, x, round(1.23e-8 + lo, 6) AS lo, round(1.23e-8 + hi, 6) AS hi, round(1.23e-8 + median, 6) AS median FROM {_NEAR8} t WHERE n >= 4")
def neighbour_min_max_median(spark, d):
    stats = P.neighbour_stats(view(spark, d, "fx_px"), P.SAME_COLOUR["rb"]).where("count >= 4")
    return stats.select("image_id", "y", "x", *[shown(c, 6).alias(c) for c in ("lo", "hi", "median")])


@query(f"SELECT image_id, y, x, round(1.23e-8 + CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND n >= 4 AND (v > hi + 0.05 OR v < lo - 0.05) THEN median + (v - median) * 0.05 / (0.05 + abs(v - median)) ELSE v END, 6) AS v FROM {_NEAR8} t")
def impulse_replace(spark, d):
    """Values beyond their same-colour neighbours by more than 0.05 are pulled to the median with a soft knee; a border of two stays."""
    inside = F.col("y").between(2, 5) & F.col("x").between(2, 5)
    return P.impulse_replace(view(spark, d, "fx_px"), P.SAME_COLOUR["rb"], 0.05, inside).withColumn("v", shown("v", 6))


_BIN = "CAST(floor(least(greatest(v, 0), 1) * 255 + 0.5) AS INT)"
_HIST = f"SELECT image_id, plane, {_BIN} AS bin, count(*) AS n FROM fx_px40 JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx GROUP BY 1, 2, 3"


def _planes(spark, d):
    return P.with_cfa(view(spark, d, "fx_px40"), view(spark, d, "fx_cfa"))


@query(_HIST)
def plane_histogram(spark, d):
    return P.histogram(_planes(spark, d), ["image_id", "plane"])


_CUM = f"SELECT *, sum(n) OVER (PARTITION BY image_id, plane ORDER BY bin) AS upto, floor(sum(n) OVER (PARTITION BY image_id, plane) * 0.05) AS goal FROM ({_HIST}) h"


@query(f"SELECT image_id, plane, round(1.23e-8 + min(CASE WHEN goal = 0 THEN 0 ELSE bin END) / 255, 6) AS value FROM ({_CUM}) c WHERE upto >= goal GROUP BY 1, 2")
def histogram_percentile(spark, d):
    counts = P.histogram(_planes(spark, d), ["image_id", "plane"])
    return P.histogram_percentile(counts, ["image_id", "plane"], 0.05).withColumn("value", shown("value", 6))


@query(f"SELECT image_id, plane, round(1.23e-8 + min(CASE WHEN goal = 0 THEN 0 ELSE bin END) / 255, 6) AS value FROM ({_CUM.replace('FROM fx_px40 JOIN', 'FROM (SELECT * FROM fx_px40 WHERE y BETWEEN 4 AND 35 AND x BETWEEN 4 AND 35) a JOIN')}) c WHERE upto >= goal GROUP BY 1, 2")
def haze_floor(spark, d):
    active = _planes(spark, d).where("y BETWEEN 4 AND 35 AND x BETWEEN 4 AND 35")
    return P.histogram_percentile(P.histogram(active, ["image_id", "plane"]), ["image_id", "plane"], 0.05).withColumn("value", shown("value", 6))


@query("SELECT image_id, CAST(floor(y/2) AS INT) AS y, CAST(floor(x/2) AS INT) AS x, round(1.23e-8 + avg(CASE WHEN colour = 0 THEN v END), 6) AS r, round(1.23e-8 + avg(CASE WHEN colour = 1 THEN v END), 6) AS g, round(1.23e-8 + avg(CASE WHEN colour = 2 THEN v END), 6) AS b FROM fx_px JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx GROUP BY 1, 2, 3")
def superpixel_bin(spark, d):
    return P.superpixels(view(spark, d, "fx_px"), view(spark, d, "fx_cfa")).select("image_id", "y", "x", *[shown(c, 6).alias(c) for c in RGB])


@query("""WITH m AS (SELECT image_id, y, x, v, colour FROM fx_px JOIN fx_cfa ON y % 2 = ry AND x % 2 = rx)
SELECT a.image_id, a.y, a.x, round(1.23e-8 + CASE WHEN a.colour = 0 THEN a.v ELSE avg(CASE WHEN b.colour = 0 THEN b.v END) END, 6) AS r, round(1.23e-8 + CASE WHEN a.colour = 1 THEN a.v ELSE avg(CASE WHEN b.colour = 1 THEN b.v END) END, 6) AS g, round(1.23e-8 + CASE WHEN a.colour = 2 THEN a.v ELSE avg(CASE WHEN b.colour = 2 THEN b.v END) END, 6) AS b
FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.image_id, a.y, a.x, a.v, a.colour""")
def demosaic_bilinear(spark, d):
    out = P.demosaic_bilinear(view(spark, d, "fx_px"), view(spark, d, "fx_cfa"))
    return out.select("image_id", "y", "x", *[shown(c, 6).alias(c) for c in RGB])


@query("SELECT image_id, avg(CASE WHEN spread >= 6 THEN 1.0 ELSE 0.0 END) >= 0.02 AS coloured, count(*) AS n FROM (SELECT image_id, greatest(abs(r - g), abs(g - b), abs(r - b)) * 255 AS spread FROM fx_rgb) t GROUP BY 1")
def color_presence_check(spark, d):
    spread = F.greatest(F.abs(F.col("r") - F.col("g")), F.abs(F.col("g") - F.col("b")), F.abs(F.col("r") - F.col("b"))) * 255
    seen = F.avg(F.when(spread >= 6, 1.0).otherwise(0.0)) >= 0.02
    return view(spark, d, "fx_rgb").groupBy("image_id").agg(seen.alias("coloured"), F.count(F.lit(1)).alias("n"))


_LUMA = K.dot(K.PROPHOTO_LUMA, RGB)


@query(f"SELECT image_id, round(1.23e-8 + 0.18 / avg({_LUMA}), 6) AS gain, round(1.23e-8 + log2(0.18 / avg({_LUMA})), 4) AS ev FROM fx_rgb GROUP BY 1")
def meter_average(spark, d):
    out = view(spark, d, "fx_rgb").groupBy("image_id").agg((F.lit(0.18) / F.avg(F.expr(_LUMA))).alias("g"))
    return out.select("image_id", shown("g", 6).alias("gain"), shown(F.log2("g"), 4).alias("ev"))


_WEIGHT = "exp(-((y - 3.5e0) * (y - 3.5e0) + (x - 3.5e0) * (x - 3.5e0)) / 18e0)"


@query(f"SELECT image_id, round(1.23e-8 + 0.18 / (sum({_LUMA} * {_WEIGHT}) / sum({_WEIGHT})), 6) AS gain FROM fx_rgb GROUP BY 1")
def meter_center_weighted(spark, d):
    """Our own definition: a Gaussian around the centre weighs the luma."""
    weighted = F.sum(F.expr(f"{_LUMA} * {_WEIGHT}")) / F.sum(F.expr(_WEIGHT))
    return view(spark, d, "fx_rgb").groupBy("image_id").agg(shown(F.lit(0.18) / weighted, 6).alias("gain"))


_TOP = "greatest(r, greatest(g, b))"


@query(f"SELECT image_id, round(1.23e-8 + 1 / quantile_cont({_TOP}, 0.99), 6) AS gain FROM fx_rgb GROUP BY 1")
def meter_highlight_safe(spark, d):
    """Our own definition: the 99th percentile of the largest channel comes to 1."""
    return view(spark, d, "fx_rgb").groupBy("image_id").agg(shown(1 / F.percentile(F.expr(_TOP), F.lit(0.99)), 6).alias("gain"))


@query(f"SELECT image_id, round(1.23e-8 + least(0.18 / avg({_LUMA}), 1 / quantile_cont({_TOP}, 0.99)), 6) AS gain FROM fx_rgb GROUP BY 1")
def meter_hybrid(spark, d):
    """Our own definition: the smaller gain of the average and the highlight-safe mode."""
    both = F.least(F.lit(0.18) / F.avg(F.expr(_LUMA)), 1 / F.percentile(F.expr(_TOP), F.lit(0.99)))
    return view(spark, d, "fx_rgb").groupBy("image_id").agg(shown(both, 6).alias("gain"))


@query(f"SELECT image_id, round(1.23e-8 + 0.18 / (sum(m * w) / sum(w)), 6) AS gain FROM (SELECT image_id, avg({_LUMA}) AS m, CASE WHEN floor(y/2) IN (1, 2) AND floor(x/2) IN (1, 2) THEN 2.0 ELSE 1.0 END AS w FROM fx_rgb GROUP BY image_id, floor(y/2), floor(x/2)) z GROUP BY 1")
def meter_matrix(spark, d):
    """Our own definition: means of 4×4 zones, the inner four counted twice."""
    zone = [F.floor(F.col(c) / 2).alias(f"z{c}") for c in ("y", "x")]
    zones = view(spark, d, "fx_rgb").groupBy("image_id", *zone).agg(F.avg(F.expr(_LUMA)).alias("m"))
    w = F.when(F.col("zy").isin(1, 2) & F.col("zx").isin(1, 2), 2.0).otherwise(1.0)
    return zones.groupBy("image_id").agg(shown(F.lit(0.18) / (F.sum(F.col("m") * w) / F.sum(w)), 6).alias("gain"))


@query(f"SELECT image_id, round(1.23e-8 + log2(0.18 / avg({_LUMA})) + coalesce(CASE WHEN image_id % 2 = 0 THEN 0.5 END, 0), 4) AS ev FROM fx_rgb GROUP BY 1")
def absolute_ev(spark, d):
    """Metered EV plus what is applied already; none counts as 0."""
    applied = F.when(F.col("image_id") % 2 == 0, 0.5)
    out = view(spark, d, "fx_rgb").groupBy("image_id").agg(F.log2(F.lit(0.18) / F.avg(F.expr(_LUMA))).alias("ev"))
    return out.select("image_id", shown(F.col("ev") + F.coalesce(applied, F.lit(0)), 4).alias("ev"))


def _boxes(aggregate: str) -> str:
    return f"SELECT a.image_id, a.y, a.x, round(1.23e-8 + {aggregate}(b.v), 6) AS v FROM fx_px40 a JOIN fx_px40 b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 3 AND a.y + 3 AND b.x BETWEEN a.x - 3 AND a.x + 3 GROUP BY 1, 2, 3"


@query(_boxes("avg"))
def box_mean(spark, d):
    return P.box_mean(view(spark, d, "fx_px40"), ["v"], 3).select("image_id", "y", "x", shown("mean_v", 6).alias("v"))


@query(_boxes("min"))
def box_min(spark, d):
    return P.box_min(view(spark, d, "fx_px40"), ["v"], 3).select("image_id", "y", "x", shown("min_v", 6).alias("v"))


def _tent() -> str:
    """Edge-clamped box sums by joins on clamped coordinates, twice in each direction."""
    parts, now = [], "fx_px"
    for k, (line, along) in enumerate((("y", "x"), ("y", "x"), ("x", "y"), ("x", "y"))):
        parts.append(f"t{k} AS (SELECT a.image_id, a.{line}, a.{along}, sum(b.v) / 3 AS v FROM {now} a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) s JOIN {now} b ON b.image_id = a.image_id AND b.{line} = a.{line} AND b.{along} = least(greatest(a.{along} + s.o, 0), 7) GROUP BY 1, 2, 3)")
        now = f"t{k}"
    return "WITH " + ", ".join(parts) + " SELECT image_id, y, x, round(1.23e-8 + v, 6) AS v FROM t3"


@query(_tent())
def tent_blur(spark, d):
    return P.tent_blur(view(spark, d, "fx_px"), "v", 2).select("image_id", "y", "x", shown("blurred_v", 6).alias("v"))


@query("""WITH m AS (SELECT a.image_id, a.y, a.x, a.r AS i, avg(b.r) AS mi, avg(b.g) AS mp, avg(b.r * b.r) AS mii, avg(b.r * b.g) AS mip FROM fx_rgb a JOIN fx_rgb b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3, 4),
c AS (SELECT *, (mip - mi * mp) / (mii - mi * mi + 0.01) AS a FROM m), e AS (SELECT *, mp - a * mi AS b FROM c)
SELECT p.image_id, p.y, p.x, round(1.23e-8 + avg(q.a) * p.i + avg(q.b), 6) AS v FROM e p JOIN e q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 2 AND abs(p.x - q.x) <= 2 GROUP BY p.image_id, p.y, p.x, p.i""")
def guided_filter(spark, d):
    return P.guided_filter(view(spark, d, "fx_rgb"), "r", "g", 2, 0.01).select("image_id", "y", "x", shown("filtered", 6).alias("v"))


@query("""WITH s AS (SELECT a.cell, a.vec_id AS ref, b.vec_id AS other, list_sum(list_transform(range(1, 65), lambda k: (a.data[k] - b.data[k]) * (a.data[k] - b.data[k]))) AS ssd FROM fx_patch a JOIN fx_patch b ON a.cell = b.cell AND a.vec_id <> b.vec_id)
SELECT cell, ref, other, round(1.23e-8 + ssd, 6) AS ssd, place FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ssd, other) AS place FROM s WHERE ssd <= 1.2544) t WHERE place <= 16""")
def patch_topk_similar(spark, d):
    return P.similar_patches(view(spark, d, "fx_patch"), 0.056).withColumn("ssd", shown("ssd", 6))


@query("SELECT image_id, CAST(floor(y/3) AS INT) AS ty, CAST(floor(x/3) AS INT) AS tx, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(1.23e-8 + sum(v), 6) AS total FROM fx_px GROUP BY 1, 2, 3")
def tile_pack(spark, d):
    tiles = P.pack_tiles(view(spark, d, "fx_px"), 3)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return tiles.select("image_id", "ty", "tx", "w", "h", shown(total, 6).alias("total"))


@query("SELECT image_id, y, x, v FROM fx_px")
def tile_unpack(spark, d):
    """Tiles packed and unpacked again."""
    return P.unpack_tiles(P.pack_tiles(view(spark, d, "fx_px"), 3), 3)


@query("SELECT a.image_id, a.y, a.x, round(1.23e-8 + avg(b.v), 6) AS v FROM fx_px40 a JOIN fx_px40 b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3")
def tile_map(spark, d):
    """A numpy kernel (3×3 mean) on tiles of 16 with a halo of 1."""
    return P.tile_map(view(spark, d, "fx_px40"), mean_of_three, 16, 1).withColumn("v", shown("v", 6))


@query("SELECT l_orderkey AS image_id, count(*) AS n, round(1.23e-8 + avg(least(greatest(l_quantity / 50 * 1.3, 0), 1)), 6) AS r, round(1.23e-8 + avg(least(greatest(l_extendedprice / 100000 * 1.3, 0), 1)), 6) AS g, round(1.23e-8 + avg(least(greatest(l_discount * 10 * 1.3, 0), 1)), 6) AS b FROM lineitem GROUP BY 1")
def exposure_summary_big(spark, d):
    """Exposure, clamp and mean of each image over the largest table: one scan, one partial and one final aggregation."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    channel = lambda e: shown(F.avg(F.least(F.greatest(e * 1.3, F.lit(0.0)), F.lit(1.0))), 6)
    return items.groupBy(F.col("l_orderkey").alias("image_id")).agg(
        F.count(F.lit(1)).alias("n"), channel(F.col("l_quantity") / 50).alias("r"), channel(F.col("l_extendedprice") / 100000).alias("g"), channel(F.col("l_discount") * 10).alias("b")
    )

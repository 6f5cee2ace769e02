"""Steps of the develop and grade chain that need more than a pixel's own values: lattices, lens models, blurs, filter patterns.

Tables beside the pixels are small by their nature (a lattice of n³ points, a few matrices a camera). They are joined
without a hint, so that Spark broadcasts them by their measured size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions import color as K
from photolake.functions import kernels

from .pixels import SAME_COLOUR, TILE, box_min, guided_filter, tent_blur, tiled, whole_groups, with_cfa

RGB = ("r", "g", "b")
PIXEL = ("image_id", "y", "x")

# Published primaries (x, y of red, green, blue) and whites.
D50, D65 = (0.3457, 0.3585), (0.3127, 0.3290)
PROPHOTO = ((0.7347, 0.2653), (0.1596, 0.8404), (0.0366, 0.0001))
GAMUTS = {
    "V-Gamut": ((0.730, 0.280), (0.165, 0.840), (0.100, -0.030)),
    "ALEXA Wide Gamut 3": ((0.6840, 0.3130), (0.2210, 0.8480), (0.0861, -0.1020)),
    "F-Gamut": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
    "S-Gamut3.Cine": ((0.766, 0.275), (0.225, 0.800), (0.089, -0.087)),
}
CAT02 = ((0.7328, 0.4296, -0.1624), (-0.7036, 1.6975, 0.0061), (0.0030, 0.0136, 0.9834))


def _xyz(xy: tuple[float, float]) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1, (1 - xy[0] - xy[1]) / xy[1]])


def gamut_matrix(primaries: tuple, white: tuple = D65, source: tuple = PROPHOTO, source_white: tuple = D50) -> np.ndarray:
    """Linear RGB of ``source`` to linear RGB of ``primaries``, adapted from white to white by CAT02."""

    def to_xyz(p: tuple, w: tuple) -> np.ndarray:
        m = np.stack([_xyz(c) for c in p], axis=1)
        return m * np.linalg.solve(m, _xyz(w))

    cat = np.array(CAT02)
    adapt = np.linalg.solve(cat, np.diag(cat @ _xyz(white) / (cat @ _xyz(source_white))) @ cat)
    return np.linalg.solve(to_xyz(primaries, white), adapt @ to_xyz(source, source_white))


#: Lattice points, of all lattices together, up to which they are sent to every executor: about 40 MB. Parts of a lattice's pixels beyond.
MOST_POINTS, LATTICE_PARTS = 1_000_000, 32


def lut3d_apply(px: DataFrame, lattices: DataFrame, most_points: int = MOST_POINTS) -> DataFrame:
    """``px`` with r, g, b looked up in the lattice of its lut_id, by tetrahedra after a clamp to 0..1.

    ``lattices``: lut_id, n, i, j, k, r, g, b; n³ rows for each lut_id, n at least 2, i for red. Pixels whose lut_id is null or
    has no lattice keep their values. The points are counted: up to ``most_points`` the lattices are broadcast; beyond, the
    pixels of each lut_id are dealt to LATTICE_PARTS keys by a hash of their place, and the lattice is copied to each, so that
    no lattice, however much it is used, is the work of one task.
    """
    at = (F.col("k") * F.col("n") + F.col("j")) * F.col("n") + F.col("i")
    packed = lattices.groupBy("lut_id").agg(F.max("n").alias("_n"), F.array_sort(F.collect_list(F.struct(at.alias("at"), *RGB))).alias("_lut"))
    n = F.col("_n")
    if lattices.limit(most_points + 1).count() <= most_points:
        out = px.join(F.broadcast(packed), "lut_id", "left")
    else:
        dealt = px.withColumn("_part", F.pmod(F.xxhash64(*PIXEL), F.lit(LATTICE_PARTS)).cast("int"))
        out = dealt.join(packed.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(LATTICE_PARTS - 1)))), ["lut_id", "_part"], "left")
    out = out.withColumns({f"_p{c}": F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * (n - 1) for c in RGB})
    out = out.withColumns({f"_b{c}": F.least(F.floor(f"_p{c}"), n - 2) for c in RGB})
    out = out.withColumns({f"_f{c}": F.col(f"_p{c}") - F.col(f"_b{c}") for c in RGB})
    fr, fg, fb = (F.col(f"_f{c}") for c in RGB)
    out = out.withColumns({"_hi": F.greatest(fr, fg, fb), "_lo": F.least(fr, fg, fb), "_at": (F.col("_bb") * n + F.col("_bg")) * n + F.col("_br")})
    hi, lo = F.col("_hi"), F.col("_lo")
    mid = fr + fg + fb - hi - lo
    far = F.col("_at") + 1 + n + n * n
    first = F.col("_at") + F.when(fr == hi, F.lit(1)).when(fg == hi, n).otherwise(n * n)
    last = far - F.when(fb == lo, n * n).when(fg == lo, n).otherwise(F.lit(1))
    corner = lambda i, c: F.get("_lut", i.cast("int"))[c]

    def value(c: str) -> Column:
        found = corner(F.col("_at"), c) * (1 - hi) + corner(first, c) * (hi - mid) + corner(last, c) * (mid - lo) + corner(far, c) * lo
        return F.when(n.isNull(), F.col(c)).otherwise(found).alias(c)

    return out.select(*[value(c) if c in RGB else F.col(c) for c in px.columns])


def gaussian_blur(px: DataFrame, value: str, sigma: float) -> DataFrame:
    """``px`` with blurred_<value>: a normalised Gaussian to ceil(3 sigma), edges repeated; one shuffle for each axis."""
    r = math.ceil(3 * sigma)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).tolist()
    out = px.withColumn("_v", F.col(value))
    for line, along in (("y", "x"), ("x", "y")):
        order = Window.partitionBy("image_id", line).orderBy(along)
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        taps = [F.coalesce(F.lag("_v", -k).over(order), (F.first("_v") if k < 0 else F.last("_v")).over(whole)) * w for k, w in zip(range(-r, r + 1), weights, strict=True)]
        out = out.withColumn("_v", sum(taps[1:], taps[0]))
    return out.withColumnRenamed("_v", f"blurred_{value}")


def lens_position(y: str, x: str, radial: tuple[float, float, float], tangential: tuple[float, float], centre: float, focal: float) -> tuple[str, str]:
    """SQL text of the source position (y, x) of a pixel under the published radial and tangential lens model."""
    yd, xd = (f"(({c} - {centre}e0) / {focal}e0)" for c in (y, x))
    r2 = f"({xd} * {xd} + {yd} * {yd})"
    a, b, c = radial
    ty, tx = tangential
    common = f"((({c}e0 * {r2} + {b}e0) * {r2} + {a}e0) * {r2} + 1 + 2 * ({ty}e0 * {yd} + {tx}e0 * {xd}))"
    return tuple(f"(({d} * {common} + {t}e0 * {r2}) * {focal}e0 + {centre}e0)" for d, t in ((yd, ty), (xd, tx)))


@dataclass(frozen=True)
class Lens:
    """The published radial and tangential lens model about a centre, in parts of a focal length, both in pixels."""

    radial: tuple[float, float, float]
    tangential: tuple[float, float]
    centre: tuple[float, float]
    focal: float

    def __call__(self, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source positions of the places (y, x)."""
        yd, xd = (y - self.centre[0]) / self.focal, (x - self.centre[1]) / self.focal
        r2 = xd * xd + yd * yd
        a, b, c = self.radial
        ty, tx = self.tangential
        common = ((c * r2 + b) * r2 + a) * r2 + 1 + 2 * (ty * yd + tx * xd)
        return (yd * common + ty * r2) * self.focal + self.centre[0], (xd * common + tx * r2) * self.focal + self.centre[1]


def _source_windows(frames: DataFrame, position: Callable, size: int) -> DataFrame:
    """(height, width, tile_y, tile_x, y0, y1, x0, x1, from_y, from_x): for each kind of frame and output tile the box of source pixels that
    it asks for, a row for each source tile that the box meets."""

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for h, w, ty, tx in rows[["height", "width", "tile_y", "tile_x"]].itertuples(index=False):
                y, x = np.meshgrid(np.arange(ty * size, min(h, (ty + 1) * size)), np.arange(tx * size, min(w, (tx + 1) * size)), indexing="ij")
                sy, sx = position(y.astype(float), x.astype(float))
                out = {"height": h, "width": w, "tile_y": ty, "tile_x": tx}
                for n, s, most in (("y", np.clip(sy, 0, h - 1), h - 1), ("x", np.clip(sx, 0, w - 1), w - 1)):
                    out |= {f"{n}0": int(np.floor(s.min())), f"{n}1": min(int(np.floor(s.max())) + 1, most)}
                yield pd.DataFrame([out])

    last = lambda c: F.floor((F.col(c) - 1) / size).cast("int")
    kinds = frames.select("height", "width").where("height > 0 AND width > 0").distinct()
    tiles = kinds.select("*", F.explode(F.sequence(F.lit(0), last("height"))).alias("tile_y")).select("*", F.explode(F.sequence(F.lit(0), last("width"))).alias("tile_x"))
    windows = tiles.mapInPandas(boxes, "height int, width int, tile_y int, tile_x int, y0 int, y1 int, x0 int, x1 int")
    part = lambda c: F.floor(F.col(c) / size).cast("int")
    met = windows.select("*", F.explode(F.sequence(part("y0"), part("y1"))).alias("from_y"))
    return met.select("*", F.explode(F.sequence(part("x0"), part("x1"))).alias("from_x"))


def resample(px: DataFrame, position: Callable, height: Column, width: Column, size: int = TILE) -> DataFrame:
    """(image_id, y, x, v) of whole frames: each place's value taken at ``position(y, x)`` of its image, bilinear, edges repeated.

    ``position`` maps numpy arrays of places to arrays of source places, the same for all frames. The box of source pixels that a
    tile of the output needs is known from it before any pixel moves, so a pixel is sent to each tile that may read it and
    to no other: hardly more than once for a lens. One shuffle. The table of boxes has a row for each tile of each size of
    frame and meets the pixels by tile. A missing or null source pixel adds nothing; a tile without any source pixel is left
    out, as are pixels without an image or outside the frame.
    """
    sent = px.where("image_id IS NOT NULL").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"), height.cast("int").alias("height"), width.cast("int").alias("width"))
    windows = _source_windows(sent, position, size)
    part = lambda c: F.floor(F.col(c) / size).cast("int")
    met = sent.withColumns({"from_y": part("y"), "from_x": part("x")}).join(windows, ["height", "width", "from_y", "from_x"]).where("y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")
    key = ["image_id", "tile_y", "tile_x"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, key):
            for (image, ty, tx), part in rows.groupby(key, sort=False):
                h, w, y0, x0, y1, x1 = (int(part[c].iloc[0]) for c in ("height", "width", "y0", "x0", "y1", "x1"))
                window = np.zeros((y1 - y0 + 1, x1 - x0 + 1))
                window[part.y.to_numpy() - y0, part.x.to_numpy() - x0] = np.nan_to_num(part.v.to_numpy())
                y, x = (a.ravel() for a in np.meshgrid(np.arange(ty * size, min(h, (ty + 1) * size)), np.arange(tx * size, min(w, (tx + 1) * size)), indexing="ij"))
                sy, sx = position(y.astype(float), x.astype(float))
                sy, sx = np.clip(sy, 0, h - 1) - y0, np.clip(sx, 0, w - 1) - x0
                iy, ix = np.floor(sy).astype(int), np.floor(sx).astype(int)
                fy, fx = sy - iy, sx - ix
                jy, jx = np.minimum(iy + 1, y1 - y0), np.minimum(ix + 1, x1 - x0)
                v = (window[iy, ix] * (1 - fx) + window[iy, jx] * fx) * (1 - fy) + (window[jy, ix] * (1 - fx) + window[jy, jx] * fx) * fy
                yield pd.DataFrame({"image_id": image, "y": y, "x": x, "v": v})

    moved = met.select(*key, "y", "x", "v", "height", "width", "y0", "y1", "x0", "x1")
    return moved.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "image_id long, y int, x int, v double")


#: Widening of a colour difference at the bound of what may be removed; a fixed value.
WIDEN = 1.16


def fringe_mask(px: DataFrame, channel: str, radius: int = 2, intensity: float = 1.0, least: float = 0.2) -> DataFrame:
    """``px`` with mask: the blurred brightness of a channel above ``least``, in 0..1."""
    lit = px.withColumn("_m", F.greatest((F.col(channel) - least) / (1 - least), F.lit(0.0)) * intensity)
    return tent_blur(lit, "_m", radius).withColumn("mask", F.least(F.greatest(F.col("blurred__m"), F.lit(0.0)), F.lit(1.0))).drop("_m", "blurred__m")


def defringe_blue(px: DataFrame, base: str, side: str, most: float = 0.33, least: float = 0.0, **mask) -> DataFrame:
    """``px`` with a blue fringe taken out, and removed_b, removed_side, touched: purple with base g and side r, cyan with base r and side g."""
    out = fringe_mask(px, "b", **mask)
    over = F.greatest(F.col("b") - F.col(base), F.lit(0.0))
    bound = F.least(F.col("mask"), over * WIDEN)
    other = F.least(F.greatest(F.col(side) - F.col(base), F.lit(0.0)), bound * most)
    blue = F.least(bound, other / least) if least > 0 else bound
    out = out.withColumns({"removed_b": blue, "removed_side": other, "touched": (over > 1e-6) & (bound > 0)})
    return out.withColumns({"b": F.col("b") - F.col("removed_b"), side: F.col(side) - F.col("removed_side")}).drop("mask")


def defringe_green(px: DataFrame, hedge: float = 0.5, strength: float = 1.0, **mask) -> DataFrame:
    """``px`` with green above red and blue drawn to their maximum or, by ``hedge``, their mean; and removed_g, touched."""
    out = fringe_mask(px, "g", **mask)
    top = F.greatest("r", "b")
    over = F.greatest(F.col("g") - top, F.lit(0.0))
    bound = F.least(F.col("mask"), over * WIDEN)
    target = top * (1 - hedge) + (F.col("r") + F.col("b")) * 0.5 * hedge
    gone = F.least(F.greatest(F.col("g") - target, F.lit(0.0)) * strength, bound)
    return out.withColumns({"removed_g": gone, "touched": (over > 1e-6) & (bound > 0)}).withColumn("g", F.col("g") - F.col("removed_g")).drop("mask")


def with_bracket(targets: DataFrame, matrices: DataFrame) -> DataFrame:
    """``targets`` (camera_id, kelvin, ...) with below and above: the camera's matrices (cct, m) around the temperature.

    Outside the range both are the nearest one; a camera without matrices has nulls. A camera has few matrices, so they
    are an array and no range join is needed.
    """
    few = matrices.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("cct", "m"))).alias("_all"))
    out = targets.join(few, "camera_id", "left")
    under = F.filter("_all", lambda s: s["cct"] < F.col("kelvin"))
    over = F.filter("_all", lambda s: s["cct"] >= F.col("kelvin"))
    low, high = F.get(under, F.size(under) - 1), F.get(over, F.lit(0))
    exact = high["cct"] == F.col("kelvin")
    return out.withColumns({"below": F.when(exact, high).otherwise(F.coalesce(low, high)), "above": F.coalesce(high, low)}).drop("_all")


def mired_blend(targets: DataFrame, matrices: DataFrame) -> DataFrame:
    """``targets`` with g and m: the bracketing matrices mixed in proportion to reciprocal temperatures."""
    out = with_bracket(targets, matrices)
    a, b, t = (1 / F.col(c) for c in ("below.cct", "above.cct", "kelvin"))
    g = F.when(F.col("below.cct") == F.col("above.cct"), F.lit(0.0)).otherwise(F.least(F.greatest((a - t) / (a - b), F.lit(0.0)), F.lit(1.0)))
    out = out.withColumn("g", g)
    return out.withColumn("m", F.zip_with("below.m", "above.m", lambda p, q: (1 - F.col("g")) * p + F.col("g") * q)).drop("below", "above")


def demosaic_weighted(px: DataFrame, cfa: DataFrame, period: int) -> DataFrame:
    """Full colour at each pixel: its own kept, the others the mean of the 3×3 neighbours of that colour, direct ones counted twice.

    A colour that no neighbour has is the pixel's own value.
    """
    return tiled(with_cfa(px, cfa, period), ["v", "colour"], 1, lambda t: kernels.fill_colours(t["v"], t["colour"], diagonal=0.5, alone=True), ["r", "g", "b"])


def plane_grids(px: DataFrame, cfa: DataFrame, period: int = 2) -> DataFrame:
    """Each colour plane of a mosaic as a frame of its own: frame_id, plane, and y and x counted in cells."""
    cell = lambda c: F.floor(F.col(c) / period).cast("int")
    planes = with_cfa(px, cfa, period)
    return planes.select(F.col("image_id").alias("frame_id"), "plane", "colour", (F.col("image_id") * (period * period) + F.col("plane")).alias("image_id"), F.col("y").alias("py"), F.col("x").alias("px"), cell("y").alias("y"), cell("x").alias("x"), "v")


def cell_merge(field: DataFrame, value: str, mode: str) -> DataFrame:
    """``field`` with merged: one value for all planes of a cell (min, avg or blue), or each plane's own (each)."""
    if mode == "each":
        return field.withColumn("merged", F.col(value))
    cell = Window.partitionBy("frame_id", "y", "x")
    v = F.col(value)
    how = {"min": F.min(v), "avg": F.avg(v), "blue": F.max(F.when(F.col("colour") == 2, v))}[mode]
    return field.withColumn("merged", F.coalesce(how.over(cell), F.lit(0.0)))


def dehaze(px: DataFrame, cfa: DataFrame, strength: float | None, cap: float = 0.01, mode: str = "min", radius: int = 8, eps: float = 0.01, light: float = 1.0) -> DataFrame:
    """(image_id, y, x, v) of a mosaic without haze: dark channel and guided filter for each plane, merged by cells, applied.

    No strength, or 0, gives the values as they are.
    """
    if not strength:
        return px.select(*PIXEL, "v")
    dark = box_min(plane_grids(px, cfa), ["v"], radius)
    field = guided_filter(dark, "v", "min_v", radius, eps)
    field = field.withColumn("haze", F.least(F.greatest(F.col("filtered"), F.lit(0.0)), F.lit(min(max(cap, 0.0), 1.0))))
    merged = cell_merge(field, "haze", mode)
    through = F.greatest(1 - min(max(strength, 0.0), 1.0) * F.col("merged"), F.lit(1e-3))
    clear = F.greatest((F.col("v") - light) / through + light, F.lit(0.0))
    return merged.select(F.col("frame_id").alias("image_id"), F.col("py").alias("y"), F.col("px").alias("x"), clear.alias("v"))



def develop_mosaic(
    px: DataFrame, cfa: DataFrame, ev: float | None = None, impulse: float | None = None, inside: Column | None = None, dehaze_strength: float | None = None,
    purple: float | None = None, green: float | None = None, gains: tuple[float, float, float] | None = None,
    cap: float = 0.01, mode: str = "min", radius: int = 8, eps: float = 0.01, light: float = 1.0, size: int | None = None,
) -> DataFrame:
    """(image_id, y, x, r, g, b) of Bayer mosaics: exposure, impulses, haze, fringes at edges, full colour, white balance.

    A stage whose parameter is None is left out. ``impulse`` is the tolerance; ``inside`` leaves out border pixels. The steps
    that the stages reach add up to one halo, with which the tiles are dealt once; all stages then run in the task that holds
    the tile. A tile's side is at least eight halos, so that the halos are about half as many pixels as the tiles at most.
    """
    offsets = SAME_COLOUR["rb"]
    fringes = bool(purple or green)
    halo = (2 if impulse is not None else 0) + (6 * radius + 1 if dehaze_strength else 0) + (1 if fringes else 0) + 1

    def chain(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v, colour = t["v"], t["colour"]
        if impulse is not None:
            v = kernels.calm(v, t["inside"], offsets, impulse)
        if dehaze_strength:
            v = kernels.clear(v, t["ry"], t["rx"], colour, dehaze_strength, cap, mode, radius, eps, light)
        if fringes:
            v = kernels.mend_fringes(v, colour, purple or 0.0, green or 0.0, 0.5, K.LOCA_EDGE, K.LOCA_FULL, K.LOCA_TINT, K.LOCA_MIX)
        out = kernels.fill_colours(v, colour)
        return {c: out[c] * w for c, w in zip(RGB, gains or (1.0, 1.0, 1.0), strict=True)}

    sites = with_cfa(px, cfa)
    read = {"v": F.expr(K.exposure("v", ev)), "colour": F.col("colour")}
    if impulse is not None:
        read["inside"] = (F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))).cast("int")
    if dehaze_strength:
        read |= {"ry": F.col("y") % 2, "rx": F.col("x") % 2}
    return tiled(sites.select(*PIXEL, *[c.alias(n) for n, c in read.items()]), list(read), halo, chain, list(RGB), size or max(TILE, 8 * halo), deep=True)


def render(px: DataFrame, matrix: tuple[tuple[float, ...], ...], graded: Column, curve: str = "V-Log", fringes: bool = True) -> DataFrame:
    """(image_id, y, x, r, g, b) in 0..255 of camera colours: projected, clipped, fringes taken out, then graded or shown.

    Rows where ``graded`` holds are boosted and encoded by the log curve, the others get the display curve.
    """
    out = px.select(*PIXEL, graded.alias("graded"), *[F.expr(K.clamp(K.dot(w, RGB))).alias(c) for c, w in zip(RGB, matrix, strict=True)])
    if fringes:
        for base, side in (("g", "r"), ("r", "g")):
            out = defringe_blue(out, base, side).select(*PIXEL, "graded", *RGB)
        out = defringe_green(out).select(*PIXEL, "graded", *RGB)
    out = out.withColumns({f"boosted_{c}": F.expr(e) for c, e in zip(RGB, K.boost(RGB), strict=True)})
    final = lambda c: F.when(F.col("graded"), F.expr(K.log_encode(f"boosted_{c}", curve))).otherwise(F.expr(K.srgb(c)))
    byte = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 1e-9).cast("int")
    return out.select(*PIXEL, *[byte(final(c)).alias(c) for c in RGB])


#: Illuminants of colour matrices, the preferred one first; fixed values.
PREFERENCE = ("D65", "A", "B", "C", "D50", "D55", "D75", "Daylight", "Flash")


def preferred_matrix(matrices: DataFrame) -> DataFrame:
    """(camera_id, illuminant, m): each camera's matrix of the most preferred illuminant; other illuminants do not count."""
    rank = F.array_position(F.array(*[F.lit(n) for n in PREFERENCE]), F.col("illuminant"))
    best = matrices.where(rank > 0).groupBy("camera_id").agg(F.min_by(F.struct("illuminant", "m"), rank).alias("best"))
    return best.select("camera_id", "best.*")


def chromatic_adapt(targets: DataFrame, matrices: DataFrame) -> DataFrame:
    """``targets`` (camera_id, target: D50 or D65, ...) with status and m, the camera's preferred matrix (XYZ to camera) for that white.

    A matrix of another white takes XYZ by Bradford to its own white first (adapted), one of the same is as it is (kept).
    A camera without matrices has the identity (identity). One of other than nine entries, or of an illuminant whose
    white is not listed, cannot be adapted: m is null (unexpected).
    """
    out = targets.join(preferred_matrix(matrices), "camera_id", "left")
    unit = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    adapted = F.lit(None).cast("array<double>")
    for source in K.WHITES:
        for target in ("D50", "D65"):
            if source != target:
                move = K.bradford(target, source)
                product = F.array(*[sum((F.col("m")[3 * i + k] * float(move[k, j]) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
                fits = (F.col("illuminant") == source) & (F.col("target") == target) & (F.size("m") == 9)
                adapted = F.when(fits, product).otherwise(adapted)
    same = F.col("illuminant") == F.col("target")
    out = out.withColumn("_m", F.when(F.col("illuminant").isNull(), unit).when(same, F.col("m")).otherwise(adapted))
    status = F.when(F.col("illuminant").isNull(), "identity").when(same, "kept").when(F.col("_m").isNotNull(), "adapted").otherwise("unexpected")
    return out.withColumn("status", status).drop("m", "illuminant").withColumnRenamed("_m", "m")


def loca(px: DataFrame, cfa: DataFrame, purple: float | None = None, green: float | None = None, least: float = 0.5) -> DataFrame:
    """(image_id, y, x, v) of Bayer mosaics with the green sites of bright edges raised against purple or lowered against green fringes.

    ``purple`` and ``green`` are strengths from 0 to 1; None switches a side off. Red and blue sites, sites at an
    image's border and those without all four diagonal neighbours stay. One shuffle by tile.
    """
    if not purple and not green:
        return px.select(*PIXEL, "v")
    near = tiled(with_cfa(px, cfa), ["v", "colour"], 1, lambda t: kernels.bright_edge(t["v"], t["colour"]), ["v", "colour", "red", "blue", "mm", "mp", "pm", "pp"])
    near = near.withColumn("red", F.when(F.col("pp").isNotNull() & F.col("mm").isNotNull() & F.col("pm").isNotNull() & F.col("mp").isNotNull(), F.col("red")))
    for step in K.loca_steps(purple or 0.0, green or 0.0, least):
        near = near.withColumns({n: F.expr(e) for n, e in step.items()})
    whole = F.col("red").isNotNull() & F.col("blue").isNotNull()
    return near.select(*PIXEL, F.when(whole, F.col("repaired")).otherwise(F.col("v")).alias("v"))

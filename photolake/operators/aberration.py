"""Lateral colour fringes of a mosaic: moments of tiles, shifts of tiles, a robust gate, a polynomial over the frame, and the planes moved back.

Frames are (image_id, y, x, r, g, b) with green known everywhere, or mosaics (image_id, y, x, v) whose green is interpolated;
red counts at even rows and columns, blue at odd ones. Neighbours are read on tiles with a halo, so gaps in a frame stay gaps
and its pixels are shuffled once to be measured and once to be moved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.functions import kernels
from photolake.sources.scratch import written

from .pixels import tiled

#: Division guards, the shift that marks a tile without texture, the scale of the moments, the gate's factor.
GUARD, FLAT, NO_SHIFT, SCALE, GRADIENT_SCALE, GATE = 1e-5, 1e-10, 17.0, 0.25, 0.3125, 8.0
ORDER = 4


def _at(v: np.ndarray, axis: int, step: int) -> np.ndarray:
    """The plane as seen ``step`` places further along an axis; NaN beyond its edges."""
    return kernels.around(v, [(step, 0) if axis == 0 else (0, step)])[0]


def _pair(v: np.ndarray, axis: int, step: int) -> np.ndarray:
    return _at(v, axis, step) + _at(v, axis, -step)


def texture(c: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
    """At the sites of a colour ``c``, of which green is known: its difference from green, and along each axis (y, x) a weight and green's slope.

    The weight is the high pass of the difference, smoothed along the rows for both axes, times brightness over flatness. NaN where a neighbour is missing. Reaches four places.
    """
    d = c - g
    out = {"difference": d}
    for axis, n in enumerate("yx"):
        across = 1 - axis
        after, before = _at(d, axis, 4), _at(d, axis, -4)
        high = np.abs(np.abs(after - d) + np.abs(d - before) - np.abs(after - before))
        green, own = 2 * g + _pair(g, axis, 2), 2 * c + _pair(c, axis, 2)
        low, bright = _pair(np.abs(green - own) / 4, axis, 2), _pair((green + own) / 4, axis, 2)
        slope = _at(g, axis, 1) - _at(g, axis, -1)
        out[f"slope_{n}"] = slope + 0.3 * _pair(slope, across, 1)
        out[f"weight_{n}"] = (high + 0.5 * _pair(high, 1, 2)) * bright / (GUARD + 0.1 * bright + low)
    return out


def filled_green(v: np.ndarray, colour: np.ndarray) -> np.ndarray:
    """Green of a Bayer mosaic at every place: between sites the means of the pairs along both axes, weighed against the step across each."""
    green = np.where(colour == 1, v, np.nan)
    means, weights = [], []
    for axis in (0, 1):
        one, other = _at(green, axis, -1), _at(green, axis, 1)
        both = ~np.isnan(one) & ~np.isnan(other)
        means.append(np.where(both, (one + other) / 2, np.where(np.isnan(one), other, one)))
        weights.append(np.where(np.isnan(means[-1]), 0.0, np.where(both, 1 / (GUARD + np.abs(one - other)) ** 2, 1.0)))
    total = weights[0] + weights[1]
    mixed = sum(np.nan_to_num(m) * w for m, w in zip(means, weights, strict=True)) / np.where(total > 0, total, np.nan)
    return np.where(colour == 1, v, mixed)


def _moments(sites: DataFrame, tile: int) -> DataFrame:
    """The sums of ``tile_moments`` from the columns of ``texture`` at the sites."""
    axes = F.array(*[F.struct(F.lit(k).alias("direction"), F.col(f"weight_{n}").alias("w"), F.col(f"slope_{n}").alias("slope")) for k, n in enumerate("yx")])
    block = lambda c: (F.floor(F.col(c) / tile) + 1).cast("int")
    rows = sites.where("difference IS NOT NULL").select("image_id", block("y").alias("vblock"), block("x").alias("hblock"), (F.col("y") % 2).cast("int").alias("colour"), "difference", F.explode(axes).alias("a"))
    w, g, d = F.col("a.w"), F.col("a.slope"), F.col("difference")
    full = rows.where("a.w IS NOT NULL AND a.slope IS NOT NULL")
    return full.groupBy("image_id", "vblock", "hblock", "colour", F.col("a.direction").alias("direction")).agg(
        (SCALE * F.sum(w * d * d)).alias("m0"), (SCALE * GRADIENT_SCALE * F.sum(w * g * d)).alias("m1"), (SCALE * GRADIENT_SCALE**2 * F.sum(w * g * g)).alias("m2")
    )


_TEXTURE = ["difference", "slope_y", "weight_y", "slope_x", "weight_x"]


def tile_moments(frames: DataFrame, tile: int) -> DataFrame:
    """(image_id, vblock, hblock, colour, direction, m0, m1, m2) of every tile: sums of w·d², w·g·d and w·g².

    d is the colour less green, g the smoothed green gradient along the direction (0 down, 1 across), w weighs texture
    against flatness. Pixels without all their neighbours (four steps away, and two from those) do not count. Blocks are
    numbered from 1. The pixels are dealt once, in tiles with a halo; the sums are combined before they are shuffled.
    """
    at = lambda k: (F.col("y") % 2 == k) & (F.col("x") % 2 == k)
    sites = frames.withColumn("c", F.when(at(0), F.col("r")).when(at(1), F.col("b")))
    return _moments(tiled(sites, ["c", "g"], 4, lambda t: texture(t["c"], t["g"]), _TEXTURE), tile)


def mosaic_moments(px: DataFrame, tile: int) -> DataFrame:
    """As ``tile_moments`` of an RGGB mosaic (image_id, y, x, v): green is interpolated in the task that holds the tile."""

    def kernel(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return texture(np.where(t["colour"] == 1, np.nan, t["v"]), filled_green(t["v"], t["colour"]))

    return _moments(tiled(_with_colour(px), ["v", "colour"], 5, kernel, _TEXTURE), tile)


def _with_colour(px: DataFrame) -> DataFrame:
    """0, 1, 2 for red, green, blue of the RGGB pattern."""
    return px.withColumn("colour", (F.col("y") % 2 + F.col("x") % 2).cast("int"))


def tile_shifts(moments: DataFrame) -> DataFrame:
    """``moments`` with shift, the tile's weight and the variance of the image's shifts under 2 for this colour and direction.

    The last colour and direction of a tile give its weight. A tile without texture has the shift NO_SHIFT.
    """
    textured = F.col("m2") > FLAT
    df = moments.withColumn("shift", F.when(textured, F.col("m1") / F.col("m2")).otherwise(NO_SHIFT))
    last = F.when((F.col("colour") == 1) & (F.col("direction") == 1), F.when(textured, F.col("m2") / (GUARD + F.col("m0"))).otherwise(0.0))
    df = df.withColumn("weight", F.max(last).over(Window.partitionBy("image_id", "vblock", "hblock")))
    small = F.when(F.abs("shift") < 2, F.col("shift"))
    var = df.groupBy("image_id", "colour", "direction").agg((F.avg(small * small) - F.avg(small) * F.avg(small)).alias("variance"))
    return df.join(var, ["image_id", "colour", "direction"])


def gated_blocks(shifts: DataFrame) -> DataFrame:
    """(image_id, vblock, hblock, colour, direction, weight, shift): medians of 3×3 blocks that pass the gate.

    Beyond the frame's edge the block inside the edge's stands in. A block goes if its squared median is more than GATE
    times the variance in either direction.
    """
    size = shifts.groupBy("image_id").agg(F.max("vblock").alias("rows"), F.max("hblock").alias("columns"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    key = ["image_id", "vblock", "hblock", "colour", "direction"]
    inside = lambda k, n: F.when(k == 0, 2).when(k > n, n - 1).otherwise(k)
    asked = shifts.join(size, "image_id").select(*key, "weight", "variance", "rows", "columns", step.alias("dv")).select("*", step.alias("dh"))
    asked = asked.withColumns({"v": inside(F.col("vblock") + F.col("dv"), F.col("rows")), "h": inside(F.col("hblock") + F.col("dh"), F.col("columns"))})
    near = shifts.select("image_id", "colour", "direction", F.col("vblock").alias("v"), F.col("hblock").alias("h"), F.col("shift").alias("near"))
    median = asked.join(near, ["image_id", "colour", "direction", "v", "h"]).groupBy(*key).agg(F.median("near").alias("shift"), F.first("weight").alias("weight"), F.first("variance").alias("variance"))
    bad = F.max((F.col("shift") * F.col("shift") > GATE * F.col("variance")).cast("int")).over(Window.partitionBy("image_id", "vblock", "hblock", "colour"))
    return median.withColumn("bad", bad).where("bad = 0").select(*key, "weight", "shift")


def power_sums(blocks: DataFrame) -> DataFrame:
    """(image_id, colour, direction, n, p, q, value, rhs): the weighted normal equations of a polynomial of 4 × 4 powers.

    The 256 sums of a system are 49 different ones, by the sums of the powers; these are aggregated and then dealt out.
    """
    v, h, w = F.col("vblock").cast("double"), F.col("hblock").cast("double"), F.col("weight")
    sums = [F.sum(w * F.pow(v, F.lit(a)) * F.pow(h, F.lit(b))).alias(f"s{a}_{b}") for a in range(2 * ORDER - 1) for b in range(2 * ORDER - 1)]
    right = [F.sum(w * F.col("shift") * F.pow(v, F.lit(a)) * F.pow(h, F.lit(b))).alias(f"t{a}_{b}") for a in range(ORDER) for b in range(ORDER)]
    agg = blocks.groupBy("image_id", "colour", "direction").agg(F.count(F.lit(1)).alias("n"), *sums, *right)
    powers = [divmod(p, ORDER) for p in range(ORDER * ORDER)]
    cells = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.col(f"s{i + m}_{j + k}").alias("value"), F.col(f"t{i}_{j}").alias("rhs")) for p, (i, j) in enumerate(powers) for q, (m, k) in enumerate(powers)])
    return agg.select("image_id", "colour", "direction", "n", F.explode(cells).alias("e")).select("image_id", "colour", "direction", "n", "e.*")


def solve(equations: DataFrame, few: str = "stored") -> DataFrame:
    """(image_id, colour, direction, coefficients): 16 coefficients for each system, null where it can't be solved.

    With fewer than 32 blocks (for blue: in both colours) four terms are solved for: ``stored`` takes the first 16 sums, as
    they are stored, as a system of four, which is not the least-squares one but what the results are compared with;
    ``bilinear`` takes the least squares of 1, h, v and vh. With fewer than 10 there is no solution. One small system a group.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["p", "q"])
        n, out = int(rows.least.iloc[0]), None
        values, right = rows.value.to_numpy(), rows.rhs.to_numpy()[:: ORDER * ORDER]
        terms = list(range(16)) if n >= 32 else [0, 1, 2, 3] if few == "stored" else [0, 1, ORDER, ORDER + 1]
        size = len(terms)
        matrix = values[: size * size].reshape(size, size) if few == "stored" or size == 16 else values.reshape(16, 16)[np.ix_(terms, terms)]
        right = right[terms]
        if n >= 10:
            # powers up to the sixth differ widely: rows and columns are scaled before the solution
            scale = np.sqrt(np.abs(np.diag(matrix)))
            scale[scale == 0] = 1
            try:
                found = np.zeros(16)
                found[terms] = np.linalg.solve(matrix / np.outer(scale, scale), right / scale) / scale
                out = found.tolist()
            except np.linalg.LinAlgError:
                out = None
        return pd.DataFrame({"image_id": rows.image_id.iloc[:1], "colour": rows.colour.iloc[:1], "direction": rows.direction.iloc[:1], "coefficients": [out]})

    least = equations.groupBy("image_id").agg(F.min(F.when(F.col("colour") == 0, F.col("n"))).alias("n0"), F.min(F.when(F.col("colour") == 1, F.col("n"))).alias("n1"))
    least = least.select("image_id", F.least(F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))).alias("least"))
    return equations.join(least, "image_id").groupBy("image_id", "colour", "direction").applyInPandas(one, "image_id long, colour int, direction int, coefficients array<double>")


def shift_at(v: Column, h: Column, coefficients: Column) -> Column:
    """The polynomial at block coordinates (v, h): nested sums over the powers, as an expression."""
    terms = [F.element_at(coefficients, ORDER * i + j + 1) * F.pow(v, F.lit(i)) * F.pow(h, F.lit(j)) for i in range(ORDER) for j in range(ORDER)]
    return sum(terms[1:], terms[0])


def radial_shift(block: Column, blocks: int, slider: Column) -> Column:
    """Shift along one axis of the block numbered ``block`` of ``blocks``: none in the middle, the slider's amount at the edge."""
    return -2 * ((block - 0.5) / blocks - 0.5) * slider


#: The largest step that a plane is moved by, in pixels; a larger one counts as this.
MOST_SHIFT = 8.0


def moved(v: np.ndarray, colour: np.ndarray, down: np.ndarray, across: np.ndarray) -> np.ndarray:
    """A mosaic whose red and blue planes lie ``down`` and ``across`` of green, with them moved back; green stays.

    What a site of a colour shows belongs to the place that lies a shift further on. There it differs from green by some
    amount; these amounts, which lie on the shifted lattice of the colour, are interpolated back to the lattice itself and
    taken from green. So a shift of 0 changes nothing. A site whose neighbours are missing stays.
    """
    green, h, w = filled_green(v, colour), *v.shape
    y, x = np.mgrid[0:h, 0:w]

    def bilinear(field: np.ndarray, dy: np.ndarray, dx: np.ndarray, step: int) -> np.ndarray:
        """``field`` at (y + dy, x + dx) between places that are ``step`` apart."""
        iy, ix = np.floor(dy / step), np.floor(dx / step)
        fy, fx = dy / step - iy, dx / step - ix
        total, weight = np.zeros_like(v), np.zeros_like(v)
        for a, wy in ((0, 1 - fy), (1, fy)):
            for b, wx in ((0, 1 - fx), (1, fx)):
                ty, tx = (y + step * (iy + a)).astype(int), (x + step * (ix + b)).astype(int)
                inside = (ty >= 0) & (ty < h) & (tx >= 0) & (tx < w)
                found = np.where(inside, field[np.clip(ty, 0, h - 1), np.clip(tx, 0, w - 1)], np.nan)
                use = wy * wx > 0
                total = total + np.where(use, wy * wx * found, 0.0)
                weight = weight + wy * wx
        return total

    site = (colour != 1) & ~np.isnan(v) & ~np.isnan(down) & ~np.isnan(across)
    dy, dx = (np.where(site, np.clip(s, -MOST_SHIFT, MOST_SHIFT), 0.0) for s in (down, across))
    amount = np.where(site, bilinear(green, dy, dx, 1) - v, np.nan)
    back = green - bilinear(amount, -dy, -dx, 2)
    return np.where(site & ~np.isnan(back) & ((dy != 0) | (dx != 0)), back, v)


def apply_shifts(px: DataFrame, down: Column, across: Column) -> DataFrame:
    """(image_id, y, x, v) of RGGB mosaics with red and blue moved by the shifts, which are columns of ``px`` or expressions of them.

    A null shift is none. One shuffle by tile.
    """
    own = _with_colour(px).select("image_id", "y", "x", "v", "colour", F.coalesce(down, F.lit(0.0)).alias("down"), F.coalesce(across, F.lit(0.0)).alias("across"))
    halo = int(MOST_SHIFT) + 4
    return tiled(own, ["v", "colour", "down", "across"], halo, lambda t: {"v": moved(t["v"], t["colour"], t["down"], t["across"])}, ["v"])


def fitted_shifts(px: DataFrame, tile: int, few: str = "bilinear") -> DataFrame:
    """(image_id, colour, down, across): the coefficients of both polynomials of red (0) and blue (1), null where the fit failed."""
    fits = solve(power_sums(gated_blocks(tile_shifts(mosaic_moments(px, tile)))), few)
    pick = lambda k: F.max_by("coefficients", F.when(F.col("direction") == k, 1))
    return fits.groupBy("image_id", "colour").agg(pick(0).alias("down"), pick(1).alias("across"))


def correct_fringes(px: DataFrame, tile: int = 64, rounds: int = 1, few: str = "bilinear") -> DataFrame:
    """(image_id, y, x, v) of RGGB mosaics with lateral fringes measured and taken out, ``rounds`` times.

    A shift is the polynomial at the place in blocks, so it changes smoothly over the frame. An image of which too few blocks
    can be measured stays as it is. One round takes out shifts of up to about a pixel; more of them are for larger shifts, as what
    a round measures of planes that lie right already is noise. Two shuffles of the pixels a round; the fits, four a image, are written between them.
    """
    out = px.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    for k in range(rounds):
        fits = written(fitted_shifts(out, tile, few), "fringe-fits").withColumnRenamed("colour", "plane")
        sites = _with_colour(out).withColumn("plane", F.when(F.col("colour") == 0, 0).when(F.col("colour") == 2, 1))
        at = [(F.col(c) + 0.5) / tile + 0.5 for c in ("y", "x")]  # the middle of block n lies at n
        known = sites.join(fits, ["image_id", "plane"], "left")
        out = apply_shifts(known.select("image_id", "y", "x", "v", *[shift_at(*at, F.col(c)).alias(c) for c in ("down", "across")]), F.col("down"), F.col("across"))
        if k + 1 < rounds:
            out = written(out, "fringes")
    return out

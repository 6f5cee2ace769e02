"""Images as tables of pixels (image_id, y, x, values): stencils, windows, aggregations over many images at once.

Stencils run on square tiles with a halo: one shuffle that sends a pixel once, and again only near a tile's edge. Wider
windows are two separable window passes, dealt by (image, row) and (image, column). No step is dealt by image alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from photolake.functions import kernels
from photolake.sources.scratch import written

#: Side of a tile; a task holds about two tiles of this many pixels squared, and their halos, at a time.
TILE = 256


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, cut so that no group is in two parts. Holds a batch and a group."""
    held = []  # of the group that may go on in the next batch
    for rows in batches:
        if rows.empty:
            continue
        last = (rows[key] == rows[key].iloc[-1]).all(axis=1).to_numpy()
        begins = len(rows) - int(last.sum())
        if held and (begins or (held[-1][key].iloc[-1] != rows[key].iloc[-1]).any()):
            yield pd.concat([*held, rows[:begins]], ignore_index=True)
            held = []
        elif begins:
            yield rows[:begins].reset_index(drop=True)
        held.append(rows[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)


def tiled(px: DataFrame, values: list[str], halo: int, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[str], size: int = TILE, deep: bool = False) -> DataFrame:
    """(image_id, y, x, *out), a row for each pixel: what a numpy kernel makes of the pixels up to ``halo`` steps around.

    The kernel gets a 2-D array of doubles for each value and returns one of the same shape for each name of ``out``, or
    one with an axis more in front, which becomes an array column. NaN stands for a place outside the image and for a
    null, both ways. With a halo of at least the kernel's reach the result does not depend on ``size``. Places count from
    0 and frames may have gaps; a pixel must not come twice; one without an image or place is left out. An empty table gives none; other columns are left out.

    With ``deep`` it gets arrays with an axis in front that counts tiles, and must take what lies beyond their edges as
    missing: small frames under a wide halo then cost their own pixels and no margin.
    """
    # a pixel goes to the tiles that its halo reaches and to no others: most go to one
    tile = lambda c: F.floor(c / size).cast("int")
    reached = lambda c: F.explode(F.sequence(tile(F.greatest(F.col(c) - halo, F.lit(0))), tile(F.col(c) + halo)))
    sent = px.where("image_id IS NOT NULL").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(f"in_{k}") for k, v in enumerate(values)])
    dealt = sent.select("*", reached("y").alias("tile_y")).select("*", reached("x").alias("tile_x"))
    key = ["image_id", "tile_y", "tile_x"]
    names, kinds = [n.split(" ")[0] for n in out], [n.split(" ")[1] if " " in n else "double" for n in out]

    def made(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole tiles, small ones stacked with a halo between them so that the kernel runs once for many."""
        new = (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1]).any(axis=1)
        first, tile_of = np.flatnonzero(np.r_[True, new]), np.r_[0, np.cumsum(new)]
        y, x, tile_y, tile_x = (rows[c].to_numpy() for c in ("y", "x", "tile_y", "tile_x"))
        core = (y // size == tile_y) & (x // size == tile_x)
        y, x = (c - np.minimum.reduceat(c, first)[tile_of] for c in (y, x))
        tall = np.maximum.reduceat(y, first) + 1 + halo
        top = np.cumsum(tall) - tall
        ends = [*first[1:][np.diff(top // (size + 2 * halo)) > 0], len(rows)]  # about a tile's height in a stack, or a tile
        for a, b in zip([0, *ends], ends, strict=False):
            if not core[a:b].any():  # nothing but halo
                continue
            at = y[a:b] + (top[tile_of[a:b]] - top[tile_of[a]]) + halo, x[a:b] + halo
            planes = {v: np.full((at[0].max() + halo + 1, at[1].max() + halo + 1), np.nan) for v in values}
            for k, v in enumerate(values):
                planes[v][at] = rows[f"in_{k}"].to_numpy()[a:b]
            done, kept = kernel(planes), core[a:b]
            taken = {n: done[n][..., at[0][kept], at[1][kept]] for n in names}
            yield pd.DataFrame({c: rows[c].to_numpy()[a:b][kept] for c in ("image_id", "y", "x")} | {n: v if v.ndim == 1 else list(v.T) for n, v in taken.items()})

    def layered(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole tiles one behind the other, as many as hold about a full tile's pixels with what fills up the smaller ones."""
        new = (rows[key].to_numpy()[1:] != rows[key].to_numpy()[:-1]).any(axis=1)
        first, tile_of = np.flatnonzero(np.r_[True, new]), np.r_[0, np.cumsum(new)]
        y, x, tile_y, tile_x = (rows[c].to_numpy() for c in ("y", "x", "tile_y", "tile_x"))
        core = (y // size == tile_y) & (x // size == tile_x)
        y, x = (c - np.minimum.reduceat(c, first)[tile_of] for c in (y, x))
        tall, broad = (np.maximum.reduceat(c, first) + 1 for c in (y, x))
        starts, h, w = [0], 0, 0  # the first tile of each stack
        for k, (high, wide) in enumerate(zip(tall.tolist(), broad.tolist(), strict=True)):
            h, w = max(h, high), max(w, wide)
            if k > starts[-1] and (k + 1 - starts[-1]) * h * w > (size + 2 * halo) ** 2:
                starts.append(k)
                h, w = high, wide
        for s, e in zip(starts, [*starts[1:], len(first)], strict=True):
            a, b = first[s], first[e] if e < len(first) else len(rows)
            if not core[a:b].any():  # nothing but halo
                continue
            at = tile_of[a:b] - s, y[a:b], x[a:b]
            planes = {v: np.full((e - s, tall[s:e].max(), broad[s:e].max()), np.nan) for v in values}
            for k, v in enumerate(values):
                planes[v][at] = rows[f"in_{k}"].to_numpy()[a:b]
            done, kept = kernel(planes), core[a:b]
            taken = {n: done[n][..., at[0][kept], at[1][kept], at[2][kept]] for n in names}
            yield pd.DataFrame({c: rows[c].to_numpy()[a:b][kept] for c in ("image_id", "y", "x")} | {n: v if v.ndim == 1 else list(v.T) for n, v in taken.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, key):
            yield from (layered if deep else made)(rows)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))
    done = dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, f"image_id long, y int, x int, {schema}")
    empty = lambda v: F.when(~F.isnan(v), v)
    return done.select("image_id", "y", "x", *[empty(F.col(n)).alias(n) if k == "double" else F.transform(n, empty).alias(n) for n, k in zip(names, kinds, strict=True)])


def gather(px: DataFrame, offsets: list[tuple[int, int]], value: str = "v") -> DataFrame:
    """(image_id, y, x, near): for each pixel the values at the offsets (dy, dx), in their order; null outside the image."""
    reach = max(abs(o) for pair in offsets for o in pair)
    return tiled(px, [value], reach, lambda t: {"near": kernels.around(t[value], offsets)}, ["near array<double>"])


def _two_passes(px: DataFrame, values: list[str], r: int, agg: Callable[[str, Column], Column]) -> DataFrame:
    rows = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-r, r)
    cols = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-r, r)
    first = px.withColumns({f"_{v}": agg(v, F.col(v)).over(rows) for v in values} | {"_n": F.count(F.lit(1)).over(rows)})
    return first.withColumns({f"__{v}": agg(v, F.col(f"_{v}")).over(cols) for v in values} | {"__n": F.sum("_n").over(cols)})


def box_mean(px: DataFrame, values: list[str], r: int) -> DataFrame:
    """``px`` with mean_<value>: means over the (2r+1)² windows' pixels that lie in the image, which must be a full grid."""
    out = _two_passes(px, values, r, lambda _, c: F.sum(c))
    return out.select(*px.columns, *[(F.col(f"__{v}") / F.col("__n")).alias(f"mean_{v}") for v in values])


def box_min(px: DataFrame, values: list[str], r: int) -> DataFrame:
    out = _two_passes(px, values, r, lambda _, c: F.min(c))
    return out.select(*px.columns, *[F.col(f"__{v}").alias(f"min_{v}") for v in values])


def tent_blur(px: DataFrame, value: str, radius: int) -> DataFrame:
    """``px`` with blurred_<value>: two box passes a direction, edges repeated, divided by 2r+1; r = ceil(radius / 2)."""
    r = -(-radius // 2)
    out = px.withColumn("_v", F.col(value))
    for line, along in (("y", "x"), ("x", "y")):
        near = Window.partitionBy("image_id", line).orderBy(along).rowsBetween(-r, r)
        whole = Window.partitionBy("image_id", line).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        for _ in range(2):
            before = F.greatest(F.lit(r) - F.col(along) + F.min(along).over(whole), F.lit(0)) * F.first("_v").over(whole)
            after = F.greatest(F.lit(r) - F.max(along).over(whole) + F.col(along), F.lit(0)) * F.last("_v").over(whole)
            out = out.withColumn("_v", (F.sum("_v").over(near) + before + after) / (2 * r + 1))
    return out.withColumnRenamed("_v", f"blurred_{value}")


def guided_filter(px: DataFrame, guide: str, source: str, r: int, eps: float) -> DataFrame:
    """``px`` with filtered: mean_a · guide + mean_b, with a = cov / (var + eps) and b = mean(source) − a · mean(guide)."""
    out = px.withColumns({"ii": F.col(guide) * F.col(guide), "ip": F.col(guide) * F.col(source), "gi": F.col(guide), "gp": F.col(source)})
    out = box_mean(out, ["gi", "gp", "ii", "ip"], r)
    a = (F.col("mean_ip") - F.col("mean_gi") * F.col("mean_gp")) / (F.col("mean_ii") - F.col("mean_gi") * F.col("mean_gi") + eps)
    out = out.withColumn("a", a).withColumn("b", F.col("mean_gp") - F.col("a") * F.col("mean_gi"))
    out = box_mean(out.select(*px.columns, "a", "b"), ["a", "b"], r)
    return out.select(*px.columns, (F.col("mean_a") * F.col(guide) + F.col("mean_b")).alias("filtered"))


def with_cfa(px: DataFrame, cfa: DataFrame, period: int = 2) -> DataFrame:
    """``px`` with plane and colour of its filter; the pattern table has period² rows."""
    return px.withColumns({"ry": F.col("y") % period, "rx": F.col("x") % period}).join(F.broadcast(cfa), ["ry", "rx"]).drop("ry", "rx")


def histogram(px: DataFrame, by: list[str]) -> DataFrame:
    """256-bin counts; the bin is the clamped value times 255, rounded."""
    b = F.floor(F.least(F.greatest(F.col("v"), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")
    return px.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentile(counts: DataFrame, by: list[str], tail: float) -> DataFrame:
    """Smallest bin whose cumulative count reaches trunc(total · tail), divided by 255; 0 where that count is 0."""
    w = Window.partitionBy(*by)
    ranked = counts.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "goal": F.floor(F.sum("n").over(w) * tail)})
    return ranked.where("upto >= goal").groupBy(*by).agg((F.min(F.when(F.col("goal") == 0, 0).otherwise(F.col("bin"))) / 255).alias("value"))


def neighbour_stats(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image_id, y, x, v, lo, hi, median, count): the pixel's value beside minimum, maximum, median and number of its neighbours that have one."""
    reach = max(abs(o) for pair in offsets for o in pair)
    out = tiled(px, ["v"], reach, lambda t: {"v": t["v"]} | kernels.spread(kernels.around(t["v"], offsets)), ["v", "lo", "hi", "median", "count"])
    return out.withColumn("count", F.col("count").cast("long"))


def impulse_replace(px: DataFrame, offsets: list[tuple[int, int]], tolerance: float, inside: Column) -> DataFrame:
    """(image_id, y, x, v): values beyond those of their neighbours by more than the tolerance are drawn to the median with a soft knee.

    Pixels that are not ``inside`` or have under four neighbours stay.
    """
    near = neighbour_stats(px, offsets)
    odd = inside & (F.col("count") >= 4) & ((F.col("v") > F.col("hi") + tolerance) | (F.col("v") < F.col("lo") - tolerance))
    away = F.col("v") - F.col("median")
    return near.select("image_id", "y", "x", F.when(odd, F.col("median") + away * tolerance / (tolerance + F.abs(away))).otherwise(F.col("v")).alias("v"))


SAME_COLOUR = {"rb": [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dy or dx], "g": [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if (dy or dx) and (dy + dx) % 2 == 0]}


def superpixels(px: DataFrame, cfa: DataFrame) -> DataFrame:
    """Each 2×2 block of a Bayer mosaic as one RGB pixel, green the mean of both greens; odd edges are dropped."""
    planes = with_cfa(px, cfa)
    half = planes.groupBy("image_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    colour = lambda k: F.avg(F.when(F.col("colour") == k, F.col("v")))
    return half.agg(colour(0).alias("r"), colour(1).alias("g"), colour(2).alias("b"), F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")


def demosaic_bilinear(px: DataFrame, cfa: DataFrame) -> DataFrame:
    """Full colour at each pixel: its own kept, the others the mean of the same colour among the 3×3 neighbours in the image."""
    return tiled(with_cfa(px, cfa), ["v", "colour"], 1, lambda t: kernels.fill_colours(t["v"], t["colour"]), ["r", "g", "b"])


#: Side of a patch, coefficients of its sketch, coefficients of the grid, and different patches of a grid cell that meet in one piece.
PATCH, SKETCH, GRID, PIECE = 8, 16, 3, 2048


def _cosines() -> np.ndarray:
    """The 64 × SKETCH first vectors of the orthonormal cosine transform of a patch, low frequencies first."""
    k = np.arange(PATCH)
    line = np.sqrt(2 / PATCH) * np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * PATCH))
    line[0] /= np.sqrt(2)
    order = sorted(np.ndindex(PATCH, PATCH), key=lambda f: (f[0] + f[1], f))[:SKETCH]
    return np.stack([np.outer(line[u], line[v]).ravel() for u, v in order], axis=1)


def sketched(patches: DataFrame) -> DataFrame:
    """``patches`` with sketch: SKETCH coefficients of ``data``. Of two patches they differ by no more than the patches do."""
    basis = _cosines()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            data = np.stack(rows.data.to_numpy()) if len(rows) else np.zeros((0, PATCH * PATCH))
            yield rows.assign(sketch=list(data @ basis))

    return patches.mapInPandas(run, StructType([*patches.schema.fields, StructField("sketch", ArrayType(DoubleType()))]))


def patch_candidates(different: DataFrame, limit: float) -> DataFrame:
    """(cell, p, q): pairs p < q of different patches (cell, p, data, sketch) within the sum of squares ``limit``, but for rounding: all that may be near.

    They meet on a grid over the GRID coefficients that vary most over the table, wide enough that partners are in equal or
    neighbouring cells; half of the neighbours are asked, so a pair meets once. A cell of many patches is cut into pieces
    that meet two by two, each two pieces in one group whose distances are one matrix product. So no task gets more than two
    pieces of a cell at a time, and where the grid tells little apart, a pair costs 64 multiplications and no row.
    """
    spread = different.agg(*[F.coalesce(F.var_pop(F.col("sketch")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(SKETCH)]).first()
    axes = sorted(range(SKETCH), key=lambda k: (-spread[k], k))[:GRID]
    # a little wider than the limit, so that rounding parts no pair
    width, most = math.sqrt(limit) * (1 + 1e-9) + 1e-12, limit * (1 + 1e-9) + 1e-12
    rows = different.withColumns({f"g{j}": F.floor(F.col("sketch")[k] / width).cast("long") for j, k in enumerate(axes)})
    grid = ["cell", *[f"g{j}" for j in range(GRID)]]
    sizes = rows.groupBy(*grid).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    rows = rows.join(sizes, grid).withColumn("piece", F.pmod(F.xxhash64("p", F.lit(1)), F.col("pieces")).cast("int"))
    rows = rows.select("cell", "p", "data", F.concat_ws("|", *grid, "piece").alias("block"))
    blocks = sizes.select(*grid, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    ahead = [d for d in np.ndindex(*[3] * GRID) if d >= (1,) * GRID]  # of each two opposite neighbours one, and the cell itself
    steps = F.explode(F.array(*[F.struct(*[F.lit(int(x) - 1).alias(f"d{j}") for j, x in enumerate(d)]) for d in ahead])).alias("d")
    asking = blocks.select("*", F.concat_ws("|", *grid, "piece").alias("a"), F.col("piece").alias("own"), steps).drop("piece")
    asking = asking.select("cell", "a", "own", *[(F.col(f"g{j}") + F.col(f"d.d{j}")).alias(f"g{j}") for j in range(GRID)], sum((F.col(f"d.d{j}") != 0).cast("int") for j in range(GRID)).alias("away"))
    meets = asking.join(blocks, grid).where("away > 0 OR own <= piece").select("a", F.concat_ws("|", *grid, "piece").alias("b"))
    ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block")
    met = rows.join(meets.select("a", "b", ends), "block").groupBy("a", "b")
    kind = StructType([StructField(n, different.schema["cell" if n == "cell" else "p"].dataType) for n in ("cell", "p", "q")])

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        first = (group.block == group.a).to_numpy()
        own = bool((group.a == group.b).iloc[0])
        one, two = group[first], group if own else group[~first]
        if not len(one) or not len(two):  # a piece to which no patch was dealt
            return group.iloc[:0].assign(q=group.p.iloc[:0])[["cell", "p", "q"]]
        x, y = np.stack(one.data.to_numpy()), np.stack(two.data.to_numpy())
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero(xx[:, None] + yy[None] - 2 * (x @ y.T) <= most + 1e-12 * (xx[:, None] + yy[None]))
        p, q = one.p.to_numpy()[i], two.p.to_numpy()[j]
        once = p < q if own else np.ones(len(p), dtype=bool)
        return pd.DataFrame({"cell": one.cell.to_numpy()[i][once], "p": np.minimum(p, q)[once], "q": np.maximum(p, q)[once]})

    return met.applyInPandas(meet, kind)


def similar_patches(patches: DataFrame, sigma: float, k: int = 16) -> DataFrame:
    """(cell, ref, other, ssd, place): for every patch the ``k`` most alike of its cell within a sum of squares of (2.5 sigma)² · 64.

    ``patches``: cell, vec_id (unique in its cell), data of 64 numbers. Equal patches are one, with their ``k`` + 1 smallest
    ids, which is all of them that a list can name; different ones meet by ``patch_candidates``, and only the pairs that it
    finds are summed up one by one. Ties go to smaller ids. Rows with a null among cell, id or data are left out.
    """
    limit = (2.5 * sigma) ** 2 * PATCH * PATCH
    rows = patches.select("cell", "vec_id", "data").where("cell IS NOT NULL AND vec_id IS NOT NULL AND data IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64("data"))
    # of equal patches the smallest ids, found in two steps so that no group is sorted in one task
    low = rows
    for part in (F.pmod(F.xxhash64("vec_id"), F.lit(64)), F.lit(0)):
        low = low.withColumn("part", part)
        low = low.withColumn("at", F.row_number().over(Window.partitionBy("cell", "hash", "data", "part").orderBy("vec_id"))).where(F.col("at") <= k + 1).drop("at", "part")
    classes = written(low.groupBy("cell", "data").agg(F.min("vec_id").alias("p"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "patch-classes")
    pairs = written(patch_candidates(sketched(classes.select("cell", "p", "data")), limit), "patch-pairs").distinct()
    ssd = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    left, right = (classes.select("cell", F.col("p").alias(n), F.col("data").alias(d), F.col("ids").alias(f"ids_{n}")) for n, d in (("p", "a"), ("q", "b")))
    near = pairs.join(left, ["cell", "p"]).join(right, ["cell", "q"]).withColumn("ssd", ssd).where(F.col("ssd") <= limit)
    there = F.struct(F.col("p").alias("own"), F.col("ids_q").alias("ids"))
    back = F.struct(F.col("q").alias("own"), F.col("ids_p").alias("ids"))
    beside = near.select("cell", "ssd", F.explode(F.array(there, back)).alias("e")).select("cell", F.col("e.own").alias("p"), F.explode("e.ids").alias("other"), "ssd")
    own = classes.select("cell", "p", F.explode("ids").alias("other"), F.lit(0.0).alias("ssd"))
    best = beside.unionByName(own).withColumn("at", F.row_number().over(Window.partitionBy("cell", "p").orderBy("ssd", "other"))).where(F.col("at") <= k + 1)
    lists = best.groupBy("cell", "p").agg(F.array_sort(F.collect_list(F.struct("ssd", "other"))).alias("best"))
    members = rows.select("cell", "vec_id", "data").join(classes.select("cell", "data", "p"), ["cell", "data"]).select("cell", F.col("vec_id").alias("ref"), "p")
    named = members.join(lists, ["cell", "p"]).select("cell", "ref", F.posexplode(F.slice(F.filter("best", lambda e: e["other"] != F.col("ref")), 1, k)).alias("at", "e"))
    return named.select("cell", "ref", "e.other", "e.ssd", (F.col("at") + 1).alias("place"))


def pack_tiles(px: DataFrame, size: int) -> DataFrame:
    """Row-major array tiles of at most size×size pixels."""
    keyed = px.withColumns({"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")})
    grouped = keyed.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    spread = lambda c: F.array_max(F.transform("p", lambda s: s[c])) - F.array_min(F.transform("p", lambda s: s[c])) + 1
    return grouped.select("image_id", "ty", "tx", spread("x").alias("w"), spread("y").alias("h"), F.transform("p", lambda s: s["v"]).alias("data"))


def unpack_tiles(tiles: DataFrame, size: int) -> DataFrame:
    out = tiles.select("image_id", "ty", "tx", "w", F.posexplode("data").alias("i", "v"))
    return out.select("image_id", (F.col("ty") * size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("tx") * size + F.col("i") % F.col("w")).cast("int").alias("x"), "v")


def tile_map(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: int, halo: int) -> DataFrame:
    """(image_id, y, x, v): a caller's numpy kernel on tiles, see ``tiled``."""
    return tiled(px, ["v"], halo, lambda t: {"v": kernel(t["v"])}, ["v"], size)


def offset_table(pattern: DataFrame, period: int, radius: int) -> DataFrame:
    """(ry, rx, dy, dx): for each place of a square filter pattern (ry, rx, colour) the steps to pixels of its own colour, itself left out.

    The pattern repeats, so the table holds for every pixel of that place; it has at most period² · (2·radius+1)² rows.
    """
    step = lambda: F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    own = pattern.select("ry", "rx", "colour", step().alias("dy")).select("*", step().alias("dx")).where("dy <> 0 OR dx <> 0")
    there = own.withColumns({"ty": F.pmod(F.col("ry") + F.col("dy"), F.lit(period)), "tx": F.pmod(F.col("rx") + F.col("dx"), F.lit(period))})
    other = pattern.select(F.col("ry").alias("ty"), F.col("rx").alias("tx"), "colour")
    return there.join(other, ["ty", "tx", "colour"]).select("ry", "rx", "dy", "dx")

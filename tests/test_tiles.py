"""Chains on tiles: one deal for all stages, and a lens that sends each source pixel to the tiles that read it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.functions import kernels
from photolake.operators import develop as D
from photolake.operators import pixels as P

H, W = 150, 131
CFA = [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 3, 2)]


@pytest.fixture(scope="module")
def mosaics(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:H, 0:W]
    base = [np.clip(0.6 + 0.35 * np.sin(y / 9 + k) * np.cos(x / 7) + 0.25 * (x > 60) + rng.normal(0, 0.05, (H, W)), 0, 1.2) for k in range(2)]
    path = str(tmp_path_factory.mktemp("mosaics") / "px")
    rows = [(k, int(a), int(b), float(v[a, b])) for k, v in enumerate(base) for a in range(H) for b in range(W) if k == 0 or not (a == 70 and b == 64)]
    spark.createDataFrame(rows, "image_id long, y int, x int, v double").write.parquet(path)
    return spark.read.parquet(path), spark.createDataFrame(CFA, "ry int, rx int, plane int, colour int")


def grid(rows, names, image=0):
    out = np.full((len(names), H, W), np.nan)
    for r in rows:
        if r.image_id == image:
            out[:, r.y, r.x] = [np.nan if r[n] is None else r[n] for n in names]
    return out


@pytest.mark.parametrize(("size", "mode"), [(64, "min"), (None, "blue"), (33, "avg"), (128, "each")])
def test_one_deal_equals_stage_after_stage(mosaics, size, mode):
    px, cfa = mosaics
    inside = F.col("y").between(2, H - 3)
    got = D.develop_mosaic(px, cfa, ev=0.3, impulse=0.05, inside=inside, dehaze_strength=0.6, purple=0.7, green=0.5, gains=(2.0, 1.0, 1.5), cap=0.3, mode=mode, radius=3, size=size).collect()
    out = px.select(*D.PIXEL, (F.least(F.greatest("v", F.lit(0.0)), F.lit(1.0)) * 2.0**0.3).alias("v"))
    out = P.impulse_replace(out, P.SAME_COLOUR["rb"], 0.05, inside)
    out = D.loca(D.dehaze(out, cfa, 0.6, cap=0.3, mode=mode, radius=3), cfa, 0.7, 0.5)
    want = P.demosaic_bilinear(out, cfa).selectExpr(*D.PIXEL, "r * 2.0 AS r", "g", "b * 1.5 AS b").collect()
    assert len(got) == len(want) == 2 * H * W - 1
    for image in (0, 1):
        assert np.allclose(grid(got, "rgb", image), grid(want, "rgb", image), atol=1e-9, equal_nan=True)


def test_the_chain_has_one_exchange(mosaics):
    px, cfa = mosaics
    plan = D.develop_mosaic(px, cfa, ev=0.3, impulse=0.05, dehaze_strength=0.6, purple=0.7, green=0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange hashpartitioning") == plan.count("- Exchange ") == 1 and plan.count("BroadcastExchange") == 1 and "Window" not in plan


LENS = D.Lens((-0.12, 0.03, 0.01), (0.004, -0.006), (H / 2, W / 2), 90.0)


def test_lens_equals_numpy_and_sends_pixels_about_once(mosaics, spark):
    px, _ = mosaics
    v = np.nan_to_num(grid(px.collect(), "v")[0])
    y, x = np.mgrid[0:H, 0:W].astype(float)
    sy, sx = LENS(y, x)
    sy, sx = np.clip(sy, 0, H - 1), np.clip(sx, 0, W - 1)
    iy, ix = np.minimum(sy.astype(int), H - 2), np.minimum(sx.astype(int), W - 2)
    fy, fx = sy - iy, sx - ix
    want = (v[iy, ix] * (1 - fx) + v[iy, ix + 1] * fx) * (1 - fy) + (v[iy + 1, ix] * (1 - fx) + v[iy + 1, ix + 1] * fx) * fy
    for size in (16, 50, 256):
        got = D.resample(px.where("image_id = 0"), LENS, F.lit(H), F.lit(W), size).collect()
        assert len(got) == H * W and np.allclose(grid(got, "v")[0], want, atol=1e-12)
    frames = spark.createDataFrame([(H, W), (400, 300)], "height int, width int")
    boxes = D._source_windows(frames, LENS, 64).dropDuplicates(["height", "tile_y", "tile_x"]).where("height = 150")
    sent = boxes.agg(F.sum(F.expr("(y1 - y0 + 1) * (x1 - x0 + 1)"))).first()[0]
    assert sent <= 1.5 * H * W
    assert D.resample(px.limit(0), LENS, F.lit(H), F.lit(W)).count() == 0


def test_the_lens_deals_pixels_once(mosaics):
    px, _ = mosaics
    plan = D.resample(px, LENS, F.lit(H), F.lit(W), 64)._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Join")]
    assert final.count("Exchange hashpartitioning(image_id") == 1


def test_window_kernels_equal_loops():
    rng = np.random.default_rng(1)
    v = rng.random((23, 17))
    v[rng.random(v.shape) < 0.2] = np.nan
    for r, step in ((1, 1), (2, 2), (40, 2)):
        mean, least = kernels.box_mean(v, r, step), kernels.box_min(v, r, step)
        for y in range(23):
            for x in range(17):
                near = [v[a, b] for a in range(y % step, 23, step) for b in range(x % step, 17, step) if abs(a - y) <= r * step and abs(b - x) <= r * step and not np.isnan(v[a, b])]
                if np.isnan(v[y, x]):
                    assert np.isnan(mean[y, x]) and np.isnan(least[y, x])
                else:
                    assert abs(mean[y, x] - np.mean(near)) < 1e-12 and least[y, x] == min(near)


def test_small_frames_under_a_wide_halo_cost_their_own_pixels(spark):
    """Frames of 8x8 and one of 5x3, halo 50: a kernel over stacks gets arrays of the frames' size, not of the halo's."""
    rows = [(i, y, x, float(i)) for i in range(300) for y in range(8) for x in range(8)] + [(300, y, x, 300.0) for y in range(5) for x in range(3)]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    sizes = lambda t: {"v": t["v"], "side": np.full(t["v"].shape, float(t["v"].shape[-1] * t["v"].shape[-2]))}
    out = P.tiled(px, ["v"], 50, sizes, ["v", "side"], deep=True).collect()
    assert sorted((r.image_id, r.y, r.x, r.v) for r in out) == sorted(rows) and max(r.side for r in out) == 64


def test_kernels_over_stacks_are_those_of_each_tile():
    rng = np.random.default_rng(5)
    v = rng.random((7, 11, 9))
    v[2, 6:], v[3, :, 4:], v[5, 2, 2] = np.nan, np.nan, np.nan
    ry, rx = (np.broadcast_to(c % 2, v.shape).astype(float) for c in np.indices(v.shape[1:]))
    colour = ry + rx
    chain = lambda v, ry, rx, colour: kernels.fill_colours(kernels.mend_fringes(kernels.clear(kernels.calm(v, ry + 1, [(0, 2), (2, 0), (0, -2), (-2, 0)], 0.05), ry, rx, colour, 0.5, 0.3, "min", 3, 0.01, 1.0), colour, 0.8, 0.6, 0.5, (0.0, 0.1), 1.0, 0.2, (0.5, 0.5)), colour)
    whole = chain(v, ry, rx, colour)
    for k in range(len(v)):
        for name, plane in chain(v[k], ry[k], rx[k], colour[k]).items():
            np.testing.assert_array_equal(whole[name][k], plane)

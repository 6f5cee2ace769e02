"""Point operators against published values and plain numpy, written apart from the expressions that both engines share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import color as K
from photolake.plans import develop, pixels, profiles, registry  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


def value(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(float(v)).alias(n) for n, v in columns.items()])
    return row.select(F.expr(expression).alias("v")).first().v


#: XYZ and Oklab, as the author of the space publishes them.
OKLAB = [((0.950, 1.000, 1.089), (1.000, 0.000, 0.000)), ((1, 0, 0), (0.450, 1.236, -0.019)), ((0, 1, 0), (0.922, -0.671, 0.263)), ((0, 0, 1), (0.153, -1.415, -0.449))]


@pytest.mark.parametrize("xyz, lab", OKLAB)
def test_oklab_is_as_published_and_turns_back(spark, xyz, lab):
    px = dict(zip("xyz", xyz, strict=True))
    got = [value(spark, e, **px) for e in K.oklab(tuple("xyz"))]
    assert np.allclose(got, lab, atol=2e-3)
    assert np.allclose([value(spark, e, **dict(zip("lab", got, strict=True))) for e in K.xyz_from_oklab(tuple("lab"))], xyz, atol=1e-6)


#: Code values of 18 % grey, and of 90 % where the makers state it.
GREY = [("V-Log", 0.18, 0.4233), ("V-Log", 0.9, 0.5872), ("LogC3", 0.18, 0.3910), ("F-Log2", 0.18, 0.3910), ("S-Log3", 0.18, 420 / 1023), ("S-Log3", 0.9, 598 / 1023), ("S-Log3", 1e-6, 95 / 1023)]


@pytest.mark.parametrize("curve, light, code", GREY)
def test_log_curves_meet_the_published_codes(spark, curve, light, code):
    assert abs(value(spark, K.log_encode("v", curve), v=light) - code) < 1e-3


def test_log_curves_have_no_step(spark):
    for curve, (cut, *_) in K.LOG_CURVES.items():
        below, above = (value(spark, K.log_encode("v", curve), v=cut * f) for f in (1 - 1e-6, 1 + 1e-6))
        assert abs(above - below) < 1e-3, curve


@pytest.mark.parametrize("light, code", [(0, 0), (0.0031308, 0.040449936), (0.2140411, 0.5), (0.5, 0.735357), (1, 1), (7, 1), (-1, 0)])
def test_display_curve(spark, light, code):
    assert abs(value(spark, K.srgb("v"), v=light) - code) < 1e-5


@pytest.mark.parametrize("kelvin, xy", [(6504, (0.3127, 0.3291)), (5003, (0.3457, 0.3586)), (2856, (0.4476, 0.4075))])
def test_temperatures_of_standard_lights(spark, kelvin, xy):
    x, y = (value(spark, e, k=kelvin) for e in K.kelvin_to_xy("k"))
    assert np.allclose((x, y), xy, atol=5e-4)
    assert abs(value(spark, K.xy_to_kelvin("x", "y"), x=x, y=y) - kelvin) < 12


def table(spark, name, keys, columns):
    rows = sorted(map(tuple, registry.QUERIES[name](spark, SF).select(*keys, *columns).collect()))
    return np.array([r[len(keys) :] for r in rows], dtype=float)


@pytest.fixture(scope="module")
def rgb(spark):
    rows = sorted(map(tuple, view(spark, SF, "fx_rgb").select("image_id", "y", "x", "r", "g", "b").collect()))
    return np.array([r[:3] for r in rows]), np.array([r[3:] for r in rows])


PIXEL, RGB = ("image_id", "y", "x"), ("r", "g", "b")
PROPHOTO, REC709 = np.array([0.2880402, 0.7118741, 0.0000857]), np.array([0.2126, 0.7152, 0.0722])


def boosted(v, saturation=1.25, contrast=1.1):
    luma = (v @ PROPHOTO)[:, None]
    return np.maximum((luma + (v - luma) * saturation - 0.18) * contrast + 0.18, 0)


def v_log(v):
    v = np.maximum(v, 1e-6)
    return np.where(v < 0.01, 5.6 * v + 0.125, 0.241514 * np.log10(v + 0.00873) + 0.598206)


def lens_falloff(at, v):
    r2 = ((at[:, 1] - 3.5) ** 2 + (at[:, 2] - 3.5) ** 2) / 64
    return v * (1 + r2 * (0.3 + r2 * (0.1 - 0.05 * r2 + 0.02 * r2**2)))


def faded(c, light):
    t = np.clip((light - 0.92) / 0.08, 0, 1)
    return c * (1 - t * t * (3 - 2 * t))


def turned(at):
    image, y, x = at.T
    return np.array([[(a, b), (b, 7 - a), (7 - a, 7 - b), (7 - b, a)][i % 4] for i, a, b in zip(image, y, x, strict=True)])


#: Query, its columns, and numpy from places and colours.
TWINS = {
    "exposure_gain": (("v", "same"), lambda at, c: np.stack([np.clip(c[:, 0], 0.2, 0.8) * 2, c[:, 0]], axis=1)),
    "exposure_bounds": (("low", "high"), lambda at, c: np.stack([np.clip(c[:, :2], 0, 1).min(axis=1), np.clip(c[:, :2], 0, 1).max(axis=1)], axis=1)),
    "baseline_exposure": (("v",), lambda at, c: (c[:, 0] * np.where(at[:, 0] % 3 == 0, 2**0.35, 1))[:, None]),
    "vignette_correct": (("v",), lambda at, c: lens_falloff(at, c[:, 0])[:, None]),
    "wb_multiply": (RGB, lambda at, c: c * np.stack([np.full(len(c), 1.9), np.ones(len(c)), np.where(at[:, 0] % 2 == 0, 1.4, 1.6)], axis=1)),
    "matrix_projection": (("cx", "cy", "cz"), lambda at, c: c @ np.array([[0.7977, 0.1352, 0.0313], [0.2880, 0.7119, 0.0001], [0, 0, 0.8249]]).T),
    "clip_to_gamut": (RGB, lambda at, c: np.clip(c, 0, 1)),
    "quantize_u8": ((*RGB, "alpha"), lambda at, c: np.c_[np.floor(np.clip(c, 0, 1) * 255), np.full(len(c), 255)]),
    "boost": (RGB, lambda at, c: boosted(c)),
    "grade_gain": (RGB, lambda at, c: c * (np.where(at[:, 0] % 2 == 0, 1.5, 1) * np.where(at[:, 0] % 3 == 0, 0.8, 1))[:, None]),
    "grade": (RGB, lambda at, c: v_log(boosted(c * 1.2))),
    "highlight_chroma_compress": (("l", "a", "b2"), lambda at, c: np.stack([c[:, 0], faded(c[:, 1], c[:, 0]), faded(c[:, 2], c[:, 0])], axis=1)),
    "dehaze_apply": (("v",), lambda at, c: np.maximum((c[:, 0] - 1) / np.maximum(1 - 0.5 * c[:, 1], 1e-3) + 1, 0)[:, None]),
}


@pytest.mark.parametrize("name", TWINS)
def test_equals_numpy(spark, rgb, name):
    columns, twin = TWINS[name]
    got, want = table(spark, name, PIXEL, columns), twin(*rgb)
    assert got.shape == want.shape and np.abs(got - want).max() < 1.1e-4


def test_grey_previews(spark, rgb):
    got, c = table(spark, "gray_preview", PIXEL, ("gray_float", "gray_int")), np.clip(rgb[1], 0, 1)
    want = np.stack([np.clip(c @ REC709, 0, 1) * 255, np.floor(c * 255) @ REC709 + 0.5], axis=1)
    assert ((got == np.floor(want - 1e-9)) | (got == np.floor(want + 1e-9))).all()  # on an edge the sums' order decides


def test_turning_keeps_every_pixel(spark, rgb):
    at, c = rgb
    rows = registry.QUERIES["rotate_flip"](spark, SF).orderBy(*PIXEL).collect()
    got = np.array([(r.ry, r.rx) for r in rows])
    assert (got == turned(at)).all() and np.allclose([r.v for r in rows], c[:, 0])
    assert len({(i, *p) for i, p in zip(at[:, 0].tolist(), map(tuple, got.tolist()), strict=True)}) == len(at)

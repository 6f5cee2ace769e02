"""Presets: equal to rendering each alone, developed once a key, nothing developed twice over runs, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.operators import develop as D
from photolake.operators import presets as R

CFA = [(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 3, 2)]
MATRIX = ((0.8, 0.1, 0.1), (0.2, 0.7, 0.1), (0.0, 0.1, 0.9))
PRESET = "preset_id long, ev double, purple double, gain_r double, fringes boolean, graded boolean, curve string, note string"
PRESETS = [(1, 0.5, None, 1.5, False, True, None, "a"), (2, 0.5, None, 1.5, True, True, "F-Log2", "b"), (3, 0.5, None, 1.5, True, False, None, "c"), (4, None, 0.8, None, False, False, None, "d")]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    rows = [(k, a, b, float(v)) for k in range(3) for (a, b), v in np.ndenumerate(rng.random((10, 12)))]
    px = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    return px, spark.createDataFrame(CFA, "ry int, rx int, plane int, colour int"), spark.createDataFrame(PRESETS, PRESET)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_each_preset_alone(spark, tables, tmp_path):
    px, cfa, presets = tables
    got, fresh = R.render_presets(px, cfa, presets, R.DevelopedStore(spark, str(tmp_path)), MATRIX)
    assert len(fresh) == 2
    want = []
    for k, ev, purple, gain, fringes, graded, curve, _ in PRESETS:
        colours = D.develop_mosaic(px, cfa, ev=ev, purple=purple, gains=(gain or 1.0, 1.0, 1.0))
        want += [(k, *r) for r in rows(D.render(colours, MATRIX, F.lit(graded), curve or "V-Log", fringes))]
    assert rows(got) == sorted(want)


def test_later_runs_develop_what_is_new(spark, tables, tmp_path):
    px, cfa, presets = tables
    store = R.DevelopedStore(spark, str(tmp_path))
    first, fresh = R.render_presets(px.where("image_id < 2"), cfa, presets, store, MATRIX)
    first = rows(first)
    assert len(fresh) == 2 and R.render_presets(px.where("image_id < 2"), cfa, presets, store, MATRIX)[1] == []
    # what acts after the projection may change without a new development
    changed = presets.withColumns({"graded": ~F.col("graded"), "note": F.lit("z")})
    assert R.render_presets(px.where("image_id < 2"), cfa, changed, store, MATRIX)[1] == []
    (tmp_path / fresh[0] / "failed" / "frames").mkdir(parents=True)
    more, again = R.render_presets(px, cfa, presets, store, MATRIX)
    assert sorted(again) == sorted(fresh) and [r for r in rows(more) if r[1] < 2] == first
    assert [r.image_id for r in store.images(fresh[0]).orderBy("image_id").collect()] == [0, 1, 2]
    # a new version of a file is developed, the old one is not shown for it
    new = px.where("image_id = 0").withColumns({"version": F.lit("2"), "v": 1 - F.col("v")})
    shown, again = R.render_presets(new, cfa, presets, store, MATRIX)
    assert len(again) == 2 and rows(shown) != [r for r in first if r[1] == 0]


def test_empty_tables_and_too_many_presets(spark, tables, tmp_path, monkeypatch):
    px, cfa, presets = tables
    store = R.DevelopedStore(spark, str(tmp_path))
    assert R.render_presets(px.limit(0), cfa, presets, store, MATRIX)[0].count() == 0
    assert R.render_presets(px, cfa, presets.limit(0), store, MATRIX)[0].count() == 0
    monkeypatch.setattr(R, "MOST_PRESETS", 3)
    with pytest.raises(ValueError, match="presets"):
        R.render_presets(px, cfa, presets, store, MATRIX)


def test_a_pixel_is_read_without_a_pattern(spark, tables, tmp_path):
    """Every pixel asks in which run it was written: a pattern over the file's path cost more than all that is done to the pixel."""
    px, cfa, _ = tables
    store = R.DevelopedStore(spark, str(tmp_path / "frames" / "images"))
    for most in (1, 3):
        store.add(px.where(F.col("image_id") < most).withColumn("version", F.lit("")), cfa, "key")
    wanted = px.select("image_id", F.lit("").alias("version")).distinct()
    out = store.read("key", wanted)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and out.count() == px.count()
    assert {r.run for r in store.images("key").collect()} == {d.name for d in (tmp_path / "frames" / "images" / "key").iterdir()}

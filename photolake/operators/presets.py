"""Frames under many presets: what presets share is developed once for each set of parameters, kept, and used again by later runs.

A preset's parameters fall into those that act before the camera's colours are projected, which make the key, and those after
it, which are applied to the kept frames. The folder of a key holds the frames that were developed under it; a run adds
those that it lacks.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.functions import color as K
from photolake.sources.scratch import written

from .develop import PIXEL, RGB, defringe_blue, defringe_green, develop_mosaic

#: Parameters by the stage that they act on, in the order in which the key names them.
DEVELOP = ("ev", "impulse", "dehaze", "purple", "green", "gain_r", "gain_b")
RENDER = ("fringes", "graded", "curve")
#: Presets that a run may have: a row each comes to the driver, which plans a job for each key.
MOST_PRESETS = 10_000


def develop_key() -> Column:
    """SHA-256 of the names and values of the parameters before the projection; those after it do not count."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("none"))) for n in DEVELOP]), 256)


def _run_of_file() -> Column:
    """The run in which a row was written, by its file run/frames/part or run/images/part. Cheap, since every pixel asks for it."""
    return F.substring_index(F.substring_index("_metadata.file_path", "/", -3), "/", 1)


class DevelopedStore:
    """Developed frames under ``path``: a folder for each key, in it one for each run that added to it.

    A run's folder holds its frames and, written after them, the list of its images with their versions; a run that failed
    has no list and does not count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self, key: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        top = path(f"{self.path}/{key}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        runs = [f.getPath().toString() for f in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(r for r in runs if fs.exists(path(f"{r}/images/_SUCCESS")))

    def images(self, key: str) -> DataFrame:
        """(image_id, version, run) of the key; of several runs that developed the same one counts."""
        runs = self._runs(key)
        if not runs:
            return self.spark.createDataFrame([], "image_id long, version string, run string")
        rows = self.spark.read.schema("image_id long, version string").parquet(*[f"{r}/images" for r in runs])
        return rows.withColumn("run", _run_of_file()).groupBy("image_id", "version").agg(F.min("run").alias("run"))

    def read(self, key: str, wanted: DataFrame) -> DataFrame:
        """(image_id, y, x, r, g, b) of the wanted (image_id, version)."""
        schema = "image_id long, y int, x int, r double, g double, b double"
        runs = self._runs(key)
        if not runs:
            return self.spark.createDataFrame([], schema)
        chosen = self.images(key).join(wanted, ["image_id", "version"], "left_semi").select("image_id", "run")
        rows = self.spark.read.schema(schema).parquet(*[f"{r}/frames" for r in runs])
        return rows.withColumn("run", _run_of_file()).join(chosen, ["image_id", "run"], "left_semi").drop("run")

    def add(self, px: DataFrame, cfa: DataFrame, key: str, **parameters) -> bool:
        """Develops the frames of ``px`` (image_id, version, y, x, v) that the key lacks; False where it lacks none."""
        images = px.select("image_id", "version").distinct()
        lacking = written(images.join(self.images(key), ["image_id", "version"], "left_anti"), "lacking")
        if lacking.isEmpty():
            return False
        run = f"{self.path}/{key}/{uuid.uuid4().hex}"
        develop_mosaic(px.join(lacking, ["image_id", "version"], "left_semi"), cfa, **parameters).write.parquet(f"{run}/frames")
        lacking.write.parquet(f"{run}/images")
        return True


def render_presets(px: DataFrame, cfa: DataFrame, presets: DataFrame, store: DevelopedStore, matrix: tuple[tuple[float, ...], ...]) -> tuple[DataFrame, list[str]]:
    """((preset_id, image_id, y, x, r, g, b) in 0..255 of every frame under every preset, keys that were developed by this call).

    ``px``: image_id, y, x, v and optionally version, a text that changes with the file; one version of an image at a time.
    ``presets``: preset_id and the columns DEVELOP and RENDER (a missing one counts as null: that stage is off; graded picks the log
    curve ``curve``, else V-Log, otherwise the display curve). Presets of one key share its frames, and those of one key and
    fringe repair the repaired ones; each pixel is read once for them. More than MOST_PRESETS presets are refused. No frames or no presets give no rows.
    """
    spark = px.sparkSession
    if "version" not in px.columns:
        px = px.withColumn("version", F.lit(""))
    for name in (*DEVELOP, *RENDER):
        if name not in presets.columns:
            presets = presets.withColumn(name, F.lit(None))
    rows = presets.withColumn("key", develop_key()).limit(MOST_PRESETS + 1).collect()
    if len(rows) > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    fresh, parts = [], []
    for key in sorted({r.key for r in rows}):
        own = sorted((r for r in rows if r.key == key), key=lambda r: r.preset_id)
        p = own[0]
        gains = (1.0 if p.gain_r is None else p.gain_r, 1.0, 1.0 if p.gain_b is None else p.gain_b)
        if store.add(px, cfa, key, ev=p.ev, impulse=p.impulse, dehaze_strength=p.dehaze, purple=p.purple, green=p.green, gains=gains):
            fresh.append(key)
        wanted = px.select("image_id", "version").distinct()
        shown = store.read(key, wanted).select(*PIXEL, *[F.expr(K.clamp(K.dot(w, RGB))).alias(c) for c, w in zip(RGB, matrix, strict=True)])
        for fringes in (False, True):
            asked = [r for r in own if bool(r.fringes) == fringes]
            if asked:
                parts.append(_encoded(_mended(shown) if fringes else shown, asked))
    if not parts:
        return spark.createDataFrame([], "preset_id long, image_id long, y int, x int, r int, g int, b int"), fresh
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, fresh


def _mended(px: DataFrame) -> DataFrame:
    for base, side in (("g", "r"), ("r", "g")):
        px = defringe_blue(px, base, side).select(*PIXEL, *RGB)
    return defringe_green(px).select(*PIXEL, *RGB)


def _encoded(px: DataFrame, presets: list) -> DataFrame:
    """Every pixel once for each preset: the curves that the presets name are computed once a pixel, and each preset takes its own."""
    curves = sorted({r.curve or "V-Log" for r in presets if r.graded})
    px = px.withColumns({f"boosted_{c}": F.expr(e) for c, e in zip(RGB, K.boost(RGB), strict=True)})
    byte = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 1e-9).cast("int")
    looks = {name: F.struct(*[byte(F.expr(K.log_encode(f"boosted_{c}", name))).alias(c) for c in RGB]) for name in curves}
    looks |= {"": F.struct(*[byte(F.expr(K.srgb(c))).alias(c) for c in RGB])}
    px = px.select(*PIXEL, *[look.alias(f"look_{k}") for k, look in enumerate(looks.values())])
    place = {name: f"look_{k}" for k, name in enumerate(looks)}
    each = F.array(*[F.struct(F.lit(r.preset_id).cast("long").alias("preset_id"), F.col(place[(r.curve or "V-Log") if r.graded else ""]).alias("look")) for r in presets])
    return px.select(*PIXEL, F.explode(each).alias("e")).select("e.preset_id", *PIXEL, "e.look.*")

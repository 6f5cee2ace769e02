"""Lattices from text files in the public .cube format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The points of every .cube file under ``path``; a file is one row until its lines are exploded."""
    return parse_cube(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value")


def parse_cube(texts: DataFrame, file: str, text: str) -> DataFrame:
    """(file, n, i, j, k, r, g, b) of the .cube texts in the column ``text``: n³ rows each, i for red, which runs fastest.

    n is at most 256 by the format. Comments and keywords other than LUT_3D_SIZE are passed over. A text without that
    keyword, or with another number of rows than n³, gives no rows.
    """
    files = texts.select(F.col(file).alias("file"), F.split(text, r"\r?\n").alias("lines"))
    n = F.regexp_extract(F.array_join("lines", "\n"), r"(?m)^\s*LUT_3D_SIZE\s+(\d+)", 1)
    points = F.filter(F.transform("lines", lambda s: F.trim(s)), lambda s: s.rlike(r"^[-+.\d]"))
    files = files.select("file", n.try_cast("int").alias("n"), points.alias("points"))
    rows = files.where(F.size("points") == F.col("n") * F.col("n") * F.col("n")).select("file", "n", F.posexplode("points").alias("at", "line"))
    parts = F.split("line", r"\s+")
    size = F.col("n")
    return rows.select(
        "file", "n", (F.col("at") % size).alias("i"), (F.floor(F.col("at") / size) % size).cast("int").alias("j"), F.floor(F.col("at") / (size * size)).cast("int").alias("k"),
        *[parts[c].cast("double").alias(name) for c, name in enumerate(("r", "g", "b"))],
    )

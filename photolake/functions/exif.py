"""Texts from tags and file names, and the routing of a file by its sniffed verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of the orientation tag.
ORIENTATIONS = {2: "Mirrored", 3: "Rotated 180", 4: "Flipped", 5: "Transposed", 6: "Rotated 90", 7: "Transversed", 8: "Rotated 270"}


def split_tail(name: Column) -> tuple[Column, Column]:
    """Head and extension with its dot; without a dot the last four characters are the tail."""
    dotted = F.contains(name, F.lit("."))
    head = F.when(dotted, F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)).otherwise(F.substring(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0))))
    return head, F.when(dotted, F.regexp_extract(name, r"(\.[^.]*)$", 1)).otherwise(F.right(name, F.lit(4)))


def middle_truncate(name: Column, width: int) -> Column:
    """At most ``width`` characters: the tail whole, the head cut, an ellipsis between."""
    head, tail = split_tail(name)
    room = F.greatest(F.lit(width - 1) - F.length(tail), F.lit(0))
    return F.when(F.length(name) <= width, name).otherwise(F.concat(F.substring(head, F.lit(1), room), F.lit("…"), tail))


def texts(tags: DataFrame) -> DataFrame:
    s = F.col("exposure_s")
    whole = lambda c: F.round(c).cast("long").cast("string")
    trimmed = lambda c: F.coalesce(F.trim(c), F.lit(""))
    orientation = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ORIENTATIONS.items() for x in kv]), F.col("orientation")), F.lit("Normal"))
    return tags.select(
        "image_id", F.when(s >= 1, F.concat(whole(s), F.lit("s"))).when(s > 0, F.concat(F.lit("1/"), whole(1 / s), F.lit(" s"))).alias("exposure"),
        orientation.alias("orientation"), F.date_format(F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd HH:mm").alias("taken"),
        (F.col("flash").bitwiseAND(1) == 1).alias("flash"), F.coalesce("iso_a", "iso_b").alias("iso"),
        F.nullif(F.trim(F.concat(trimmed("make"), F.lit(" "), trimmed("model"))), F.lit("")).alias("camera"),
        F.format_string("%d:%02d", F.floor(F.col("seconds") / 60), F.col("seconds") % 60).alias("duration"), F.format_string("%.5f, %.5f", "lat", "lon").alias("geo"),
    )


def route(raw_ok: str, raw_format: str, coil_ok: str, coil_format: str) -> Column:
    """RawToRaster where the raw decoder can, else ToCoil where the platform can, else Unsupported."""
    raw = F.concat(F.lit("RawToRaster:"), F.coalesce(raw_format, F.lit("raw")))
    coil = F.concat(F.lit("ToCoil:"), F.coalesce(coil_format, F.lit("application/octet-stream")))
    return F.when(F.col(raw_ok), raw).when(F.col(coil_ok), coil).otherwise("Unsupported")

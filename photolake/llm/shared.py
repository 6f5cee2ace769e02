"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is missing (local tests) a temporary folder is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="spark-photolake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/photolake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables of ``written`` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if path is not None and path.getParent().getName() == "photolake":
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A bitmap row holds 32,768 bits (4 KB); at most 2**29 bits (64 MB) are broadcast.
_ROW_BITS, _MOST_BITS = 1 << 15, 1 << 29


def key_bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """Hashed bitmap (row_, bitmap_) of the long column ``key`` and its number of bits: about 16 for each key, 2**29 at most.

    The bits are set by an aggregation, so only the bitmap, whose size is bounded, is ever in one place.
    """
    bits = _ROW_BITS
    n = keys.count()
    while bits < min(16 * n, _MOST_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64("key"), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("row_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap_")), bits


def marked(df: DataFrame, key: str, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """``df`` with ``hit_``: false where ``key`` is null or surely not among the keys of the bitmap. Few other rows hit by chance.

    ``df`` has no columns row_, bitmap_ or hit_. A row that hits is for an exact join to decide; the filter only spares
    the others the shuffle.
    """
    table, bits = bitmap
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bit_position(place)
    bit = F.expr("getbit(cast(conv(hex(substring(bitmap_, cast(at_ div 8 as int) + 1, 1)), 16, 10) as int), cast(at_ % 8 as int)) = 1")
    named = df.withColumn("row_", F.when(F.col(key).isNotNull(), F.bitmap_bucket_number(place))).withColumn("at_", at)
    return named.join(F.broadcast(table), "row_", "left").withColumn("hit_", F.coalesce(bit, F.lit(False))).select(*df.columns, "hit_")


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its freed memory back to the system at its end: Python workers are used again, and
    what one operator's arrays took would otherwise stay with the process beside the next one's."""

    @functools.wraps(run)
    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries need none
        if trim:
            trim(0)

    return freed


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of a column's text modulo ``n``: the fold a row belongs to."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n

"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Shuffle files go when the write that read them is done; else they stay until the driver collects garbage, and a walk's rounds pile up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What Spark merges shuffle partitions to in a write, in bytes, and into how many it cuts them at first. A task's memory follows the first
#: (each sort and hash table holds its partition, several times as large as it is packed), so it is less than Spark's 64 MB; the second
#: grows with the rows, for partitions are merged but a full one is not cut.
ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PART_BYTES, PART_ROWS, MOST_PARTS = 16 << 20, 200_000, 5_000
#: What a task of a write reads of files, in bytes, where the session allows more: Spark's 128 MB packed are several times as much in the
#: hash table of an aggregation, which the task holds before its shuffle.
SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 32 << 20
#: Bytes of a file that count as a row where rows are not known: two packed keys.
ROW_BYTES = 8


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is not set and all tasks run on this machine, a new temporary folder that is set there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="spark-photolake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _bytes(text: str) -> int:
    """A size as Spark writes it: 134217728b, 16m, 1g."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def rows_read(*tables: DataFrame) -> int:
    """About how many rows the plans of the tables read, told by the sizes of their files: ``rows`` of a first write. 0 without files."""
    files = sorted({f for df in tables for f in df.inputFiles()})
    if not files:
        return 0
    # of binary files the listing alone is read, whatever their format
    return (tables[0].sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0) // ROW_BYTES


def small_tasks(spark: SparkSession, rows: int = 0):
    """While this lasts a write deals its work to tasks whose memory does not follow the tables' size; ``rows`` as in ``written``."""
    settings = {CLEANUP: "true", ADVISORY: str(PART_BYTES), SPLIT: str(min(_bytes(spark.conf.get(SPLIT)), SPLIT_BYTES))}
    parts = min(rows // PART_ROWS, MOST_PARTS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        settings[INITIAL] = str(parts)
    return _set(spark, settings)


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """``df`` written once as Parquet and read again: the lineage ends here, and a lost executor costs no recomputation.

    ``rows`` says how many rows about its largest shuffle moves; the more, the more partitions that is cut into. Without it these
    are the session's number, however large the tables: for small ones, or where nothing is shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/photolake/{name}-{uuid.uuid4().hex}"
    with small_tasks(spark, rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if folder.getParent().getName() == "photolake":
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

"""First bytes of files: a data source whose tasks open a file, read a mebibyte at most and close it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

#: Bytes of a file that tell its kind.
HEADER = 1 << 20
#: Files that a task reads, and bytes that it holds at a time.
FILES, HELD = 256, 4 << 20

COLUMNS = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("header", pa.binary())])
_TESTS = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: a in b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it: a local path, or a URI of a store that Arrow opens (file, hdfs, s3, gs, abfs)."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files  # path, length, time of change in microseconds


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.tests: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  the interface's name
        """Conditions on path and length are checked on the listing, so that other files are never opened."""
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("length",)):
                self.tests.append((f.attribute[0], _TESTS[type(f)], f.value))
            elif not (type(f) is IsNotNull and f.attribute in (("path",), ("length",))):  # neither is ever null
                yield f

    def partitions(self) -> list[Files]:
        fs, root = located(self.path)
        info = fs.get_file_info(root)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        files = []
        for f in found:
            if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
                seen = {"path": f.path, "length": f.size}
                if all(test(seen[name], value) for name, test, value in self.tests):
                    files.append((f.path, f.size, (f.mtime_ns or 0) // 1000))
        files.sort()
        return [Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.path)
        rows: list[tuple] = []
        held = 0
        for path, length, changed in partition.files:
            with fs.open_input_file(path) as f:
                head = f.read(min(self.most, length))
            rows.append((path, changed, length, head))
            held += len(head)
            if held >= HELD:
                yield self._batch(rows)
                rows, held = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(COLUMNS)], schema=COLUMNS)


class Headers(DataSource):
    """``spark.read.format("file_headers").option("most", bytes).load(path)``: path, modificationTime, length, header of every file under a path.

    Names that begin with a dot or an underscore are passed over. The listing is made by the driver, as by Spark's own
    file sources.
    """

    @classmethod
    def name(cls) -> str:
        return "file_headers"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length bigint, header binary"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"], int(self.options.get("most", HEADER)))


def read_headers(spark: SparkSession, path: str, most: int = HEADER, largest: int | None = None) -> DataFrame:
    """(path, modificationTime, length, header) of the files under ``path``, of at most ``largest`` bytes where that is given.

    At most the first ``most`` bytes of a file are read, whatever its length; a task holds HELD bytes and one header at a
    time. Conditions on path and length reach the listing. An empty folder gives no rows.
    """
    spark.dataSource.register(Headers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("file_headers").option("most", most).load(path)
    return files if largest is None else files.where(F.col("length") <= largest)


def write_files(rows: DataFrame, folder: str) -> None:
    """A file of ``content`` (binary) under each ``name`` in the folder; a name that comes again is written again.

    A task that is repeated writes the same files, so a lost executor leaves none half written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = located(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()

"""Structured Streaming jobs: picks imported into a versioned catalogue, its live listing, the recent list of each user."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from photolake.operators.catalogue import distinct_picks, import_changes, link_changes, live
from photolake.sources.scratch import shared_dir, written
from photolake.sources.snapshots import Snapshot, Snapshots

#: The state of a query lies in RocksDB on the executors' disks and goes to the checkpoint as changes.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows about of a file that a stream reads; folders up to which the edges under them are picked out by a list sent to all tasks.
FILE_ROWS, FEW = 50_000, 500_000


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/photolake/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is available now into a Parquet folder and reads it. One table for each micro-batch, with its number."""
    spark = stream.sparkSession
    path = folder(spark, f"stream-{name}")

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/number={number}")

    run(stream, mode, put, f"{path}/state")
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out").drop("number")


def run(stream: DataFrame, mode: str, put, checkpoint: str) -> None:
    """One pass over all that is available now, its state in RocksDB."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def arrivals(events: DataFrame, name: str, by: str, parts: int = 4) -> DataFrame:
    """The events as a file stream of about ``parts`` micro-batches in the order of ``by``, from parts written one after the other.

    Each part has the same number of files, and so has a micro-batch: it is one part, which many tasks write and read. The
    smallest part tells the number, so that no file stays empty and is left out. Events without a value of ``by`` come first.
    """
    spark, path = events.sparkSession, folder(events.sparkSession, f"arrivals-{name}")
    edges = sorted(set(events.stat.approxQuantile(by, [k / parts for k in range(1, parts)], 0.01)))
    after = lambda edge: F.coalesce(F.col(by) > edge, F.lit(False))
    beyond = events.agg(F.count(F.lit(1)), *[F.count_if(after(e)) for e in edges]).first()
    sizes = [a - b for a, b in zip(beyond, [*beyond[1:], 0], strict=True)]
    files = max(1, min([n for n in sizes if n], default=0) // FILE_ROWS)
    for low, high, size in zip([None, *edges], [*edges, None], sizes, strict=True):
        if size or low is None:
            part = events if low is None else events.where(F.col(by) > low)
            part = part if high is None else part.where((F.col(by) <= high) | (F.col(by).isNull() if low is None else F.lit(False)))
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def under(parents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Picks out the edges under the parents (parent) where these are few; else keeps all, and a join must do it."""
    keys = written(parents.select(F.col("parent").alias("fs_node_id_parent")).distinct(), "parents")
    return (lambda rows: rows.join(F.broadcast(keys), "fs_node_id_parent", "left_semi").select(*rows.columns)) if keys.count() <= FEW else lambda rows: rows


def import_batch(catalogue: Snapshots, picks: DataFrame, number: int, stream: str = "import") -> Snapshot:
    """One batch of picks (uri_storage, name_display, type_mime, picked, parent) in the catalogue: nodes and edges in one version.

    A new URI becomes a node, a dead one is revived, and each is linked under its parent; what is there stays. The batch's
    number is committed with it, so a batch that is sent again after a failure changes nothing. A pick may come however
    late: what is known of a URI is the table, not a state with a horizon. Only changed rows are written, and of the edges
    only those under the picks' parents meet them.
    """
    picks = written(distinct_picks(picks), "picks")  # small beside the tables, and of a known size to the planner
    near = under(picks)

    def change(now: Snapshot) -> dict[str, DataFrame]:
        changed, placed = import_changes(now.read("nodes"), picks)
        pairs = written(placed.join(picks, "uri_storage").select(F.col("fs_node_id").alias("child"), "parent"), "pairs")
        return {"nodes": changed, "edges": link_changes(now.read("edges", near), pairs)}

    return catalogue.update(change, (stream, number))


def listing(catalogue: Snapshot, parents: DataFrame) -> DataFrame:
    """(parent, fs_node_id, name_display, uri_storage, time_created): the live children of the given parents (parent)."""
    links = live(catalogue.read("edges", under(parents))).select(F.col("fs_node_id_parent").alias("parent"), F.col("fs_node_id_child").alias("fs_node_id"))
    inside = links.join(parents.select("parent").distinct(), "parent", "left_semi")
    return inside.join(live(catalogue.read("nodes")), "fs_node_id").select("parent", "fs_node_id", "name_display", "uri_storage", "time_created")


def import_stream(catalogue: Snapshots, picks: DataFrame, checkpoint: str, listings: str | None = None) -> None:
    """Imports a stream of picks batch by batch, see ``import_batch``.

    With ``listings`` the listing of each parent that a batch touched is sent again after it, to the folder batch=N under
    that path; a batch that is sent again replaces its own.
    """

    def put(rows: DataFrame, number: int) -> None:
        rows = written(distinct_picks(rows), "batch")
        now = import_batch(catalogue, rows, number)
        if listings:
            listing(now, rows).withColumn("version", F.lit(now.version)).write.mode("overwrite").parquet(f"{listings}/batch={number}")

    run(picks, "append", put, checkpoint)


class Recent(StatefulProcessor):
    """The list of a user, newest first, each item once, at most ``cap``: a list in the state store, kept however long the user is idle.

    An item that has left the list returns only by a newer use, so nothing but the list need be kept.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = StructType([StructField("item", StringType()), StructField("used", LongType())])
        self.kept = handle.getListState("recent", kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        last = {item: used for item, used in self.kept.get()}
        before = dict(last)
        for part in rows:
            for item, used in part.groupby("item", dropna=False).used.max().items():
                item = item if isinstance(item, str) else None
                last[item] = max(last.get(item, used), int(used))
        top = sorted(last, key=lambda i: (-last[i], i is None, i or ""))[: self.cap]
        if list(before.items()) != [(i, last[i]) for i in top]:
            self.kept.put([(i, last[i]) for i in top])
        yield pd.DataFrame({"user_id": [key[0]], "items": [top]})

    def close(self) -> None:
        pass


def recent_stream(events: DataFrame, cap: int) -> DataFrame:
    """(user_id, items): the user's recent list after each batch that uses something, see ``Recent``. Events without a time count as oldest."""
    used = events.select("user_id", "item", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62))).alias("used"))
    kind = StructType([StructField("user_id", events.schema["user_id"].dataType), StructField("items", ArrayType(StringType()))])
    return used.groupBy("user_id").transformWithStateInPandas(Recent(cap), kind, "Update", "None")

"""Writers: the catalogue's tables, to which rows are appended once, and rendered tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.operators.catalogue import with_row_numbers
from photolake.sources.snapshots import Snapshot, Snapshots


def append_nodes(catalogue: Snapshots, new: DataFrame, by: str = "uri_storage", table: str = "nodes") -> Snapshot:
    """Append ``new`` (the columns of a node but its id) to the catalogue's node table, and return the version that holds them.

    Of rows that repeat ``by`` one is added, of those that the table has none. Ids go on from the largest of the table, in
    the order of ``by``. Rows without ``by`` are not added. Writers may run side by side: one whose version is taken
    numbers anew from what the other left. A failed append leaves the table as it was.
    """

    def change(now: Snapshot) -> dict[str, DataFrame]:
        rows = now.read(table)
        fresh = new.where(F.col(by).isNotNull()).dropDuplicates([by]).join(rows.where(F.col(by).isNotNull()).select(by), by, "left_anti")
        top = rows.agg(F.coalesce(F.max("fs_node_id"), F.lit(0))).first()[0]
        return {table: with_row_numbers(fresh, by).withColumn("fs_node_id", F.lit(top) + F.col("row_number")).select(*rows.columns)}

    return catalogue.update(change)


def append_edges(catalogue: Snapshots, new: DataFrame, table: str = "edges") -> Snapshot:
    """Append the edges of ``new`` that the catalogue lacks by (child, parent); repeated ones once. As safe as ``append_nodes``."""
    key = ["fs_node_id_child", "fs_node_id_parent"]

    def change(now: Snapshot) -> dict[str, DataFrame]:
        rows = now.read(table)
        return {table: new.dropDuplicates(key).join(rows.select(*key), key, "left_anti").select(*rows.columns)}

    return catalogue.update(change)


def write_tiles(tiles: DataFrame, path: str, preset: str = "preset", by: str = "image_id") -> None:
    """Tiles as Parquet, a folder for each preset, sorted by image within a file so that one image is few row groups.

    Presets are few by nature; images are not, so that they make no folders.
    """
    tiles.repartition(preset, by).sortWithinPartitions(preset, by).write.partitionBy(preset).parquet(path)

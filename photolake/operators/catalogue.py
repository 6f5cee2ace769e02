"""The photo catalogue as two tables, nodes and many-to-many edges: listings, searches, sets, merges.

``time_deleted`` null means live. Every operator takes DataFrames and returns one; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photolake.sources.scratch import discard, rows_read, written

ROOT, FOLDER = "application/folder-root", "application/folder"


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("time_deleted").isNull())


def file_entries(nodes: DataFrame) -> DataFrame:
    """Live nodes that are neither folder nor root."""
    return live(nodes).where(~F.col("type_mime").isin(ROOT, FOLDER))


def collections_by_name(nodes: DataFrame) -> DataFrame:
    return live(nodes).where(F.col("type_mime") == FOLDER).orderBy("name_display", "fs_node_id")


def deletable_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids whose node exists and is not the root."""
    return ids.distinct().join(nodes.where(F.col("type_mime") != ROOT), "fs_node_id", "left_semi")


def is_media(mime: Column) -> Column:
    return mime.startswith("image/") | mime.startswith("video/")


def mime_class(mime: Column) -> Column:
    return (
        F.when(mime == ROOT, "root").when(mime == FOLDER, "folder").when(mime.startswith("image/"), "image")
        .when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").otherwise("file")
    )


def children_of(nodes: DataFrame, edges: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Live children through live edges, with their parent; of all parents, or of those in ``parents`` (fs_node_id)."""
    links = live(edges).select(F.col("fs_node_id_parent").alias("parent"), F.col("fs_node_id_child").alias("fs_node_id"))
    if parents is not None:
        links = links.join(parents.select(F.col("fs_node_id").alias("parent")).distinct(), "parent", "left_semi")
    return links.join(live(nodes), "fs_node_id")


def parents_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live parents of each child through live edges."""
    links = live(edges).select(F.col("fs_node_id_child").alias("child"), F.col("fs_node_id_parent").alias("fs_node_id"))
    return links.join(live(nodes), "fs_node_id")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live nodes other than the root without a live edge to a live parent."""
    parents = live(nodes).select(F.col("fs_node_id").alias("fs_node_id_parent"))
    held = live(edges).join(parents, "fs_node_id_parent", "left_semi").select(F.col("fs_node_id_child").alias("fs_node_id"))
    return live(nodes).where(F.col("type_mime") != ROOT).join(held, "fs_node_id", "left_anti")


def orphan_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fs_node_id of ``orphan_nodes``, written: the joins run in partitions whose size does not follow the tables'.

    The nodes are written before, for Spark asks each part of a union for its orphans, all parts in one task.
    """
    links = written(live(edges), "edges", rows_read(edges))
    alive = written(live(nodes).select("fs_node_id", "type_mime", "time_deleted"), "alive", rows_read(nodes))
    out = written(orphan_nodes(alive, links).select("fs_node_id"), "orphans", links.count() + alive.count())
    discard(links, alive)
    return out


def reconcile_targets(nodes: DataFrame, edges: DataFrame, missing: DataFrame) -> DataFrame:
    """fs_node_id of the missing files and of the orphans, each once, written like ``orphan_ids``."""
    orphans = orphan_ids(nodes, edges)
    out = written(missing.select("fs_node_id").unionByName(orphans).distinct(), "targets", nodes.count())
    discard(orphans)
    return out


def dead_parent_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live edges whose parent is null, missing or dead."""
    return live(edges).join(live(nodes).select(F.col("fs_node_id").alias("fs_node_id_parent")), "fs_node_id_parent", "left_anti").select(*edges.columns)


def missing_files(nodes: DataFrame, listing: DataFrame) -> DataFrame:
    """File entries whose URI is not in the listing (uri)."""
    return file_entries(nodes).join(listing.select(F.col("uri").alias("uri_storage")).distinct(), "uri_storage", "left_anti")


def viewer_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Media of each folder in listing order, with place, previous and next item.

    The rows are dealt to ranges of (folder, order), so a folder of any size splits: places and neighbours are found in a range,
    and what the ranges before and after it hold of the same folder is added from one row for each range and folder end.
    """
    media = children_of(nodes, edges).where(is_media(F.col("type_mime")))
    order = ["parent", F.desc("time_created"), "name_display", "fs_node_id"]
    dealt = written(media.select("parent", "time_created", "name_display", "fs_node_id").repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("range_", "parent").orderBy(*order[1:])
    rows = dealt.withColumns({"at": F.row_number().over(own) - 1, "previous": F.lag("fs_node_id").over(own), "next": F.lead("fs_node_id").over(own)})
    # a folder that spans ranges has an end in each: so few rows that the ranges of one folder are ordered together
    ends = rows.groupBy("parent", "range_").agg(F.count(F.lit(1)).alias("n"), F.min_by("fs_node_id", "at").alias("head"), F.max_by("fs_node_id", "at").alias("tail"))
    over = Window.partitionBy("parent").orderBy("range_")
    ends = ends.select("parent", "range_", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("tail").over(over).alias("tail"), F.lead("head").over(over).alias("head"))
    ends = ends.where("before > 0 OR head IS NOT NULL")
    out = rows.join(ends, ["parent", "range_"], "left")
    place = (F.col("at") + F.coalesce("before", F.lit(0))).alias("place")
    return out.select("parent", "fs_node_id", place, F.coalesce("previous", F.col("tail")).alias("previous"), F.coalesce("next", F.col("head")).alias("next"))


def recent_list(events: DataFrame, cap: int = 60) -> DataFrame:
    """Most recently used items of each user, newest first, each once, at most ``cap``."""
    last = events.groupBy("user_id", "item").agg(F.max("ts").alias("ts"))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "item")
    return last.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def batch_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(batch, parent, fs_node_id): in each delete batch the parent of each node of the same batch, -1 where none is. The last edge wins.

    A row a child, so that a parent of any number of children is no single value; a tree's order is that of the rows.
    """
    dead = nodes.where(F.col("time_deleted").isNotNull()).select(F.col("time_deleted").alias("batch"), "fs_node_id")
    links = edges.select(F.col("fs_node_id_child").alias("fs_node_id"), F.col("fs_node_id_parent").alias("parent"), "id")
    inside = dead.join(links, "fs_node_id").join(dead.select("batch", F.col("fs_node_id").alias("parent")), ["batch", "parent"], "left_semi")
    best = inside.groupBy("batch", "fs_node_id").agg(F.max_by("parent", "id").alias("parent"))
    return dead.join(best, ["batch", "fs_node_id"], "left").select("batch", F.coalesce("parent", F.lit(-1)).alias("parent"), "fs_node_id")


def toggled(selection: DataFrame, ids: DataFrame) -> DataFrame:
    """Symmetric difference of two id sets."""
    return selection.subtract(ids).unionByName(ids.subtract(selection))


def _first_picks(picks: DataFrame) -> DataFrame:
    """(uri_storage, new_name, new_mime, picked): of a URI's repeated picks the first by ``picked``."""
    row = F.struct("picked", F.col("name_display").alias("new_name"), F.col("type_mime").alias("new_mime"))
    first = picks.where(F.col("uri_storage").isNotNull()).groupBy("uri_storage").agg(F.min(row).alias("first"))
    return first.select("uri_storage", "first.new_name", "first.new_mime", "first.picked")


def _added(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """First picks that no node has as new nodes, numbered by URI on top of the largest id."""
    numbered = with_row_numbers(fresh, "uri_storage").crossJoin(F.broadcast(nodes.agg(F.coalesce(F.max("fs_node_id"), F.lit(0)).alias("top"))))
    return numbered.select(
        (F.col("top") + F.col("row_number")).alias("fs_node_id"), F.col("new_name").alias("name_display"), F.col("new_mime").alias("type_mime"), "uri_storage",
        F.lit(None).cast("long").alias("time_modified"), F.col("picked").alias("time_created"), F.lit(None).cast("long").alias("time_deleted"),
    )


def import_merge(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """The node table after an import of picks (uri_storage, name_display, type_mime, picked).

    A new URI is inserted with the next ids, a dead one revived under its new name and MIME, a live one untouched. Of a
    URI's repeated picks the first by ``picked`` counts. New ids are numbered by URI on top of the largest id.
    """
    new = _first_picks(picks)
    known = nodes.join(new, "uri_storage", "left").withColumn("revive", F.col("time_deleted").isNotNull() & F.col("picked").isNotNull())
    kept = known.select(
        "fs_node_id", F.when(F.col("revive"), F.col("new_name")).otherwise(F.col("name_display")).alias("name_display"),
        F.when(F.col("revive"), F.col("new_mime")).otherwise(F.col("type_mime")).alias("type_mime"), "uri_storage", "time_modified", "time_created",
        F.when(~F.col("revive"), F.col("time_deleted")).alias("time_deleted"),
    )
    return kept.unionByName(_added(nodes, new.join(nodes.where(F.col("uri_storage").isNotNull()), "uri_storage", "left_anti")))


def distinct_picks(picks: DataFrame) -> DataFrame:
    """Of the picks (uri_storage, name_display, type_mime, picked, parent) of a URI under a parent the first: all that an import asks of them."""
    first = picks.groupBy("uri_storage", "parent").agg(F.min(F.struct("picked", "name_display", "type_mime")).alias("first"))
    return first.select("uri_storage", "first.name_display", "first.type_mime", "first.picked", "parent")


def import_changes(nodes: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``import_merge`` the added and revived rows alone: what a table that keeps changes beside its rows has to write.

    Beside them (fs_node_id, uri_storage) of every node that then has a picked URI. The nodes meet the first picks once, and
    what they leave is written: all that follows is as small as the picks.
    """
    new = written(_first_picks(picks), "first")
    met = written(nodes.join(new, "uri_storage"), "met")
    revived = met.where(F.col("time_deleted").isNotNull()).select(
        "fs_node_id", F.col("new_name").alias("name_display"), F.col("new_mime").alias("type_mime"), "uri_storage", "time_modified", "time_created", F.lit(None).cast("long").alias("time_deleted")
    )
    added = written(_added(nodes, new.join(met, "uri_storage", "left_anti")), "added")
    placed = met.select("fs_node_id", "uri_storage").unionByName(added.select("fs_node_id", "uri_storage"))
    return revived.unionByName(added), placed


def with_row_numbers(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with row_number 1.. in the order of ``by`` without a global window: ranks inside ranges plus offsets.

    The rows are dealt to ranges once and written with their range, so that both branches see the same deal. The offsets
    table has one row for each range. ``by`` must be unique. Columns may have any name but row_number (``ValueError``).
    """
    if "row_number" in rows.columns:
        raise ValueError("there is a column row_number")
    packed = rows.select(F.struct("*").alias("row_"), F.col(by).alias("by_"))
    dealt = written(packed.repartitionByRange("by_").withColumn("part_", F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("by_").alias("low_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("low_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("part_").orderBy("by_"))
    return dealt.withColumn("own_", own).join(F.broadcast(before), "part_").select("row_.*", (F.col("own_") + F.col("before_")).alias("row_number"))


def link_merge(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges after linking the pairs (child, parent): a dead edge is revived, a missing one added, a live one kept."""
    pairs = pairs.select(F.col("child").alias("fs_node_id_child"), F.col("parent").alias("fs_node_id_parent")).distinct().withColumn("asked", F.lit(True))
    both = edges.join(pairs, ["fs_node_id_child", "fs_node_id_parent"], "full_outer")
    new_id = F.col("fs_node_id_child") * 10000000 + F.col("fs_node_id_parent")
    return both.select(F.coalesce("id", new_id).alias("id"), "fs_node_id_child", "fs_node_id_parent", F.when(F.col("asked").isNull(), F.col("time_deleted")).alias("time_deleted"))


def link_changes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``link_merge`` the added and revived edges alone."""
    pairs = pairs.select(F.col("child").alias("fs_node_id_child"), F.col("parent").alias("fs_node_id_parent")).distinct()
    both = pairs.join(edges, ["fs_node_id_child", "fs_node_id_parent"], "left").where("id IS NULL OR time_deleted IS NOT NULL")
    new_id = F.col("fs_node_id_child") * 10000000 + F.col("fs_node_id_parent")
    return both.select(F.coalesce("id", new_id).alias("id"), "fs_node_id_child", "fs_node_id_parent", F.lit(None).cast("long").alias("time_deleted"))


def restore_batches(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Nodes or edges with the stamps of the given batches (time_deleted) cleared."""
    hit = batches.select("time_deleted").distinct().withColumn("hit", F.lit(True))
    out = rows.join(hit, "time_deleted", "left").withColumn("time_deleted", F.when(F.col("hit").isNull(), F.col("time_deleted")))
    return out.select(*rows.columns)


def sweep_dead_edges(nodes: DataFrame, edges: DataFrame, at: int) -> DataFrame:
    """Edges with ``at`` stamped on the live ones whose parent is not live."""
    parents = live(nodes).select(F.col("fs_node_id").alias("fs_node_id_parent"), F.lit(True).alias("has"))
    stamp = F.when(F.col("time_deleted").isNull() & F.col("has").isNull(), F.lit(at).cast("long")).otherwise(F.col("time_deleted"))
    return edges.join(parents, "fs_node_id_parent", "left").withColumn("time_deleted", stamp).select(*edges.columns)


def ensure_root(nodes: DataFrame) -> DataFrame:
    """Nodes with the root added where it is missing."""
    root = nodes.sparkSession.range(1).select(*[
        F.lit({"fs_node_id": 0, "name_display": "Library", "type_mime": ROOT, "time_created": 0}.get(f.name)).cast(f.dataType).alias(f.name) for f in nodes.schema
    ])
    return nodes.unionByName(root.join(nodes.where(F.col("fs_node_id") == 0).select("fs_node_id"), "fs_node_id", "left_anti").select(*nodes.columns))

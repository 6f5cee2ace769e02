"""Catalogue queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import exif
from photolake.operators import catalogue as C
from photolake.operators import graph as G

from .registry import query

NODE = "fs_node_id, name_display, type_mime, uri_storage, time_modified, time_created, time_deleted"
LIVE_CHILD = "fx_edge e JOIN fx_node n ON n.fs_node_id = e.fs_node_id_child AND e.time_deleted IS NULL AND n.time_deleted IS NULL"
FILES = "time_deleted IS NULL AND type_mime NOT IN ('application/folder-root', 'application/folder')"
ORPHAN = "SELECT fs_node_id FROM fx_node n WHERE n.time_deleted IS NULL AND type_mime <> 'application/folder-root' AND NOT EXISTS (SELECT 1 FROM fx_edge e JOIN fx_node p ON p.fs_node_id = e.fs_node_id_parent WHERE e.fs_node_id_child = n.fs_node_id AND e.time_deleted IS NULL AND p.time_deleted IS NULL)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_node")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_edge")


def ids(spark: SparkSession, d: str, condition: str) -> DataFrame:
    return nodes(spark, d).where(condition).select("fs_node_id")


@query(f"SELECT e.fs_node_id_parent AS folder, count(*) AS files, max(n.time_created) AS latest FROM {LIVE_CHILD} WHERE n.type_mime NOT IN ('application/folder-root', 'application/folder') GROUP BY 1")
def folder_summary(spark, d):
    """Files under each folder and the latest creation time."""
    files = C.children_of(nodes(spark, d), edges(spark, d)).where(~F.col("type_mime").isin(C.ROOT, C.FOLDER))
    return files.groupBy(F.col("parent").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.max("time_created").alias("latest"))


@query(f"SELECT {NODE} FROM fx_node WHERE fs_node_id = 10000037")
def scan_node_by_id(spark, d):
    return nodes(spark, d).where("fs_node_id = 10000037")


@query("SELECT * FROM fx_edge WHERE fs_node_id_child = 10000037 OR fs_node_id_parent = 101")
def scan_edges(spark, d):
    return edges(spark, d).where("fs_node_id_child = 10000037 OR fs_node_id_parent = 101")


@query("SELECT fs_node_id, sha256(concat(uri_storage, '|', CAST(coalesce(time_modified, -1) AS VARCHAR))) AS source_key FROM fx_node WHERE uri_storage IS NOT NULL")
def source_fingerprint(spark, d):
    n = nodes(spark, d).where("uri_storage IS NOT NULL")
    return n.select("fs_node_id", F.sha2(F.concat_ws("|", "uri_storage", F.coalesce("time_modified", F.lit(-1))), 256).alias("source_key"))


@query(f"SELECT {NODE} FROM fx_node WHERE time_deleted IS NULL")
def live_nodes(spark, d):
    return C.live(nodes(spark, d))


@query(f"SELECT {NODE} FROM fx_node WHERE {FILES}")
def file_entries(spark, d):
    return C.file_entries(nodes(spark, d))


@query("SELECT fs_node_id, name_display FROM fx_node WHERE time_deleted IS NULL AND type_mime = 'application/folder' ORDER BY name_display, fs_node_id")
def collections_by_name(spark, d):
    return C.collections_by_name(nodes(spark, d)).select("fs_node_id", "name_display")


@query("SELECT fs_node_id FROM fx_node WHERE type_mime <> 'application/folder-root'")
def deletable_ids(spark, d):
    """Of all nodes those that may be deleted."""
    return C.deletable_ids(nodes(spark, d), nodes(spark, d).select("fs_node_id"))


@query(f"SELECT {NODE} FROM fx_node WHERE time_deleted = 9003 ORDER BY name_display, fs_node_id")
def batch_nodes(spark, d):
    return nodes(spark, d).where("time_deleted = 9003").orderBy("name_display", "fs_node_id")


@query("SELECT * FROM fx_edge WHERE time_deleted = 9002")
def batch_edges(spark, d):
    return edges(spark, d).where("time_deleted = 9002")


@query("SELECT fs_node_id, type_mime FROM fx_node WHERE type_mime LIKE 'image/%' OR type_mime LIKE 'video/%'")
def media_only(spark, d):
    return nodes(spark, d).where(C.is_media(F.col("type_mime"))).select("fs_node_id", "type_mime")


@query("SELECT fs_node_id, CASE WHEN type_mime = 'application/folder-root' THEN 'root' WHEN type_mime = 'application/folder' THEN 'folder' WHEN starts_with(type_mime, 'image/') THEN 'image' WHEN starts_with(type_mime, 'video/') THEN 'video' WHEN starts_with(type_mime, 'audio/') THEN 'audio' ELSE 'file' END AS icon FROM fx_node")
def mime_class(spark, d):
    return nodes(spark, d).select("fs_node_id", C.mime_class(F.col("type_mime")).alias("icon"))


@query(f"SELECT e.fs_node_id_parent AS parent, n.fs_node_id, n.name_display, n.time_created FROM {LIVE_CHILD} ORDER BY 1, 4 DESC, 3")
def children_of(spark, d):
    return C.children_of(nodes(spark, d), edges(spark, d)).select("parent", "fs_node_id", "name_display", "time_created").orderBy("parent", F.desc("time_created"), "name_display")


@query("SELECT e.fs_node_id_child AS child, n.fs_node_id, n.name_display FROM fx_edge e JOIN fx_node n ON n.fs_node_id = e.fs_node_id_parent AND e.time_deleted IS NULL AND n.time_deleted IS NULL")
def parents_of(spark, d):
    return C.parents_of(nodes(spark, d), edges(spark, d)).select("child", "fs_node_id", "name_display")


@query("SELECT * FROM fx_edge WHERE fs_node_id_parent = 101 AND fs_node_id_child = 1000001 AND time_deleted IS NULL")
def get_relation(spark, d):
    return C.live(edges(spark, d)).where("fs_node_id_parent = 101 AND fs_node_id_child = 1000001")


@query("SELECT e.* FROM fx_edge e JOIN fx_node p ON p.fs_node_id = e.fs_node_id_parent AND p.time_deleted = e.time_deleted")
def batch_children_of(spark, d):
    """Edges stamped with the batch of their dead parent."""
    dead = nodes(spark, d).where("time_deleted IS NOT NULL").select(F.col("fs_node_id").alias("fs_node_id_parent"), "time_deleted")
    return edges(spark, d).join(dead, ["fs_node_id_parent", "time_deleted"], "left_semi")


@query(ORPHAN)
def orphan_nodes(spark, d):
    return C.orphan_ids(nodes(spark, d), edges(spark, d))


@query("SELECT e.* FROM fx_edge e WHERE e.time_deleted IS NULL AND NOT EXISTS (SELECT 1 FROM fx_node p WHERE p.fs_node_id = e.fs_node_id_parent AND p.time_deleted IS NULL)")
def dead_parent_edges(spark, d):
    return C.dead_parent_edges(nodes(spark, d), edges(spark, d))


@query("SELECT p.fs_node_id AS parent, coalesce(bool_and(e.id IS NOT NULL), true) AS all_inside FROM fx_node p CROSS JOIN (SELECT fs_node_id FROM fx_node WHERE fs_node_id BETWEEN 101 AND 103) s LEFT JOIN fx_edge e ON e.fs_node_id_child = s.fs_node_id AND e.fs_node_id_parent = p.fs_node_id AND e.time_deleted IS NULL WHERE p.fs_node_id BETWEEN 1 AND 5 GROUP BY 1")
def selection_gate(spark, d):
    """Does every selected node hang live under the folder: the count of selected children against the selection's size."""
    selected = ids(spark, d, "fs_node_id BETWEEN 101 AND 103").distinct()
    inside = C.live(edges(spark, d)).join(selected.withColumnRenamed("fs_node_id", "fs_node_id_child"), "fs_node_id_child", "left_semi")
    found = inside.groupBy(F.col("fs_node_id_parent").alias("parent")).agg(F.countDistinct("fs_node_id_child").alias("n"))
    folders = ids(spark, d, "fs_node_id BETWEEN 1 AND 5").withColumnRenamed("fs_node_id", "parent")
    total = F.broadcast(selected.agg(F.count(F.lit(1)).alias("total")))  # one row
    return folders.join(found, "parent", "left").join(total).select("parent", (F.coalesce("n", F.lit(0)) == F.col("total")).alias("all_inside"))


@query(f"SELECT fs_node_id, uri_storage FROM fx_node WHERE {FILES} AND uri_storage NOT IN (SELECT uri FROM fx_event)")
def missing_files(spark, d):
    return C.missing_files(nodes(spark, d), view(spark, d, "fx_event")).select("fs_node_id", "uri_storage")


@query("SELECT n.fs_node_id, count(e.id) AS parents FROM fx_node n LEFT JOIN fx_edge e ON e.fs_node_id_child = n.fs_node_id AND e.time_deleted IS NULL GROUP BY 1")
def active_parent_count(spark, d):
    counts = C.live(edges(spark, d)).groupBy(F.col("fs_node_id_child").alias("fs_node_id")).agg(F.count(F.lit(1)).alias("parents"))
    return nodes(spark, d).select("fs_node_id").join(counts, "fs_node_id", "left").fillna(0, ["parents"])


@query("SELECT DISTINCT time_deleted FROM fx_node WHERE time_deleted IS NOT NULL ORDER BY 1 DESC")
def delete_batches(spark, d):
    return nodes(spark, d).where("time_deleted IS NOT NULL").select("time_deleted").distinct().orderBy(F.desc("time_deleted"))


@query("""WITH dead AS (SELECT time_deleted AS batch, fs_node_id FROM fx_node WHERE time_deleted IS NOT NULL),
best AS (SELECT d.batch, d.fs_node_id, arg_max(e.fs_node_id_parent, e.id) AS parent FROM dead d JOIN fx_edge e ON e.fs_node_id_child = d.fs_node_id JOIN dead p ON p.batch = d.batch AND p.fs_node_id = e.fs_node_id_parent GROUP BY 1, 2)
SELECT d.batch, coalesce(b.parent, -1) AS parent, count(*) AS n, array_to_string(list_sort(list(d.fs_node_id)), ',') AS children FROM dead d LEFT JOIN best b USING (batch, fs_node_id) GROUP BY 1, 2""")
def batch_tree(spark, d):
    """The number and the sorted list of the children under each parent of a batch."""
    listed = C.batch_tree(nodes(spark, d), edges(spark, d)).groupBy("batch", "parent").agg(F.array_sort(F.collect_list("fs_node_id")).alias("children"))
    return listed.select("batch", "parent", F.size("children").cast("long").alias("n"), F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query("SELECT uri_storage, fs_node_id FROM (SELECT *, row_number() OVER (PARTITION BY uri_storage ORDER BY (time_deleted IS NULL) DESC, fs_node_id) AS k FROM fx_node WHERE uri_storage IS NOT NULL) t WHERE k = 1")
def lookup_any_status(spark, d):
    """For every URI its live node, else its dead one."""
    rank = F.struct(F.col("time_deleted").isNotNull().alias("dead"), "fs_node_id")
    return nodes(spark, d).where("uri_storage IS NOT NULL").groupBy("uri_storage").agg(F.min_by("fs_node_id", rank).alias("fs_node_id"))


@query(f"SELECT parent, fs_node_id, name_display, place FROM (SELECT e.fs_node_id_parent AS parent, n.fs_node_id, n.name_display, row_number() OVER (PARTITION BY e.fs_node_id_parent ORDER BY n.time_created DESC, n.name_display, n.fs_node_id) AS place FROM {LIVE_CHILD}) t WHERE place BETWEEN 21 AND 40")
def listing_page(spark, d):
    """The second page of 20 of every folder's listing."""
    w = C.Window.partitionBy("parent").orderBy(F.desc("time_created"), "name_display", "fs_node_id")
    rows = C.children_of(nodes(spark, d), edges(spark, d)).withColumn("place", F.row_number().over(w))
    return rows.where("place BETWEEN 21 AND 40").select("parent", "fs_node_id", "name_display", "place")


@query("SELECT user_id, item, place FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS place FROM (SELECT user_id, item, max(ts) AS ts FROM fx_event GROUP BY 1, 2) a) b WHERE place <= 3")
def recent_list(spark, d):
    return C.recent_list(view(spark, d, "fx_event"), 3).select("user_id", "item", "place")


@query(f"SELECT parent, fs_node_id FROM (SELECT e.fs_node_id_parent AS parent, n.fs_node_id, row_number() OVER (PARTITION BY e.fs_node_id_parent ORDER BY n.time_modified DESC, n.fs_node_id) AS k FROM {LIVE_CHILD} WHERE n.uri_storage IS NOT NULL) t WHERE k <= 8")
def cache_survivors(spark, d):
    """The eight files of each folder that were modified last."""
    w = C.Window.partitionBy("parent").orderBy(F.desc("time_modified"), "fs_node_id")
    files = C.children_of(nodes(spark, d), edges(spark, d)).where("uri_storage IS NOT NULL")
    return files.withColumn("k", F.row_number().over(w)).where("k <= 8").select("parent", "fs_node_id")


@query(f"SELECT parent, fs_node_id, row_number() OVER w - 1 AS place, lag(fs_node_id) OVER w AS previous, lead(fs_node_id) OVER w AS next FROM (SELECT e.fs_node_id_parent AS parent, n.* FROM {LIVE_CHILD} WHERE type_mime LIKE 'image/%' OR type_mime LIKE 'video/%') t WINDOW w AS (PARTITION BY parent ORDER BY time_created DESC, name_display, fs_node_id)")
def viewer_neighbours(spark, d):
    return C.viewer_neighbours(nodes(spark, d), edges(spark, d))


A, B = "fs_node_id % 3 = 0", "fs_node_id % 5 = 0"


@query(f"SELECT fs_node_id FROM fx_node WHERE {A} UNION SELECT fs_node_id FROM fx_node WHERE {B}")
def select_union(spark, d):
    return ids(spark, d, A).union(ids(spark, d, B)).distinct()


@query(f"SELECT fs_node_id FROM fx_node WHERE ({A}) <> ({B})")
def select_toggle(spark, d):
    return C.toggled(ids(spark, d, A), ids(spark, d, B))


@query(f"SELECT fs_node_id FROM fx_node WHERE ({A}) <> (time_deleted IS NULL)")
def select_invert(spark, d):
    return C.toggled(ids(spark, d, "time_deleted IS NULL"), ids(spark, d, A))


@query(f"SELECT fs_node_id FROM fx_node WHERE {A} AND {B}")
def select_intersect(spark, d):
    return ids(spark, d, A).intersect(ids(spark, d, B))


@query(f"SELECT fs_node_id FROM fx_node WHERE {FILES} AND uri_storage NOT IN (SELECT uri FROM fx_event) UNION {ORPHAN}")
def reconcile_targets(spark, d):
    n = nodes(spark, d)
    return C.reconcile_targets(n, edges(spark, d), C.missing_files(n, view(spark, d, "fx_event")))


PICKS = "SELECT uri AS uri_storage, concat('NEW_', event_id, '.jpg') AS name_display, 'image/jpeg' AS type_mime, event_id AS picked FROM fx_event UNION ALL SELECT concat('content://new/', CAST(user_id AS BIGINT)), 'x.jpg', 'image/jpeg', event_id FROM fx_event"


def picks(spark, d):
    e = view(spark, d, "fx_event")
    known = e.select(F.col("uri").alias("uri_storage"), F.concat(F.lit("NEW_"), "event_id", F.lit(".jpg")).alias("name_display"), F.lit("image/jpeg").alias("type_mime"), F.col("event_id").alias("picked"))
    return known.unionByName(e.select(F.concat(F.lit("content://new/"), "user_id").alias("uri_storage"), F.lit("x.jpg").alias("name_display"), F.lit("image/jpeg").alias("type_mime"), F.col("event_id").alias("picked")))


IMPORTED = f"""WITH picks AS ({PICKS}), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri_storage ORDER BY picked, name_display, type_mime) AS k FROM picks) t WHERE k = 1)
SELECT n.fs_node_id, CASE WHEN n.time_deleted IS NOT NULL AND p.picked IS NOT NULL THEN p.name_display ELSE n.name_display END AS name_display, CASE WHEN n.time_deleted IS NOT NULL AND p.picked IS NOT NULL THEN p.type_mime ELSE n.type_mime END AS type_mime,
  n.uri_storage, n.time_created, CASE WHEN p.picked IS NULL THEN n.time_deleted END AS time_deleted FROM fx_node n LEFT JOIN p USING (uri_storage)
UNION ALL SELECT (SELECT max(fs_node_id) FROM fx_node) + row_number() OVER (ORDER BY uri_storage), name_display, type_mime, uri_storage, picked, NULL FROM p WHERE uri_storage NOT IN (SELECT uri_storage FROM fx_node WHERE uri_storage IS NOT NULL)"""


@query(IMPORTED)
def import_merge(spark, d):
    return C.import_merge(nodes(spark, d), picks(spark, d)).drop("time_modified")


@query("""WITH pairs AS (SELECT DISTINCT fs_node_id_child AS c, fs_node_id_parent AS p FROM fx_edge WHERE time_deleted IS NOT NULL UNION SELECT fs_node_id, 0 FROM fx_node WHERE type_mime = 'application/folder')
SELECT coalesce(e.id, p.c * 10000000 + p.p) AS id, coalesce(fs_node_id_child, c) AS fs_node_id_child, coalesce(fs_node_id_parent, p) AS fs_node_id_parent, CASE WHEN p.c IS NULL THEN time_deleted END AS time_deleted
FROM fx_edge e FULL JOIN pairs p ON p.c = e.fs_node_id_child AND p.p = e.fs_node_id_parent""")
def link_merge(spark, d):
    """All dead edges are linked again, and every folder is linked to the root."""
    pairs = edges(spark, d).where("time_deleted IS NOT NULL").select(F.col("fs_node_id_child").alias("child"), F.col("fs_node_id_parent").alias("parent"))
    new = ids(spark, d, "type_mime = 'application/folder'").select(F.col("fs_node_id").alias("child"), F.lit(0).cast("long").alias("parent"))
    return C.link_merge(edges(spark, d), pairs.unionByName(new))


@query("SELECT id, fs_node_id_child, fs_node_id_parent, CASE WHEN id % 5 = 2 THEN 9100 ELSE time_deleted END AS time_deleted FROM fx_edge")
def unlink(spark, d):
    return edges(spark, d).withColumn("time_deleted", F.when(F.col("id") % 5 == 2, F.lit(9100).cast("long")).otherwise(F.col("time_deleted")))


@query("SELECT fs_node_id, CASE WHEN fs_node_id % 9 = 4 THEN upper(name_display) ELSE name_display END AS name_display FROM fx_node")
def rename(spark, d):
    n = nodes(spark, d)
    changes = n.where("fs_node_id % 9 = 4").select("fs_node_id", F.upper("name_display").alias("new_name"))
    return n.join(changes, "fs_node_id", "left").select("fs_node_id", F.coalesce("new_name", "name_display").alias("name_display"))


@query("SELECT fs_node_id, type_mime FROM fx_node WHERE fs_node_id > 0 UNION ALL SELECT 0, 'application/folder-root'")
def ensure_root(spark, d):
    return C.ensure_root(C.ensure_root(nodes(spark, d).where("fs_node_id > 0"))).select("fs_node_id", "type_mime")


@query("SELECT fs_node_id, CASE WHEN time_deleted NOT IN (SELECT time_deleted FROM fx_node WHERE time_deleted IS NOT NULL AND fs_node_id < 1000000) THEN time_deleted END AS time_deleted FROM fx_node")
def restore_batches(spark, d):
    """Restores the batches in which folders of the upper levels fell."""
    n = nodes(spark, d)
    return C.restore_batches(n, n.where("time_deleted IS NOT NULL AND fs_node_id < 1000000")).select("fs_node_id", "time_deleted")


@query("SELECT e.id, CASE WHEN e.time_deleted IS NULL AND p.fs_node_id IS NULL THEN 9200 ELSE e.time_deleted END AS time_deleted FROM fx_edge e LEFT JOIN fx_node p ON p.fs_node_id = e.fs_node_id_parent AND p.time_deleted IS NULL")
def sweep_dead_edges(spark, d):
    return C.sweep_dead_edges(nodes(spark, d), edges(spark, d), 9200).select("id", "time_deleted")


@query("SELECT fs_node_id, CAST(NULL AS BIGINT) AS time_deleted FROM fx_node WHERE time_deleted IS NULL")
def recycle_layout_migration(spark, d):
    """Old layout (live table and a separate table of recycled rows) to the one with a stamp; recycled rows are dropped."""
    old = C.live(nodes(spark, d)).drop("time_deleted")
    return old.unionByName(nodes(spark, d).limit(0), allowMissingColumns=True).select("fs_node_id", "time_deleted")


@query("SELECT 20000000 + fs_node_id AS fs_node_id, concat('Album ', name_display) AS name_display, (20000000 + fs_node_id) * 10000000 AS edge_id FROM fx_node WHERE type_mime = 'application/folder'")
def create_collection(spark, d):
    """A new folder with an edge to the root for each folder."""
    n = nodes(spark, d).where("type_mime = 'application/folder'")
    new = n.select((F.lit(20000000) + F.col("fs_node_id")).alias("fs_node_id"), F.concat(F.lit("Album "), "name_display").alias("name_display"))
    return new.withColumn("edge_id", F.col("fs_node_id") * 10000000)


@query("""WITH RECURSIVE up(start, node) AS (SELECT fs_node_id, fs_node_id FROM fx_node
  UNION SELECT u.start, e.fs_node_id_parent FROM up u JOIN fx_edge e ON e.fs_node_id_child = u.node AND e.time_deleted IS NULL)
SELECT start, node AS fs_node_id FROM up""")
def ancestors(spark, d):
    return G.closure(edges(spark, d), nodes(spark, d).select("fs_node_id"), up=True).select("start", "fs_node_id")


@query("""WITH RECURSIVE down(start, node) AS (SELECT fs_node_id, fs_node_id FROM fx_node
  UNION SELECT u.start, e.fs_node_id_child FROM down u JOIN fx_edge e ON e.fs_node_id_parent = u.node AND e.time_deleted IS NULL)
SELECT start, node AS fs_node_id FROM down""")
def subtree(spark, d):
    return G.closure(edges(spark, d), nodes(spark, d).select("fs_node_id"), up=False).select("start", "fs_node_id")


@query("""WITH RECURSIVE pairs AS (SELECT fs_node_id_parent AS child, fs_node_id_child AS parent FROM fx_edge UNION SELECT fs_node_id, fs_node_id FROM fx_node),
up(start, node) AS (SELECT DISTINCT parent, parent FROM pairs UNION SELECT u.start, e.fs_node_id_parent FROM up u JOIN fx_edge e ON e.fs_node_id_child = u.node AND e.time_deleted IS NULL)
SELECT p.child, p.parent, u.node IS NOT NULL AS cycle FROM pairs p LEFT JOIN up u ON u.start = p.parent AND u.node = p.child""")
def would_create_cycle(spark, d):
    back = edges(spark, d).select(F.col("fs_node_id_parent").alias("child"), F.col("fs_node_id_child").alias("parent"))
    own = nodes(spark, d).select(F.col("fs_node_id").alias("child"), F.col("fs_node_id").alias("parent"))
    return G.would_create_cycle(edges(spark, d), back.unionByName(own))


def _fallen(targets: str | None = None) -> str:
    """The cascade from the nodes that meet the condition or else from the table target, as the table f4.

    Every edge of the view joins neighbouring levels, which the ranges of the ids tell, so one statement a level does, each
    of which reads the level above it once.
    """
    met = "SELECT fs_node_id FROM alive " + (f"WHERE ({targets})" if targets else "WHERE fs_node_id IN (SELECT fs_node_id FROM target)")
    parts = [
        "alive AS MATERIALIZED (SELECT fs_node_id FROM fx_node WHERE time_deleted IS NULL AND type_mime <> 'application/folder-root')",
        "hung AS MATERIALIZED (SELECT e.fs_node_id_child AS c, e.fs_node_id_parent AS p FROM fx_edge e JOIN alive a ON a.fs_node_id = e.fs_node_id_child WHERE e.time_deleted IS NULL)",
        f"l1 AS MATERIALIZED ({met} AND fs_node_id < 100)",
    ]
    for k, (low, high) in enumerate(((100, 1000000), (1000000, 10000000), (10000000, 1000000000000)), 2):
        inside = f"BETWEEN {low} AND {high - 1}"
        parts.append(f"l{k} AS MATERIALIZED ({met} AND fs_node_id {inside} UNION SELECT c FROM hung LEFT JOIN l{k-1} f ON f.fs_node_id = p WHERE c {inside} GROUP BY c HAVING count(*) = count(f.fs_node_id))")
    return ", ".join([*parts, "f4 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT fs_node_id FROM l{k}" for k in range(1, 5)) + ")"])


def _stamped(at: int) -> str:
    """The edges with ``at`` on the live ones of a fallen child or parent."""
    return f"SELECT e.id, CASE WHEN e.time_deleted IS NULL AND (e.fs_node_id_child IN (SELECT fs_node_id FROM f4) OR e.fs_node_id_parent IN (SELECT fs_node_id FROM f4)) THEN {at} ELSE e.time_deleted END AS t FROM fx_edge e"


TARGETS = "fs_node_id IN (2, 103, 2000005) OR fs_node_id % 50 = 7"


@query(f"WITH {_fallen(TARGETS)} SELECT n.fs_node_id, CASE WHEN f.fs_node_id IS NOT NULL THEN 9300 ELSE n.time_deleted END AS time_deleted FROM fx_node n LEFT JOIN f4 f ON f.fs_node_id = n.fs_node_id")
def soft_delete_cascade(spark, d):
    return G.soft_delete(nodes(spark, d), edges(spark, d), ids(spark, d, TARGETS), 9300)[0].select("fs_node_id", "time_deleted")


@query(f"WITH {_fallen(TARGETS)} SELECT id, t AS time_deleted FROM ({_stamped(9300)}) s")
def soft_delete_cascade_edges(spark, d):
    return G.soft_delete(nodes(spark, d), edges(spark, d), ids(spark, d, TARGETS), 9300)[1].select("id", "time_deleted")


@query("""WITH RECURSIVE gone(node, batch) AS (SELECT fs_node_id, time_deleted FROM fx_node WHERE time_deleted IS NOT NULL AND fs_node_id < 1001000
  UNION SELECT n.fs_node_id, n.time_deleted FROM gone g JOIN fx_edge e ON e.fs_node_id_parent = g.node AND e.time_deleted = g.batch JOIN fx_node n ON n.fs_node_id = e.fs_node_id_child AND n.time_deleted = g.batch)
SELECT id FROM fx_edge WHERE fs_node_id_child NOT IN (SELECT node FROM gone) AND fs_node_id_parent NOT IN (SELECT node FROM gone)""")
def delete_forever(spark, d):
    return G.delete_forever(nodes(spark, d), edges(spark, d), ids(spark, d, "fs_node_id < 1001000"))[1].select("id")


TARGET = f"""target AS MATERIALIZED (SELECT fs_node_id FROM fx_node WHERE {FILES} AND uri_storage NOT IN (SELECT uri FROM fx_event)
 UNION SELECT fs_node_id FROM fx_node WHERE time_deleted IS NULL AND type_mime <> 'application/folder-root' AND fs_node_id NOT IN (SELECT e.fs_node_id_child FROM fx_edge e JOIN fx_node p ON p.fs_node_id = e.fs_node_id_parent WHERE e.time_deleted IS NULL AND p.time_deleted IS NULL))"""


@query(f"""WITH {TARGET}, {_fallen()}, standing AS MATERIALIZED (SELECT fs_node_id FROM fx_node WHERE time_deleted IS NULL)
SELECT id, CASE WHEN was IS NOT NULL THEN was WHEN t IS NOT NULL THEN t WHEN parent NOT IN (SELECT fs_node_id FROM standing) THEN 9401 END AS time_deleted
FROM (SELECT e.id, e.time_deleted AS was, e.fs_node_id_parent AS parent, CASE WHEN e.fs_node_id_child IN (SELECT fs_node_id FROM f4) OR e.fs_node_id_parent IN (SELECT fs_node_id FROM f4) THEN 9400 END AS t FROM fx_edge e) s""")
def reconcile(spark, d):
    n = nodes(spark, d)
    missing = C.missing_files(n, view(spark, d, "fx_event"))
    return G.reconcile(n, edges(spark, d), missing, 9400)[1].select("id", "time_deleted")


@query("""SELECT fs_node_id, CASE WHEN instr(name_display, '.') > 0 THEN regexp_extract(name_display, '^(.*)\\.([^.]*)$', 1) ELSE substr(name_display, 1, greatest(length(name_display) - 4, 0)) END AS head,
 CASE WHEN instr(name_display, '.') > 0 THEN regexp_extract(name_display, '(\\.[^.]*)$', 1) ELSE substr(name_display, greatest(length(name_display) - 3, 1)) END AS tail FROM fx_node""")
def split_file_tail(spark, d):
    head, tail = exif.split_tail(F.col("name_display"))
    return nodes(spark, d).select("fs_node_id", head.alias("head"), tail.alias("tail"))


@query("""SELECT fs_node_id, CASE WHEN length(name_display) <= 12 THEN name_display WHEN instr(name_display, '.') > 0 THEN concat(substr(regexp_extract(name_display, '^(.*)\\.([^.]*)$', 1), 1, 11 - length(regexp_extract(name_display, '(\\.[^.]*)$', 1))), '…', regexp_extract(name_display, '(\\.[^.]*)$', 1))
 ELSE concat(substr(name_display, 1, 7), '…', substr(name_display, length(name_display) - 3)) END AS shown FROM fx_node""")
def middle_truncate(spark, d):
    return nodes(spark, d).select("fs_node_id", exif.middle_truncate(F.col("name_display"), 12).alias("shown"))


@query("SELECT DISTINCT time_deleted, strftime(epoch_ms(time_deleted * 100000000), '%Y-%m-%d %H:%M') AS name_display FROM fx_node WHERE time_deleted IS NOT NULL")
def batch_folder_name(spark, d):
    return nodes(spark, d).where("time_deleted IS NOT NULL").select("time_deleted").distinct().withColumn("name_display", F.date_format(F.timestamp_millis(F.col("time_deleted") * 100000000), "yyyy-MM-dd HH:mm"))


@query("""SELECT image_id, CASE WHEN exposure_s >= 1 THEN concat(CAST(CAST(round(exposure_s) AS BIGINT) AS VARCHAR), 's') WHEN exposure_s > 0 THEN concat('1/', CAST(CAST(round(1/exposure_s) AS BIGINT) AS VARCHAR), ' s') END AS exposure,
 CASE orientation WHEN 2 THEN 'Mirrored' WHEN 3 THEN 'Rotated 180' WHEN 4 THEN 'Flipped' WHEN 5 THEN 'Transposed' WHEN 6 THEN 'Rotated 90' WHEN 7 THEN 'Transversed' WHEN 8 THEN 'Rotated 270' ELSE 'Normal' END AS orientation,
 CASE WHEN taken LIKE '____:__:__ %' THEN concat(substr(taken, 1, 4), '-', substr(taken, 6, 2), '-', substr(taken, 9, 2), substr(taken, 11, 6)) END AS taken, flash % 2 = 1 AS flash, coalesce(iso_a, iso_b) AS iso,
 nullif(trim(concat(coalesce(trim(make), ''), ' ', coalesce(trim(model), ''))), '') AS camera, concat(CAST(seconds // 60 AS VARCHAR), ':', lpad(CAST(seconds % 60 AS VARCHAR), 2, '0')) AS duration, printf('%.5f, %.5f', lat, lon) AS geo FROM fx_tags""", name="exif_texts")
def exif_texts(spark, d):
    """Exposure, orientation, date, flash, ISO, camera, duration and place as texts."""
    return exif.texts(view(spark, d, "fx_tags"))


@query("""SELECT image_id, CASE WHEN iso_w IS NOT NULL AND iso_h IS NOT NULL THEN iso_w WHEN priv_w IS NOT NULL AND priv_h IS NOT NULL THEN priv_w ELSE up_w END AS width,
 CASE WHEN iso_w IS NOT NULL AND iso_h IS NOT NULL THEN iso_h WHEN priv_w IS NOT NULL AND priv_h IS NOT NULL THEN priv_h ELSE up_h END AS height FROM fx_tags""")
def shape_with_fallback(spark, d):
    """Width and height of the first namespace that has both."""
    both = lambda p: F.when(F.col(f"{p}_w").isNotNull() & F.col(f"{p}_h").isNotNull(), F.struct(F.col(f"{p}_w").alias("w"), F.col(f"{p}_h").alias("h")))
    return view(spark, d, "fx_tags").withColumn("s", F.coalesce(both("iso"), both("priv"), both("up"))).select("image_id", F.col("s.w").alias("width"), F.col("s.h").alias("height"))


@query("SELECT page_id, lower(substr(ltrim(substr(html, 1, 1048576), ' ' || chr(9) || chr(10) || chr(13)), 2, 64)) LIKE '%svg%' AND starts_with(ltrim(html, ' ' || chr(9) || chr(10) || chr(13)), '<') AS svg, length(substr(html, 1, 1048576)) AS header_length FROM pages")
def sniff_svg(spark, d):
    """Header scan: does a file's first mebibyte start like an SVG."""
    header = F.substring("html", 1, 1 << 20)
    body = F.regexp_replace(header, r"^[ \t\r\n]+", "")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", (F.lower(F.substring(body, 2, 64)).contains("svg") & body.startswith("<")).alias("svg"), F.length(header).cast("long").alias("header_length"))


ROUTE = "CASE WHEN page_id % 4 = 0 THEN concat('RawToRaster:', CASE WHEN page_id % 8 = 0 THEN 'cr2' ELSE 'raw' END) WHEN page_id % 4 = 1 THEN concat('ToCoil:', CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE 'application/octet-stream' END) ELSE 'Unsupported' END"


def routed(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    verdicts = pages.select(
        "page_id", (F.col("page_id") % 4 == 0).alias("raw_ok"), F.when(F.col("page_id") % 8 == 0, "cr2").alias("raw_format"),
        (F.col("page_id") % 4 == 1).alias("coil_ok"), F.when(F.col("page_id") % 3 == 0, "image/png").alias("coil_format"),
    )
    return verdicts.withColumn("route", exif.route("raw_ok", "raw_format", "coil_ok", "coil_format"))


@query(f"SELECT page_id, {ROUTE} AS route FROM pages")
def route(spark, d):
    return routed(spark, d).select("page_id", "route")


@query(f"SELECT {ROUTE} AS route, count(*) AS n, sum(length(html)) AS chars FROM pages GROUP BY 1")
def scan_and_route(spark, d):
    sized = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.length("html").alias("chars"))
    return routed(spark, d).join(sized, "page_id").groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))

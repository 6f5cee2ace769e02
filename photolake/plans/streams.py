"""Streaming queries: each runs its stream to the end of what is there and returns the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.sources.snapshots import Snapshots
from photolake.streaming import jobs as S

from .registry import query

# Each event picks its URI and a new one of its user, both into one of 25 folders. The streams deal the events by event_id.
_PICKS = """picks AS (SELECT uri AS uri_storage, concat('NEW_', event_id, '.jpg') AS name_display, event_id AS picked, 100 + user_id % 25 AS parent FROM fx_event
  UNION ALL SELECT concat('content://new/', CAST(user_id AS BIGINT)), 'x.jpg', event_id, 100 + event_id % 25 FROM fx_event),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri_storage ORDER BY picked, name_display) AS k FROM picks) t WHERE k = 1),
n AS (SELECT CASE WHEN n.time_deleted IS NOT NULL AND p.picked IS NOT NULL THEN p.name_display ELSE n.name_display END AS name_display, n.uri_storage, n.time_created, CASE WHEN p.picked IS NULL THEN n.time_deleted END AS time_deleted, fs_node_id AS old
  FROM fx_node n LEFT JOIN p USING (uri_storage)
  UNION ALL SELECT name_display, uri_storage, picked, NULL, NULL FROM p WHERE uri_storage NOT IN (SELECT uri_storage FROM fx_node WHERE uri_storage IS NOT NULL))"""


def _imported(spark, d, listings=None):
    """The catalogue after the stream of all picks, and the number of its last batch."""
    store = Snapshots(spark, S.folder(spark, "catalogue"))
    store.create({"nodes": (view(spark, d, "fx_node"), ["fs_node_id"]), "edges": (view(spark, d, "fx_edge"), ["id"])})
    e = S.arrivals(view(spark, d, "fx_event"), "import", "event_id")
    pick = lambda uri, name, parent: F.struct(uri.alias("uri_storage"), name.alias("name_display"), F.lit("image/jpeg").alias("type_mime"), F.col("event_id").alias("picked"), (F.lit(100) + parent % 25).cast("long").alias("parent"))
    both = F.array(pick(F.col("uri"), F.concat(F.lit("NEW_"), "event_id", F.lit(".jpg")), F.col("user_id")), pick(F.concat(F.lit("content://new/"), "user_id"), F.lit("x.jpg"), F.col("event_id")))
    S.import_stream(store, e.select(F.inline(both)), S.folder(spark, "import-state"), listings)
    return store.at()


@query(f"WITH {_PICKS} SELECT uri_storage, name_display, time_created, time_deleted FROM n WHERE uri_storage IS NOT NULL")
def stream_import(spark, d):
    """The catalogue's files after all batches: what one import of all picks gives, but for the ids of new rows."""
    return _imported(spark, d).read("nodes").where("uri_storage IS NOT NULL").select("uri_storage", "name_display", "time_created", "time_deleted")


@query(f"""WITH {_PICKS}, links AS (SELECT e.fs_node_id_parent AS parent, n.name_display, n.uri_storage, n.time_created FROM fx_edge e JOIN n ON n.old = e.fs_node_id_child WHERE e.time_deleted IS NULL AND n.time_deleted IS NULL
  UNION SELECT parent, n.name_display, n.uri_storage, n.time_created FROM picks JOIN n USING (uri_storage))
SELECT parent, name_display, uri_storage FROM links WHERE parent IN (SELECT parent FROM picks)""")
def stream_live_listing(spark, d):
    """Of each folder that picks touched the listing that was sent last: what children_of gives on the final catalogue."""
    path = S.folder(spark, "listings")
    _imported(spark, d, path)
    sent = spark.read.parquet(path)
    last = sent.groupBy("parent").agg(F.max("batch").alias("batch"))
    return sent.join(F.broadcast(last), ["parent", "batch"]).select("parent", "name_display", "uri_storage")


@query("SELECT user_id, string_agg(item, ',' ORDER BY place) AS items FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS place FROM (SELECT user_id, item, max(ts) AS ts FROM fx_event GROUP BY 1, 2) a) b WHERE place <= 3 GROUP BY 1")
def stream_recent_list(spark, d):
    """Each user's list after all batches, whenever the user was active last."""
    e = view(spark, d, "fx_event").select("event_id", "user_id", "item", F.col("ts").cast("timestamp").alias("ts"))
    out = S.drained(S.recent_stream(S.arrivals(e, "recent", "event_id"), 3), "update", "recent")
    return out.groupBy("user_id").agg(F.array_join(F.max_by("items", "batch"), ",").alias("items"))

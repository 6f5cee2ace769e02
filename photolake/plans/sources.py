"""Queries of sources and sinks: headers, tags, lattices, log spaces, the catalogue's and the tiles' writers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.functions import logspace, tags
from photolake.operators import pixels as P
from photolake.sources import sinks
from photolake.sources.cube import read_cube
from photolake.sources.headers import HEADER, read_headers, write_files
from photolake.sources.scratch import shared_dir
from photolake.sources.snapshots import Snapshots

from .pixels import shown
from .registry import query


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/photolake/{name}-{uuid.uuid4().hex}"


@query("""WITH new AS (SELECT DISTINCT concat('content://new/', CAST(user_id AS BIGINT)) AS uri_storage FROM fx_event UNION SELECT uri FROM fx_event), fresh AS (SELECT uri_storage FROM new WHERE uri_storage NOT IN (SELECT uri_storage FROM fx_node WHERE uri_storage IS NOT NULL))
SELECT fs_node_id, uri_storage, time_deleted FROM fx_node UNION ALL SELECT (SELECT max(fs_node_id) FROM fx_node) + row_number() OVER (ORDER BY uri_storage), uri_storage, NULL FROM fresh""")
def catalogue_sink(spark, d):
    """The node table written, the picks of all events appended twice (the second time nothing is new), and read again."""
    events, store = view(spark, d, "fx_event"), Snapshots(spark, _folder(spark, "catalogue"))
    store.create({"nodes": (view(spark, d, "fx_node"), ["fs_node_id"])})
    uri = events.select(F.col("uri").alias("uri_storage")).union(events.select(F.concat(F.lit("content://new/"), "user_id")))
    new = uri.select("uri_storage", F.col("uri_storage").alias("name_display"), F.lit("image/jpeg").alias("type_mime"), F.lit(None).cast("long").alias("time_modified"), F.lit(1).cast("long").alias("time_created"), F.lit(None).cast("long").alias("time_deleted"))
    for _ in range(2):
        sinks.append_nodes(store, new)
    return store.at().read("nodes").select("fs_node_id", "uri_storage", "time_deleted")


@query("SELECT id, fs_node_id_child, fs_node_id_parent, time_deleted FROM fx_edge UNION ALL SELECT fs_node_id * 10000000, fs_node_id, 0, NULL FROM fx_node n WHERE fs_node_id > 0 AND NOT EXISTS (SELECT 1 FROM fx_edge e WHERE e.fs_node_id_child = n.fs_node_id AND e.fs_node_id_parent = 0)")
def catalogue_sink_edges(spark, d):
    """The edge table written, an edge to the root appended for every node without one, and read again."""
    store = Snapshots(spark, _folder(spark, "catalogue"))
    store.create({"edges": (view(spark, d, "fx_edge"), ["id"])})
    new = view(spark, d, "fx_node").where("fs_node_id > 0").select((F.col("fs_node_id") * 10000000).alias("id"), F.col("fs_node_id").alias("fs_node_id_child"), F.lit(0).cast("long").alias("fs_node_id_parent"), F.lit(None).cast("long").alias("time_deleted"))
    return sinks.append_edges(store, new.unionByName(new)).read("edges")


@query("SELECT image_id % 3 AS preset, image_id, y, x, v FROM fx_px")
def tile_sink(spark, d):
    """Tiles of 4 × 4 written by preset, read again and unpacked."""
    path = _folder(spark, "tiles")
    sinks.write_tiles(P.pack_tiles(view(spark, d, "fx_px"), 4).withColumn("preset", F.col("image_id") % 3), path)
    back = spark.read.parquet(path)
    return P.unpack_tiles(back.drop("preset"), 4).select((F.col("image_id") % 3).alias("preset"), "image_id", "y", "x", "v")


@query(f"SELECT page_id, least(octet_length(encode(html)), {HEADER}) AS bytes, lower(hex(encode(html)[1:8])) AS first_bytes FROM pages")
def header_scan(spark, d):
    """Bytes of the header of a file for each page, at most a mebibyte, and the first eight: the files written, then read by ranges."""
    path = _folder(spark, "files")
    pages = spark.read.parquet(f"{d}/pages.parquet")
    name = F.format_string("%02x/page-%d.html", F.pmod(F.xxhash64("page_id"), F.lit(256)), "page_id")
    write_files(pages.select(name.alias("name"), F.encode("html", "UTF-8").alias("content")), path)
    read = read_headers(spark, path).where(F.col("path").endswith(".html"))
    page = F.regexp_extract("path", r"page-(\d+)\.html$", 1).cast("long")
    return read.select(page.alias("page_id"), F.octet_length("header").cast("long").alias("bytes"), F.lower(F.hex(F.substring("header", 1, 8))).alias("first_bytes"))


@query("SELECT image_id AS file, 4 AS n, (y * 8 + x) % 4 AS i, (y * 8 + x) // 4 % 4 AS j, (y * 8 + x) // 16 AS k, r, g, b FROM fx_rgb")
def cube_lut_scan(spark, d):
    """Every frame of 64 pixels written as a .cube file of a 4 × 4 × 4 lattice; the files read and parsed."""
    path = _folder(spark, "cubes")
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("r", "g", "b")])
    points = F.sort_array(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("at"), line.alias("line"))))
    text = F.concat(F.lit("# lattice\nTITLE \"frame\"\nLUT_3D_SIZE 4\n"), F.array_join(F.transform(points, lambda p: p["line"]), "\n"))
    texts = view(spark, d, "fx_rgb").groupBy("image_id").agg(F.encode(text, "UTF-8").alias("content"))
    write_files(texts.select(F.format_string("frame-%d.cube", "image_id").alias("name"), "content"), path)
    return read_cube(spark, path).withColumn("file", F.regexp_extract("file", r"frame-(\d+)\.cube$", 1).cast("long"))


_CHOSEN = "CASE event_id % 3 WHEN 0 THEN display WHEN 1 THEN canonical ELSE concat(canonical, '?') END"
_SPACES = "(VALUES " + ", ".join(f"({k}, '{c}', '{n}')" for k, (c, n) in enumerate(logspace.SPACES)) + ") s(k, canonical, display)"


@query(f"SELECT display, row_number() OVER (ORDER BY display) AS place, count(event_id) AS uses FROM {_SPACES} LEFT JOIN fx_event ON event_id % {len(logspace.SPACES)} = k GROUP BY display")
def log_space_menu(spark, d):
    """The menu of log spaces by display name, each with the number of events that use it."""
    uses = view(spark, d, "fx_event").groupBy((F.col("event_id") % len(logspace.SPACES)).alias("k")).agg(F.count(F.lit(1)).alias("uses"))
    names = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(n).alias("display")) for k, (_, n) in enumerate(logspace.SPACES)])).alias("s")
    menu = spark.range(1).select(names).select("s.*").join(uses, "k", "left").withColumn("place", logspace.place("display"))
    return menu.select("display", "place", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(f"WITH e AS (SELECT event_id, {_CHOSEN} AS name FROM fx_event JOIN {_SPACES} ON event_id % {len(logspace.SPACES)} = k) SELECT event_id, name, coalesce(a.canonical, b.canonical) AS canonical FROM e LEFT JOIN {_SPACES.replace(' s(', ' a(')} ON a.display = name LEFT JOIN {_SPACES.replace(' s(', ' b(')} ON b.canonical = name")
def log_space_resolve(spark, d):
    """The canonical name for a name that an event gives: display name, canonical name or neither (null)."""
    at = (F.col("event_id") % len(logspace.SPACES) + 1).cast("int")
    pick = lambda side: F.element_at(F.array(*[F.lit(s[side]) for s in logspace.SPACES]), at)
    name = F.when(F.col("event_id") % 3 == 0, pick(1)).when(F.col("event_id") % 3 == 1, pick(0)).otherwise(F.concat(pick(0), F.lit("?")))
    return view(spark, d, "fx_event").select("event_id", name.alias("name")).withColumn("canonical", logspace.resolve("name"))


_KIND = "CASE event_id % 5 WHEN 0 THEN 'I64' WHEN 1 THEN 'F64' WHEN 2 THEN 'SHORT' WHEN 3 THEN 'TEXT' END"
_RAW = "CASE event_id % 5 WHEN 0 THEN CAST(event_id * 7919 - 500000 AS {s}) WHEN 1 THEN CAST(round(value * 3 - 50, 2) AS {s}) WHEN 2 THEN concat(CAST(event_id % 70000 AS {s}), ' 7 9') WHEN 3 THEN 'fifty' END"


@query(f"""WITH t AS (SELECT event_id, {_KIND} AS kind, {_RAW.format(s='VARCHAR')} AS raw FROM fx_event)
SELECT event_id, CASE kind WHEN 'I64' THEN CASE WHEN CAST(raw AS BIGINT) BETWEEN 0 AND 4294967295 THEN CAST(raw AS BIGINT) END WHEN 'F64' THEN CAST(trunc(greatest(CAST(raw AS DOUBLE), 0)) AS BIGINT) WHEN 'SHORT' THEN CAST(split_part(raw, ' ', 1) AS BIGINT) END AS number FROM t""")
def tag_get(spark, d):
    """A numeric tag read as an unsigned 32-bit number; null for texts, absent tags and integers out of range."""
    rows = view(spark, d, "fx_event").select("event_id", F.expr(_KIND).alias("kind"), F.expr(_RAW.format(s="STRING")).alias("raw"))
    return rows.select("event_id", tags.number("kind", "raw").alias("number"))


@query("""SELECT a.image_id, a.y, a.x, count(b.v) AS n, round(1.23e-8 + avg(b.v), 6) AS mean FROM (SELECT * FROM fx_px40 JOIN fx_xtrans ON y % 6 = ry AND x % 6 = rx) a
LEFT JOIN (SELECT * FROM fx_px40 JOIN fx_xtrans ON y % 6 = ry AND x % 6 = rx) b ON a.image_id = b.image_id AND a.colour = b.colour AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3""")
def offset_table(spark, d):
    """For each pixel of a 6 × 6 filter pattern the neighbours of its colour in a 5 × 5 window, by the table of offsets."""
    offsets = P.offset_table(view(spark, d, "fx_xtrans"), 6, 2)
    px = view(spark, d, "fx_px40")
    asked = px.withColumns({"ry": F.col("y") % 6, "rx": F.col("x") % 6}).join(F.broadcast(offsets), ["ry", "rx"])  # at most 36 × 24 rows
    near = asked.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    found = near.join(px, ["image_id", "y", "x"], "left").groupBy("image_id", F.col("cy").alias("y"), F.col("cx").alias("x"))
    return found.agg(F.count("v").alias("n"), shown(F.avg("v"), 6).alias("mean"))

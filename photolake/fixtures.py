"""Views of the given tables in the shapes that the photo operators read: catalogue nodes and edges, pixels, metadata.

Each view has a Spark form and, under the same name, a DuckDB form for the oracles. They use the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODE = """
SELECT CAST(0 AS BIGINT) AS fs_node_id, 'Library' AS name_display, 'application/folder-root' AS type_mime, CAST(NULL AS {s}) AS uri_storage, CAST(NULL AS BIGINT) AS time_modified, CAST(0 AS BIGINT) AS time_created, CAST(NULL AS BIGINT) AS time_deleted
UNION ALL SELECT 1+r_regionkey, r_name, 'application/folder', NULL, NULL, 10, NULL FROM {region}
UNION ALL SELECT 100+n_nationkey, n_name, 'application/folder', NULL, NULL, 20+n_nationkey%4, CASE WHEN n_nationkey%8=3 THEN 9001 END FROM {nation}
UNION ALL SELECT 1000000+c_custkey, c_name, 'application/folder', NULL, NULL, c_custkey%100, CASE WHEN c_custkey%11=4 THEN 9002 END FROM {customer}
UNION ALL SELECT 2000000+s_suppkey, s_name, 'application/folder', NULL, NULL, s_suppkey%100, CASE WHEN s_suppkey%7=2 THEN 9001 END FROM {supplier}
UNION ALL SELECT 10000000+o_orderkey, concat('IMG_', o_orderkey, CASE o_orderkey%6 WHEN 0 THEN '.CR2' WHEN 1 THEN '.ARW' WHEN 2 THEN '.png' WHEN 3 THEN '.mp4' WHEN 4 THEN '.mp3' ELSE '.pdf' END),
 CASE o_orderkey%6 WHEN 0 THEN 'image/x-canon-cr2' WHEN 1 THEN 'image/x-sony-arw' WHEN 2 THEN 'image/png' WHEN 3 THEN 'video/mp4' WHEN 4 THEN 'audio/mpeg' ELSE 'application/pdf' END,
 concat('content://media/', o_orderkey), 1000*(o_orderkey%700), 1000*(o_orderkey%5000)+100, CASE WHEN o_orderkey%37=5 THEN 9003+o_orderkey%3 END FROM {orders}"""
_EDGE = """
SELECT c*10000000+p AS id, c AS fs_node_id_child, p AS fs_node_id_parent, CAST(CASE WHEN (c+p)%13=6 THEN 9002 END AS BIGINT) AS time_deleted FROM (
 SELECT CAST(1+r_regionkey AS BIGINT) AS c, CAST(0 AS BIGINT) AS p FROM {region}
 UNION ALL SELECT 100+n_nationkey, 1+n_regionkey FROM {nation}
 UNION ALL SELECT 1000000+c_custkey, 100+c_nationkey FROM {customer}
 UNION ALL SELECT 2000000+s_suppkey, 100+s_nationkey FROM {supplier}
 UNION ALL SELECT 10000000+o_orderkey, 1000000+o_custkey FROM {orders}
 UNION ALL SELECT DISTINCT 10000000+l_orderkey, 2000000+l_suppkey FROM {lineitem}) e"""
_RGB = """
SELECT vec_id AS image_id, CAST(floor(i/8) AS INT) AS y, CAST(i%8 AS INT) AS x,
  round(0.5+CAST(embedding[i{o}] AS DOUBLE),6) AS r, round(0.5+CAST(embedding[(i*7+3)%64{o}] AS DOUBLE),6) AS g, round(0.5+CAST(embedding[(i*11+5)%64{o}] AS DOUBLE),6) AS b
FROM (SELECT vec_id, embedding, {i} AS i FROM {embeddings}) e"""
_PX = "SELECT image_id, y, x, r AS v FROM fx_rgb"
_PX40 = """
SELECT CAST(floor(image_id/25) AS BIGINT) AS image_id, CAST(y+8*floor((image_id%25)/5) AS INT) AS y, CAST(x+8*(image_id%5) AS INT) AS x, v FROM fx_px"""
_RGB64 = """
SELECT CAST(floor(image_id/64) AS BIGINT) AS image_id, CAST(y+8*floor((image_id%64)/8) AS INT) AS y, CAST(x+8*(image_id%8) AS INT) AS x, r, g, b FROM fx_rgb"""
_META = """
SELECT vec_id AS image_id, 8 AS width, 8 AS height, CAST(vec_id%3 AS INT) AS crop_x, CAST(vec_id%4 AS INT) AS crop_y, CAST(4+vec_id%4 AS INT) AS crop_w, CAST(4+vec_id%3 AS INT) AS crop_h,
  CASE WHEN vec_id%5=0 THEN 16 ELSE 8 END AS roi_w, CASE WHEN vec_id%5=0 THEN 16 ELSE 8 END AS roi_h, CAST(vec_id%4 AS INT) AS camera_id,
  CASE WHEN vec_id%7=0 THEN 35.0 END AS focal_user, CASE WHEN vec_id%3=0 THEN 24.0 END AS focal_decoded, CASE WHEN vec_id%2=0 THEN 85.0 END AS focal_profile,
  CASE WHEN vec_id%4=3 THEN 1 ELSE 3 END AS channels FROM {embeddings}"""
_EVENT = """
SELECT event_id, ts, user_id, event_type AS item, concat('content://media/', event_id%500) AS uri, value FROM {events}"""
_KELVIN = "SELECT event_id, CAST(1500+100*(event_id%246) AS DOUBLE) AS kelvin FROM {events}"
_TAGS = """
SELECT event_id AS image_id, value AS exposure_s, CAST(event_id%10 AS INT) AS orientation, CAST(event_id%32 AS INT) AS flash,
  CASE WHEN event_id%3=0 THEN CAST(100*(1+event_id%8) AS INT) END AS iso_a, CASE WHEN event_id%2=0 THEN CAST(50*(1+event_id%8) AS INT) END AS iso_b,
  CASE event_id%4 WHEN 0 THEN '2024:05:06 07:08:09' WHEN 1 THEN '2023:12:31 23:59:58' WHEN 2 THEN 'unknown' END AS taken,
  CASE WHEN event_id%5<4 THEN ' Acme ' END AS make, CASE WHEN event_id%3<2 THEN concat('M', event_id%9, ' ') END AS model,
  CAST(event_id%7200 AS BIGINT) AS seconds, round(value/10-45, 7) AS lat, round(value/5-90, 7) AS lon,
  CASE WHEN event_id%3>0 THEN CAST(100+event_id%50 AS INT) END AS iso_w, CASE WHEN event_id%3>1 THEN CAST(80+event_id%40 AS INT) END AS iso_h,
  CASE WHEN event_id%2=0 THEN CAST(200+event_id%50 AS INT) END AS priv_w, CASE WHEN event_id%4=0 THEN CAST(180+event_id%40 AS INT) END AS priv_h,
  CAST(300+event_id%50 AS INT) AS up_w, CAST(280+event_id%40 AS INT) AS up_h FROM {events}"""
_PATCH = "SELECT vec_id, label AS cell, {cast} AS data FROM {embeddings}"
_CFA = """
SELECT * FROM (VALUES (0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 3, 2)) AS t(ry, rx, plane, colour)"""

_LUT = """
SELECT lut_id, 5 AS n, i, j, k, CASE WHEN lut_id = 0 THEN r ELSE 1 - r END AS r, CASE WHEN lut_id = 0 THEN g ELSE 1 - g END AS g, CASE WHEN lut_id = 0 THEN b ELSE 1 - b END AS b FROM (
 SELECT lut_id, i, j, k, 0.9e0*i/4+0.1e0*j*k/16 AS r, 0.9e0*j/4+0.1e0*k*i/16 AS g, 0.9e0*k/4+0.1e0*i*j/16 AS b FROM (
  SELECT CAST(floor(q/125) AS INT) AS lut_id, CAST(q%5 AS INT) AS i, CAST(floor(q/5)%5 AS INT) AS j, CAST(floor(q/25)%5 AS INT) AS k FROM (SELECT {lattice} AS q) e) f) h"""
_MATRIX = """
SELECT camera_id, cct, {nine} AS m FROM (VALUES (0, 2856e0), (0, 6504e0), (1, 2856e0), (1, 6504e0), (2, 5003e0)) AS t(camera_id, cct)"""
# The 6×6 colour filter pattern, row by row.
_PATTERN = (
    "1 1 0 1 1 2",
    "1 1 2 1 1 0",
    "2 0 1 0 2 1",
    "1 1 2 1 1 0",
    "1 1 0 1 1 2",
    "0 2 1 2 0 1",
)
_XTRANS = "SELECT ry, rx, colour AS plane, colour FROM (VALUES " + ", ".join(f"({y}, {x}, {c})" for y, row in enumerate(_PATTERN) for x, c in enumerate(row.split())) + ") AS t(ry, rx, colour)"

SOURCES = ("region", "nation", "customer", "supplier", "orders", "lineitem", "embeddings", "events")
_VIEWS = {"fx_node": _NODE, "fx_edge": _EDGE, "fx_rgb": _RGB, "fx_px": _PX, "fx_px40": _PX40, "fx_rgb64": _RGB64, "fx_meta": _META, "fx_event": _EVENT, "fx_kelvin": _KELVIN, "fx_tags": _TAGS, "fx_patch": _PATCH, "fx_cfa": _CFA, "fx_lut": _LUT, "fx_matrix": _MATRIX, "fx_xtrans": _XTRANS}
_NEEDS = {"fx_px": ["fx_rgb"], "fx_rgb64": ["fx_rgb"], "fx_px40": ["fx_rgb", "fx_px"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark form of a view over the Parquet tables of ``sf_dir``."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in SOURCES}
    text = _VIEWS[name].format(s="STRING", o="", i="explode(sequence(0, 63))", cast="transform(embedding, x -> CAST(x AS DOUBLE))", lattice="explode(sequence(0, 249))", nine="transform(sequence(0, 8), k -> CASE WHEN k % 4 = 0 THEN 0.8e0 ELSE 0.1e0 END + k * (camera_id + 1) * cct / 1e6)", **tables)
    needs = _NEEDS.get(name, [])
    if needs:
        parts = [f"{n} AS ({_VIEWS[n].format(o='', i='explode(sequence(0, 63))', **tables)})" for n in needs]
        text = "WITH " + ", ".join(parts) + text
    return spark.sql(text)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions before it; a leading WITH joins them."""
    tables = {t: t for t in SOURCES}
    named = [n for n in _VIEWS if any(n in x for x in [sql])]
    every = [n for n in _VIEWS if n in named or any(n in _NEEDS.get(m, []) for m in named)]
    parts = [f"{n} AS ({_VIEWS[n].format(s='VARCHAR', o='+1', i='unnest(range(64))', cast='CAST(embedding AS DOUBLE[])', lattice='unnest(range(250))', nine='list_transform(range(9), lambda k: CASE WHEN k % 4 = 0 THEN 0.8e0 ELSE 0.1e0 END + k * (camera_id + 1) * cct / 1e6)', **tables)})" for n in every]
    sql = sql.strip()
    recursive = sql[:14].upper() == "WITH RECURSIVE"
    rest = sql[14:] if recursive else sql[4:] if sql[:4].upper() == "WITH" else None
    if not parts:
        return sql
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
    return f"{head},\n{rest}" if rest is not None else f"{head}\n{sql}"


def pixels(df: DataFrame, *names: str) -> DataFrame:
    return df.select("image_id", "y", "x", *[F.col(n) for n in names])

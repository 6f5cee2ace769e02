"""Row numbers at size, plans imported one by one, sinks, files, streams and the fit of the fringe polynomial."""

import resource
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.functions import tags
from photolake.operators import aberration, catalogue
from photolake.sources import cube, headers, sinks
from photolake.sources.snapshots import Snapshots
from photolake.streaming import jobs

REPO = Path(__file__).resolve().parent.parent
NODE = "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long"


@pytest.mark.parametrize("module", ["aberration", "catalogue", "develop", "pixels", "profiles", "registry", "sources", "streams"])
def test_every_plan_can_be_imported_first(module):
    subprocess.run([sys.executable, "-c", f"import photolake.plans.{module}"], cwd=REPO, check=True)


def test_row_numbers_are_gapless_at_size(spark):
    n = 500_000
    rows = spark.range(n).select(F.concat(F.lit("content://"), F.xxhash64("id")).alias("uri"))
    out = catalogue.with_row_numbers(rows, "uri")
    got = out.agg(F.count(F.lit(1)), F.countDistinct("row_number"), F.min("row_number"), F.max("row_number"), F.countDistinct("uri")).first()
    assert tuple(got) == (n, n, 1, n, n)
    assert catalogue.with_row_numbers(rows.limit(0), "uri").count() == 0


def test_import_keeps_every_new_node(spark):
    nodes = spark.createDataFrame([(7, "a", "image/png", "content://old", None, 1, None)], NODE)
    picks = spark.range(50_000).select(F.concat(F.lit("content://n"), "id").alias("uri_storage"), F.lit("x").alias("name_display"), F.lit("image/png").alias("type_mime"), F.col("id").alias("picked"))
    out = catalogue.import_merge(nodes, picks)
    assert tuple(out.agg(F.count(F.lit(1)), F.countDistinct("fs_node_id"), F.max("fs_node_id")).first()) == (50_001, 50_001, 50_007)


def test_node_sink_adds_each_uri_once(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "catalogue"))
    store.create({"nodes": (spark.createDataFrame([(3, "a", "m", "u1", None, 1, None), (4, "f", "folder", None, None, 1, None)], NODE), ["fs_node_id"])})
    new = spark.createDataFrame([("b", "m", "u2", None, 1, None), ("b", "m", "u2", None, 1, None), ("a", "m", "u1", None, 1, None), ("c", "m", None, None, 1, None)], NODE.split(", ", 1)[1])
    sinks.append_nodes(store, new)
    sinks.append_nodes(store, new.limit(0))
    assert sorted((r.fs_node_id, r.uri_storage) for r in store.at().read("nodes").collect()) == [(3, "u1"), (4, None), (5, "u2")]


def test_tile_sink_makes_a_folder_for_each_preset(spark, tmp_path):
    tiles = spark.range(40).select((F.col("id") % 2).alias("preset"), F.col("id").alias("image_id"), F.array(F.lit(1.0)).alias("data"))
    sinks.write_tiles(tiles, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").glob("preset=*")) == ["preset=0", "preset=1"]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40


def test_headers_push_the_length_down(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"ab" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 5000)
    out = headers.read_headers(spark, str(tmp_path), 4, largest=100)
    assert [(r.length, bytes(r.header)) for r in out.collect()] == [(20, b"abab")]
    assert " Filter " not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(len(r.header) for r in headers.read_headers(spark, str(tmp_path), 100).collect()) == [20, 100]


def test_header_reader_opens_what_it_must_and_no_more(tmp_path):
    from pyspark.sql.datasource import GreaterThan, IsNotNull, LessThan, StringEndsWith

    (tmp_path / "sub" / "deep").mkdir(parents=True)
    with (tmp_path / "sub" / "big.raw").open("wb") as f:
        f.write(b"II*\x00")
        f.truncate(2 << 30)
    (tmp_path / "sub" / "deep" / "é %20.raw").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(b"text")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for root in (str(tmp_path), tmp_path.as_uri()):
        reader = headers.HeaderReader(root, headers.HEADER)
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["path"].rsplit("/", 1)[1], r["length"], len(r["header"])) for r in rows] == [("note.txt", 4, 4), ("big.raw", 2 << 30, headers.HEADER), ("é %20.raw", 0, 0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 10_000  # kilobytes
    reader = headers.HeaderReader(str(tmp_path), 4)
    kept = list(reader.pushFilters([LessThan(("length",), 3 << 30), GreaterThan(("length",), 3), StringEndsWith(("path",), ".raw"), IsNotNull(("header",))]))
    assert kept == [IsNotNull(("header",))] and [f[1] for p in reader.partitions() for f in p.files] == [2 << 30]


def test_files_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}", bytes([k]) * k) for k in range(20)] + [("null", None)], "name string, content binary").repartition(4)
    for _ in range(2):
        headers.write_files(rows, (tmp_path / "out").as_uri())
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.header)) for r in headers.read_headers(spark, str(tmp_path / "out"), 5).collect()}
    assert got == {f"f{k}": (k, bytes([k]) * min(k, 5)) for k in range(20)} | {"null": (0, b"")}
    (tmp_path / "none").mkdir()
    assert headers.read_headers(spark, str(tmp_path / "none")).count() == 0


def test_cube_files(spark, tmp_path):
    points = [(i / 1, j / 1, k / 1) for k in range(2) for j in range(2) for i in range(2)]
    (tmp_path / "a.cube").write_text("# c\nLUT_3D_SIZE 2\n" + "\n".join(" ".join(map(str, p)) for p in points))
    (tmp_path / "b.cube").write_text("LUT_3D_SIZE 3\n0 0 0\n")
    rows = cube.read_cube(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and all((r.i, r.j, r.k) == (r.r, r.g, r.b) for r in rows)


def test_numbers_of_tags(spark):
    cases = [("I64", "-1", None), ("I64", "4294967295", 4294967295), ("I64", "4294967296", None), ("F64", "-3.5", 0), ("F64", "7.9", 7), ("F64", "1e30", 4294967295), ("F64", "NaN", 0),
             ("SHORT", "12 13", 12), ("SSHORT", "-1", 4294967295), ("BYTE", "", None), ("ASCII", "12", None), (None, "1", None), ("LONG", None, None)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, raw string")
    assert [r.number for r in df.select("i", tags.number("kind", "raw").alias("number")).orderBy("i").collect()] == [c[2] for c in cases]


def test_fit_finds_a_known_polynomial(spark):
    rng = np.random.default_rng(3)
    rows = [(1, v, h, c, d, 1.0 + rng.random(), 0.2 + 0.03 * v - 0.02 * h + 0.001 * v * h * (c + 1) - 0.002 * d * v * v) for v in range(1, 9) for h in range(1, 9) for c in (0, 1) for d in (0, 1)]
    blocks = spark.createDataFrame(rows, "image_id long, vblock int, hblock int, colour int, direction int, weight double, shift double")
    fit = aberration.solve(aberration.power_sums(blocks))
    out = blocks.join(fit, ["image_id", "colour", "direction"]).select("shift", aberration.shift_at(F.col("vblock"), F.col("hblock"), F.col("coefficients")).alias("fitted")).collect()
    assert len(out) == len(rows) and max(abs(r.shift - r.fitted) for r in out) < 1e-6
    few = aberration.solve(aberration.power_sums(blocks.where("vblock = 1"))).collect()
    assert len(few) == 4 and all(r.coefficients is None for r in few)


def test_shift_of_a_displaced_red_plane(spark):
    """Red is green moved down by half a pixel: the tiles' shifts say so, with the sign of the difference against the slope."""
    y, x = np.mgrid[0:64, 0:64].astype(float)
    field = lambda yy: 0.5 + 0.2 * np.sin(yy / 5 + np.cos(x / 9)) + 0.1 * np.cos(x / 6)
    rows = [(1, int(a), int(b), float(field(y + 0.5)[a, b]), float(field(y)[a, b]), float(field(y)[a, b])) for a in range(64) for b in range(64)]
    frames = spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")
    shifts = aberration.tile_shifts(aberration.tile_moments(frames, 16)).where("colour = 0 and direction = 0").collect()
    # the slope adds green's differences over two pixels in three columns of weights 0.3, 1, 0.3; its scale takes that off again
    assert len(shifts) == 16 and np.allclose([r.shift for r in shifts], 0.5, atol=0.12)


def test_streams_keep_bounded_state(spark, tmp_path):
    ts = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)"
    for part in range(2):
        spark.range(part * 50, part * 50 + 50).selectExpr("id AS event_id", f"{ts} AS ts", "id % 2 AS user_id", "concat('i', CAST(id % 7 AS STRING)) AS item").write.mode("append").parquet(str(tmp_path / "e"))
    schema = "event_id long, ts timestamp, user_id long, item string"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    out = jobs.drained(jobs.recent_stream(source(), 2), "update", "t").groupBy("user_id").agg(F.max_by("items", "batch").alias("items")).collect()
    assert {r.user_id: r["items"] for r in out} == {0: ["i0", "i5"], 1: ["i1", "i6"]}


def _displaced(size=192, tile=16):
    """A textured RGGB mosaic whose red and blue lie off green by linear polynomials of the block, and the same in place."""
    y, x = np.mgrid[0:size, 0:size].astype(float)
    scene = lambda yy, xx: 0.5 + 0.14 * np.sin(yy / 3.1 + np.cos(xx / 9)) + 0.12 * np.cos(xx / 3.7 + np.sin(yy / 11)) + 0.1 * np.sin((yy + xx) / 5)
    v, h = (y + 0.5) / tile + 0.5, (x + 0.5) / tile + 0.5
    shifts = {0: (0.9 - 0.1 * v, 0.05 * h - 0.3), 2: (0.4 + 0.02 * h, -0.8 + 0.08 * v)}
    colour = (y.astype(int) % 2) + (x.astype(int) % 2)
    off, right = scene(y, x), scene(y, x)
    for c, part in ((0, 0.9), (2, 1.05)):
        site = colour == c
        off[site] = (part * scene(y + shifts[c][0], x + shifts[c][1]))[site]
        right[site] = (part * scene(y, x))[site]
    return off, right, colour, shifts, v, h


def _mosaic(spark, plane):
    return spark.createDataFrame([(1, int(a), int(b), float(p)) for (a, b), p in np.ndenumerate(plane)], "image_id long, y int, x int, v double")


def _plane(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def test_known_shifts_are_taken_back():
    off, right, colour, shifts, _, _ = _displaced()
    down, across = (sum(np.where(colour == c, shifts[c][k], 0.0) for c in (0, 2)) for k in (0, 1))
    back = aberration.moved(off, colour, down, across)
    inner = (colour != 1) & (np.minimum(*np.mgrid[0:192, 0:192]) > 10) & (np.maximum(*np.mgrid[0:192, 0:192]) < 182)
    assert np.abs(back - right)[inner].mean() < 0.25 * np.abs(off - right)[inner].mean()
    assert (back[colour == 1] == off[colour == 1]).all()
    same = aberration.moved(off, colour, np.zeros_like(off), np.zeros_like(off))
    assert (same == off).all()


def test_measured_shifts_are_taken_back(spark):
    """Polynomials that displaced the planes are found and undone."""
    off, right, colour, shifts, v, h = _displaced()
    inner = (colour != 1) & (np.minimum(*np.mgrid[0:192, 0:192]) > 20) & (np.maximum(*np.mgrid[0:192, 0:192]) < 172)
    back = _plane(aberration.correct_fringes(_mosaic(spark, off), 16), off.shape)
    assert np.isfinite(back).all() and back.min() > -1 and back.max() < 2
    assert np.abs(back - right)[inner].mean() < 0.4 * np.abs(off - right)[inner].mean()


def test_frames_without_texture_or_rows_stay(spark):
    flat = np.full((40, 40), 0.25)
    assert (_plane(aberration.correct_fringes(_mosaic(spark, flat), 8, 1), flat.shape) == flat).all()
    assert aberration.correct_fringes(_mosaic(spark, flat).limit(0), 8, 1).count() == 0


def test_moments_and_shifts_deal_pixels_once(spark, tmp_path):
    _mosaic(spark, np.zeros((8, 8))).write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    for df, deals in ((aberration.mosaic_moments(px, 8), 2), (aberration.apply_shifts(px, F.lit(0.5), F.lit(0.5)), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("- Exchange ") == deals and "Window" not in plan  # the second deals the sums of blocks


def test_lattices_both_ways(spark):
    """Broadcast or dealt to parts: the same pixels, also those whose lattice is null or missing."""
    from photolake.operators import develop

    rng = np.random.default_rng(6)
    px = spark.createDataFrame([(k % 3, k // 40, k % 40, [0, 0, 0, 7, None][k % 5], *map(float, rng.random(3))) for k in range(800)], "image_id long, y int, x int, lut_id int, r double, g double, b double")
    lattices = spark.createDataFrame([(0, 3, i, j, k, i / 2, j / 4, k / 2) for i in range(3) for j in range(3) for k in range(3)], "lut_id int, n int, i int, j int, k int, r double, g double, b double")
    one, two = (sorted((tuple(r) for r in develop.lut3d_apply(px, lattices, most).select(*px.columns).collect()), key=repr) for most in (27, 26))
    assert one == two and len(one) == 800
    plan = develop.lut3d_apply(px, lattices, 26)._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "strategy=broadcast" not in plan


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from photolake.sources import scratch

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    assert scratch.shared_dir(session("local[4]")).startswith("/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            scratch.shared_dir(session(master))


def test_shipped_package_is_whole(spark):
    import zipfile

    from photolake.sources.ship import ship

    names = zipfile.ZipFile(ship(spark)).namelist()
    assert {"photolake/__init__.py", "photolake/operators/graph.py", "photolake/functions/kernels.py"} <= set(names)
    assert all(n.startswith("photolake/") and n.endswith(".py") for n in names)

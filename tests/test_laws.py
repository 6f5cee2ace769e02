"""Laws of the operators on tiny tables: identities, fixed points, order of listings, cascades."""

import numpy as np

from photolake.functions import color
from photolake.operators import catalogue, develop, graph, pixels

NODE = "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long"
EDGE = "id long, fs_node_id_child long, fs_node_id_parent long, time_deleted long"


def node(i, name="n", mime="image/png", created=0, deleted=None):
    return (i, name, mime, f"uri{i}", None, created, deleted)


def tables(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame([(c * 1000 + p, c, p, None) for c, p in edges], EDGE)


def tree(spark):
    root = (0, "root", catalogue.ROOT, None, None, 0, None)
    return tables(spark, [root, node(1, "A", catalogue.FOLDER), node(2, "B", catalogue.FOLDER), node(3, "shared"), node(4, "lone")], [(1, 0), (2, 0), (3, 1), (3, 2), (4, 1)])


def test_shared_child_survives_and_lone_child_falls(spark):
    nodes, edges = tree(spark)
    targets = nodes.where("fs_node_id IN (0, 1)").select("fs_node_id")
    after, links = graph.soft_delete(nodes, edges, targets, 77)
    assert {r.fs_node_id for r in after.where("time_deleted = 77").collect()} == {1, 4}
    again, _ = graph.soft_delete(after, links, targets, 88)
    assert again.where("time_deleted = 88").count() == 0
    restored = catalogue.restore_batches(after, after.where("time_deleted = 77").select("time_deleted"))
    assert sorted(map(tuple, restored.collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)


def test_cycles_and_orphans(spark):
    nodes, edges = tree(spark)
    pairs = spark.createDataFrame([(1, 3), (3, 1), (2, 2)], "child long, parent long")
    assert {(r.child, r.parent): r.cycle for r in graph.would_create_cycle(edges, pairs).collect()} == {(1, 3): True, (3, 1): False, (2, 2): True}
    assert catalogue.orphan_nodes(nodes, edges.where("fs_node_id_child <> 4")).first().fs_node_id == 4


def test_delete_forever_keeps_other_batches(spark):
    nodes = spark.createDataFrame([node(1, "c", catalogue.FOLDER, deleted=5), node(2, "d", catalogue.FOLDER, deleted=6), node(3, "f", deleted=6)], NODE)
    edges = spark.createDataFrame([(1, 3, 1, 5), (2, 3, 2, 6)], EDGE)
    left, links = graph.delete_forever(nodes, edges, nodes.where("fs_node_id = 1").select("fs_node_id"))
    assert {r.fs_node_id for r in left.collect()} == {2, 3} and [r.id for r in links.collect()] == [2]


def test_row_numbers_follow_the_order(spark):
    rows = catalogue.with_row_numbers(spark.range(1000).selectExpr("(id * 7919) % 1000 AS k"), "k").collect()
    assert all(r.k + 1 == r.row_number for r in rows)


def frame(spark, h=12, w=10, value=None):
    v = np.random.default_rng(1).random((h, w)) if value is None else np.full((h, w), value)
    return v, spark.createDataFrame([(1, y, x, float(v[y, x])) for y in range(h) for x in range(w)], "image_id long, y int, x int, v double")


def test_flat_field_is_a_fixed_point(spark):
    _, px = frame(spark, value=0.25)
    for out, c in ((pixels.box_mean(px, ["v"], 3), "mean_v"), (pixels.tent_blur(px, "v", 3), "blurred_v"), (pixels.guided_filter(px, "v", "v", 2, 0.01), "filtered")):
        assert all(abs(r[c] - 0.25) < 1e-12 for r in out.collect())


def test_tiles_round_trip_and_tile_size_does_not_matter(spark):
    v, px = frame(spark)
    back = {(r.y, r.x): r.v for r in pixels.unpack_tiles(pixels.pack_tiles(px, 4), 4).collect()}
    assert back == {(y, x): v[y, x] for y in range(12) for x in range(10)}

    def kernel(tile):
        return np.nan_to_num(tile) + np.nan_to_num(np.roll(tile, 1, axis=0))

    a, b = ({(r.y, r.x): r.v for r in pixels.tile_map(px, kernel, size, 1).collect()} for size in (4, 16))
    assert a == b and len(a) == 120


def test_unset_stages_are_identities():
    assert color.exposure("v", None) == "v" and color.boost(("r", "g", "b"), None, None) == ("r", "g", "b")


def test_gamuts_keep_white():
    for primaries in develop.GAMUTS.values():
        assert np.allclose(develop.gamut_matrix(primaries) @ np.ones(3), 1)


def test_develop_steps_keep_flat_fields_and_unset_stages(spark):
    from pyspark.sql import functions as F

    _, px = frame(spark, value=0.25)
    cfa = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 1), (1, 0, 2, 1), (1, 1, 3, 2)], "ry int, rx int, plane int, colour int")
    assert all(abs(r.blurred_v - 0.25) < 1e-12 for r in develop.gaussian_blur(px, "v", 1.0).collect())
    assert all(abs(r.v - 0.25) < 1e-12 for r in develop.resample(px, lambda y, x: (y * 1.3 - 2, x * 0.7), F.lit(12), F.lit(10)).collect())
    assert all(abs(v - 0.25) < 1e-12 for r in develop.demosaic_weighted(px, cfa, 2).collect() for v in (r.r, r.g, r.b))
    assert {r.v for r in develop.dehaze(px, cfa, None).collect()} == {0.25}


def test_cube_files(spark, tmp_path):
    from photolake.sources.cube import read_cube

    points = [(r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3)]
    body = "\n".join(f"{r} {g} {b}" for r, g, b in points)
    (tmp_path / "good.cube").write_text(f'# made here\nTITLE "x"\nLUT_3D_SIZE 3\nDOMAIN_MIN 0 0 0\n{body}\n')
    (tmp_path / "short.cube").write_text("LUT_3D_SIZE 2\n0 0 0\n")
    (tmp_path / "empty.cube").write_text("")
    rows = read_cube(spark, str(tmp_path)).collect()
    assert len(rows) == 27
    assert all(r.file.endswith("good.cube") and r.n == 3 and (r.r, r.g, r.b) == (r.i / 2, r.j / 2, r.k / 2) for r in rows)


def test_matrices_of_whites(spark):
    import numpy as np

    from photolake.functions import color as K
    from photolake.operators import develop as D

    there, back = K.bradford("A", "D65"), K.bradford("D65", "A")
    assert np.allclose(there @ back, np.eye(3)) and np.allclose(there @ K.WHITES["A"], K.WHITES["D65"])
    none = spark.createDataFrame([], "camera_id int, illuminant string, m array<double>")
    asked = spark.createDataFrame([(1, "D65")], "camera_id int, target string")
    row = D.chromatic_adapt(asked, none).first()
    assert row.status == "identity" and row.m == [1.0, 0, 0, 0, 1, 0, 0, 0, 1]


def test_stencils_equal_a_plain_loop_at_every_tile_size(spark):
    v, px = frame(spark)
    px = px.where("NOT (y = 5 AND x = 4)")  # a gap
    v[5, 4] = np.nan
    offsets = pixels.SAME_COLOUR["rb"]
    at = lambda y, x: v[y, x] if 0 <= y < 12 and 0 <= x < 10 else np.nan
    want = {(y, x): [at(y + a, x + b) for a, b in offsets] for y in range(12) for x in range(10) if (y, x) != (5, 4)}
    near = {(r.y, r.x): [np.nan if e is None else e for e in r.near] for r in pixels.gather(px, offsets).collect()}
    assert near.keys() == want.keys() and all(np.array_equal(near[k], want[k], equal_nan=True) for k in want)
    for r in pixels.neighbour_stats(px, offsets).collect():
        seen = [e for e in want[r.y, r.x] if not np.isnan(e)]
        assert (r.lo, r.hi, r["count"]) == (min(seen), max(seen), len(seen)) and abs(r.median - np.median(seen)) < 1e-12
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(rows_a_batch, "7")  # tiles go on over batches
    found = [{(r.y, r.x): (r.lo, r.hi) for r in pixels.tiled(px, ["v"], 2, lambda t: pixels.kernels.spread(pixels.kernels.around(t["v"], offsets)), ["lo", "hi"], size).collect()} for size in (3, 5, 64)]
    spark.conf.unset(rows_a_batch)
    assert found[0] == found[1] == found[2] and len(found[0]) == 119
    assert pixels.gather(px.limit(0), offsets).collect() == []

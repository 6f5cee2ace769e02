"""Walks over the catalogue's edges: long chains, folders of very many children, crowded frontiers, cycles, against plain search."""

import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from photolake.fixtures import view
from photolake.operators import catalogue as C
from photolake.operators import graph as G
from photolake.plans import catalogue, registry  # noqa: F401  it registers its queries
from photolake.sources import scratch
from photolake.sources.scratch import CLEANUP, written

EDGE = "id long, fs_node_id_child long, fs_node_id_parent long, time_deleted long"


def edges_of(spark, pairs):
    return spark.createDataFrame([(k, c, p, None) for k, (c, p) in enumerate(pairs)], EDGE)


def above(pairs):
    up = defaultdict(set)
    for c, p in pairs:
        up[c].add(p)

    def reach(node):
        seen, todo = {node}, [node]
        while todo:
            for p in up[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        return seen

    return reach


@pytest.fixture
def counted(monkeypatch):
    """Rows and number of the tables that walks write, by name."""
    seen, put = defaultdict(list), G.written

    def written(df, name):
        out = put(df, name)
        seen[name].append(out.count())
        return out

    monkeypatch.setattr(G, "written", written)
    return seen


@pytest.mark.parametrize("hot", [100_000, 3])
def test_cycles_and_closure_equal_plain_search(spark, monkeypatch, hot):
    monkeypatch.setattr(G, "HOT", hot)
    monkeypatch.setattr(G, "SALTS", 4)
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 45), rng.integers(0, 40, 45), strict=True)})
    edges = edges_of(spark, [*pairs, (1, 2), (1, 2)])
    dead = spark.createDataFrame([(900, 3, 30, 5), (901, None, 3, None), (902, 3, None, None)], EDGE)
    reach = above([*pairs, (1, 2)])
    asked = [(a, b) for a in range(0, 42, 3) for b in range(0, 42, 2)]
    table = spark.createDataFrame([*asked, *asked[:5], (None, 1), (1, None)], "child long, parent long")
    got = sorted((tuple(r) for r in G.would_create_cycle(edges.unionByName(dead), table).collect()), key=repr)
    assert got == sorted([(c, p, c in reach(p)) for c, p in asked] + [(None, 1, False), (1, None, False)], key=repr)
    starts = spark.createDataFrame([(k,) for k in range(42)], "fs_node_id long")
    found = {(r.start, r.fs_node_id) for r in G.closure(edges.unionByName(dead), starts, up=True).collect()}
    assert found == {(k, n) for k in range(42) for n in reach(k)}


def test_long_chain_takes_few_rounds(spark, counted):
    chain = edges_of(spark, [(k, k + 1) for k in range(40)])
    pairs = spark.createDataFrame([(40, 0), (0, 40)], "child long, parent long")
    assert sorted(map(tuple, G.would_create_cycle(chain, pairs).collect())) == [(0, 40, False), (40, 0, True)]
    rounds = counted["cycle-seen"]  # the first two are the ends themselves
    assert len(rounds) <= 2 + 40 // G.LEVELS + 1 and sum(rounds) <= 2 * 41 + 4


def test_folder_of_a_million_children_is_not_walked_down(spark, counted):
    hub = spark.range(1_000_000).select(F.col("id"), (F.col("id") + 10).alias("fs_node_id_child"), F.lit(1).cast("long").alias("fs_node_id_parent"), F.lit(None).cast("long").alias("time_deleted"))
    edges = hub.unionByName(edges_of(spark, [(1, 0), (5, 6), (6, 7)]))
    pairs = spark.createDataFrame([(1, 500_000), (1, 7), (0, 77), (0, 5)], "child long, parent long")
    assert sorted(map(tuple, G.would_create_cycle(edges, pairs).collect())) == [(0, 5, False), (0, 77, True), (1, 7, False), (1, 500_000, True)]
    assert sum(counted["cycle-seen"]) <= 20 and len(counted["cycle-seen"]) <= 6


def test_viewer_splits_a_folder_over_ranges(spark):
    n = 3000
    rows = [(1, "dir", "application/folder", None, None, 0, None)] + [(10 + k, f"f{k % 7}", "image/png", f"u{k}", None, k % 50, None) for k in range(n)]
    nodes = spark.createDataFrame(rows, "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long")
    edges = edges_of(spark, [(10 + k, 1 if k % 10 else 2) for k in range(n)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps the ranges apart
    try:
        out = C.viewer_neighbours(nodes, edges).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for parent in (1, 2):
        ids = [10 + k for k in sorted((k for k in range(n) if (1 if k % 10 else 2) == parent), key=lambda k: (-(k % 50), f"f{k % 7}", k))]
        want = [(i, at, ids[at - 1] if at else None, ids[at + 1] if at + 1 < len(ids) else None) for at, i in enumerate(ids)]
        assert sorted((r.fs_node_id, r.place, r.previous, r.next) for r in out if r.parent == parent) == sorted(want)


def test_cascade_writes_what_is_new(spark, counted):
    """A tree of five levels: each round writes the nodes that fall in it, not all that have fallen."""
    pairs = [(10 ** k + i, 10 ** (k - 1) + i // 3) for k in range(1, 5) for i in range(3**k)] + [(10_001, 777)]
    pairs = [(c, p) for c, p in pairs]
    ids = sorted({n for e in pairs for n in e})
    nodes = spark.createDataFrame([(i, "n", "image/png", None, None, 0, None) for i in ids], "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long")
    fallen = {r[0] for r in G.cascade(nodes, edges_of(spark, pairs), spark.createDataFrame([(1,)], "fs_node_id long")).collect()}
    assert fallen == set(ids) - {777, 10_001}
    assert counted["cascade"] == [1, 3, 9, 27, 80, 0]


def test_batch_tree_states_count_and_sorted_children(spark):
    """The query names the children of each parent and their number, none left out."""
    sf = "/root/testdata/sf0.001"
    out = registry.QUERIES["batch_tree"](spark, sf)
    assert sorted(out.columns) == ["batch", "children", "n", "parent"]
    rows = out.collect()
    listed = [(r.batch, int(c)) for r in rows for c in r.children.split(",")]
    assert all(r.n == len(r.children.split(",")) and r.children.split(",") == sorted(r.children.split(","), key=int) for r in rows)
    assert sorted(listed) == sorted((r.time_deleted, r.fs_node_id) for r in view(spark, sf, "fx_node").where("time_deleted IS NOT NULL").collect())


def test_pairs_that_an_edge_joins_are_not_walked(spark, counted):
    pairs = [(k, k + 1) for k in range(40)]
    asked = spark.createDataFrame([(p, c) for c, p in pairs] + [(7, 7), (None, 3)], "child long, parent long")
    got = G.would_create_cycle(edges_of(spark, pairs), asked).collect()
    assert sorted((r.child, r.parent) for r in got if r.cycle) == sorted([*((p, c) for c, p in pairs), (7, 7)]) and len(got) == 42
    assert "cycle-seen" not in counted


def test_written_tables_leave_no_shuffle_files(spark):
    shuffles = lambda: {f for _, _, files in os.walk(spark.conf.get("spark.local.dir")) for f in files if f.startswith("shuffle_")}
    before = shuffles()
    out = written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert not shuffles() - before and out.count() == 100 and spark.conf.get(CLEANUP, None) is None


def test_nodes_that_are_crowded_levels_ahead_are_dealt(spark, monkeypatch):
    """The frontier has each node once, yet all of it stands at one node a level on: that level's steps are dealt."""
    monkeypatch.setattr(G, "HOT", 100)
    monkeypatch.setattr(G, "SALTS", 2)
    edges = edges_of(spark, [(10 + k, 1) for k in range(1000)] + [(1, 0)])
    starts = spark.range(10, 1010).select(F.col("id").alias("fs_node_id"))
    hot = G._hot(starts.select(F.col("fs_node_id").alias("start"), "fs_node_id"), G._steps(edges, True), 3)
    assert hot[0] is None and [tuple(map(tuple, h.collect())) for h in hot[1:]] == [((1, 10),), ((0, 10),)]
    found = {(r.start, r.fs_node_id, r.depth) for r in G.closure(edges, starts, up=True).collect()}
    assert found == {(s, n, d) for s in range(10, 1010) for n, d in ((s, 0), (1, 1), (0, 2))}


def walked_levels(monkeypatch):
    """How many levels each round of a walk asks for."""
    seen, hot = [], G._hot
    monkeypatch.setattr(G, "HOT", 50)
    monkeypatch.setattr(G, "_hot", lambda frontier, steps, levels: seen.append(levels) or hot(frontier, steps, levels))
    return seen


def test_large_frontiers_walk_up_one_level_a_round(spark, monkeypatch):
    """The levels of a round lie in one task, so a large frontier must not hold several at a time; a small one still does."""
    seen = walked_levels(monkeypatch)
    pairs = [(1000 + k, 100 + k % 30) for k in range(200)] + [(100 + k, 10 + k % 3) for k in range(30)] + [(10 + k, 1) for k in range(3)]
    reach = above(pairs)
    starts = spark.range(1000, 1200).select(F.col("id").alias("fs_node_id"))
    found = {(r.start, r.fs_node_id) for r in G.closure(edges_of(spark, pairs), starts, up=True).collect()}
    assert found == {(s, n) for s in range(1000, 1200) for n in reach(s)}
    assert seen and set(seen) == {1}
    seen.clear()
    G.closure(edges_of(spark, pairs), starts.limit(5), up=True)
    assert set(seen) == {G.LEVELS}


def test_writes_of_many_rows_are_cut_small(spark, monkeypatch):
    """Partitions of a write are merged to PART_BYTES at most, and cut finer where more rows are moved."""
    seen, names = [], (scratch.ADVISORY, scratch.INITIAL)
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append([spark.conf.get(n, None) for n in names]) or write(self, path))
    before = [spark.conf.get(n, None) for n in names]
    written(spark.range(10), "few")
    written(spark.range(10), "many", rows=100 * scratch.PART_ROWS)
    assert seen == [[str(scratch.PART_BYTES), None], [str(scratch.PART_BYTES), "100"]]
    assert [spark.conf.get(n, None) for n in names] == before


def cuts(spark, monkeypatch):
    """(name, number of partitions asked for) of each table that is written, the number None where it is the session's."""
    seen, write = [], DataFrameWriter.parquet
    cut = lambda: (lambda n: n and int(n))(spark.conf.get(scratch.INITIAL, None))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append((path.rsplit("/", 1)[1][:-33], cut())) or write(self, path))
    return seen


def filed(df, path):
    """The rows from a file, as the given tables come."""
    df.coalesce(1).write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_a_walk_is_cut_by_the_rows_that_it_reads(spark, tmp_path, monkeypatch):
    """From the first write on, when no table of its own tells their number: else the session's few partitions grow with the tables."""
    pairs = [(100 + k, 1 + k % 7) for k in range(300)]
    edges, starts = filed(edges_of(spark, pairs), tmp_path / "e"), filed(spark.range(1, 400).withColumnRenamed("id", "fs_node_id"), tmp_path / "s")
    bytes_read = sum(os.path.getsize(f.removeprefix("file://")) for f in edges.inputFiles())
    assert scratch.rows_read(edges, edges) == bytes_read // scratch.ROW_BYTES and scratch.rows_read(spark.range(3)) == 0
    monkeypatch.setattr(scratch, "PART_ROWS", 10)
    monkeypatch.setattr(G, "HOT", 50)
    seen = cuts(spark, monkeypatch)
    G.closure(edges, starts, up=False)
    assert {name for name, _ in seen} == {"edges", "closure", "crowd"} and all(n and n >= 20 for _, n in seen), seen


def test_a_task_of_a_write_reads_a_small_split(spark, tmp_path, monkeypatch):
    """A split is SPLIT_BYTES at most, however few cores there are, or what the session allows if that is less."""
    for k in range(12):
        spark.range(1000).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    table = lambda: spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get(scratch.SPLIT)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        monkeypatch.setattr(scratch, "SPLIT_BYTES", 9 << 20)  # a small file counts as 4 MB and more, so three are a split
        assert len(written(table(), "split").inputFiles()) == 4
        spark.conf.set(scratch.SPLIT, "5m")
        assert len(written(table(), "split").inputFiles()) == 6 and spark.conf.get(scratch.SPLIT) == "5m"
    finally:
        spark.conf.set(scratch.SPLIT, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert [scratch._bytes(t) for t in ("134217728b", "128MB", "16m", "1g", "7")] == [1 << 27, 1 << 27, 1 << 24, 1 << 30, 7]


def test_large_frontiers_walk_down_one_level_a_round(spark, monkeypatch):
    """A folder that all starts hang below: least depths by two ways, with a cycle."""
    seen = walked_levels(monkeypatch)
    pairs = [(1000 + k, 100 + k % 60) for k in range(200)] + [(100 + k, 1) for k in range(60)] + [(1000, 1), (1, 1007)]
    reach = above([(p, c) for c, p in pairs])
    starts = spark.range(100, 160).union(spark.range(1, 2)).select(F.col("id").alias("fs_node_id"))
    out = G.closure(edges_of(spark, pairs), starts, up=False).collect()
    assert {(r.start, r.fs_node_id) for r in out} == {(s, n) for s in [1, *range(100, 160)] for n in reach(s)}
    assert len(out) == len({(r.start, r.fs_node_id) for r in out}) and next(r.depth for r in out if (r.start, r.fs_node_id) == (1, 1000)) == 1
    assert set(seen[:2]) == {1}


NODE = "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long"


def small_catalogue(spark):
    """Nodes as a union, as the given tables make them: a root, two folders of which one is dead, files held by none, one or both."""
    folders = spark.createDataFrame([(0, "r", C.ROOT, None, 0, 0, None), (1, "a", C.FOLDER, None, 0, 0, None), (2, "b", C.FOLDER, None, 0, 0, 7)], NODE)
    files = spark.createDataFrame([(10 + k, f"{k}", "image/png", f"u{k}", 0, 0, 7 if k == 5 else None) for k in range(8)], NODE)
    return folders.unionByName(files), edges_of(spark, [(1, 0), (2, 0), (10, 1), (11, 2), (12, 1), (12, 2), (14, 99), (15, 2), (16, 1)])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_targets_come_written_and_each_once(spark):
    nodes, edges = small_catalogue(spark)
    listing = spark.createDataFrame([("u0",), ("u0",), ("u1",), ("u3",), ("u4",)], "uri string")
    targets = C.reconcile_targets(nodes, edges, C.missing_files(nodes, listing))
    assert sorted(r.fs_node_id for r in targets.collect()) == [11, 12, 13, 14, 16, 17]
    assert "Join" not in plan_of(targets)  # what reads it reads a table: no join is left to partitions of another size
    # a listing that names a URI often is made small before it meets the files
    assert "Aggregate" in plan_of(C.missing_files(nodes, listing))


def test_reconciled_edges_come_written(spark):
    nodes, edges = small_catalogue(spark)
    after, swept = G.reconcile(nodes, edges, spark.createDataFrame([(13,)], "fs_node_id long"), 50)
    assert "Join" not in plan_of(swept)
    got = {(r.fs_node_id_child, r.fs_node_id_parent): r.time_deleted for r in swept.collect()}
    assert got == {(1, 0): None, (2, 0): None, (10, 1): None, (11, 2): 50, (12, 1): None, (12, 2): 51, (14, 99): 50, (15, 2): 51, (16, 1): None}
    assert sorted(r.fs_node_id for r in after.where("time_deleted = 50").collect()) == [11, 13, 14, 17]


def test_orphans_of_a_union_come_written(spark):
    nodes, edges = small_catalogue(spark)
    out = C.orphan_ids(nodes, edges)
    assert sorted(r.fs_node_id for r in out.collect()) == [11, 13, 14, 17] and "Join" not in plan_of(out)


def test_a_reconciliation_is_cut_by_the_rows_that_it_reads(spark, tmp_path, monkeypatch):
    """Each write from the first on, that of the edges, which come as a union made distinct."""
    nodes, edges = small_catalogue(spark)
    nodes, edges = filed(nodes, tmp_path / "n"), filed(edges, tmp_path / "e").distinct()
    monkeypatch.setattr(scratch, "PART_ROWS", 1)
    seen = cuts(spark, monkeypatch)
    G.reconcile(nodes, edges, spark.createDataFrame([(13,)], "fs_node_id long"), 50)
    assert {"edges", "alive", "orphans", "targets", "cascade", "reconciled"} == {name for name, _ in seen} and all(n and n > 4 for _, n in seen), seen

"""Versioned tables and the streams behind them: writers side by side, failures, replays, late rows, state without a horizon."""

import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from photolake.operators.catalogue import with_row_numbers
from photolake.sources import sinks, snapshots
from photolake.sources.snapshots import Conflict, Snapshots
from photolake.streaming import jobs

NODE = "fs_node_id long, name_display string, type_mime string, uri_storage string, time_modified long, time_created long, time_deleted long"
EDGE = "id long, fs_node_id_child long, fs_node_id_parent long, time_deleted long"
PICK = "uri_storage string, name_display string, type_mime string, picked long, parent long"


@pytest.fixture
def store(spark, tmp_path):
    nodes = [(0, "root", "application/folder-root", None, None, 0, None), (1, "a", "image/png", "u1", None, 1, None), (2, "b", "image/png", "u2", None, 1, 99)]
    out = Snapshots(spark, str(tmp_path / "catalogue"))
    out.create({"nodes": (spark.createDataFrame(nodes, NODE), ["fs_node_id"]), "edges": (spark.createDataFrame([(10, 1, 0, None), (20, 2, 0, 99)], EDGE), ["id"])})
    return out


def new(spark, uris):
    return spark.createDataFrame([(u, u, "image/png", None, 1, None) for u in uris], "uri_storage string, name_display string, type_mime string, time_modified long, time_created long, time_deleted long")


def files(snapshot):
    return {r.uri_storage: (r.fs_node_id, r.name_display, r.time_deleted) for r in snapshot.read("nodes").where("uri_storage is not null").collect()}


def test_two_writers_at_once_number_apart(spark, store, monkeypatch):
    both_read, first = threading.Barrier(2), threading.local()
    put, taken = snapshots._put_once, []

    def put_after_both(*args):
        if not getattr(first, "done", False):  # both have read version 1 and written their rows
            first.done = True
            both_read.wait(60)
        try:
            put(*args)
        except Conflict:
            taken.append(args[2])
            raise

    monkeypatch.setattr(snapshots, "_put_once", put_after_both)
    threads = [threading.Thread(target=sinks.append_nodes, args=(store, new(spark, uris))) for uris in (["x", "y", None], ["z", "y"])]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    now = store.at()
    ids = [r.fs_node_id for r in now.read("nodes").collect()]
    assert len(taken) == 1 and now.version == 3
    assert len(ids) == len(set(ids)) == 6 and set(files(now)) == {"u1", "u2", "x", "y", "z"}


def test_failed_append_changes_nothing(spark, store, monkeypatch):
    before = files(store.at())
    with monkeypatch.context() as m:
        m.setattr(snapshots, "_put_once", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            sinks.append_nodes(store, new(spark, ["x"]))
    assert store.version() == 1 and files(store.at()) == before
    sinks.append_edges(store, spark.createDataFrame([(30, 1, 0, None), (40, 1, 2, None), (40, 1, 2, None)], EDGE))
    store.clean()
    assert files(store.at()) == before and sorted(r.id for r in store.at().read("edges").collect()) == [10, 20, 40]
    store.clean(keep=1)
    assert store.version() == 2 and store.at().read("edges").count() == 3
    with pytest.raises(Conflict):
        store.create({"nodes": (spark.createDataFrame([], NODE), ["fs_node_id"])})


def test_many_changes_are_written_anew(spark, store, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_CHANGES", 2)
    for k in range(4):
        sinks.append_nodes(store, new(spark, [f"n{k}", "n0"]))
    now = store.at()
    assert len(now.manifest["tables"]["nodes"]["parts"]) <= 3
    assert sorted(i for i, _, _ in files(now).values()) == [1, 2, 3, 4, 5, 6]
    assert store.at(2).read("nodes").count() == 4  # earlier versions stay


def test_batch_sent_again_changes_nothing(spark, store):
    picks = spark.createDataFrame([("u2", "again", "image/jpeg", 5, 0), ("u3", "new", "image/jpeg", 6, 0), ("u3", "later", "image/jpeg", 7, 1), (None, "x", "x", 1, 0), ("u1", "no", "x", 1, 1)], PICK)
    one = jobs.import_batch(store, picks, 0)
    assert files(one) == {"u1": (1, "a", None), "u2": (2, "again", None), "u3": (3, "new", None)}
    assert sorted((r.fs_node_id_child, r.fs_node_id_parent, r.time_deleted) for r in one.read("edges").collect()) == [(1, 0, None), (1, 1, None), (2, 0, None), (3, 0, None), (3, 1, None)]
    two = jobs.import_batch(store, picks, 0)
    assert two.version == one.version
    assert jobs.import_batch(store, picks, 1).read("nodes").count() == one.read("nodes").count()


def test_killed_stream_goes_on_where_it_was(spark, store, tmp_path, monkeypatch):
    """A run that dies between the commit and the checkpoint of its second batch; picks come 60 days and more late."""
    day = 86_400
    for k, (uri, picked) in enumerate([("p1", 100 * day), ("p2", 40 * day), ("p1", 1), ("p3", 2)]):
        spark.createDataFrame([(uri, f"{uri}-{k}", "image/jpeg", picked, 0)], PICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(PICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent, commit = [], jobs.import_batch

    def dies(catalogue, rows, number):
        out = commit(catalogue, rows, number)
        sent.append(number)
        if sent == [0, 1]:
            raise RuntimeError("killed")
        return out

    monkeypatch.setattr(jobs, "import_batch", dies)
    with pytest.raises(Exception, match="killed"):
        jobs.import_stream(store, stream(), str(tmp_path / "state"), str(tmp_path / "listings"))
    jobs.import_stream(store, stream(), str(tmp_path / "state"), str(tmp_path / "listings"))
    now = store.at()
    assert sent == [0, 1, 1, 2, 3] and now.version == 5 and now.marks == {"import": 3}
    assert {u: n for u, (_, n, _) in files(now).items()} == {"u1": "a", "u2": "b", "p1": "p1-0", "p2": "p2-1", "p3": "p3-3"}
    last = spark.read.parquet(str(tmp_path / "listings")).where("batch = 3")
    assert sorted(r.uri_storage for r in last.collect()) == ["p1", "p2", "p3", "u1"]


def test_recent_list_of_idle_users_and_odd_rows(spark, tmp_path):
    """A user who comes back after two years finds the list as it was."""
    batches = [[(1, "a", "2020-01-01"), (1, "b", "2020-01-02"), (2, "z", "2020-01-01")], [(2, "y", "2021-06-01"), (None, "q", "2021-06-01"), (2, None, None)], [(1, "c", "2022-01-01"), (1, "a", "2019-01-01"), (1, "d", None), (2, None, "2021-07-01")]]
    for rows in batches:
        spark.createDataFrame(rows, "user_id long, item string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("user_id long, item string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.drained(jobs.recent_stream(events, 3), "update", "recent-test")
    last = {r.user_id: r["items"] for r in out.groupBy("user_id").agg(F.max_by("items", "batch").alias("items")).collect()}
    assert last == {1: ["c", "b", "a"], 2: [None, "y", "z"], None: ["q"]}


def test_row_numbers_keep_columns_of_any_name(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.lit("p").alias("part"), F.lit("o").alias("own"), F.lit("b").alias("before"), F.lit("x").alias("row_"), F.lit("y").alias("by_"))
    out = with_row_numbers(rows, "k")
    assert out.columns == [*rows.columns, "row_number"]
    assert [tuple(r) for r in out.orderBy("row_number").collect()] == [(k, "p", "o", "b", "x", "y", k + 1) for k in range(500)]
    with pytest.raises(ValueError, match="row_number"):
        with_row_numbers(out, "k")


def test_a_batch_of_arrivals_is_a_part_of_many_files(spark, monkeypatch):
    """Parts follow each other in order, repeated and missing values among them, though each is written by several tasks."""
    monkeypatch.setattr(jobs, "FILE_ROWS", 50)
    ids = [k * 7 % 1000 for k in range(1000)] + [500] * 40 + [None] * 3
    events = spark.createDataFrame([(k, f"i{k}") for k in ids], "event_id long, item string").repartition(3)
    stream = jobs.arrivals(events, "test", "event_id")
    rows = jobs.drained(stream, "append", "arrivals-test").collect()
    assert sorted((r.event_id is not None, r.event_id) for r in rows) == sorted((k is not None, k) for k in ids)
    spans = {b: [-1 if r.event_id is None else r.event_id for r in rows if r.batch == b] for b in range(4)}
    assert all(max(spans[b]) < min(spans[b + 1]) for b in range(3)) and {r.batch for r in rows} == set(spans)
    same = jobs.arrivals(spark.createDataFrame([(5,)] * 300 + [(6,)], "event_id long"), "test", "event_id")
    assert sorted((r.batch, r.event_id) for r in jobs.drained(same, "append", "arrivals-same").distinct().collect()) == [(0, 5), (1, 6)]


def test_arrivals_of_a_large_part_have_more_files_than_one(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 50)
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: written.append(path) or write(self, path))
    jobs.arrivals(spark.range(1000).withColumnRenamed("id", "event_id"), "test", "event_id")
    assert len(written) == 4 and len(spark.read.parquet(written[0]).inputFiles()) >= 16


@pytest.mark.parametrize("few", [0, 100])
def test_import_meets_the_edges_under_its_parents_alone(spark, tmp_path, monkeypatch, few):
    """Edges of other folders do not move, and a changed edge counts by what it is now; with many parents all edges meet the pairs."""
    store = Snapshots(spark, str(tmp_path / "c"))
    nodes = spark.createDataFrame([(1, "a", "image/png", "u1", None, 1, None), (2, "b", "image/png", "u2", None, 1, 9)], NODE)
    store.create({"nodes": (nodes, ["fs_node_id"]), "edges": (spark.createDataFrame([(k, 1, k, None) for k in range(50)] + [(90, 2, 7, 9)], EDGE), ["id"])})
    store.update(lambda now: {"edges": spark.createDataFrame([(3, 1, 70, None), (60, 1, 7, 8)], EDGE)})
    monkeypatch.setattr(jobs, "FEW", few)
    met, links = [], jobs.link_changes
    monkeypatch.setattr(jobs, "link_changes", lambda edges, pairs: met.append(edges.count()) or links(edges, pairs))
    picks = [("u1", "x", "image/png", 1, 3), ("u2", "y", "image/png", 2, 7), ("u1", "x", "image/png", 3, 70), ("u2", "z", "image/png", 1, 7), ("u9", "n", "image/png", 4, 7)]
    now = jobs.import_batch(store, spark.createDataFrame(picks, PICK), 0)
    assert met == [52 if few == 0 else 4]  # ids 7, 60 and 90 under 7, and 3, which went from 3 to 70
    assert files(now) == {"u1": (1, "a", None), "u2": (2, "z", None), "u9": (3, "n", None)}
    live = {(r.id, r.fs_node_id_child, r.fs_node_id_parent) for r in now.read("edges").where("time_deleted IS NULL").collect()}
    assert live == {(k, 1, k) for k in range(50) if k != 3} | {(3, 1, 70), (10000003, 1, 3), (90, 2, 7), (30000007, 3, 7)}


def test_listing_reads_the_edges_under_its_parents_alone(spark, store, monkeypatch):
    now = store.update(lambda now: {"edges": spark.createDataFrame([(k, 1, k, None) for k in range(30, 60)] + [(20, 2, 0, None), (61, 0, 30, 5)], EDGE)})
    seen, read = [], snapshots.Snapshot.read
    monkeypatch.setattr(snapshots.Snapshot, "read", lambda self, name, *only: seen.append((name, read(self, name, *only).count())) or read(self, name, *only))
    out = jobs.listing(now, spark.createDataFrame([(30,), (0,), (30,), (None,)], "parent long")).collect()
    assert sorted((r.parent, r.uri_storage) for r in out) == [(0, "u1"), (30, "u1")] and dict(seen)["edges"] == 4

"""Walks over the catalogue's edges as set-at-a-time fixpoints: frontier joins, distinct, anti-joins with what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.sources.scratch import discard, rows_read, small_tasks, written

from .catalogue import ROOT, dead_parent_edges, live, reconcile_targets, sweep_dead_edges


#: A node that more frontier rows stand at is stepped from in a part for each HOT rows, SALTS parts at least; levels that a
#: round walks before it writes; steps of a node up to which a graph counts as narrow.
HOT, SALTS, LEVELS, NARROW = 100_000, 64, 4, 4


def stepped(frontier: DataFrame, steps: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(start, fs_node_id) one step on from the frontier (start, fs_node_id) over ``steps`` (fs_node_id, to).

    ``hot`` (fs_node_id, parts) lists nodes at which much of the frontier stands: their frontier rows are dealt by start to
    so many keys, and their steps copied to each.
    """
    if hot is None:
        return frontier.join(steps, "fs_node_id").select("start", F.col("to").alias("fs_node_id")).distinct()
    many = frontier.join(F.broadcast(hot), "fs_node_id", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("start"), "parts"), F.lit(0).cast("long"))).drop("parts")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts") - 1, F.lit(0).cast("long")))
    few = steps.join(F.broadcast(hot), "fs_node_id", "left").select("fs_node_id", "to", F.explode(copies).alias("salt"))
    return many.join(few, ["fs_node_id", "salt"]).select("start", F.col("to").alias("fs_node_id")).distinct()


def _hot(frontier: DataFrame, steps: DataFrame, levels: int) -> list[DataFrame | None]:
    """For each of the next ``levels`` the nodes (fs_node_id, parts) at which more than HOT rows of the walk stand, a part for each HOT.

    Paths are counted a node, not a start, so this costs a pass over the steps a level; no node holds more rows than there
    are starts. So few nodes are crowded that they are broadcast: at most one for each HOT rows.
    """
    size = frontier.count()
    if size <= HOT:
        return [None] * levels  # rows at a node are starts, and each start is a row of the frontier
    out = []
    with small_tasks(frontier.sparkSession, max(size, steps.count())):
        starts = F.lit(frontier.select("start").distinct().count()).cast("double")
        at = written(frontier.groupBy("fs_node_id").agg(F.count(F.lit(1)).cast("double").alias("rows")), "crowd")
        for level in range(levels):
            hot = at.where(F.col("rows") > HOT).select("fs_node_id", F.greatest(F.ceil(F.col("rows") / HOT), F.lit(SALTS)).alias("parts"))
            out.append(None if hot.isEmpty() else hot)
            if level + 1 < levels:
                at = written(at.join(steps, "fs_node_id").groupBy(F.col("to").alias("fs_node_id")).agg(F.least(F.sum("rows"), starts).alias("rows")), "crowd")
    return out


def _steps(edges: DataFrame, up: bool) -> DataFrame:
    a, b = ("fs_node_id_child", "fs_node_id_parent") if up else ("fs_node_id_parent", "fs_node_id_child")
    with small_tasks(edges.sparkSession, rows_read(edges)):
        return written(live(edges).select(F.col(a).alias("fs_node_id"), F.col(b).alias("to")).where("fs_node_id IS NOT NULL AND to IS NOT NULL").distinct(), "edges")


def closure(edges: DataFrame, starts: DataFrame, up: bool, max_depth: int = 1000) -> DataFrame:
    """(start, fs_node_id, depth): what is reached over live edges from each start, itself at depth 0, least depth.

    ``starts`` has a column fs_node_id. A round walks a level, or LEVELS of them where the frontier is small, and writes what
    is new; a node once reached from a start leaves the frontier, so cycles and diamonds end. A large frontier goes one level
    a round, because the levels of a round lie in one task and their memory adds up.
    """
    steps = _steps(edges, up)
    frontier = starts.select(F.col("fs_node_id").alias("start"), "fs_node_id").distinct().withColumn("depth", F.lit(0))
    known = frontier = written(frontier, "closure", rows_read(starts))
    depth, rows, links = 0, frontier.count(), steps.count()
    while depth < max_depth:
        levels = LEVELS if frontier.count() <= HOT else 1
        layer, found = frontier.drop("depth"), None
        for k, hot in enumerate(_hot(layer, steps, levels), 1):
            layer = stepped(layer, steps, hot)
            here = layer.withColumn("depth", F.lit(depth + k))
            found = here if found is None else found.unionByName(here)
        new = found if levels == 1 else found.groupBy("start", "fs_node_id").agg(F.min("depth").alias("depth"))
        new = written(new.join(known, ["start", "fs_node_id"], "left_anti"), "closure", max(rows, links))
        known = known.unionByName(new)
        depth, rows = depth + levels, rows + new.count()
        frontier = new.where(F.col("depth") == depth)
        if frontier.isEmpty():
            discard(steps)
            return known
    raise RuntimeError(f"deeper than {max_depth}")


def would_create_cycle(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(child, parent, cycle): would linking the child under the parent close a cycle; a node under itself does.

    It does if the child is reached upwards from the parent. Pairs of one node, and those that an edge joins, are settled as
    they are read; only what is left is walked. Both ends are walked, in each round from the side whose next steps are fewer,
    and a pair is settled when the sides meet or one of them ends; settled pairs drop out with what only they asked for. So a
    folder of a million children is not walked down where its few parents answer, nor a long chain twice.
    """
    key = ["child", "parent"]
    links = _steps(edges, True)  # (fs_node_id, to): child and parent, once for both directions
    asked = pairs.select(*key, F.lit(True).alias("asked"), F.lit(False).alias("joined"))
    joined = links.select(F.col("to").alias("child"), F.col("fs_node_id").alias("parent"), F.lit(False), F.lit(True))
    either = asked.union(joined).groupBy(*key).agg(F.max("asked").alias("asked"), F.max("joined").alias("joined")).where("asked")
    cycle = F.when(F.col("joined") | (F.col("child") == F.col("parent")), True).when(F.col("child").isNull() | F.col("parent").isNull(), False)
    first = written(either.select(*key, cycle.alias("cycle")), "cycle-pairs")
    done, open_ = [first.where("cycle IS NOT NULL")], first.where("cycle IS NULL").select(*key)
    sides = {}
    if not open_.isEmpty():
        for end, up in (("parent", True), ("child", False)):
            seen = written(open_.select(F.col(end).alias("start"), F.col(end).alias("fs_node_id")).distinct(), "cycle-seen")
            steps = links if up else links.select(F.col("to").alias("fs_node_id"), F.col("fs_node_id").alias("to"))
            degrees = written(steps.groupBy("fs_node_id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
            # where no node has many steps, several levels at a time cost little more than one
            narrow = (degrees.agg(F.max("degree")).first()[0] or 0) <= NARROW
            sides[end] = {"seen": seen, "last": seen, "steps": steps, "degrees": degrees, "levels": LEVELS if narrow else 1}
    while sides and not open_.isEmpty():
        frontier = {e: s["last"].join(open_.select(F.col(e).alias("start")).distinct(), "start", "left_semi") for e, s in sides.items()}
        cost = {e: frontier[e].join(s["degrees"], "fs_node_id").agg(F.sum("degree")).first()[0] or 0 for e, s in sides.items()}
        end = min(cost, key=lambda e: (cost[e], e))
        if not cost[end]:  # no step leads on from this side: what is known of it is all
            done.append(open_.withColumn("cycle", F.lit(False)))
            break
        there = "child" if end == "parent" else "parent"
        s, other = sides[end], sides[there]
        layer, found = frontier[end], None
        for level, hot in enumerate(_hot(layer, s["steps"], s["levels"])):
            layer = stepped(layer, s["steps"], hot)
            here = layer.withColumn("level", F.lit(level))
            found = here if found is None else found.unionByName(here)
        found = found.groupBy("start", "fs_node_id").agg(F.min("level").alias("level"))
        new = written(found.join(s["seen"], ["start", "fs_node_id"], "left_anti"), "cycle-seen")
        s["last"], new = new.where(F.col("level") == s["levels"] - 1).drop("level"), new.drop("level")
        s["seen"] = s["seen"].unionByName(new)
        # the places that an open pair's other side knows, met by the new ones of this side
        near = open_.join(other["seen"].select(F.col("start").alias(there), "fs_node_id"), there)
        met = near.join(new.select(F.col("start").alias(end), "fs_node_id"), [end, "fs_node_id"], "left_semi").select(*key).distinct()
        on = s["last"].select(F.col("start").alias(end)).distinct()
        judged = open_.join(met.withColumn("met", F.lit(True)), key, "left").join(on.withColumn("on", F.lit(True)), end, "left")
        judged = written(judged.select(*key, F.when(F.col("met"), True).when(F.col("on").isNull(), False).alias("cycle")), "cycle-judged")
        done.append(judged.where("cycle IS NOT NULL"))
        open_ = judged.where("cycle IS NULL").select(*key)
    # what is returned reads the settled pairs alone
    discard(links, *[t for s in sides.values() for t in (s["seen"], s["degrees"])])
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("child", "parent", "cycle")


def cascade(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """fs_node_id of all nodes that fall when the targets are deleted.

    Live targets other than the root fall. A live child falls when its last live edge goes, that is when all parents of
    its live edges have fallen. The set only grows, so the order of deletions does not matter.
    """
    spark = nodes.sparkSession
    with small_tasks(spark, rows_read(nodes, edges)):
        alive = written(live(nodes).where(F.col("type_mime") != ROOT).select("fs_node_id"), "alive")
        links = written(live(edges).select(F.col("fs_node_id_parent").alias("parent"), F.col("fs_node_id_child").alias("fs_node_id")), "edges")
    with small_tasks(spark, links.count() + alive.count()):
        new = fallen = written(targets.select("fs_node_id").distinct().join(alive, "fs_node_id", "left_semi"), "cascade")
        while not new.isEmpty():
            # only a child of what fell last can have lost its last parent just now
            below = links.join(new.select(F.col("fs_node_id").alias("parent")), "parent", "left_semi").select("fs_node_id").distinct()
            below = below.join(alive, "fs_node_id", "left_semi").join(fallen, "fs_node_id", "left_anti")
            held = links.join(below, "fs_node_id", "left_semi").join(fallen.select(F.col("fs_node_id").alias("parent")), "parent", "left_anti").select("fs_node_id")
            new = written(below.join(held, "fs_node_id", "left_anti"), "cascade")
            fallen = fallen.unionByName(new)
    discard(alive, links)
    return fallen


def soft_delete(nodes: DataFrame, edges: DataFrame, targets: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Both tables after the deletion of the targets: fallen nodes and their live edges up and down carry the stamp ``at``."""
    fallen = cascade(nodes, edges, targets).withColumn("fell", F.lit(True))
    stamp = F.lit(at).cast("long")
    new_nodes = nodes.join(fallen, "fs_node_id", "left").withColumn("time_deleted", F.when(F.col("fell"), stamp).otherwise(F.col("time_deleted"))).select(*nodes.columns)
    up = fallen.select(F.col("fs_node_id").alias("fs_node_id_child"), F.col("fell").alias("fell_child"))
    down = fallen.select(F.col("fs_node_id").alias("fs_node_id_parent"), F.col("fell").alias("fell_parent"))
    joined = edges.join(up, "fs_node_id_child", "left").join(down, "fs_node_id_parent", "left")
    touched = F.coalesce("fell_child", "fell_parent").isNotNull() & F.col("time_deleted").isNull()
    return new_nodes, joined.withColumn("time_deleted", F.when(touched, stamp).otherwise(F.col("time_deleted"))).select(*edges.columns)


def delete_forever(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the dead ids, what hangs below them in the same batch, and every edge that touches these."""
    dead = nodes.where(F.col("time_deleted").isNotNull() & (F.col("type_mime") != ROOT)).select("fs_node_id", F.col("time_deleted").alias("batch"))
    steps = edges.where(F.col("time_deleted").isNotNull()).select(F.col("fs_node_id_parent").alias("fs_node_id"), F.col("fs_node_id_child").alias("to"), F.col("time_deleted").alias("batch"))
    gone = frontier = written(dead.join(ids.select("fs_node_id").distinct(), "fs_node_id", "left_semi"), "forever")
    while True:
        found = frontier.join(steps, ["fs_node_id", "batch"]).select(F.col("to").alias("fs_node_id"), "batch").distinct().join(dead, ["fs_node_id", "batch"], "left_semi")
        frontier = written(found.join(gone, ["fs_node_id", "batch"], "left_anti"), "forever")
        if frontier.isEmpty():
            break
        gone = gone.unionByName(frontier)
    gone = gone.select("fs_node_id").distinct()
    kept = edges
    for end in ("fs_node_id_child", "fs_node_id_parent"):
        kept = kept.join(gone.select(F.col("fs_node_id").alias(end)), end, "left_anti")
    return nodes.join(gone, "fs_node_id", "left_anti"), kept.select(*edges.columns)


def reconcile(nodes: DataFrame, edges: DataFrame, missing: DataFrame, at: int) -> tuple[DataFrame, DataFrame]:
    """Deletes missing files and orphans with the stamp ``at``, then sweeps edges under dead parents with ``at + 1``.

    The edges are written before, since four steps read them, and after, so that no task holds more than a small partition.
    """
    whole = written(edges, "edges", rows_read(edges))
    nodes, edges = soft_delete(nodes, whole, reconcile_targets(nodes, whole, missing), at)
    out = written(sweep_dead_edges(nodes, edges, at + 1), "reconciled", whole.count())
    discard(whole)
    return nodes, out


__all__ = ["cascade", "closure", "dead_parent_edges", "delete_forever", "reconcile", "soft_delete", "would_create_cycle"]

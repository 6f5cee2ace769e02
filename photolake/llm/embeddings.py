"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, freeing, written

COSINE, RECALL, SEED = 0.9, 0.995, 7
#: Mean number of vectors of a code, were they spread evenly.
CROWD = 4
#: Members of a bucket that one task compares at once. A larger bucket is cut into blocks, and each pair of blocks is a
#: piece of work of its own.
BLOCK = 1024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key_, v (array of double): vectors with a length above 0 and finite components only, scaled to length 1."""
    rows = vectors.select(F.col(key).cast("long").alias("key_"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    # the largest component is divided out first, so that no square overflows or vanishes
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rows = rows.withColumn("top", top).where("top > 0").withColumn("v", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("key_", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def coded(rows: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """id_, v (binary of doubles), width, codes (binary of ``tables`` 32-bit sign codes)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            codes: list[bytes] = [b""] * len(sizes)
            for width in np.unique(sizes):
                if width not in planes:
                    planes[width] = np.random.default_rng([seed, int(width)]).standard_normal((int(width), tables * bits))
                own = np.flatnonzero(sizes == width)
                block = np.stack([flat[at[i] : at[i + 1]] for i in own])
                signs = (block @ planes[width] >= 0).reshape(len(own), tables, bits)
                packed = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                for i, c in zip(own, packed, strict=True):
                    codes[i] = c.tobytes()
            vectors = [flat[at[i] : at[i + 1]].tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int32()), pa.array(codes, pa.binary())],
                ["id_", "v", "width", "codes"],
            )

    return rows.mapInArrow(freeing(code), "id_ long, v binary, width int, codes binary")


def tables_and_bits(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits of a code, so that ``n`` evenly spread vectors are about CROWD to a code, and the tables that then keep ``recall`` at the threshold.

    Two vectors at the threshold agree in a bit with the probability 1 - angle / pi. So the chance meetings of a table grow
    with n, not with its square, and the tables with about the fifth root of n.
    """
    bits = max(4, math.ceil(math.log2(max(n, 1) / CROWD))) if n > CROWD else 4
    bits = min(bits, 30)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))), bits


def _linked(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, table: int, cosine: float, same: bool) -> np.ndarray:
    """Index pairs with the least cosine that meet in ``table`` and in no table before it."""
    i, j = np.nonzero(x @ y.T >= cosine)
    if same:
        i, j = i[i < j], j[i < j]
    for a in range(0, len(i), 200_000):
        part = slice(a, a + 200_000)
        if table and len(i[part]):
            earlier = (cx[i[part], :table] == cy[j[part], :table]).any(axis=1)
            i[part] = np.where(earlier, -1, i[part])
    held = i >= 0
    return np.stack([i[held], j[held]])


def compared(members: DataFrame, tables: int, cosine: float) -> DataFrame:
    """(a, b, n): with b null, n links of vector a; else an edge a-b. The edges connect what the links connect."""

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, kept = ["table", "code", "width", "cell"], None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            change = (batch[by] != batch[by].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(change)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield batch.iloc[a:b]
            kept = batch.iloc[starts[-1] :] if len(starts) else kept
        if kept is not None and len(kept):
            yield kept

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, counts, edges, held = [], [], [], 0
        for group in groups(batches):
            if len(group) < 2:
                continue
            table, width = int(group.table.iat[0]), int(group.width.iat[0])
            v = np.frombuffer(b"".join(group.v), np.float64).reshape(-1, width)
            codes = np.frombuffer(b"".join(group.codes), np.int32).reshape(-1, tables)
            own, side, weight = group.id_.to_numpy(), group.side.to_numpy(), group.copies.to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
            pairs = [_linked(v[left], v[left], codes[left], codes[left], table, cosine, True)] if not len(right) else []
            if len(right):
                i, j = _linked(v[left], v[right], codes[left], codes[right], table, cosine, False)
                pairs = [np.stack([i, j + len(left)])]
                own, weight = np.concatenate([own[left], own[right]]), np.concatenate([weight[left], weight[right]])
            i, j = pairs[0]
            if not len(i):
                continue
            n = np.bincount(i, weight[j], len(own)) + np.bincount(j, weight[i], len(own))
            some = np.flatnonzero(n)
            ids.append(own[some]), counts.append(n[some].astype(np.int64))
            edges.append(_stars(own, i, j))
            held += len(some)
            if held > 50_000:
                yield _rows(ids, counts, edges)
                ids, counts, edges, held = [], [], [], 0
        if ids:
            yield _rows(ids, counts, edges)

    return members.mapInPandas(freeing(compare), "a long, b long, n long")


def _stars(own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each linked member with the smallest member that it reaches inside the block: as many edges as members."""
    label = own.copy()
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == label).all():
            break
        label = new
    moved = label != own
    return np.stack([own[moved], label[moved]])


def _rows(ids: list, counts: list, edges: list) -> pd.DataFrame:
    a, n, e = np.concatenate(ids), np.concatenate(counts), np.concatenate(edges, axis=1)
    return pd.DataFrame({"a": np.concatenate([a, e[0]]), "b": pd.array([None] * len(a) + e[1].tolist(), dtype="Int64"), "n": np.concatenate([n, np.zeros(len(e[0]), np.int64)])})


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL, seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``vectors``: key, n_links, component_id, kept.

    ``n_links``: other vectors with a cosine of at least ``cosine`` (in double precision) that share a code in some
    table; ``component_id``: the smallest key reachable by links, itself included. A pair at the threshold is met with
    the probability ``recall``, one of cosine 0.95 practically always. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing; vectors of different lengths never link. Equal vectors are compared as
    one and count as links of each other. Rows that repeat a key are one vector each for the counts and share a
    component; a row without a key has null for all but n_links, which is 0. Other columns are not read.
    An empty table gives an empty result.
    """
    tables, bits = tables_and_bits(vectors.count(), cosine, recall)
    rows = written(coded(usable(vectors, key, vector), tables, bits, seed), "coded")
    rows_table = rows
    rows = rows.where("id_ is not null").withColumn("same", F.md5(F.concat("v", F.lit("").cast("binary"))))
    reps = written(rows.groupBy("same").agg(F.min("id_").alias("id_"), F.min("v").alias("v"), F.min("width").alias("width"), F.min("codes").alias("codes"), F.count(F.lit(1)).alias("copies")), "vectors")
    code = lambda t: F.conv(F.hex(F.substring("codes", 4 * t + 1, 4)), 16, 10).cast("long")
    keys = reps.select("id_", "width", F.posexplode(F.array(*[code(t) for t in range(tables)])).alias("table", "code"))
    sizes = keys.groupBy("table", "code", "width").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = keys.join(sizes, ["table", "code", "width"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    met = met.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id_", "table"), F.col("blocks"))).otherwise(0).cast("int"))
    # block k takes part in the cells (k, k), (k, later) as the left side and (earlier, k) as the right side
    cell = lambda a, b: a * F.col("blocks") + b
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.when(k >= F.col("own"), F.struct(cell(F.col("own"), k).cast("long").alias("cell"), F.lit(0).alias("side"))).otherwise(F.struct(cell(k, F.col("own")).cast("long").alias("cell"), F.lit(1).alias("side"))))
    met = met.select("id_", "width", "table", "code", F.explode(cells).alias("c")).select("id_", "width", "table", "code", "c.cell", "c.side")
    members = met.join(reps.select("id_", "v", "codes", "copies"), "id_")
    by = ["table", "code", "width", "cell"]
    found = written(compared(members.repartition(*by).sortWithinPartitions(*by), tables, cosine), "links")
    classes = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("id_")).agg(F.sum("n").alias("n"))
    named = reps.select("same", "id_", "copies").join(counts, "id_", "left").join(classes.withColumnRenamed("node", "id_"), "id_", "left")
    links = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long")
    named = named.select("same", links.alias("n_links"), F.coalesce("component", "id_").alias("component_id"))
    # per row again: a key's rows may be usable and unusable ones
    linked = rows.select("id_", "same").join(named, "same").groupBy("id_").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    linked = written(linked, "linked")
    discard(rows_table, reps, found, classes)
    out = vectors.select(F.col(key).cast("long").alias("id_")).join(linked, "id_", "left")
    out = out.select(F.col("id_").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id_").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))

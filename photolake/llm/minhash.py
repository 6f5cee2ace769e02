"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

1. One pass counts in how many documents each shingle bin occurs (a fixed number of bins, as feature hashing does).
2. One pass draws the weighted samples of every document and keeps its bands and one byte of each sample. Documents of
   equal text go on as one representative.
3. First round: representatives that share a band meet. In a bucket each is held against the leaders seen so far by its
   samples and its total weight; one that is much like a leader stays with it, any other becomes a leader too. Each is
   paired with the leader that is most like it. These pairs are verified by the exact weighted Jaccard similarity of
   their whole texts and give classes by distributed connected components.
4. Second round: the buckets that hold more than one class meet, all members in cells of two blocks: every pair that may
   be similar enough and whose two classes differ is verified as well. So a group of copies gives about as many pairs as
   it has members and bands, not all pairs of the group, and no link between classes is left out. Here a pair must also
   pass by its shingles of lowest hash, a sharper estimate that is made for the members of these buckets alone.
5. The links of both rounds give the final classes.

Buckets of every size are treated by the same rules; BLOCK only says how many members a task holds at once. Verification
moves the texts of candidates alone: a bitmap of bounded size spares all others the shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import discard, freeing, key_bitmap, marked, written
from .words import mix, pieces, raw, shingles, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
#: Shingle bins for document frequencies. A shingle in less than COMMON of the documents weighs 1 for each time it
#: occurs; above that its weight falls with the logarithm of its share, to LEAST for one that is everywhere.
BINS, COMMON, LEAST = 1 << 20, 1 / 256, 0.1
_BLOCK = 1 << 14
#: Members of a bucket that make a block of a cell, of which a task compares two at most; members that are led in one go.
BLOCK, LEAD_BLOCK = 500, 250
#: How far under the similarity a pair's estimate may lie for it to be verified (2.7 standard deviations), and from which
#: estimate on a member needs no place among the leaders.
MARGIN, COVERED = 0.12, 0.85
#: A pair of different classes must also pass by its shingles of lowest hash, up to LOWEST of each text (of shorter texts
#: that is all of them). Weights that differ blur this estimate: a longer text whose mean squared weight is more than SKEW
#: times its squared mean weight keeps none and passes; up to there LOW_MARGIN is 3.4 standard deviations at least.
LOWEST, LOW_MARGIN, SKEW = 256, 0.12, 2.0
_LOW = np.dtype([("hash", np.uint32), ("weight", np.float32)])


def _bins(shingle: np.ndarray) -> np.ndarray:
    return (shingle & np.uint64(BINS - 1)).astype(np.int64)


def _counted(hashed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row with their counts, and offsets."""
    shingle, to = shingles(hashed, at, SHINGLE)
    if not len(shingle):
        return shingle, np.zeros(0), to
    out, counts, sizes = [], [], []
    for i in range(len(to) - 1):
        own = np.sort(shingle[to[i] : to[i + 1]])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        out.append(own[first])
        counts.append(np.diff(np.append(first, len(own))))
        sizes.append(len(first))
    return np.concatenate(out), np.concatenate(counts).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


def idf_table(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, weight) of the bins that more than COMMON of the documents share; never more than BINS rows.

    Other shingles that fall into a bin add BINS-th of all occurrences to its count; that mean load is taken off.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for part in pieces(batch, "text_"):
                shingle, to = shingles(*words(part.column(0)), SHINGLE)
                n += part.num_rows
                if len(shingle):
                    own = [np.unique(_bins(shingle[to[i] : to[i + 1]])) for i in range(len(to) - 1)]
                    total += np.bincount(np.concatenate(own), minlength=BINS)
        for k in range(0, BINS, _BLOCK):
            yield pa.RecordBatch.from_pydict({"block": [k // _BLOCK], "counts": [zlib.compress(total[k : k + _BLOCK].tobytes(), 1)]})
        yield pa.RecordBatch.from_pydict({"block": [-1], "counts": [zlib.compress(np.int64(n).tobytes())]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
                sums[block] = sums[block] + got if block in sums else got
        for block, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(block * _BLOCK + some, pa.int64()), "df": pa.array(total[some], pa.int64())})

    counted = docs.select(F.col(text).alias("text_")).mapInArrow(freeing(count), "block long, counts binary")
    table = written(counted.repartition(16, "block").mapInArrow(freeing(add), "bin long, df long"), "idf")
    total, load = table.agg(F.sum(F.when(F.col("bin") < 0, F.col("df"))), F.sum(F.when(F.col("bin") >= 0, F.col("df")) / BINS)).first()
    total, load = total or 0, load or 0.0
    rows = table.where((F.col("bin") >= 0) & (F.col("df") - load > max(2.0, COMMON * total))).toPandas()
    discard(table)
    share = np.clip((rows.df.to_numpy() - load) / max(total, 1), 1e-12, 1.0)
    weight = np.clip(np.log(1 / share) / np.log(1 / COMMON), LEAST, 1.0)
    order = np.argsort(rows["bin"].to_numpy())
    return rows["bin"].to_numpy()[order], weight[order]


class Weights:
    """Weights of shingles: counts times the idf of their bins."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.idf = np.ones(BINS, dtype=np.float32)
        self.idf[table[0]] = table[1]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shingle, counts, to = _counted(*words(column))
        return shingle, counts * self.idf[_bins(shingle)], to


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal parts, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling (Ioffe): r and c from Gamma(2, 1) and beta uniform, all hashed from (shingle, k).

    16 bits of the hash each pick r and c among as many equal parts of their distribution and beta. Values are positive,
    so their bits sort alike.
    """

    def __init__(self, samples: int):
        self.gamma, self.samples = _gamma_quantiles(1 << 16).astype(np.float32), samples
        self.factors = mix(np.arange(samples, dtype=np.uint64), 5) | np.uint64(1)

    def sign(self, shingle: np.ndarray, weight: np.ndarray, to: np.ndarray) -> np.ndarray:
        """A row of ``samples`` 32-bit values for each range of ``to``; equal with the probability of the weighted Jaccard similarity."""
        out = np.zeros((len(to) - 1, self.samples), dtype=np.uint32)
        full = np.flatnonzero(np.diff(to) > 0)
        if not len(full):
            return out
        starts, low32 = to[:-1][full], np.uint64(0xFFFFFFFF)
        key = shingle & low32
        name, value = key.view(np.uint32).reshape(-1, 2)[:, 0], key.view(np.float32).reshape(-1, 2)[:, 1]
        other = np.flatnonzero(weight != 1)
        log_s, own = np.log(weight[other]).astype(np.float32), name[other]
        for k in range(self.samples):
            h = shingle * self.factors[k]  # shingles are mixed already; a multiplication and a fold more make a hash for each k
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            lanes = h.view(np.uint16).reshape(-1, 4)
            c, r, beta = self.gamma[lanes[:, 0].astype(np.int64)], self.gamma[lanes[:, 1].astype(np.int64)], lanes[:, 2] * np.float32(1 / 65536)
            # log a = log c - r (t - beta + 1), and t is 0 for a weight of 1
            np.multiply(c, np.exp(r * (beta - np.float32(1))), out=value)
            if len(other):
                at, up = r[other], beta[other]
                t = np.floor(log_s / at + up)
                value[other] = c[other] * np.exp(at * (up - t - 1))
                name[other] = own ^ (t.astype(np.int64) * 0x9E3779B1).astype(np.uint32)
            out[full, k] = (np.minimum.reduceat(key, starts) & low32).astype(np.uint32)
        return out


def _buckets(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each row of samples."""
    out = np.zeros((len(signed), bands), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = mix(out[:, b] + signed[:, b * rows + r], b)
    return out.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, idf: tuple[np.ndarray, np.ndarray], bands: int, rows: int) -> DataFrame:
    """key_, text_key (MD5 of the whole text), total weight, a byte of each sample and the buckets of its bands (null without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sampler = Weights(shared.value), Sampler(bands * rows)
        for batch in batches:
            for part in pieces(batch, "text_", 1 << 17):
                shingle, weight, to = weights.of(part.column(1))
                signed = sampler.sign(shingle, weight, to)
                data, at = raw(part.column(1))
                data = data.tobytes()
                keys = [hashlib.md5(data[at[i] : at[i + 1]]).digest() for i in range(part.num_rows)]
                none = to[1:] == to[:-1]
                bytes_ = signed.astype(np.uint8)
                sketch = [None if none[i] else bytes_[i].tobytes() for i in range(part.num_rows)]
                offsets = pa.array(np.arange(part.num_rows + 1) * bands, pa.int32(), mask=np.append(none, False))
                buckets = pa.ListArray.from_arrays(offsets, pa.array(_buckets(signed, bands, rows).ravel()))
                sums = np.concatenate([[0.0], np.cumsum(weight)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sums[to[1:]] - sums[to[:-1]], pa.float64()), pa.array(sketch, pa.binary()), buckets], ["key_", "text_key", "total", "sketch", "buckets"])

    return docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).mapInArrow(freeing(sign), "key_ long, text_key binary, total double, sketch binary, buckets array<bigint>")


def _alike(sketches: np.ndarray, totals: np.ndarray, one: np.ndarray, total: float, similarity: float) -> np.ndarray:
    """Estimates of ``one`` against each row; 0 where the ratio of the total weights, which no similarity exceeds, is too low.

    Bytes of unequal samples agree once in 256 times; the estimate makes up for that.
    """
    like = np.zeros(len(sketches))
    near = np.flatnonzero(np.minimum(totals, total) >= (similarity - 1e-9) * np.maximum(totals, total))
    like[near] = ((sketches[near] == one).mean(axis=1) - 1 / 256) * (256 / 255)
    return like


def lowest(docs: DataFrame, key: str, text: str, idf: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key_ and the shingles of lowest hash with their weights; empty where the weights are too unequal for an estimate."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for batch in batches:
            for part in pieces(batch, "text_"):
                shingle, weight, to = weights.of(part.column(1))
                low = np.empty(len(shingle), dtype=_LOW)
                low["hash"], low["weight"] = shingle >> np.uint64(32), weight
                sums, squares = (np.concatenate([[0.0], np.cumsum(w)]) for w in (weight, weight**2))
                n, total, square = np.diff(to), sums[to[1:]] - sums[to[:-1]], squares[to[1:]] - squares[to[:-1]]
                skewed = (n >= LOWEST) & (n * square > SKEW * total**2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b"" if skewed[i] else low[to[i] : min(to[i + 1], to[i] + LOWEST)].tobytes() for i in range(len(n))], pa.binary())], ["key_", "lowest"])

    return docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")).mapInArrow(freeing(cut), "key_ long, lowest binary")


def _each_once(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, each once, with the sums of their weights: two shingles of a text may share the 32 bits that are kept."""
    first = np.flatnonzero(np.concatenate([[True], low["hash"][1:] != low["hash"][:-1]])) if len(low) else np.zeros(0, np.int64)
    return (low["hash"], low["weight"]) if len(first) == len(low) else (low["hash"][first], np.add.reduceat(low["weight"], first))


def low_estimate(x: np.ndarray, y: np.ndarray) -> tuple[float, bool]:
    """Weighted Jaccard similarity over the shingles under the lower of the two last hashes, and if these are all."""
    whole = len(x) < LOWEST and len(y) < LOWEST
    if not whole:
        last = min(t["hash"][-1] for t in (x, y) if len(t) == LOWEST)
        x, y = x[: np.searchsorted(x["hash"], last, "right")], y[: np.searchsorted(y["hash"], last, "right")]
    return weighted_jaccard(_each_once(x), _each_once(y)), whole


def low_passes(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    if not len(x) or not len(y):
        return True
    like, whole = low_estimate(x, y)
    return like >= similarity - (0.001 if whole else LOW_MARGIN)


class _Leaders:
    """The leaders of one bucket so far, with room to grow."""

    def __init__(self, width: int, similarity: float):
        self.n, self.similarity = 0, similarity
        self.ids, self.totals = np.zeros(8, np.int64), np.zeros(8)
        self.sketches = np.zeros((8, width), dtype=np.uint8)

    def meet(self, one: int, total: float, sketch: np.ndarray) -> tuple[int, float] | None:
        """The leader that ``one`` is most like, if it is to be verified; ``one`` becomes a leader unless one covers it."""
        n = self.n
        like = _alike(self.sketches[:n], self.totals[:n], sketch, total, self.similarity)
        best = int(like.argmax()) if n else 0
        if not n or like[best] < COVERED:
            if n == len(self.ids):
                self.ids, self.totals, self.sketches = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.totals, self.sketches))
            self.ids[n], self.totals[n], self.sketches[n] = one, total, sketch
            self.n += 1
        return (int(self.ids[best]), float(like[best])) if n and like[best] >= self.similarity - MARGIN else None


def _led(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """(bucket, one, other, like, total, sketch): each member with its leader; and, of dealt buckets, each leader, with other null."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders = None, None
        for batch in batches:
            out = []
            sketches = np.frombuffer(b"".join(batch.sketch), np.uint8).reshape(len(batch), width)
            for i, (bucket, shard, one, size, total) in enumerate(zip(batch.bucket, batch.shard, batch.rep, batch.n, batch.total, strict=True)):
                if (bucket, shard) != now:
                    now, leaders = (bucket, shard), _Leaders(width, similarity)
                n = leaders.n
                found = leaders.meet(one, total, sketches[i])
                if found is not None:
                    out.append((bucket, one, *found, None, None))
                if leaders.n > n and size > dealt_from:
                    out.append((bucket, one, None, None, total, sketches[i].tobytes()))
            led = pd.DataFrame(out, columns=["bucket", "one", "other", "like", "total", "sketch"]).astype({"bucket": "int64", "one": "int64"})
            # from the numbers themselves: beside nulls the frame holds them as floats, which do not tell keys over 2**53 apart
            led["other"] = pd.array([x[2] for x in out], dtype="Int64")
            yield led

    dealt_from = LEAD_BLOCK
    # each bucket has an order of its own, so that members meet other leaders in each band
    dealt = members.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard", F.xxhash64("rep", "bucket"))
    return dealt.mapInPandas(freeing(meet), "bucket long, one long, other long, like double, total double, sketch binary")


def _cells(members: DataFrame) -> DataFrame:
    """``members`` (bucket, rep, n, ...) once for each cell (block, block) of their bucket that they take part in.

    A bucket is dealt to blocks of about BLOCK. Block k takes part in the cells (k, k) and (k, later) as side 0, in
    (earlier, k) as side 1: any two members meet in one cell, and no task holds more than two blocks at once.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("rep"), blocks)
    part = lambda a, b, side: F.struct((a * blocks + b).alias("cell"), F.lit(side).alias("side"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.when(k >= own, part(own, k, 0)).otherwise(part(k, own, 1)))
    return members.withColumn("part", F.explode(parts)).select(*members.columns, "part.cell", "part.side")


def _met(members: DataFrame, bands: int, rows: int, similarity: float, best: bool) -> DataFrame:
    """(a, b), a < b, to verify, of the members that share a cell.

    With ``best`` each member with the one before it in its bucket that is most like it, so that alike members hang
    together; else all pairs of different labels, in the first of their common bands.
    """

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        kept = None
        for batch in batches:
            batch = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            bucket, cell = batch.bucket.to_numpy(), batch.cell.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1]) if len(batch) else np.zeros(1, np.int64)
            yield from parts(batch, starts)
            kept = batch.iloc[starts[-1] :]
        if kept is not None and len(kept):
            yield from parts(kept, np.array([0, len(kept)]))

    def parts(batch: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple]:
        end = starts[-1]
        if not end:
            return
        sketches = np.frombuffer(b"".join(batch.sketch.iloc[:end]), np.uint8).reshape(-1, bands * rows)
        columns = [batch[c].to_numpy() for c in ("side", "rep", "total", "band", "label", "lowest")]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield (sketches[a:b], *(c[a:b] for c in columns))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for sketches, side, ids, totals, band, labels, lows in groups(batches):
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
            low: dict[int, np.ndarray] = {}
            for k, i in enumerate(right if len(right) else left):
                others = left if len(right) else left[:k]
                others = others if best else others[labels[others] != labels[i]]
                if not len(others):
                    continue
                like = _alike(sketches[others], totals[others], sketches[i], totals[i], similarity)
                if best:
                    others = others[[like.argmax()]] if like.max() >= similarity - MARGIN else others[:0]
                else:
                    others = others[like >= similarity - MARGIN]
                    if band[i] and len(others):
                        same = (sketches[others] == sketches[i]).reshape(len(others), bands, rows).all(axis=2)
                        others = others[~same[:, : band[i]].any(axis=1)]
                    for j in (i, *others) if len(others) else ():
                        if j not in low:
                            low[j] = np.frombuffer(lows[j] or b"", _LOW)
                    others = [j for j in others if low_passes(low[i], low[j], similarity)]
                found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in others]
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
                found = []
        yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    by = ["bucket", "cell"]
    return members.repartition(*by).sortWithinPartitions(*by).mapInPandas(freeing(compare), "a long, b long")


def band_members(reps: DataFrame) -> DataFrame:
    """(bucket, band, rep, n) of the representatives that share a bucket with others."""
    keyed = reps.select("rep", F.posexplode("buckets").alias("band", "bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return written(keyed.join(sizes, "bucket"), "members")


def first_candidates(members: DataFrame, reps: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, to verify: each member of a bucket with the leader that is most like it."""
    shard = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / LEAD_BLOCK)).cast("long").alias("shard")
    about = members.select("bucket", "rep", "n", shard).join(reps.select("rep", "sketch", "total"), "rep")
    led = written(_led(about, bands * rows, similarity), "led")
    first = led.where("other is not null").select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
    leaders = led.where("other is null").select("bucket", F.col("one").alias("rep"), "total", "sketch")
    leaders = leaders.join(leaders.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    none = [F.lit(0).alias("band"), F.lit(0).cast("long").alias("label"), F.lit(None).cast("binary").alias("lowest")]
    among = _met(_cells(leaders.select("*", *none)), bands, rows, similarity, True)
    out = written(first.unionByName(among).distinct(), "pairs")
    discard(led)
    return out


def other_candidates(members: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, idf: tuple[np.ndarray, np.ndarray], bands: int, rows: int, similarity: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, to verify: any two members of a bucket whose classes in ``labels`` (node, component) differ.

    ``docs`` (key_, text_) gives the shingles of lowest hash of these members.
    """
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.select("bucket", "band", "rep", "n", F.coalesce("component", "rep").alias("label")), "named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("bucket")
    mixed = written(named.join(mixed, "bucket", "left_semi"), "mixed")
    needed = key_bitmap(mixed.select(F.col("rep").alias("key")).distinct())
    low = lowest(marked(docs, "key_", needed).where("hit_"), "key_", "text_", idf)
    low = low.groupBy(F.col("key_").alias("rep")).agg(F.min("lowest").alias("lowest"))
    about = _cells(mixed.join(reps.select("rep", "sketch", "total"), "rep").join(low, "rep"))
    out = written(_met(about, bands, rows, similarity, False).distinct(), "pairs")
    discard(named, mixed)
    return out


def weighted_jaccard(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted shingle arrays with weights; no shingle is twice in one of them."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    least = np.minimum(x[1][i], y[1][j]).sum() if len(both) else 0.0
    total = x[1].sum() + y[1].sum() - least
    return float(least / total) if total else 0.0


def verify(pairs: DataFrame, docs: DataFrame, key: str, text: str, idf: tuple[np.ndarray, np.ndarray], similarity: float) -> DataFrame:
    """The pairs whose whole texts have at least ``similarity``, written. Only texts of the pairs are moved."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    needed = key_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    texts = marked(docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_")), "key_", needed).where("hit_")
    # a key names one text; should it repeat with others, its smallest text speaks for it
    texts = texts.groupBy("key_").agg(F.min("text_").alias("text_"))
    side = lambda k: texts.select(F.col("key_").alias(k), F.col("text_").alias(f"text_{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        for batch in batches:
            names = batch.schema.names
            for part in pieces(batch, "text_a"):
                for part_b in pieces(part, "text_b"):
                    (sa, wa, ta), (sb, wb, tb) = (weights.of(part_b.column(names.index(n))) for n in ("text_a", "text_b"))
                    like = [weighted_jaccard((sa[ta[i] : ta[i + 1]], wa[ta[i] : ta[i + 1]]), (sb[tb[i] : tb[i + 1]], wb[tb[i] : tb[i + 1]])) for i in range(part_b.num_rows)]
                    out = pa.RecordBatch.from_arrays([part_b.column(names.index("a")), part_b.column(names.index("b"))], ["a", "b"])
                    yield out.filter(pa.array([x >= similarity for x in like], pa.bool_()))

    return written(joined.mapInArrow(freeing(check), "a long, b long"), "links")


def row_classes(docs: DataFrame, similarity: float, bands: int, rows: int) -> DataFrame:
    """key_, text_key, class_id for each row of ``docs`` (key_ long, text_ string without nulls); class_id is null where key_ is."""
    idf = idf_table(docs, "text_")
    signed = written(signatures(docs, "key_", "text_", idf, bands, rows), "signatures")
    keyed = signed.where("key_ is not null")
    # equal texts have equal samples: the group keeps one row; min() combines on the map side
    about = F.min(F.struct("key_", "total", "sketch", "buckets")).alias("r")
    reps = written(keyed.groupBy("text_key").agg(about).select("text_key", F.col("r.key_").alias("rep"), "r.total", "r.sketch", "r.buckets"), "representatives")
    worded = reps.where("sketch is not null")
    members = band_members(worded)
    first = first_candidates(members, worded, bands, rows, similarity)
    links = verify(first, docs, "key_", "text_", idf, similarity)
    classes = connected_components(links)
    other = other_candidates(members, worded, classes, docs, idf, bands, rows, similarity)
    more = verify(other, docs, "key_", "text_", idf, similarity)
    final = connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = reps.select("text_key", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = written(named.select("text_key", F.coalesce("component", "rep").alias("class_id")), "classes")
    discard(reps, members, first, links, other, more, classes, final)
    out = keyed.select("key_", "text_key").join(named, "text_key")
    return out.select("key_", "text_key", "class_id").unionByName(signed.where("key_ is null").select("key_", "text_key", F.lit(None).cast(T.LongType()).alias("class_id")))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: key, class_id, kept.

    Two texts are linked if they are equal, or if the weighted Jaccard similarity of their five-word shingles is at
    least ``similarity`` (weight: count times idf; only shingles that more than one in 256 documents share weigh less
    than their count). ``class_id`` is the smallest key reachable by links; copies are not expanded into all
    pairs. ``kept`` is true for the row whose key is the class's; of rows that repeat a key none is dropped for it, and
    should a key repeat with other texts, these share its class.
    Banding and its estimate let a pair at the threshold pass with a
    probability of 0.995, and any pair of a similarity of 0.85 practically always. Texts without words (null, empty, punctuation
    only) have no shingles and link only to equal texts; null equals empty. Rows without a key have a null class and
    are kept. Other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    out = row_classes(docs, similarity, bands, rows)
    return out.select(F.col("key_").alias(key), "class_id", F.coalesce(F.col("key_") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``, that of the smallest key; rows without a key all stay.

    All columns stay as they are, whatever their names. Rows that repeat both key and text are one; different texts under
    one key all stay if the key does. An empty table gives an empty result. Rows whose key neither goes nor repeats are
    not moved: they are told from the others by a bitmap of bounded size.
    """
    narrow = docs.select(F.col(key).cast("long").alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    out = written(row_classes(narrow, similarity, bands, rows).where("key_ is not null").groupBy("key_", "text_key", "class_id").agg(F.count(F.lit(1)).alias("n")), "decided")
    gone = out.where("key_ <> class_id").select(F.col("key_").alias("key")).distinct()
    doubtful = out.where("key_ <> class_id or n > 1").select(F.col("key_").alias("key")).distinct()
    row = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = marked(row, "key", key_bitmap(doubtful))
    kept = row.where("hit_").join(gone, "key", "left_anti").withColumn("text", F.sha2("text", 256)).dropDuplicates(["key", "text"])
    return row.where("not hit_").select("row").unionByName(kept.select("row")).select("row.*")

"""Importance resampling towards a target: hashed n-gram features, gains by bucket, a Gumbel draw of the highest scores.

N-grams of a window are interned in an open-addressed numpy table: 64-bit xxHash keys, every match verified by its bytes,
a bucket and a count to each slot. The slot of each occurrence then gathers the gain of its n-gram.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import freeing, written
from .words import pieces, raw

BUCKETS = 10_000
#: N-grams that are interned at a time.
WINDOW = 1 << 18

_WORD = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The five 64-bit primes of xxHash.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _lanes(data: np.ndarray, kind: str) -> np.ndarray:
    """A view of the integers that begin at every byte."""
    return np.ndarray(shape=(len(data) - np.dtype(kind).itemsize + 1,), dtype=kind, buffer=data, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of the byte ranges; ``data`` has 8 spare bytes behind the last. Ranges of 32 bytes and more go to the library."""
    size = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    long = np.flatnonzero(size >= 32)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    short = np.flatnonzero(size < 32)
    at, left = starts[short].copy(), size[short].copy()
    h = _P5 + left.astype(np.uint64)
    eight, four = _lanes(data, "<u8"), _lanes(data, "<u4")
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        if len(on):
            h[on] = _turned(h[on] ^ (_turned(eight[at[on]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[on] += 8
            left[on] -= 8
    on = np.flatnonzero(left >= 4)
    if len(on):
        h[on] = _turned(h[on] ^ (four[at[on]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        if len(on):
            h[on] = _turned(h[on] ^ (data[at[on]].astype(np.uint64) * _P5), 11) * _P1
            at[on] += 1
            left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    out[short] = h ^ (h >> np.uint64(32))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Are the ``size`` bytes at a and at b alike? ``data`` has 8 spare bytes behind the last."""
    alike = np.ones(len(a), dtype=bool)
    for i in np.flatnonzero(size > 64):
        alike[i] = data[a[i] : a[i] + size[i]].tobytes() == data[b[i] : b[i] + size[i]].tobytes()
    eight = _lanes(data, "<u8")
    for k in range(0, 64, 8):
        on = np.flatnonzero(alike & (size > k) & (size <= 64))
        if not len(on):
            break
        apart = eight[a[on] + k] ^ eight[b[on] + k]
        apart <<= (8 * np.maximum(8 - (size[on] - k), 0)).astype(np.uint64)  # bytes behind the end don't count
        alike[on] = apart == 0
    return alike


class Interned:
    """Open-addressed table of the distinct byte ranges among those given.

    ``slot`` is each range's place; ``used`` lists the taken places, and with each of them go a ``bucket`` and a ``count``.
    At most half of the places are taken, so a probe ends.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, hashed=xxh64):
        keys, size = hashed(data, starts, ends), ends - starts
        places = 1 << max(3, (2 * len(starts)).bit_length())
        owner = np.full(places, -1, dtype=np.int64)  # the range that took the place
        self.slot = np.full(len(starts), -1, dtype=np.int64)
        pending, probe = np.arange(len(starts)), (keys & np.uint64(places - 1)).astype(np.int64)
        while len(pending):
            at = probe[pending]
            free = owner[at] < 0
            owner[at[free]] = pending[free]  # of several that ask for a place one gets it
            has = owner[at]
            hit = (keys[has] == keys[pending]) & (size[has] == size[pending])
            hit[hit] = same_bytes(data, starts[has[hit]], starts[pending[hit]], size[pending[hit]])
            self.slot[pending[hit]] = at[hit]
            pending = pending[~hit]
            probe[pending] = (probe[pending] + 1) & (places - 1)
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=places)
        self.bucket = np.zeros(places, dtype=np.int64)
        first, last = starts[owner[self.used]].tolist(), ends[owner[self.used]].tolist()
        view = memoryview(data)
        self.bucket[self.used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(first, last, strict=True)]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word of lower-cased rows; no word spans two rows."""
    is_word = _WORD[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1:-1]
    ends = is_word
    ends[:-1] &= ~is_word[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of (bytes, starts, ends, rows) of all runs of ``n`` words of a row, the words joined by one space.

    ``row`` is each word's row, ascending. The bytes have 8 spare ones at their end.
    """
    for i in range(0, len(starts) - n + 1, WINDOW):
        j = min(i + WINDOW, len(starts) - n + 1)
        a, b, r = starts[i : j + n - 1], ends[i : j + n - 1], row[i : j + n - 1]
        if n == 1:
            yield np.concatenate([data[a[0] : b[-1]], np.zeros(8, np.uint8)]), a - a[0], b - a[0], r
            continue
        size = b - a
        first = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()) + 8, 32, dtype=np.uint8)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(first, size) + inside] = data[np.repeat(a, size) + inside]
        whole = r[: j - i] == r[n - 1 :]
        yield joined, first[: j - i][whole], (first + size)[n - 1 :][whole], r[: j - i][whole]


def _features(piece: pa.RecordBatch, n: int, buckets: int) -> Iterator[tuple[Interned, np.ndarray]]:
    data, at = raw(piece.column(piece.schema.get_field_index("text_")))
    data = _LOWER[data]
    starts, ends = word_bounds(data, at)
    row = np.searchsorted(at, starts, "right") - 1
    for k in range(1, n + 1):
        for content, a, b, rows in ngrams(data, starts, ends, row, k):
            yield Interned(content, a, b, buckets), rows


def bucket_counts(docs: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts by bucket; a task sends a row for each bucket at most. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text_"):
                for table, _ in _features(piece, n, buckets):
                    np.add.at(total, table.bucket[table.used], table.count[table.used])
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    parts = docs.select(F.col(text).alias("text_")).mapInArrow(freeing(run), "bucket bigint, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 · ln of the smoothed ratio of shares, target over source) for each bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: ((target.get(b, 0) + 1) * (s_all + buckets)) / ((source.get(b, 0) + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """(key_, n_words, n_features, weight): the sum of the gains of each row's features; without a feature 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for piece in pieces(batch, "text_"):
                counts, weight, words = (np.zeros(piece.num_rows, dtype=np.int64) for _ in range(3))
                data, at = raw(piece.column(1))
                starts, _ = word_bounds(_LOWER[data], at)
                words += np.diff(np.searchsorted(starts, at))
                for table, rows in _features(piece, n, len(gain)):
                    np.add.at(counts, rows, 1)
                    np.add.at(weight, rows, gain[table.bucket][table.slot])
                columns = [piece.column(0), *(pa.array(x, pa.int64()) for x in (words, counts, weight))]
                yield pa.RecordBatch.from_arrays(columns, ["key_", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    return rows.mapInArrow(freeing(run), f"key_ {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(name, seed: int):
    """floor(1000 · a standard Gumbel number) that seed and name choose."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def highest(rows: DataFrame, order: list, k: int) -> DataFrame:
    """``rows`` with rank 1.. in ``order`` for the first ``k``, null for the others. No task sees more than a range.

    The rows are dealt to ranges and written with their range and its first place, so that offsets and ranks see the same deal.
    """
    dealt = written(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("size_"))
    before = sizes.select("range_", F.coalesce(F.sum("size_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    # a range that begins behind the last drawn place needs no order
    split = dealt.join(F.broadcast(before), "range_")
    drawn = split.where(F.col("before_") < k)
    place = F.col("before_") + F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    drawn = drawn.withColumn("rank", F.when(place <= k, place).cast("bigint"))
    rest = split.where(F.col("before_") >= k).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select(*rows.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1,
    buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """One row for each row of ``docs``: key, n_features, weight, score, rank (all long but the key); rank is null for what is not drawn.

    Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII; features are all runs of 1 to
    ``n`` words. Of the N rows of at least ``least_words`` words floor(percent · N / 100) with the highest scores are drawn,
    ties to smaller keys. Null and empty texts have no feature and weight 0; a null key counts as an empty name and comes
    last among ties; repeated rows count and are ranked each. Other columns are not read; an empty table gives none, and an
    empty target leaves the smoothing alone. Counts are those of all rows; two scans of the texts, one of the target, and
    one shuffle of four numbers a row.
    """
    source = {r.bucket: r.n for r in bucket_counts(docs, text, n, buckets).collect()}  # a row for each bucket at most
    wanted = {r.bucket: r.n for r in bucket_counts(target, target_text, n, buckets).collect()}
    rows = weigh(docs, gains(source, wanted, buckets), key, text, n)
    name = F.coalesce(F.col("key_").cast("string"), F.lit(""))
    rows = written(rows.withColumn("score", F.col("weight") + gumbel(name, seed)), "weighed")
    able = F.col("n_words") >= least_words
    k = rows.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("key_"), F.desc("weight"), F.desc("n_features")]
    ranked = highest(rows.where(able), order, k)
    others = rows.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select(F.col("key_").alias(key), "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents with all their columns: one semi-join by key. ``key`` should be unique; rows of a drawn key all stay."""
    drawn = resample(docs, target, key, **options).where("rank IS NOT NULL").select(F.col(key))
    return docs.join(drawn, key, "left_semi")


#: DuckDB SQL of the same rows for documents (doc_id, text) and benchmark (text), with the defaults above. CRC-32 by its bytewise table.
SQL = r"""
WITH RECURSIVE tab8(i, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END, k + 1 FROM tab8 WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM tab8 WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
words AS (SELECT word FROM dw UNION SELECT word FROM bw),
bytes AS (SELECT word, list_transform(range(CAST(length(hex(encode(word))) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2*i+1 AS BIGINT), 2) AS BIGINT)) AS l FROM words),
crc AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), l), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN crc USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN crc USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM dw) AS S, (SELECT count(*) FROM bw) AS T),
gain AS (SELECT s.bucket, CAST(floor(1000*ln((coalesce(t.n, 0)+1)*CAST(tot.S+10000 AS DOUBLE)/((s.n+1)*CAST(tot.T+10000 AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket), tot),
wd AS (SELECT doc_id, count(*) AS f, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
sc AS (SELECT d.doc_id, CAST(coalesce(f, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT)+0.5)/4294967296))) AS BIGINT) AS score FROM d LEFT JOIN wd USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CAST(r.rank AS BIGINT) AS rank FROM sc LEFT JOIN r ON sc.doc_id = r.doc_id AND r.rank <= (SELECT count(*) * 10 // 100 FROM r)"""

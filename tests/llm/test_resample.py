"""Importance resampling: the interning table, hashes and ranks against plain Python, and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from photolake.llm import resample as R

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, key_ string, text_ string, rank long, weight string, range_ int, before_ int"
ODD = [None, "", " \n ", "a", "!!!", "A_b A_b Ünï 漢字😀 x1", "x" * 30000, "1 " * 4000, "one two three " * 20, "one two three " * 20]


def ranges(words):
    data = b"".join(words) + bytes(8)
    ends = np.cumsum([len(w) for w in words])
    return np.frombuffer(data, np.uint8), ends - np.array([len(w) for w in words]), ends


def some_bytes(n, most):
    rng = np.random.default_rng(5)
    return [rng.integers(0, 256, rng.integers(0, most), dtype=np.uint8).tobytes() for _ in range(n)]


def test_hashes_equal_the_library():
    words = some_bytes(3000, 70)
    assert R.xxh64(*ranges(words)).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


@pytest.mark.parametrize("hashed", [R.xxh64, lambda d, s, e: np.zeros(len(s), np.uint64), lambda d, s, e: np.full(len(s), 2**64 - 1, np.uint64)])
def test_equal_keys_are_told_apart_by_bytes(hashed):
    words = [w[: k % 9] for k, w in enumerate(some_bytes(400, 12))] + some_bytes(40, 200) * 2 + [b"a" * 64, b"a" * 65, b"a" * 64 + b"b"]
    table = R.Interned(*ranges(words), 97, hashed)
    slots = table.slot.tolist()
    assert len(set(slots)) == len(set(words)) == len(table.used)
    assert all(len({words[i] for i in range(len(words)) if slots[i] == s}) == 1 for s in set(slots))
    assert {words[i]: int(table.count[s]) for i, s in enumerate(slots)} == Counter(words)
    assert all(table.bucket[s] == zlib.crc32(words[i]) % 97 for i, s in enumerate(slots))


def plain_features(text, n):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n, buckets, percent, least, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in plain_features(x, n)[1]) for texts in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, able = [], []
    for i, text in docs:
        words, features = plain_features(text, n)
        weight = sum(gain(of(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((i, len(features), weight, score))
        if words >= least:
            able.append((-score, i is None, i, len(out) - 1))
    ranks = {x[3]: k + 1 for k, x in enumerate(sorted(able)[: len(able) * percent // 100])}
    return sorted(((*r, ranks.get(k)) for k, r in enumerate(out)), key=repr)


@pytest.mark.parametrize(("n", "window"), [(1, 1 << 18), (1, 3), (3, 1 << 18), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, n, window):
    monkeypatch.setattr(R, "WINDOW", window)  # of this process: windows are tried on the features themselves below
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, f"word{i} one two w{i % 7} " * (1 + i % 9)) for i in range(120)] + [(None, "one two " * 30)]
    target = ["one two three", None, "", "w3 w4", "x1"]
    df = spark.createDataFrame([(*d, "k", "t", 5, "w", 1, 2) for d in docs], COLUMNS).repartition(3)
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=50, percent=30, least_words=3, seed=7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, n, 50, 30, 3, 7)


@pytest.mark.parametrize(("n", "window"), [(1, 2), (2, 3), (3, 4), (4, 1 << 18)])
def test_windows_lose_no_feature(monkeypatch, n, window):
    monkeypatch.setattr(R, "WINDOW", window)
    got = Counter()
    for table, rows in R._features(pa.record_batch({"text_": pa.array(ODD)}), n, 50):
        got.update(zip(rows.tolist(), table.bucket[table.slot].tolist(), strict=True))
    assert got == Counter((i, zlib.crc32(f.encode()) % 50) for i, t in enumerate(ODD) for f in plain_features(t, n)[1])


def test_empty_tables(spark):
    df = spark.createDataFrame([], COLUMNS)
    target = spark.createDataFrame([], "text string")
    assert R.resample(df, target).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20, "", "", 1, "", 1, 1)], COLUMNS)
    assert [r["rank"] for r in R.resample(some, target, percent=100).collect()] == [1]
    assert R.resampled(some, target, percent=100).columns == some.columns


def test_ties_and_repeated_rows(spark):
    """Equal rows are ranked each; of equal scores the smaller key comes first, over several ranges too."""
    df = spark.createDataFrame([(i // 3, i % 5) for i in range(3000)], "key_ long, score long")
    from pyspark.sql import functions as F

    got = R.highest(df.repartition(5), [F.desc("score"), "key_"], 700).where("rank is not null").orderBy("rank").collect()
    want = sorted(((i // 3, i % 5) for i in range(3000)), key=lambda r: (-r[1], r[0]))[:700]
    assert [(r.key_, r.score) for r in got] == want and [r["rank"] for r in got] == list(range(1, 701))

"""Similar patches against all pairs: equal means, crowded cells of the grid, equal patches, ties, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photolake.operators import pixels as P

SCHEMA = "vec_id long, cell int, data array<double>"


def brute(rows, sigma, k):
    limit = (2.5 * sigma) ** 2 * 64
    out = set()
    for cell in {c for _, c, _ in rows}:
        ids = np.array([i for i, c, _ in rows if c == cell])
        data = np.array([d for _, c, d in rows if c == cell])
        for n, ref in enumerate(ids):
            ssd = ((data - data[n]) ** 2).sum(axis=1)
            near = sorted((round(float(s), 9), int(o)) for s, o in zip(ssd, ids, strict=True) if s <= limit and o != ref)[:k]
            out |= {(cell, int(ref), o, s, at + 1) for at, (s, o) in enumerate(near)}
    return out


def got(df, sigma, k):
    return {(r.cell, r.ref, r.other, round(r.ssd, 9), r.place) for r in P.similar_patches(df, sigma, k).collect()}


def clusters(n, groups, noise, seed=1):
    """Patches of groups, every mean 0.5."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (groups, 64))
    data = centres[rng.integers(0, groups, n)] + rng.normal(0, noise, (n, 64))
    return data - data.mean(axis=1, keepdims=True) + 0.5


@pytest.mark.parametrize("piece", [512, 7])
def test_equal_means_and_crowded_cells(spark, monkeypatch, piece):
    monkeypatch.setattr(P, "PIECE", piece)
    data = clusters(400, 30, 0.004)
    rows = [(i, i % 2, d.tolist()) for i, d in enumerate(data)] + [(1000 + i, 0, data[0].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df, 0.0045, 5) == brute(rows, 0.0045, 5)


def test_candidates_follow_the_results(spark):
    """All means are equal, yet few more pairs are fetched than are near."""
    data = clusters(3000, 300, 0.01)
    sigma = 0.0095
    df = spark.createDataFrame([(i, 0, d.tolist()) for i, d in enumerate(data)], SCHEMA)
    different = P.sketched(df.withColumn("p", F.col("vec_id")))
    found = {(r.p, r.q) for r in P.patch_candidates(different, (2.5 * sigma) ** 2 * 64).collect()}
    square = (data**2).sum(axis=1)
    ssd = square[:, None] + square[None] - 2 * data @ data.T
    near = {(int(a), int(b)) for a, b in np.argwhere(np.triu(ssd <= (2.5 * sigma) ** 2 * 64, 1))}
    assert len(near) > 5000 and near <= found and len(found) <= 20 * len(near)


def test_ties_equal_patches_and_odd_rows(spark):
    one, two = [0.25] * 64, [0.25] * 63 + [0.26]
    rows = [(9, 1, one), (3, 1, one), (7, 1, one), (1, 1, two), (2, 1, two), (3, 2, one)]
    odd = [(None, 1, one), (5, None, one), (6, 1, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumns({n: F.lit("x") for n in ("p", "q", "ids", "hash", "sketch", "part")})
    assert got(df, 0.056, 2) == brute(rows, 0.056, 2)
    assert P.similar_patches(df.limit(0), 0.056).count() == 0


def test_patches_that_the_grid_does_not_part(spark):
    """Unit vectors in all directions: nearly all meet in a few grid cells, yet only those that are near come out as candidates."""
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1500, 64))
    data /= np.sqrt((data**2).sum(axis=1, keepdims=True))
    rows = [(i, i % 2, d.tolist()) for i, d in enumerate(data)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, 0.056, 16) == brute(rows, 0.056, 16)
    limit = (2.5 * 0.056) ** 2 * 64
    ssd = ((data[:, None, :] - data[None]) ** 2).sum(axis=2)
    near = {(a, b) for a, b in np.argwhere(ssd <= limit).tolist() if a < b and a % 2 == b % 2}
    found = {(r.p, r.q) for r in P.patch_candidates(P.sketched(df.withColumn("p", F.col("vec_id"))), limit).collect()}
    assert found == near

import math
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from lodestream.llm import clustering
from lodestream.llm.queries import op13_clustering

FLOATS = "vec_id long, embedding array<float>, label int, ints int, lead string, id string"


def expected(rows, k=40, rounds=5):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * Fraction(x)) for x in v]))
    if not kept:
        return []
    name = lambda r: (sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=name)[:k]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if own:
                cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(min(d, clustering.MOST), j) for d, j in assign()]
    total = {j: min(sum(d for d, c in found if c == j), clustering.MOST) for j in range(len(cents))}
    whole = min(sum(d for d, _ in found), clustering.MOST)
    sha = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, j, d, total[j], whole, sha[j]) for (i, _), (d, j) in zip(kept, found, strict=True)], key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, schema=FLOATS):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y") for i, v in rows], schema)


def vectors(n, seed=1, scale=0.2):
    v = (np.random.default_rng(seed).standard_normal((n, 64)) * scale).astype(np.float32)
    return [(i, row) for i, row in enumerate(v.tolist())]


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(op13_clustering(spark, sf)) == expected(rows)


def test_nulls_lengths_repeats_and_clashing_names(spark):
    rows = vectors(120)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (3, rows[4][1])] + [(500 + i, rows[7][1]) for i in range(60)]
    rows += [(200, None), (201, []), (202, rows[0][1][:63]), (203, rows[0][1] + [0.0]), (204, [float("nan")] + rows[0][1][1:]), (205, [float("inf")] + rows[0][1][1:]), (206, [None] + rows[0][1][1:])]
    assert got(clustering.clustered(frame(spark, rows))) == expected(rows)


@pytest.mark.parametrize("scale", [1e-30, 1e4, 1e6, 3e37])
def test_any_finite_size(spark, scale):
    """Integers beyond int32 and distances beyond a long are compared in full; only what is reported is bounded."""
    rows = vectors(60, 2, 0.2) + [(100 + i, v) for i, v in vectors(25, 3, scale)]
    assert got(clustering.clustered(frame(spark, rows), k=12)) == expected(rows, 12)


def test_doubles_beyond_floats(spark):
    rows = [(i, [x * 1e300 for x in v]) for i, v in vectors(12, 4)] + vectors(5, 5)
    found = clustering.clustered(frame(spark, rows, FLOATS.replace("float", "double")), k=4)
    assert got(found) == expected(rows, 4)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(7)
    assert got(clustering.clustered(frame(spark, rows))) == expected(rows)
    assert got(clustering.clustered(frame(spark, []))) == []


def test_bounds_hold_and_rule_out_most_centroids_of_grouped_vectors(spark):
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((20, 64))
    v = (middles[rng.integers(0, 20, 2000)] + rng.standard_normal((2000, 64)) * 0.05).astype(np.float32)
    rows, mean, axes = clustering.stored(frame(spark, list(enumerate(v.tolist()))), "vec_id", "embedding")
    whole = clustering.first_centroids(rows)
    cents = clustering.Centroids(whole, mean, axes, clustering.LEAD)
    ints = np.floor(v.astype(np.float64) * 256).astype(np.int64)
    turned = (ints - mean) @ axes
    bound = cents.bounds(turned[:, : clustering.LEAD], np.linalg.norm(turned[:, clustering.LEAD :], axis=1))
    exact = ((ints[:, None, :] - cents.ints[None]) ** 2).sum(2)
    assert (bound <= exact).all()
    _, worked = clustering.moved(rows, cents)
    assert worked < 2000 * len(whole) / 8

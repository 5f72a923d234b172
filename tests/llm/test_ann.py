import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import ann
from lodestream.llm.queries import op10_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, cell int"


def brute(rows, queries, k):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    out = {}
    for i, q in ok:
        if queries(i):
            near = sorted((-float((v * q).sum()), j) for j, v in ok if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_query_and_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in op10_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    vec = {i: np.array(v, np.float64) for i, v in rows}
    hits = 0
    for q, near in got.items():
        assert [n[0] for n in near] == list(range(1, 21)) and q not in [n[1] for n in near]
        assert near == sorted(near, key=lambda n: (-n[2], n[1]))
        for _, j, s in near:
            assert abs(s - float(vec[q] @ vec[j])) < 1e-12
        hits += len({n[1] for n in near} & {j for j, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_exact_equals_brute_force_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(200, None), (201, []), (202, [0.0] * 5), (203, [float("nan")] * 5), (204, [1.0, None, 1.0, 1.0, 1.0]), (205, [float("inf")] * 5), (206, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 0, "a", "b", 1) for r in rows], SCHEMA)
    kept = [r for r in rows if r[0] != 206]
    want = brute(kept, lambda i: i % 20 == 0, 5)
    for found in (ann.exact(df, F.col("id") % 20 == 0, 5), ann.nearest(df, F.col("id") % 20 == 0, 5, probes=4, tables=2), ann.nearest(df, F.col("id") % 20 == 0, 5, bucket_rows=3, tables=3, hashes=2)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got.keys() == want.keys()
        assert all(len(got[q]) == 5 for q in got)
    got = {}
    for r in ann.exact(df, F.col("id") % 20 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [j for j, _ in near] for q, near in want.items()}


def test_too_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "", "", 0), (20, [-1.0, 0.0], 0, "", "", 0), (3, [0.0, 1.0], 0, "", "", 0)], SCHEMA)
    got = ann.nearest(df, F.col("id") % 20 == 0, 20, width=0.01, probes=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 3), (0, 2, 20), (20, 1, 3), (20, 2, 0)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_probe_order_is_by_expected_score():
    sets = ann.probe_sets(6, 40)
    assert sets[0] == () and sets[1] == (0,) and len(sets) == len(set(sets)) == 40
    assert all(11 - j not in s for s in sets for j in s)


def test_ids_of_other_types(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    long = df.withColumn("vec_id", F.col("vec_id").cast("long"))
    got, want = (sorted(ann.nearest(x, F.col("id") % 20 == 0, 5).collect()) for x in (df, long))
    assert got == want and len(got) == 10
    with pytest.raises(TypeError):
        ann.nearest(df.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_probes_leave_few_rows_where_the_data_have_structure(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    points = centres[np.arange(4000) % 40] + 0.05 * rng.standard_normal((4000, 32))
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>")
    asked = F.col("id") % 100 == 0
    pruning = {"tables": 6, "hashes": 12, "probes": 16, "width": 0.8}
    best = {(r.query_id, r.vec_id) for r in ann.exact(df, asked, 20).collect()}
    found = {(r.query_id, r.vec_id) for r in ann.nearest(df, asked, 20, **pruning).collect()}
    assert len(best & found) >= 0.9 * len(best)
    met = [r.met for r in ann.rows_met(df, asked, **pruning).collect()]
    assert len(met) == 40 and sum(met) / len(met) < 0.1 * 4000 * 6


@pytest.mark.parametrize("scale", [1e-30, 1e19, 1e21, 3e38])
def test_any_finite_size(spark, scale):
    """Squares beyond or below single precision lose no neighbour, and scores are those of double precision."""
    v = (np.random.default_rng(5).uniform(-1, 1, (300, 16)) * scale).astype(np.float32)
    rows = list(enumerate(v.tolist()))
    df = spark.createDataFrame([(*r, 0, "a", "b", 1) for r in rows], SCHEMA)
    want = brute(rows, lambda i: i % 20 == 0, 10)
    for found, least in ((ann.exact(df, F.col("id") % 20 == 0, 10), 1.0), (ann.nearest(df, F.col("id") % 20 == 0, 10), 0.9)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got.keys() == want.keys()
        hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
        assert hits >= least * sum(map(len, want.values()))
        for q, near in got.items():
            assert all(abs(s - float(v[q].astype(np.float64) @ v[j].astype(np.float64))) <= 1e-12 * scale * scale * 16 for j, s in near)
    met = ann.rows_met(df, F.col("id") % 20 == 0).agg(F.min("met")).first()[0]
    assert met > 0


def test_doubles_of_very_different_sizes(spark):
    rows = [(i, [float(x) * 10.0 ** (i % 7 * 40 - 120) for x in np.random.default_rng(i).uniform(-1, 1, 8)]) for i in range(120)]
    df = spark.createDataFrame([(*r, 0, "a", "b", 1) for r in rows], SCHEMA.replace("float", "double"))
    want = brute(rows, lambda i: i % 20 == 0, 5)
    for found in (ann.exact(df, F.col("id") % 20 == 0, 5), ann.nearest(df, F.col("id") % 20 == 0, 5)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: [j for j, _ in near] for q, near in want.items()}

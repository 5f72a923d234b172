import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestream.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, copies int"


def filled(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
        if not open_:
            return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(re.findall(mixing.WORD, t or ""))
    want = filled(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    return want, taken


def test_query(spark, sf):
    from lodestream.llm.queries import op6_mixing

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    one, two = op6_mixing(spark, sf).collect(), op6_mixing(spark, sf).collect()
    assert sorted(one) == sorted(two) and len(one) == len(docs)
    check(one, docs)


def test_hot_source_nulls_and_ties(spark):
    docs = [(i, "w " * (i % 7), "a") for i in range(300)] + [(1000 + i, "same words here", "b") for i in range(500)] + [(2000, None, None), (2001, "x y z", None), (2002, "", "empty"), (1000, "same words here", "b")]
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], SCHEMA)
    rows = mixing.mix(df).collect()
    check(rows, docs)
    out = mixing.sampled(df)
    assert out.columns == df.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in out.collect():
        got[(r.doc_id, r.text, r.source)] += 1
    for r in rows:
        want[r.doc_id] += r.copies
    by_id = defaultdict(int)
    for (i, *_), n in got.items():
        by_id[i] += n
    assert by_id == {i: n for i, n in want.items() if n}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.sampled(df).count() == 0


def test_clashing_columns_come_through(spark):
    names = ["_id", "_hash", "_rows", "_copies", "_own", "_k", "_nth", "_key", "_source", "row_hash"]
    docs = spark.createDataFrame([(i, f"w{i} " * (1 + i % 5), "s", *[f"{n}{i}" for n in names]) for i in range(40)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.sampled(docs)
    assert got.columns == docs.columns and got.exceptAll(docs.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))).drop("x")).count() == 0 and got.count() > 40
    text_ids = spark.createDataFrame([("a", "x y", None, 1), (None, "z", "s", 2)], "doc_id string, text string, source string, _key int")
    assert mixing.sampled(text_ids).exceptAll(text_ids.union(text_ids)).count() == 0

"""Containment, interval and point-in-time lookups against brute force, with hot keys and ends."""

import bisect
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import asof, bitmaps, containment, intervals

T0 = dt.datetime(2024, 1, 1)


def test_bitmap_hash_is_sparks(spark):
    x = np.array([0, 1, -5, 2**62, 123456789, -(2**63)], np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(i),) for i in x], "x long").select(F.xxhash64("x")).collect()]
    assert bitmaps.xxhash64_of_longs(x).view(np.int64).tolist() == got


@pytest.mark.parametrize("hot", [1000, 4])
def test_names_in_texts(spark, monkeypatch, hot):
    """Short, long, empty, null and foreign names; with few parts allowed, every common trigram is split."""
    monkeypatch.setattr(containment, "HOT", hot)
    rng = random.Random(1)
    names = ["a", "ab", "é", "日本", "", "abc", "CAB", "zzz", None, "bcab", "😀b"] + ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [(i, "".join(rng.choice("abcÉ日本😀 ") for _ in range(rng.randint(0, 60)))) for i in range(200)]
    texts += [(5, "abcabc"), (None, "cab"), (None, None), (7, None), (8, "x" * 100_000 + "Bcab"), (9, "")] + [(300, "the same cab")] * 100
    want = {(n.lower(), i) for n in names if n for i, t in texts if t is not None and n.lower() in t.lower()}
    rows = spark.createDataFrame([(n, 1) for n in names], "name string, id int"), spark.createDataFrame([(i, t, "x", 0) for i, t in texts], "id long, text string, name string, gram int")
    got = [tuple(r) for r in containment.containing(*rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    top = [tuple(r) for r in containment.newest_containing(*rows, newest=3).collect()]
    for name in {n for n, _ in want}:
        ids = sorted((i for n, i in want if n == name and i is not None), reverse=True)[:3]
        assert [i for n, i in sorted(top, key=lambda r: -(r[1] or -1)) if n == name and i is not None] == ids


def test_nothing_named_or_written(spark):
    none = spark.createDataFrame([], "name string"), spark.createDataFrame([(1, "a")], "id long, text string")
    assert containment.containing(*none).count() == 0
    assert containment.containing(spark.createDataFrame([("a",)], "name string"), none[1].limit(0)).count() == 0


def test_neither_side_of_containment_is_broadcast(spark):
    """Both sides are shuffled on the trigram: the plan has no broadcast but the bounded list of hot trigrams."""
    names = spark.createDataFrame([(f"name {i}",) for i in range(50)], "name string")
    texts = spark.createDataFrame([(i, f"a name {i % 60} b") for i in range(200)], "id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = containment.containing(names, texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("BroadcastExchange") <= 2 and "NestedLoop" not in plan and "Cartesian" not in plan


def points(n, seed, hot):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else rng.choice("abc"), rng.choice([rng.randrange(0, 400), rng.random() * 400])) for _ in range(n)]


@pytest.mark.parametrize(("closed", "width", "hot"), [(False, None, 1000), (True, None, 3), (True, 7.0, 3), (False, 1000.0, 1000)])
def test_interval_join(spark, monkeypatch, closed, width, hot):
    """Every width, closed or not, with bins split or whole: each pair once."""
    monkeypatch.setattr(intervals, "HOT", hot)
    rng = random.Random(2)
    at = [(i, k, float(t)) for i, (k, t) in enumerate(points(400, 1, 0.4))] + [(900, None, 1.0), (901, "a", None)]
    spans = [(i, rng.choice(["hot", "a", "b", "d"]), float(lo := rng.randrange(0, 400)), float(lo + rng.choice([0, 1, 10, 60]))) for i in range(80)]
    spans += [(500, None, 0.0, 9.0), (501, "a", None, 9.0), (502, "a", 9.0, 3.0)]
    want = sorted((p, s) for p, k, t in at for s, j, lo, hi in spans if k is not None and k == j and None not in (t, lo) and lo <= t and (t <= hi if closed else t < hi))
    got = intervals.interval_join(spark.createDataFrame(at, "p int, k string, at double"), spark.createDataFrame(spans, "s int, k string, lo double, hi double"), ["k"], closed=closed, width=width)
    assert sorted((r.p, r.s) for r in got.collect()) == want


def test_grid_of_overlapping_anchors(spark):
    """Ends of buckets: half open, the anchor's own moment twice, the last closed."""
    anchors = [("k", 1, T0), ("k", 2, T0 + dt.timedelta(hours=6)), ("z", 3, T0)]
    hours = [-169, -168, -72, -24, -12, -6, -0.001, 0, 5.999, 6, 24, 72, 168, 168.001, 174, 175]
    events = [("k", T0 + dt.timedelta(hours=h)) for h in hours]
    want = {}
    for k, a, t0 in anchors:
        for j, t in events:
            for name, lo, hi, closed in intervals.GRID if k == j else ():
                apart = (t - t0) / dt.timedelta(hours=1)
                if lo <= apart and (apart <= hi if closed else apart < hi):
                    want[k, a, name] = want.get((k, a, name), 0) + 1
    got = intervals.grid_counts(spark.createDataFrame(anchors, "k string, a int, t0 timestamp_ntz"), spark.createDataFrame(events, "k string, at timestamp_ntz"), ["k"], "a")
    assert {(r.k, r.a, r.bucket): r.n for r in got.collect()} == want and want["k", 1, "T0"] == 1 and want["k", 1, "T+7d"] == 2


def test_known_at(spark):
    """A hot key over many parts, facts of one time, moments before any fact, null keys and times."""
    rng = random.Random(3)
    facts = [("hot" if i % 2 else rng.choice("ab"), rng.randrange(0, 300), f"v{i}") for i in range(600)] + [(None, 5, "n"), ("a", None, "never"), ("c", 50, None)]
    moments = [(i, "hot" if i % 3 else rng.choice("abcd"), rng.randrange(-5, 320)) for i in range(900)] + [(2000, None, 5), (2001, None, 4), (2002, "a", None)]
    by = {}
    for k, t, v in sorted((f for f in facts if f[1] is not None), key=lambda f: (f[1], f[2] or "")):
        by.setdefault(k, []).append((t, v))
    want = {}
    for i, k, t in moments:
        old = by.get(k, [])
        at = bisect.bisect_right([x for x, _ in old], t) if t is not None else 0
        want[i] = old[at - 1][1] if at else None
    f = spark.createDataFrame(facts, "k string, known int, v string")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # or so few rows are one part
    try:
        got = asof.known_at(spark.createDataFrame(moments, "i int, k string, at int"), f, ["k"], "at", "known", ["v"])
        rows = got.collect()
    finally:
        spark.conf.unset(coalesce)
    assert len(rows) == len(moments) and {r.i: r.v for r in rows} == want
    assert asof.known_at(spark.createDataFrame([(1, "a", 9)], "i int, k string, at int"), f.limit(0), ["k"], "at", "known", ["v"]).first().v is None


def test_items_matched_by_label(spark):
    """Labels are looked for in all fields, hyphens as blanks; keys without words match nothing."""
    entities = spark.createDataFrame([("name:my-tool",), ("plain",), ("name:",), ("github:a/b",), ("term:My Tool",)], "entity_key string")
    rows = [(1, "My Tool 2", None, None, None), (2, None, "http://x/PLAIN", None, {}), (3, "n", "u", "a/b", None), (4, "n", "u", None, {"k": "my tool"}), (5, "mytool", "", "", {})]
    items = spark.createDataFrame(rows, "item_id int, name string, url string, description string, metadata map<string,string>")
    got = {tuple(r) for r in containment.matched_items(entities, items).collect()}
    assert got == {("name:my-tool", 1), ("name:my-tool", 4), ("term:My Tool", 1), ("term:My Tool", 4), ("plain", 2), ("github:a/b", 3)}
    assert containment.matched_items(entities.filter("entity_key = 'name:my-tool'"), items, 1).first().item_id == 4


def test_postings_come_in_pieces():
    """A batch of many long texts is posted piece by piece, and counted over all of its pieces."""
    import pyarrow as pa

    texts = [f"text {i:04} " * 30 for i in range(1000)]

    class Texts:  # what _postings asks of a DataFrame, so that its function runs here
        sparkSession = sparkContext = property(lambda self: self)  # noqa: N815
        broadcast = staticmethod(lambda v: type("B", (), {"value": v}))
        select = lambda self, *_: self
        mapInArrow = staticmethod(lambda run, _: run)  # noqa: N815

    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(1000)]), pa.array(texts)], ["key", "text"])
    every = np.full(1 << 20, np.uint64(2**64 - 1))
    posted = list(containment._postings(Texts(), every, [3], False)(iter([batch])))
    counted = list(containment._postings(Texts(), every, [3], True)(iter([batch])))
    want = [(str(i), g) for i, t in enumerate(texts) for g in containment.grams(t, 3).tolist()]
    assert [(r["key"], r["gram"]) for b in posted for r in b.to_pylist()] == want
    assert max(len(set(b["key"].to_pylist())) for b in posted) <= 256 and len(counted) == 1
    totals = {}
    for _, g in want:
        totals[g] = totals.get(g, 0) + 1
    assert {r["gram"]: r["n"] for r in counted[0].to_pylist()} == totals


@pytest.mark.parametrize("points", [1, 50, 1 << 20])
def test_texts_looked_at_together_post_what_each_has(monkeypatch, points):
    """No run crosses two texts, whether texts are looked at one by one or many at a time; empty ones and long ones among them."""
    monkeypatch.setattr(containment, "POINTS", points)
    rng = random.Random(2)
    texts = ["", "ab", "", "日本😀"] + ["".join(rng.choice("abé😀 ") for _ in range(rng.choice([0, 1, 2, 3, 20, 200]))) for _ in range(60)] + [""]
    every = np.full(1 << 20, np.uint64(2**64 - 1))
    some = np.array([rng.getrandbits(64) for _ in range(1 << 20)], np.uint64)
    for words in (every, some):
        for sizes in ([3], [1, 2, 3], [2]):
            own = [(i, containment.grams(t, s)) for i, t in enumerate(texts) for s in sizes]
            want = {(i, g) for i, x in own for g in x[bitmaps.admits(words, x)].tolist()}
            got = list(zip(*(x.tolist() for x in containment._wanted_grams(texts, sizes, words)), strict=True))
            assert got == sorted(want)
    assert [len(x) for x in containment._wanted_grams([], [3], every)] == [0, 0]


def test_texts_are_worked_out_once(spark):
    """Postings are counted, made and verified from texts that were written once, each text once."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [(i, f"a name {i % 7} b") for i in range(100)]
    texts = spark.createDataFrame(rows, "id long, text string").select("id", F.udf(read).asNondeterministic()("text").alias("text"))
    found = containment.containing(spark.createDataFrame([("name 3",), ("E 5",)], "name string"), texts)
    assert {r.id for r in found.collect()} == {i for i in range(100) if i % 7 in (3, 5)} and seen.value == 100


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_newest_texts_of_names_slice_by_slice(spark, monkeypatch, kind):
    """Slices of any kind of id give what all texts together give; ids of several texts, null ids and names with too few texts among them."""
    monkeypatch.setattr(containment, "FIRST", 1)
    monkeypatch.setattr(containment, "GROWTH", 2)
    monkeypatch.setattr(containment, "PICKED", 60)
    rng = random.Random(4)
    made = {"long": lambda i: i, "string": lambda i: f"id {i:04}", "date": lambda i: T0.date() + dt.timedelta(days=i)}[kind]
    texts = [(made(rng.randrange(300)), "".join(rng.choice("abcÉ ") for _ in range(rng.choice([0, 5, 40])))) for _ in range(400)]
    texts += texts[:50] + [(made(7), "only here"), (None, "only here"), (None, "nowhere else"), (made(8), None)]
    names = ["a", "B", "é", "ab", "abc", "abca", "abcab", "cab abcab", "only here", "nowhere else", "never", "", None]
    want = {(n.lower(), i) for n in names if n for i, t in texts if t is not None and n.lower() in t.lower()}
    top = {(n, i) for n in {n for n, _ in want} for i in sorted((i for m, i in want if m == n), key=lambda i: (i is not None, i or made(0)), reverse=True)[:3]}
    given = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(texts, f"id {kind}, text string")
    assert len(containment._bounds(given[1].select("id"), 3)) >= 4
    got = [tuple(r) for r in containment.newest_containing(*given, newest=3).collect()]
    assert len(got) == len(set(got)) and set(got) == top


def test_names_that_have_their_newest_texts_meet_no_more(spark, monkeypatch):
    """Names in every text meet a few texts each, not all of them: what meets is not names times texts."""
    met = []
    whole = containment._met

    def counted(*sides):
        found = whole(*sides)
        met.append(found.count())
        return found

    monkeypatch.setattr(containment, "_met", counted)
    names = [(f"name {i:02}",) for i in range(40)] + [("text 3.",)]
    texts = [(i, " ".join(n for n, in names[:40]) + f" text {i}.") for i in range(4000)]
    found = containment.newest_containing(spark.createDataFrame(names, "name string"), spark.createDataFrame(texts, "id int, text string"), newest=2)
    assert {tuple(r) for r in found.collect()} == {(n, i) for n, in names[:40] for i in (3999, 3998)} | {("text 3.", 3)}
    assert sum(met) < 40 * 4000 / 4

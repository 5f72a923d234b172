import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import toxicity
from lodestream.llm.queries import op2_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, toxic int"


@pytest.fixture
def large(sf):
    """The larger tables beside the test's own, for figures that need many labelled rows."""
    path = f"{os.path.dirname(sf.rstrip('/'))}/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no larger tables here")
    return path


def plain_features(text, stems):
    """The features as they are described, by name, in their order: words, stems, pairs next to each other and over gaps."""
    words = re.findall(r"[a-z\u0080-\U0010ffff]+", text)
    out = [("word", w) for w in words]
    for k in stems:
        out += [("stem", w[:k]) for w in words if len(w) > k]
    for gap in (1, 2, 3):
        out += [("pair", gap, a, b) for a, b in zip(words, words[gap:], strict=False)]
    return out


def test_features_equal_plain_ones():
    """Every named feature has one coordinate, and unlike ones hardly ever share one."""
    rng = random.Random(5)
    words = ["a", "Ab", "moron", "morons", "idiot", "straße", "überall", "мусорщик", "日本語", "x9y", "don't", "e-mail"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "...", " 7 "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for stems in ((), (4, 5, 6)):
        named, coordinates = {}, defaultdict(set)
        for text in texts:
            raw, offs = toxicity._texts(pa.array([text]))
            at, row = toxicity.features(raw, offs, stems)
            keys = plain_features(raw.tobytes().decode(), stems)
            assert len(at) == len(keys) and not row.any()
            for key, c in zip(keys, at.tolist(), strict=True):
                assert named.setdefault(key, c) == c
                coordinates[c].add(key)
        assert len(coordinates) >= 0.99 * len(named)
        raw, offs = toxicity._texts(pa.array(texts))
        at, row = toxicity.features(raw, offs, stems)
        for k, text in enumerate(texts):  # the same, all texts at once
            assert sorted(at[row == k].tolist()) == sorted(named[f] for f in plain_features(text.lower(), stems))


def test_weights_are_the_mean_of_the_shards(spark):
    """Each shard learns alone from its rows in the order of their hash; the mean of their weights is what training gives."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["moron", "fine", "good", "day", "words", "idiot"]) for _ in range(8))) for i in range(900)]
    labels = [(i, int("moron" in t or "idiot" in t)) for i, t in rows]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.train(docs, known, shard_rows=300)
    dealt = known.select("doc_id", F.xxhash64("doc_id", F.lit("train")).alias("h")).select("doc_id", "h", F.pmod(F.shiftright("h", 30), F.lit(3)).alias("s")).collect()
    text, y = dict(rows), dict(labels)
    total = defaultdict(float)
    for shard in range(3):
        model = toxicity.Ftrl()
        held = []
        for r in sorted((r for r in dealt if r.s == shard), key=lambda r: r.h):
            at, _ = toxicity.features(*toxicity._texts(pa.array([text[r.doc_id]])))
            held.append((np.unique(at), float(y[r.doc_id])))
        for _ in range(toxicity.EPOCHS):
            for at, label in held:
                model.learn(at, label)
        for at, w in zip(*(x.tolist() for x in model.nonzero()), strict=True):
            total[at] += w / 3
    assert got.keys() == total.keys() and all(abs(got[k] - total[k]) < 1e-9 for k in got)


def test_features_see_words_not_layout():
    raw, offs = toxicity._texts(pa.array(["You IDIOT!!!", "you %%% idiot", "", None, "9 8 7", "bäd wörd"]))
    at, row = toxicity.features(raw, offs)
    by = [sorted(at[row == k].tolist()) for k in range(6)]
    assert by[0] == by[1] and len(by[0]) == 4  # two words, a stem, a pair
    assert not by[2] and not by[3] and not by[4] and by[5]


def test_query_on_held_out_rows(spark, large):
    sf = large
    got = {r.doc_id: r for r in op2_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    caught = sum(p for y, p in held if y)
    assert caught >= 0.85 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.02 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.classify(docs, x).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(one) == sorted(two)


def test_nulls_repeats_and_no_labels(spark):
    rows = [(i, ("moron " if i % 3 == 0 else "fine ") * (1 + i % 4) + "words", None, None, "x", 0) for i in range(400)]
    rows += [(None, "moron", None, None, None, None), (900, None, None, None, None, None), (901, "", None, None, None, None), (3, rows[3][1], None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(None, 1), (3, 1), (7000, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 400)
    empty = {r.score for r in got if r.doc_id in (900, 901)}
    assert len(empty) == 1
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert all(not re.search("moron", r.text or "") for r in kept.collect()) and kept.filter("text like '%fine%'").count() == sum("fine" in (r[1] or "") for r in rows)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert np.allclose([r.score for r in none], 0.05)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_stems_are_whole_characters_and_can_be_left_out():
    raw, offs = toxicity._texts(pa.array(["мусорщик", "мусорный", "abcde", "abcdf"]))
    at, row = toxicity.features(raw, offs)
    by = [set(at[row == k].tolist()) for k in range(4)]
    assert [len(x) for x in by] == [4, 4, 2, 2]  # the word and its stems of 4, 5, 6 (and of 4) characters
    assert len(by[0] & by[1]) == 2 and len(by[2] & by[3]) == 1
    at, row = toxicity.features(raw, offs, stems=())
    assert len(at) == 4


def test_ftrl_equals_a_plain_one():
    """Coordinate by coordinate, as the algorithm is published, over dictionaries."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 50, rng.integers(1, 12))).astype(np.int32) for _ in range(2000)]
    rows = [(at, float((at % 7 == 3).any())) for at in rows]
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        first = 0.0 if i == -1 else l1
        if abs(z[i]) <= first:
            return 0.0
        return -(z[i] - math.copysign(first, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    model = toxicity.Ftrl(64)
    for at, y in rows:
        own = [*at.tolist(), -1]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in own:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
            n[i] += g * g
        model.learn(at, y)
    got = dict(zip(*(x.tolist() for x in model.nonzero()), strict=True))
    want = {i: weight(i) for i in [*range(50), -1] if i == -1 or weight(i)}
    assert got.keys() == want.keys() and len(want) > 5
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_recall_with_and_without_stems(spark, large):
    sf = large
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    caught = []
    for stems in ((), toxicity.STEMS):
        held = [(truth[r.doc_id], r.predicted) for r in toxicity.classify(docs, labels, stems=stems).collect() if r.held_out and r.doc_id in truth]
        caught.append((sum(p for y, p in held if y), sum(y for y, _ in held), sum(p for y, p in held if not y)))
    print("held-out toxic caught, all, clean hit, without and with stems:", caught)
    assert caught[1][0] >= caught[0][0] >= 0.5 * caught[0][1]

import itertools
import random
import re

import numpy as np
import xxhash

from lodestream.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, key int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(docs, fps):
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            parent[find(a)] = find(b)
    least = {}
    for i, d in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(docs))]


def test_triples_cover_every_four_positions():
    triples = [set(t) for t in simhash.covering_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_fingerprint_equals_the_plain_one():
    for t in ["", "a", "A b\tc", "One two THREE four", "É x y z É x y z\x0bq", "w " * 500, "a b c d e f g"]:
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_query(spark, sf):
    from lodestream.llm.queries import op7_simhash

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [plain(t) for _, t in docs]
    want = {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, components([d for d, _ in docs], fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op7_simhash(spark, sf).collect()} == want


def test_links_connect_all_that_is_linked_with_large_postings(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(200)}
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = components(list(range(len(fps))), fps)
    for block in (8, 4096):
        got = simhash.links(df, block=block).collect()
        assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in got)
        place = {s: i for i, s in enumerate(signed)}
        parent = list(range(len(fps)))
        for _ in range(len(fps)):
            for r in got:
                m = min(parent[place[r.a]], parent[place[r.b]])
                parent[place[r.a]] = parent[place[r.b]] = m
        groups = lambda x: {tuple(i for i, v in enumerate(x) if v == k) for k in set(x)}
        assert groups(parent) == groups(want)


def test_nulls_repeats_and_one_of_each(spark):
    t = "one two three four five six seven eight nine ten"
    docs = [(5, t), (5, t), (3, t.upper()), (9, None), (8, ""), (None, "alone in the world of words and more"), (7, "quite another text with words of its own kind")]
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = [plain(x) for _, x in docs]
    assert got == sorted(zip([d for d, _ in docs], components([d for d, _ in docs], fps), strict=True), key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 8, None]
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_each_keeps_unrelated_texts_under_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven eight nine ten", "quite another text with words of its own kind"
    c, d = "alone in the world of words and more", "the last of these has nothing in common with them"
    docs = [(None, a), (None, b), (None, b.upper()), (7, c), (7, d), (12, d.upper())]
    kept = simhash.one_of_each(spark.createDataFrame([(*x, None, None, None) for x in docs], SCHEMA)).collect()
    assert len(kept) == 4
    assert {(r.doc_id, r.text.lower()) for r in kept} == {(None, a), (None, b), (7, c), (7, d)}


def test_clashing_columns_other_ids_and_hot_fingerprints(spark, monkeypatch):
    names = ["_id", "_hash", "_nth", "_key", "_rows", "row_hash", "node"]
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(k, x, *[n + k for n in names]) for k, x in (("b", t), ("a", t), ("c", "quite another text with words of its own kind"))], "doc_id string, text string, " + ", ".join(f"{n} string" for n in names))
    for hot in (1, 1000):
        monkeypatch.setattr(simhash, "HOT", hot)
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
        assert sorted(r.doc_id for r in kept.collect()) == ["a", "c"]

import hashlib

from pyspark.sql import functions as F

from lodestream.llm import fingerprints as fp
from lodestream.llm.queries import op3_fingerprints

SCHEMA = "doc_id long, text string, h string, fingerprint string, part int"


def expected(docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out = []
    for k, (i, t) in enumerate(docs):
        t, n = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        e = t[: len(t) - q] + n[:q]
        a, b, c = (fp.canonical(x) for x in (t, e, n))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), float(a == b), float(a == c), a, b))
    return out


def check(got, docs):
    want = expected(docs)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1], r[2])
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.fingerprint, r.edited_fingerprint) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    of, back = {}, {}
    for g, w in zip(got, want, strict=True):
        for name, form in ((g[5], w[5]), (g[6], w[6])):
            assert of.setdefault(form, name) == name and back.setdefault(name, form) == form


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op3_fingerprints(spark, sf).collect(), docs)


def test_nulls_ties_and_one_row(spark):
    docs = [(1, "Straße  and ﬁre"), (2, "STRASSE and\tfire "), (3, None), (4, ""), (4, ""), (4, "abc"), (None, "x" * 50), (7, "日本語のテキスト" * 9), (8, "ab")]
    df = spark.createDataFrame([(*d, "a", "b", 1) for d in docs], SCHEMA)
    check(fp.compared(df).collect(), docs)
    names = {(r.doc_id, r.fingerprint) for r in fp.fingerprints(df).collect()}
    by = dict(n for n in names if n[0] in (1, 2))
    assert by[1] == by[2]
    check(fp.compared(df.filter("doc_id = 1")).collect(), docs[:1])
    assert fp.compared(df.limit(0)).count() == 0 and fp.fingerprints(df.limit(0)).count() == 0


def test_different_bytes_in_one_bucket_are_told_apart(spark):
    forms = spark.createDataFrame([(b"h1", b"a"), (b"h1", b"a"), (b"h2", b"a"), (b"h2", b"b")], "hash binary, form binary")
    mixed = fp.mixed_buckets(forms)
    assert [bytes(r["hash"]) for r in mixed.collect()] == [b"h2"]
    rows = spark.createDataFrame([(b"h1", b"s1"), (b"h2", b"s2"), (b"h2", b"s3")], "d binary, s binary")
    got = [r.d for r in fp.named("d", "s", mixed, rows).collect()]
    assert len(set(got)) == 3 and b"h1".hex() in got


def test_a_hot_id_spreads_over_parts(spark):
    """A third of all rows under one id, and more without one, are dealt by the beginnings of their texts, in order."""
    docs = [(7, f"{k:05} hot") for k in range(1000)] + [(None, f"{k:04} none") for k in range(500)] + [(k, f"text {k}") for k in range(8, 1500)]
    df = spark.createDataFrame([(i, t, "h", "f", 0) for i, t in docs], SCHEMA).repartition(6)
    check(fp.compared(df).collect(), docs)
    first, text = F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit(""))
    sizes = df.repartitionByRange(8, first, F.substring(text, 1, fp.BEGINNING)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 1000

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestream.llm import exactdedup
from lodestream.llm.queries import op11_exact_dedup

SCHEMA = "doc_id long, text string, kept string, n int, mark string, _metadata string, digest string"


def expected(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for form, rows in groups.items():
        rows.sort()
        sha = hashlib.sha256(form.encode()).hexdigest()
        out += [(r[3], rows[0][3], len(rows), k == 0, sha) for k, r in enumerate(rows)]
    return sorted(out, key=str)


def stored(spark, path, docs, parts=1, mode="append"):
    rows = [(i, t, "x", 1, "x", "x", "x") for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.mode(mode).parquet(str(path))
    return str(path)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


DOCS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, "a b "), (5, None), (6, ""), (None, " \x0b\x0c\r"), (7, "a b"), (8, "ab "), (9, "x" * 300_000), (10, "x" * 299_999 + " x"), (None, "lone"), (None, "lone"), (11, "é"), (12, "é"), (11, "é"), (13, "once")]


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op11_exact_dedup(spark, sf)) == expected(docs)


@pytest.mark.parametrize("digits", [64, 1])
def test_nulls_ties_blanks_clashing_names_and_equal_digests(spark, tmp_path, digits):
    """With one hexadecimal digit as the digest, unlike texts meet in one entry and are told apart by their bytes."""
    path = stored(spark, tmp_path / "in", DOCS * 2, 5)
    found = exactdedup.deduplicated(spark, path, digest=lambda form: F.substring(F.sha2(form, 256), 1, digits), maxFilesPerTrigger=2)
    assert got(found) == expected(DOCS * 2)
    assert found.filter("kept").count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in DOCS})


def test_state_lasts_over_restarts(spark, tmp_path):
    """A second run on the same work folder reads the new files alone and still hits what the first one registered."""
    path = stored(spark, tmp_path / "in", DOCS[:9])
    work = f"file://{tmp_path}/work"
    assert got(exactdedup.deduplicated(spark, path, work=work)) == expected(DOCS[:9])
    stored(spark, path, DOCS[9:] + DOCS[:4])
    query = exactdedup.registered(spark, path, work)
    query.awaitTermination()
    assert query.lastProgress["numInputRows"] == len(DOCS[9:] + DOCS[:4])
    again = exactdedup.deduplicated(spark, path, work=work)  # nothing new to read
    assert got(again) == expected(DOCS + DOCS[:4])


def test_settings_are_put_back(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    exactdedup.deduplicated(spark, stored(spark, tmp_path / "in", DOCS[:3])).collect()
    assert spark.conf.get(name, None) == before


def test_empty_table(spark, tmp_path):
    assert got(exactdedup.deduplicated(spark, stored(spark, tmp_path / "in", []))) == []


def test_a_third_under_one_text_is_combined_before_it_is_dealt(spark, tmp_path):
    docs = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    found = got(exactdedup.deduplicated(spark, stored(spark, tmp_path / "in", docs, 6)))
    assert found == expected(docs)

import re

import public_tokenizers
import tiktoken  # noqa: F401

import corpus_pipeline as cp
from lodestream.llm import bpe, simhash, toxicity


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(cp.STAGES)
    assert list(stage) == ["toxicity", "simhash near-dedup", "pii", "mixing", "byte-level bpe"]

    clean = stage["toxicity"](spark, docs, sf).cache()
    assert clean.schema == docs.schema
    scores = {r.doc_id: r.predicted for r in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in scores.items() if not p)

    single = stage["simhash near-dedup"](spark, clean, sf).cache()
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))

    private = stage["pii"](spark, single, sf).cache()
    assert private.columns == docs.columns and private.count() == single.count()
    old = {r.doc_id: r.text for r in single.collect()}
    for r in private.collect():
        assert r.n_chars == len(r.text)
        assert all(m not in r.text for m in re.findall(r"[\w.]+@[\w.]+\.com", old[r.doc_id]))

    mixed = stage["mixing"](spark, private, sf).cache()
    assert mixed.columns == docs.columns and private.count() <= mixed.count() <= 2 * private.count()

    last = stage["byte-level bpe"](spark, mixed, sf)
    assert last.count() == mixed.count() and {"doc_id", "n_tokens", "ids", "ids_sha256"} <= set(last.columns)
    assert last.filter("octet_length(ids) != 4 * n_tokens or sha2(ids, 256) != ids_sha256").count() == 0
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    some = bpe.decode(bpe.encode(mixed, vocabulary), vocabulary).join(mixed.select("doc_id", "text").distinct(), "doc_id")
    assert some.filter("decoded != cast(text as binary)").count() == 0


def test_run(spark, sf):
    assert cp.run(spark, sf).count() > 0


def test_every_stage_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        found = stage(spark, docs, sf)
        assert found.count() == 0, name
        assert name == cp.STAGES[-1][0] or found.columns == docs.columns

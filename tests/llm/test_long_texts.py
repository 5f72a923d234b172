"""Very long texts go through every text operator whole."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe, fingerprints, mixing, pii, simhash, tokenfile, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(400_000)) + " mail me@site.org"
    rows = [(1, long, "en", "s", len(long)), (2, "x" * 1_000_000, "en", "s", 1_000_000), (3, "\n " * 300_000, "en", "t", 600_000), (4, "short", "en", None, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


def test_bpe_and_token_files(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    files = {r.doc_id: r.n_tokens for r in tokenfile.through_files(docs.filter("doc_id in (1, 4)"), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    ids = {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert files == {i: ids[i] + 1 for i in (1, 4)}


def test_the_rest(docs, spark):
    texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes == {i: len(t.split()) for i, t in texts.items()}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs).collect()} == {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    assert fingerprints.compared(docs).count() == 4
    out = {r.doc_id: r for r in pii.pseudonymised(docs).select("doc_id", F.length("text").alias("n"), F.col("text").contains("me@site").alias("m")).collect()}
    assert all(out[i].n == len(t) and not out[i].m for i, t in texts.items())
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 4

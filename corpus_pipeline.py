"""The corpus pipeline: toxic documents go, near copies go, personal data is replaced, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages are written as Parquet
in the shared folder and read again, so a lost executor costs one stage's tasks, not the run. All stages but the last
return the columns of ``documents``. The mix holds a document as often as it is taken, in rows that follow each other, so
each text is encoded once; the last stage returns each row's token ids and the digests that prove the round trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, mixing, pii, simhash, toxicity
from lodestream.llm._shared import written
from lodestream.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(docs, counts_col=None)
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_texts),
]

#: Hashing, learning and the tokenizer's merges are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

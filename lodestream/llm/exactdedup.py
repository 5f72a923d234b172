"""Exact deduplication as a stateful stream (operator 11).

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. A stream reads the files
of a folder; its state, one entry a digest without expiry, is kept by Spark in RocksDB on the executors' disks and saved
in the checkpoint folder. An entry retains the digest, the number of rows, and the row to keep: its length, its id and
its content locator (file and row within it). Rows are combined within a task before they reach the state, so a text
that a third of all rows hold is one entry a task.

A digest of more than one row is a hit. On hits the full bytes are compared: the least and the greatest normalised text
of each hit are taken, again combined within tasks, and where they differ the rows of that digest are grouped by the
texts themselves, so equal digests of different texts lose no row.

Of equal texts the row with most code points stays, then the least id (a row without one comes last), then the first
by locator; exactly one row of a group stays, whatever is repeated. Null texts are empty, and empty texts are equal.
A group whose kept row has no id has a null keep_id. An empty folder of Parquet gives an empty result. Only the id
and text columns are read, so others may have any names. A stream started again on the same work folder goes on from its
checkpoint and reads new files alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import admitted, key_bitmap, shared_dir

#: Characters deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: What one micro-batch reads at most; the input is whole however many it takes.
BYTES_A_TRIGGER = 1 << 40
#: A digest of more than one in HOT rows is hot; there are fewer than HOT of them.
HOT = 1000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(form: Column) -> Column:
    return F.sha2(form, 256)


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _schema(spark: SparkSession, path: str, id_col: str, text_col: str) -> T.StructType:
    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(c, found[c].dataType) for c in (id_col, text_col)])


def _entry(id_type: T.DataType) -> T.StructType:
    mark = T.StructType().add("longer", T.LongType()).add(
        "nameless", T.BooleanType()
    ).add("id", id_type).add("file", T.StringType()).add("row", T.LongType())
    return T.StructType().add("digest", T.StringType()).add("kept", mark).add("n", T.LongType())


def _rows(read: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, digest, form (the normalised text) and mark: what orders the rows of a group, the one to keep first."""
    where = read.metadataColumn("_metadata")
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.struct(
        (-F.length(text)).cast("long").alias("longer"), F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"),
        where["file_path"].alias("file"), where["row_index"].alias("row"),
    )
    return read.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("form"), mark.alias("mark")
    ).withColumn("digest", digest(F.col("form")))


def registered(
    spark: SparkSession, path: str, work: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256,
    **limits: int
):
    """Start the stream over the files of ``path`` that ``work`` has not seen; returns the query, which ends when they are read.

    Every micro-batch writes the entries that it hit under ``work``/hits, one folder an epoch, so a replayed batch
    writes over what it wrote. ``limits`` are options of the file source (``maxFilesPerTrigger``).
    """
    files = path.rstrip("/")
    files = f"{files[:-1]}[{files[-1]}]"  # a pattern of one name: the source takes a folder or a single file by it, but a file by no plain name
    read = spark.readStream.schema(_schema(spark, path, id_col, text_col)).options(
        **(limits or {"maxBytesPerTrigger": BYTES_A_TRIGGER})
    ).parquet(files)
    entries = _rows(read, id_col, text_col, digest).groupBy("digest").agg(F.min("mark").alias("kept"), F.count(F.lit(1)).alias("n"))

    def hits(batch: DataFrame, epoch: int) -> None:
        batch.filter("n > 1").write.mode("overwrite").parquet(f"{work}/hits/epoch={epoch}")

    id_type = _schema(spark, path, id_col, text_col)[0].dataType
    spark.createDataFrame([], _entry(id_type)).write.mode("overwrite").parquet(f"{work}/hits/epoch=-1")
    with _settings(spark, _STATE):
        return entries.writeStream.outputMode("update").foreachBatch(hits).option(
            "checkpointLocation", f"{work}/state"
        ).trigger(availableNow=True).start()


def hit_entries(spark: SparkSession, work: str, id_type: T.DataType) -> DataFrame:
    """digest, kept, n: of each digest that was hit, the entry as of its last micro-batch."""
    found = spark.read.schema(_entry(id_type).add("epoch", T.LongType())).parquet(f"{work}/hits")
    return found.groupBy("digest").agg(F.max_by(F.struct("kept", "n"), "epoch").alias("e")).select("digest", "e.kept", "e.n")


def _with_entries(rows: DataFrame, entries: DataFrame, total: int) -> DataFrame:
    """``rows`` with kept and n, null where the digest was never hit. Hot digests meet their rows by a broadcast of
    fewer than ``HOT`` entries, so no task holds a third of the table; the others by a shuffle."""
    hot = F.broadcast(
        entries.filter(F.col("n") * HOT > total).select(F.col("digest").alias("_hot"), F.col("kept").alias("_kept"), F.col("n").alias("_n"))
    )
    dealt = rows.join(hot, F.col("digest") == F.col("_hot"), "left")
    near = dealt.filter("_hot is not null").select(*rows.columns, F.col("_kept").alias("kept"), F.col("_n").alias("n"))
    rest = dealt.filter("_hot is null").select(*rows.columns)
    return near.union(rest.join(entries.filter(F.col("n") * HOT <= total), "digest", "left").select(*rows.columns, "kept", "n"))


def mixed_digests(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """digest of the hits whose rows are not all of the same bytes.

    A bitmap of fixed size keeps the texts of other digests out of the shuffle (beyond some tens of millions of hits it
    admits more and more of them, which costs their shuffle and changes nothing); the texts of a hit are brought down to
    their least and their greatest within each task.
    """
    texts = admitted(rows.select("digest", "form"), F.col("digest"), key_bitmap(entries, F.col("digest")))
    ends = texts.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    return ends.filter("least != most").select("digest")


def deduplicated(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", work: str | None = None,
    digest: Callable[[Column], Column] = sha256, **limits: int
) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for every row of the Parquet files under ``path``."""
    work = work or f"{shared_dir(spark)}/lodestream/exact-{uuid.uuid4().hex}"
    registered(spark, path, work, id_col, text_col, digest, **limits).awaitTermination()
    schema = _schema(spark, path, id_col, text_col)
    read = spark.read.schema(schema).parquet(path)
    rows = _rows(read, id_col, text_col, digest)
    entries = hit_entries(spark, work, schema[0].dataType)
    mixed_path = f"{work}/mixed-{uuid.uuid4().hex}"
    mixed_digests(rows, entries).write.parquet(mixed_path)
    mixed = spark.read.schema("digest string").parquet(mixed_path)
    plain = rows.select("id", "digest", sha256(F.col("form")).alias("sha"), "mark")
    own = F.col("mark")
    if mixed.isEmpty():
        both = _with_entries(plain, entries, read.count())
    else:
        told = rows.join(mixed, "digest", "left_semi")
        groups = told.groupBy("digest", "form").agg(F.min("mark").alias("kept"), F.count(F.lit(1)).alias("n"))
        told = told.join(groups, ["digest", "form"]).select("id", "digest", sha256(F.col("form")).alias("sha"), "mark", "kept", "n")
        both = _with_entries(
            plain.join(mixed, "digest", "left_anti"), entries.join(mixed, "digest", "left_anti"), read.count()
        ).unionByName(told)
    kept = F.coalesce(F.col("kept"), own)
    return both.select(
        F.col("id").alias(id_col), kept["id"].alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (kept == own).alias("kept"), F.col("sha").alias("text_sha256")
    )


ORACLE_SQL = r"""
WITH r AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS form FROM documents),
o AS (SELECT doc_id, form, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY form) AS group_size
  FROM r WINDOW w AS (PARTITION BY form ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(form) AS text_sha256 FROM o
"""

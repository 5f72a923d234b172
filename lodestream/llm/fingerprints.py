"""Document fingerprints: canonical exact digests (operator 3).

A text's canonical form is its NFKC form, case-folded, brought to NFKC again, with every run of white space as one
blank and none at its ends. Documents are grouped by the 128-bit xxhash of that form; where a bucket has two rows or
more, their canonical bytes are compared (least against greatest, which combine before the shuffle), and a bucket
that holds different bytes is told apart by half a SHA-256. So equal canonical texts have equal fingerprints and different
ones different fingerprints.

``edited_pairs`` also fingerprints each text with its end replaced by the beginning of the next document: rows are
range-partitioned by id, paired within partitions, and the last row of each partition is paired with the first of
the next in a second, small step. Each text is shuffled once; the texts whose bytes are to be compared are picked from
the table by a bitmap of fixed size before they are joined.

Null texts are empty; repeated ids are ordered by their text; null ids come first; an empty table gives an empty
result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import admitted, key_bitmap, written


#: Characters of a text that tell which of a range of equal ids it belongs to.
BEGINNING = 64


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digests(text: str) -> tuple[bytes, bytes]:
    """128-bit xxhash and the first half of the SHA-256 of the canonical form."""
    form = canonical(text)
    return xxhash.xxh3_128_digest(form), hashlib.sha256(form).digest()[:16]


def edited(text: str, following: str) -> str:
    """The last quarter of the text, rounded down, replaced by as much of the following text, or all of it."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


# --- byte comparison ------------------------------------------------------------------------------------------------


def mixed_buckets(forms: DataFrame) -> DataFrame:
    """hash of the buckets of (hash, form) whose canonical bytes differ."""
    ends = forms.groupBy("hash").agg(F.min("form").alias("least"), F.max("form").alias("most"))
    return ends.filter("least != most").select("hash")


def canonical_forms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """hash, form of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh3_128_digest(f) for f in forms], pa.binary()), pa.array(forms, pa.binary())], ["hash", "form"]
            )

    return df.select(text_col).mapInArrow(run, "hash binary, form binary")


def named(digest: str, sha: str, mixed: DataFrame | None, df: DataFrame) -> DataFrame:
    """``df`` with column ``digest`` as a hex fingerprint; rows in a mixed bucket carry their SHA-256 too."""
    plain = F.lower(F.hex(digest))
    if mixed is None:
        return df.withColumn(digest, plain)
    marked = df.join(mixed.select(F.col("hash").alias("_mixed")), F.col(digest) == F.col("_mixed"), "left")
    return marked.withColumn(
        digest, F.when(F.col("_mixed").isNull(), plain).otherwise(F.concat_ws("-", plain, F.lower(F.hex(sha))))
    ).drop("_mixed")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint for every row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [digests(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h for h, _ in got], pa.binary()), pa.array([s for _, s in got], pa.binary())],
                [id_col, "fingerprint", "sha"]
            )

    rows = written(df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fingerprint binary, sha binary"), "fingerprints")
    shared = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("fingerprint").alias("hash"))
    wanted = rows.join(shared, F.col("fingerprint") == F.col("hash"), "left_semi").select(F.col(id_col).alias("_id")).distinct()
    texts = admitted(df.select(id_col, text_col), F.col(id_col), key_bitmap(wanted, F.col("_id")))
    texts = texts.join(wanted, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
    mixed = written(mixed_buckets(canonical_forms(texts, text_col)), "mixed")
    return named("fingerprint", "sha", None if mixed.isEmpty() else mixed, rows).select(id_col, "fingerprint")


# --- documents and their edited texts -------------------------------------------------------------------------------

_PAIR = "`{id}` {kind}, n_chars long, edited_sha256 binary, h binary, hs binary, eh binary, ehs binary, nh binary, nhs binary, next_id {kind}, part int, place string, body string"
_NAMES = ["n_chars", "edited_sha256", "h", "hs", "eh", "ehs", "nh", "nhs", "next_id", "part", "place", "body"]


def _pair(text: str, own: tuple[bytes, bytes], following: str, after: tuple[bytes, bytes]) -> tuple:
    changed = edited(text, following)
    return len(text), hashlib.sha256(changed.encode()).digest(), *own, *digests(changed), *after


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_chars, edited_sha256, digests of the text, of its edited text, of the next text, next_id."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spec = _PAIR.format(id=id_col, kind=df.schema[id_col].dataType.simpleString())
    arrow = to_arrow_schema(_parse_datatype_string(spec))
    first, text = F.col(id_col).asc_nulls_first(), F.coalesce(F.col(text_col), F.lit(""))
    # the beginning of the text spreads the rows of one id, and keeps the order
    ordered = df.select(id_col, text_col).repartitionByRange(first, F.substring(text, 1, BEGINNING)).sortWithinPartitions(first, text)
    ordered = ordered.select(id_col, text_col, F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        part = -1
        for batch in batches:
            out = []
            for i, text, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own = digests(text)
                if held is None:
                    out.append((i, *[None] * 9, part, "first", text))
                else:
                    out.append((held[0], *_pair(held[1], held[2], text, own), i, part, "pair", None))
                held = (i, text, own)
            if out:
                yield _batch(out, arrow)
        if held is not None:
            yield _batch([(held[0], *[None] * 9, part, "last", held[1])], arrow)

    rows = written(ordered.mapInArrow(run, spec), "pairs")
    edge = rows.filter("place != 'pair'").select(F.col(id_col).alias("id"), "part", "place", "body")
    firsts = edge.filter("place = 'first'").select(
        F.col("part").alias("next_part"), F.col("id").alias("next_id"), F.col("body").alias("next_body")
    )
    whole = Window.orderBy("part")  # one number for each partition; the texts meet by a join
    after = edge.filter("place = 'first'").select(
        "part", F.coalesce(F.lead("part").over(whole), F.first("part").over(whole)).alias("next_part")
    )
    lasts = edge.filter("place = 'last'").join(after, "part").join(firsts, "next_part").select("id", "body", "next_id", "next_body", "part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, j, following, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((i, *_pair(text, digests(text), following, digests(following)), j, part, "pair", None))
            if out:
                yield _batch(out, arrow)

    return rows.filter("place = 'pair'").union(lasts.mapInArrow(close, spec)).select(id_col, *_NAMES[:9])


def compared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; exact digests are alike (1) or not (0)."""
    pairs = edited_pairs(df, id_col, text_col)
    both = pairs.select(F.col("h").alias("hash")).union(pairs.select("eh"))
    shared = written(both.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "shared")

    def of(column: str) -> DataFrame:
        return pairs.join(shared, F.col(column) == F.col("hash"), "left_semi")

    ids = of("h").select(id_col).union(of("eh").select(id_col)).union(of("eh").select("next_id"))
    bitmap = key_bitmap(ids, F.col(id_col))
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = written(admitted(texts, F.col("_id"), bitmap), "repeated")
    plain = texts.join(of("h").select(F.col(id_col).alias("_want")).distinct(), F.col("_id").eqNullSafe(F.col("_want")), "left_semi")
    forms = canonical_forms(plain, "_text")
    ends = of("eh").select(F.col(id_col).alias("_a"), F.col("next_id").alias("_b"), "eh").distinct()
    changed = texts.join(ends, F.col("_id").eqNullSafe(F.col("_a"))).select("_text", "_b", "eh")
    following = texts.select(F.col("_id").alias("_next"), F.col("_text").alias("_after"))
    changed = changed.join(following, F.col("_b").eqNullSafe(F.col("_next"))).select("_text", "_after", "eh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(canonical(edited(t or "", n or "")), eh) for t, n, eh in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            got = [(eh, f) for f, eh in got if xxhash.xxh3_128_digest(f) == eh]  # repeated ids pair more texts than were
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in got], pa.binary()), pa.array([f for _, f in got], pa.binary())], ["hash", "form"]
            )

    forms = forms.union(changed.mapInArrow(run, "hash binary, form binary"))
    mixed = written(mixed_buckets(forms), "mixed")
    some = None if mixed.isEmpty() else mixed
    for digest, sha in (("h", "hs"), ("eh", "ehs"), ("nh", "nhs")):
        pairs = named(digest, sha, some, pairs)
    same = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return pairs.select(
        id_col, "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.col("h").alias("fingerprint"),
        F.col("eh").alias("edited_fingerprint"), same("h", "eh").alias("near_edited"), same("h", "nh").alias("near_next")
    )

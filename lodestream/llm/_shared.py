"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.components import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset in local runs."""
    return shared_folder(spark)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added while the table has such a column (Spark tells no upper from lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    This cuts the lineage without a copy that a lost executor could take away; the files stay until the
    folder is cleared, as checkpoints do.
    """
    path = f"{shared_dir(df.sparkSession)}/lodestream/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (n + 1, from 0) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offs[0] : offs[-1]]
    offs = offs - offs[0]
    if column.null_count:
        length = np.diff(offs)
        valid = np.asarray(column.is_valid())
        if (length[~valid] != 0).any():  # Arrow leaves the bytes under a null undefined
            raw = raw[np.repeat(valid, length)]
            offs = np.concatenate(([0], np.cumsum(np.where(valid, length, 0))))
    return raw, offs


def binary_array(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column of the slices of ``data`` between ``offs`` (bytes)."""
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offs) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.binary())


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (count[0] of them), first[1], .. as one array of indices."""
    total = int(count.sum())
    ends = np.cumsum(count)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(first - (ends - count), count)
    return out


def row_chunks(offs: np.ndarray, limit: int):
    """Ranges of rows whose bytes stay under ``limit``; a row larger than that stands alone."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Bits of a key bitmap: at most 2**20 words of 64 bits, whatever the input.
BITMAP_BITS = 26


def key_bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """A bitmap of hashed keys. Its size is fixed, so it may be broadcast; it admits every key and few others."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")
    ).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[np.asarray(words["w"])] = np.asarray(words["b"]).view(np.uint64)
    return out


def admitted(df: DataFrame, key: Column, bitmap: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap, so that a join on the key need not shuffle the others."""
    table = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        words = table.value
        for batch in batches:
            p = np.asarray(batch.column(batch.num_columns - 1))
            on = (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            if on.any():
                yield batch.filter(pa.array(on))

    place = F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)).alias("__place")
    marked = df.select("*", place)
    return marked.mapInArrow(run, marked.schema).drop("__place")

"""Token ids in files with directly addressable codes (operator 9).

A file set is a Parquet folder whose rows are shards of about a million ids, in ascending document order. An id is
cut into 8-bit chunks; level k holds the k-th chunk of every id that has one, its continuation bitmap tells which
ids go on to level k + 1, and the bitmap's rank directory (a 32-bit count per 65,536 bits, a 16-bit count per 64)
tells where. Any id is read from the levels with one rank per level: nothing is decoded up to it.

Documents are range-partitioned and sorted by id before they are encoded, so the only shuffle moves each text once.
Null texts hold only the end id; repeated rows are stored each, in order of their text; null document ids come first;
an empty table makes an empty file set; columns other than the two named are ignored. The definition's added tokens in a
text get their ids, as the library has it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import shared_dir, spans, utf8
from .bpe import encode_chunks
from .pretokens import distinct_pieces, piece_starts

#: Ids a shard holds; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Bytes of text that one round of array work covers, and pieces that a Python worker remembers between rounds.
CHUNK_BYTES, MEMO = 4 << 20, 500_000


# --- the code -------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes], list[bytes]]:
    """(chunk levels, continuation bitmaps, coarse ranks, fine ranks) of the ids."""
    levels, bitmaps, coarse, fine = [], [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        if not more.any():
            return levels, bitmaps, coarse, fine
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(more) // 64) * 8, np.uint8)
        words[: len(bits)] = bits
        ones = np.bitwise_count(words.view("<u8")).astype(np.int64)
        before = np.cumsum(ones) - ones
        top = before[::1024]
        bitmaps.append(words.tobytes())
        coarse.append(top.astype("<u4").tobytes())
        fine.append((before - np.repeat(top, 1024)[: len(before)]).astype("<u2").tobytes())
        rest = rest[more] >> 8


class Codes:
    """Random access into one shard."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], coarse: list[bytes], fine: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.words = [np.frombuffer(x, "<u8") for x in bitmaps]
        self.coarse = [np.frombuffer(x, "<u4") for x in coarse]
        self.fine = [np.frombuffer(x, "<u2") for x in fine]

    def at(self, where: np.ndarray) -> np.ndarray:
        """The ids at the given places, in any order."""
        out = self.levels[0][where].astype(np.uint32)
        own, at = np.arange(len(where)), where
        for k, words in enumerate(self.words):
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            own, at, word, bit = own[on], at[on], word[on], bit[on]
            at = self.coarse[k][at >> 16].astype(np.int64) + self.fine[k][at >> 6] + np.bitwise_count(
                word & ((np.uint64(1) << bit) - np.uint64(1))
            )
            out[own] |= self.levels[k + 1][at].astype(np.uint32) << (8 * (k + 1))
        return out


# --- writing --------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class PieceEncoder:
    """The tokenizers library's model over the distinct pre-tokens of a batch; equal pieces have equal ids, so each is encoded once.

    ``by_piece`` tells whether the definition is byte-level BPE with the usual pattern, as this needs; if not, texts go
    to the library whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        told = json.loads(definition)
        cut, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_piece = model.get("type") == "BPE" and not model.get("dropout") and not told.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.letters = _byte_letters()
        self.memo: dict[bytes, bytes] = {}

    def __call__(self, pad: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = piece_starts(pad, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        size = np.diff(np.append(start, offs[-1]))
        index, kind = distinct_pieces(pad, start, size)
        raw, memo = pad.tobytes(), self.memo
        pieces = [raw[a : a + z] for a, z in zip(start[index].tolist(), size[index].tolist(), strict=True)]
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = pieces
        model, letters = self.tokenizer.model.tokenize, self.letters
        for p in new:
            memo[p] = array("I", [t.id for t in model(p.decode("latin-1").translate(letters))]).tobytes()
        got = [memo[p] for p in pieces]
        each = np.fromiter(map(len, got), np.int64, len(got)) // 4
        pool = np.frombuffer(b"".join(got), np.uint32)
        count = each[kind]
        ids = pool[spans((np.cumsum(each) - each)[kind], count)]
        ends = np.concatenate(([0], np.cumsum(count)))
        return ids, np.diff(ends[np.searchsorted(start, offs)])


class AddedTokens:
    """A definition's added tokens, which the library cuts out of a text before anything else.

    The texts between them are encoded as texts of their own. Tokens that also take the white space beside them, or stand
    only as whole words, are left to the library: a text that holds one of those is given to it whole.
    """

    def __init__(self, definition: str):
        found = json.loads(definition).get("added_tokens") or []
        self.ids = {t["content"]: t["id"] for t in found if t["content"]}
        self.plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in found)
        longest = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def rows(self, column: pa.Array) -> np.ndarray:
        """Places of the texts that hold one."""
        on = np.zeros(len(column), bool)
        for token in self.ids:
            on |= np.asarray(pc.fill_null(pc.match_substring(column, token), False))
        return np.flatnonzero(on)

    def encode(self, text: str, encoder: PieceEncoder) -> np.ndarray:
        if not (self.plain and encoder.by_piece):
            return np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        cut = self.pattern.split(text)
        out = []
        for k, part in enumerate(cut):
            if k % 2:
                out.append(np.array([self.ids[part]], np.uint32))
            elif part:
                raw, offs = utf8(pa.array([part], pa.large_string()))
                out += [ids for _, _, ids, _ in encode_chunks(raw, offs, encoder, CHUNK_BYTES)]
        return np.concatenate(out)


def encoded(column: pa.Array, encoder: PieceEncoder, added: AddedTokens) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [a, b), their ids, and how many each has, as the library gives them."""
    at = 0
    alone = added.rows(column) if encoder.by_piece else np.arange(len(column))
    for special in [*alone.tolist(), len(column)]:
        raw, offs = utf8(column.slice(at, special - at))
        for a, b, ids, n in encode_chunks(raw, offs, encoder, CHUNK_BYTES):
            yield at + a, at + b, ids, n
        if special < len(column):
            ids = added.encode(column[special].as_py() or "", encoder)
            yield special, special + 1, ids, np.array([len(ids)], np.int64)
        at = special + 1


def _schema(id_type: T.DataType) -> T.StructType:
    binaries = T.ArrayType(T.BinaryType())
    fields = [
        ("part", T.IntegerType()), ("seq", T.IntegerType()), ("n_tokens", T.LongType()), ("ids_of_documents", T.ArrayType(id_type)),
        ("ends", T.ArrayType(T.LongType())), ("levels", binaries), ("bitmaps", binaries), ("coarse_ranks", binaries),
        ("fine_ranks", binaries)
    ]
    return T.StructType([T.StructField(*f) for f in fields])


def write_tokens(
    df: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS
) -> None:
    """Encode every text with the tokenizer's definition file, append ``end_id``, and write the shards under ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    schema = _schema(df.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        encoder, added = PieceEncoder(definition.value), AddedTokens(definition.value)
        docs: list[pa.Array] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            nonlocal seq, held
            ids = np.concatenate(parts)
            own = [part, seq, len(ids), pa.concat_arrays(docs).to_pylist(), np.cumsum(np.concatenate(counts)).tolist(), *pack(ids)]
            docs.clear(), parts.clear(), counts.clear()
            seq, held = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(own, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for a, b, ids, n in encoded(batch.column(1), encoder, added):
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, end_id), n + 1
                ends = np.cumsum(n)
                done = 0
                while done < b - a:  # as many rows as the shard still takes, one at least
                    base = int(ends[done - 1]) if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, base + shard_tokens - held, side="right")))
                    docs.append(batch.column(0).slice(a + done, upto - done))
                    parts.append(ids[base : ends[upto - 1]])
                    counts.append(n[done:upto])
                    held, done = held + len(parts[-1]), upto
                    if held >= shard_tokens or done < b - a:
                        yield shard()
        if held:
            yield shard()

    first, text = F.col(id_col).asc_nulls_first(), F.col(text_col).asc_nulls_first()
    # the beginning of the text spreads the rows of one id, and keeps the order
    ordered = df.select(id_col, text_col).repartitionByRange(
        first, F.substring(text_col, 1, 64).asc_nulls_first()
    ).sortWithinPartitions(first, text)
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


# --- reading --------------------------------------------------------------------------------------------------------


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: ids before each shard, from two small prefix sums (over parts, then over a part's shards)."""
    shards = spark.read.parquet(path).select("part", "seq", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("own_base"))
    return shards.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("own_base")).alias("base"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row per document: id, start, n_tokens, ids_crc32 and, if asked, ``ids`` (little-endian unsigned 32-bit)."""
    files = spark.read.parquet(path)
    item = files.schema["ids_of_documents"].dataType.elementType.simpleString()
    out = f"part int, seq int, `{id_col}` {item}, own_start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                part, seq = row.column(0)[0], row.column(1)[0]
                codes = Codes(*(row.column(c)[0].as_py() for c in range(5, 9)))
                docs = row.column(3).flatten()
                ends = np.asarray(row.column(4).flatten())
                begins = np.concatenate(([0], ends[:-1]))
                done = 0
                while done < len(ends):
                    upto = max(done + 1, int(np.searchsorted(ends, begins[done] + (1 << 18), side="right")))
                    lo = int(begins[done])
                    data = codes.at(np.arange(lo, int(ends[upto - 1]))).astype("<u4").tobytes()
                    cut = [
                        data[4 * (x - lo) : 4 * (y - lo)] for x, y in zip(begins[done:upto].tolist(), ends[done:upto].tolist(), strict=True)
                    ]
                    n = upto - done
                    columns = [
                        pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), docs.slice(done, n),
                        pa.array(begins[done:upto]), pa.array((ends - begins)[done:upto]),
                        pa.array([zlib.crc32(x) for x in cut], pa.int64())
                    ]
                    names = ["part", "seq", id_col, "own_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array(cut, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    done = upto

    rows = files.select(
        "part", "seq", "n_tokens", "ids_of_documents", "ends", "levels", "bitmaps", "coarse_ranks", "fine_ranks"
    ).mapInArrow(run, out)
    rows = rows.join(shard_starts(spark, path), ["part", "seq"])
    return rows.select(id_col, (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place_col: str = "place") -> DataFrame:
    """place_col, token_id for global token places; each is one rank walk in its shard. Places outside the files have no row.

    A place finds its shard in a sorted list of the shards' first places, one number a shard (a million tokens), and the
    places of a shard are read in one Arrow call against its codes, which come once a task.
    """
    files = spark.read.parquet(path)
    starts = shard_starts(spark, path).join(files.select("part", "seq", "n_tokens"), ["part", "seq"]).orderBy("base", "n_tokens").toArrow()
    table = spark.sparkContext.broadcast([np.asarray(starts[c], np.int64) for c in ("base", "n_tokens", "part", "seq")])

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n, part, seq = table.value
        for batch in batches:
            place = np.asarray(batch.column(0).drop_null(), np.int64)
            shard = np.searchsorted(base, place, side="right") - 1
            on = (shard >= 0) & (place < (base + n)[shard]) if len(base) else np.zeros(len(place), bool)
            place, shard = place[on], shard[on]
            arrays = [part[shard].astype(np.int32), seq[shard].astype(np.int32), place, place - base[shard]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["part", "seq", "place", "own"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes = None, None
        for batch in batches:
            of = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            at = 0
            while at < len(of):
                end = at
                while end < len(of) and of[end] == of[at]:
                    end += 1
                lists = [batch.column(c)[at] for c in range(4, 8)]
                if lists[0].is_valid:  # the shard's own row stands before its places
                    shard, codes = of[at], Codes(*(x.as_py() for x in lists))
                rows = batch.slice(at, end - at)
                rows = rows.filter(rows.column(2).is_valid())
                if rows.num_rows and shard == of[at]:
                    ids = codes.at(np.asarray(rows.column(3))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([rows.column(2), pa.array(ids)], ["place", "token_id"])
                at = end

    wanted = places.select(F.col(place_col).cast("long")).mapInArrow(located, "part int, seq int, place long, own long")
    codes = files.select("part", "seq", "levels", "bitmaps", "coarse_ranks", "fine_ranks")
    both = wanted.unionByName(codes.join(wanted.select("part", "seq").distinct(), ["part", "seq"], "left_semi"), allowMissingColumns=True)
    both = both.repartition("part", "seq").sortWithinPartitions("part", "seq", F.col("place").asc_nulls_first())
    found = both.select(
        "part", "seq", "place", "own", "levels", "bitmaps", "coarse_ranks", "fine_ranks"
    ).mapInArrow(walked, "place long, token_id long")
    return found.select(F.col("place").alias(place_col), "token_id")


def through_files(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the table's token files in the shared folder and read the documents back from them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestream/tokens-{uuid.uuid4().hex}"
    write_tokens(df, tokenizer_path, path, end_id, id_col, text_col)
    return read_documents(spark, path, id_col, with_ids=False)


__all__ = ["CHUNK_BYTES", "Codes", "pack", "read_documents", "shard_starts", "through_files", "tokens_at", "write_tokens"]

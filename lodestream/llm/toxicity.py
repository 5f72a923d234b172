"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 2).

A text's words are the runs of letters of its lower-cased form (ASCII letters and all characters beyond ASCII), so
digits, marks and layout around a word do not hide it. Features are the presence of words, of word pairs and of pairs
with one or two words between them, hashed to 2**20 coordinates; and, as the parameter ``stems`` says, of the first
four, five and six characters of longer words, which stand for inflected forms ((): none).

Learning is bounded by about ``MAX_ROWS`` labelled ids, chosen by a hash of the id, one text each (the least, if an id has
several): the rows are dealt to tasks of about ``SHARD_ROWS``, each runs FTRL-proximal (a learning rate per coordinate,
L1 that keeps most weights at exactly zero), and the shards' weights are averaged per coordinate. What is broadcast to score the corpus is the list of non-zero weights,
at most the 2**20 coordinates and in practice some thousands. Scoring is one pass over all texts, without a shuffle.

Null and empty texts score the intercept alone; repeated rows score alike; a label that is given twice counts as
toxic if any row says so; without labelled rows every score is the prior's 0.05; labels without a document are
ignored; columns other than those named are ignored or, in ``without_toxic``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import row_chunks, utf8
from .pretokens import mixed, padded, piece_hash

BITS = 20
#: Bytes of text whose features are held at once.
CHUNK_BYTES = 1 << 20
#: Characters of a longer word that stand for its stem.
STEMS = (4, 5, 6)
#: Most labelled rows that are learned from, and those that one task learns from.
MAX_ROWS, SHARD_ROWS = 24_000, 6_000
#: FTRL-proximal: learning rate, its smoothing, L1, L2; passes over a shard; score from which a text is toxic.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
EPOCHS, THRESHOLD, PRIOR = 3, 0.3, 0.05

_LETTER = np.zeros(256, bool)
_LETTER[list(range(ord("a"), ord("z") + 1)) + list(range(128, 256))] = True


def features(raw: np.ndarray, offs: np.ndarray, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, row) of every feature of the lower-cased texts between ``offs``, repeats included."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(raw):
        return none
    inside = _LETTER[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offs[:-1][np.diff(offs) > 0]
    begin[edges] = inside[edges]
    start = np.flatnonzero(begin)
    if not len(start):
        return none
    gap = np.append(np.flatnonzero(~inside), len(raw))  # a word ends at the next mark, the next text or the end
    end = np.minimum(gap[np.searchsorted(gap, start)], offs[np.searchsorted(offs, start, side="right")])
    row = np.searchsorted(offs, start, side="right") - 1
    word = piece_hash(padded(raw), start, end - start)
    found, rows = [word], [row]
    if stems:
        char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters begin
        first = np.searchsorted(char, start)
    for k in stems:
        stop = char[np.minimum(first + k, len(char) - 1)]
        at = np.flatnonzero(stop < end)
        found.append(piece_hash(padded(raw), start[at], (stop - start)[at], seed=1))
        rows.append(row[at])
    for k, salt in ((1, 0xA5A5A5A5), (2, 0x5C5C5C5C), (3, 0x3B3B3B3B)):
        at = np.flatnonzero(row[k:] == row[:-k])
        found.append(mixed(word[at] * np.uint64(0x9E3779B97F4A7C15) + word[at + k] + np.uint64(salt)))
        rows.append(row[at])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rows)


def feature_chunks(column: pa.Array, stems: tuple[int, ...] = STEMS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, coordinates, rows within) of a column of texts, about a MB at a time."""
    _, offs = utf8(column)
    for a, b in row_chunks(offs, CHUNK_BYTES):
        yield a, b, *features(*_texts(column.slice(a, b - a)), stems)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column.cast(pa.large_string())))


class Ftrl:
    """FTRL-proximal over sparse binary rows; the intercept has no L1."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.z0 = self.n0 = 0.0

    @staticmethod
    def _weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float) -> None:
        z, n = self.z[at], self.n[at]
        w, w0 = self._weights(z, n, L1), float(self._weights(self.z0, self.n0, 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - y
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.z0 += g - (np.sqrt(self.n0 + g * g) - np.sqrt(self.n0)) / ALPHA * w0
        self.n0 += g * g

    def nonzero(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and weights; the intercept is coordinate -1."""
        w = self._weights(self.z, self.n, L1)
        at = np.flatnonzero(w)
        return np.append(at, -1), np.append(w[at], float(self._weights(self.z0, self.n0, 0.0)))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS,
    shard_rows: int = SHARD_ROWS, stems: tuple[int, ...] = STEMS
) -> dict[int, float]:
    """Non-zero weights by coordinate, with the intercept at -1, learned from about ``max_rows`` labelled documents at most."""
    known = labels.filter(
        F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    ).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    n = known.count()
    if not n:
        return {-1: float(np.log(PRIOR / (1 - PRIOR)))}
    known = known.withColumn("_h", F.xxhash64("_id", F.lit("train")))
    shards = max(1, min(n, max_rows) // shard_rows)
    part = min(1 << 30, max_rows * (1 << 30) // n)
    chosen = known.filter(F.pmod("_h", F.lit(1 << 30)) < part)  # max_rows or so ids of 24 bytes: a bounded broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"), F.first("_h").alias("_h"))
    rows = rows.select("_text", "_y", F.pmod(F.shiftright("_h", 30), F.lit(shards)).cast("int").alias("_shard"), "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def learned() -> Iterator[pa.RecordBatch]:
            if held:
                model = Ftrl()
                for _ in range(EPOCHS):
                    for at, label in held:
                        model.learn(at, label)
                at, w = model.nonzero()
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

        for batch in batches:
            y, own = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b, at, row in feature_chunks(batch.column(0), stems):
                key = np.unique(row << BITS | at)
                cut = np.searchsorted(key >> BITS, np.arange(b - a + 1))
                for k in range(b - a):
                    if own[a + k] != shard:  # rows come sorted by shard
                        yield from learned()
                        shard = own[a + k]
                    held.append(((key[cut[k] : cut[k + 1]] & ((1 << BITS) - 1)).astype(np.int32), y[a + k]))
        yield from learned()

    dealt = rows.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_h")
    learned = dealt.mapInArrow(run, "at long, w double")
    alone = learned.groupBy("at").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
    got = {r["at"]: (r["w"], r["n"]) for r in alone.collect()}
    if not got:
        return {-1: float(np.log(PRIOR / (1 - PRIOR)))}
    models = got[-1][1]
    return {at: w / models for at, (w, _) in got.items()}


def _scorer(docs: DataFrame, weights: dict[int, float], stems: tuple[int, ...] = STEMS):
    """A function from a column of texts to (row range, scores), over a broadcast of the non-zero weights."""
    at = np.array([k for k in weights if k >= 0], np.int64)
    table = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[k] for k in at.tolist()], np.float64), weights.get(-1, 0.0)))

    def scores(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
        at, w, base = table.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for a, b, where, row in feature_chunks(column, stems):
            on = np.flatnonzero(dense[where])
            key = np.unique(row[on] << BITS | where[on])
            total = base + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], minlength=b - a)
            yield a, b, 1 / (1 + np.exp(-np.clip(total, -35, 35)))

    return scores


def score(
    docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", stems: tuple[int, ...] = STEMS
) -> DataFrame:
    """id_col, score from 0 to 1: the logistic of the weights of the features present."""
    scores, kind = _scorer(docs, weights, stems), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, p in scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p)], [id_col, "score"])
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing only."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, stems: tuple[int, ...] = STEMS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learned from labels that are not held out."""
    weights = train(docs, labels.filter(~held_out(F.col("doc_id"))), stems=stems)
    return score(docs, weights, stems=stems).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more: all columns, each row as often as it came, no shuffle."""
    scores = _scorer(docs, train(docs, labels.filter(~held_out(F.col("doc_id"))), text_col=text_col))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, p in scores(batch.column(where)):
                yield batch.slice(a, b - a).filter(pa.array(p < threshold))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)

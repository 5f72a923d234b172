"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 7).

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight bytes, in place. The
index posts every distinct fingerprint under byte positions and values; pairs that meet are tallied by the bytes
they share in place, pairs below the guaranteed four are dropped, the rest are verified bit by bit.

Postings under single bytes would each hold 1/256 of all fingerprints, so the tally would grow with the square of
the corpus. The postings here stand for three positions at once: 20 triples of the eight positions such that every
four positions include one of the triples (Turan's construction), so a pair that shares four bytes meets under one
of them at least, and a posting holds 1/16,777,216 of unrelated fingerprints.

Equal fingerprints are one entry. A posting returns links that connect its members, not all its pairs, and a posting
of more than ``BLOCK`` members is split in blocks that are compared in tasks of their own, each with itself and each two
with one another, so no task holds a large group. Components of the links then carry the least document id.

Null and empty texts, and texts without words, have fingerprint 0 and are linked like any other; repeated rows each
get a row; a null id gets a row but names no component unless all ids of its component are null; an empty table
gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.components import connected_components

from ._shared import free_names, utf8, written

WORDS, SEED, MOST_BITS, LEAST_BYTES, BLOCK = 4, 42, 4, 4, 4096
#: A fingerprint of more than one in HOT rows is hot; there are fewer than HOT of them.
HOT = 1000


# --- fingerprints ---------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A-Z lower-cased, words between ASCII white space, shingles with repeats, majority of the bits of their XXH64."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) < words:
        return digest(joined, SEED)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    begin, end = (end - size).tolist(), end[words - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(end)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[k : k + (1 << 16)], end[k : k + (1 << 16)], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, row_hash (of the text) and fp (the fingerprint as a signed long), one row per row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column(2))
            fps = np.fromiter(
                (fingerprint(raw[a:b].tobytes(), words) for a, b in zip(offs[:-1], offs[1:], strict=True)), np.uint64, batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], [id_col, "row_hash", "fp"])
            pa.default_memory_pool().release_unused()

    return df.select(id_col, F.xxhash64(F.col(text_col)), text_col).mapInArrow(run, f"`{id_col}` {kind}, row_hash long, fp long")


# --- the index ------------------------------------------------------------------------------------------------------


def covering_triples() -> list[tuple[int, ...]]:
    """Triples of eight positions of which every four positions include one."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    inside = {(0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 2), (0, 2, 2)}
    return [t for t in combinations(range(8), 3) if tuple(part[i] for i in t) in inside]


def posting_keys(fp: Column) -> Column:
    def byte(i: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))

    keys = [byte(i) + byte(j) * 256 + byte(k) * 65536 + F.lit(n << 24) for n, (i, j, k) in enumerate(covering_triples())]
    return F.array(*[k.cast("int") for k in keys])


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification: which pairs share enough bytes in place and differ in few bits."""
    apart = a ^ b
    shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = np.flatnonzero(shared >= LEAST_BYTES)
    return near[np.bitwise_count(apart[near]) <= MOST_BITS]


def _links_of(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what the posting's links connect: each member, once reached, takes what is near it out of the rest."""
    out, rest = [], members
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = _linked(np.full(len(rest), x), rest)
            if len(near):
                out.append((np.full(len(near), x), rest[near]))
                front += rest[near].tolist()
                keep = np.ones(len(rest), bool)
                keep[near] = False
                rest = rest[keep]
                front = [np.uint64(v) for v in front]
    return out


def _links_between(a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same between two blocks of a posting: a member is compared with the other block's alone, since each block is also compared with itself."""
    out, rest = [], [a, b]
    while len(rest[0]) and len(rest[1]):
        front, rest[0] = [(0, rest[0][0])], rest[0][1:]
        while front:
            side, x = front.pop()
            other = rest[1 - side]
            near = _linked(np.full(len(other), x), other) if len(other) else ()
            if len(near):
                out.append((np.full(len(near), x), other[near]))
                front += [(1 - side, v) for v in other[near]]
                rest[1 - side] = np.delete(other, near)
    return out


def posting_links(groups: np.ndarray, fps: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``groups``: short runs all at once, offset by offset, long runs one by one."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    size = np.diff(np.append(first, n))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    run_size = np.repeat(size, size)
    left = np.repeat(first + size, size) - np.arange(n)  # members from here to the run's end
    short = run_size <= small
    for d in range(1, small):
        at = np.flatnonzero(short & (left > d))
        if not len(at):
            break
        near = at[_linked(fps[at], fps[at + d])]
        found.append((fps[near], fps[near + d]))
    for k in np.flatnonzero(size > small):
        found += _links_of(fps[first[k] : first[k] + size[k]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def links(distinct: DataFrame, fp: str = "fp", block: int = BLOCK) -> DataFrame:
    """a, b: verified links between distinct fingerprints, enough of them to connect all that are linked."""
    postings = distinct.select(F.col(fp).alias("fp"), F.explode(posting_keys(F.col(fp))).alias("key"))
    large = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = large.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = postings.join(large, "key", "left").withColumn(
        "own", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), "blocks")).cast("int")
    )
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("fp", "key", "own", other.alias("other"))
    dealt = dealt.select(
        "fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("second")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows):
                same = (rows[1:, 1:4] == rows[:-1, 1:4]).all(1)
                group = np.concatenate(([0], np.cumsum(~same)))
                fps = np.ascontiguousarray(rows[:, 0]).view(np.uint64)
                alone = rows[:, 2] == rows[:, 3]
                found = [posting_links(group[alone], fps[alone])] if alone.any() else []
                for g in np.unique(group[~alone]):
                    of = slice(np.searchsorted(group, g, "left"), np.searchsorted(group, g, "right"))
                    second = rows[of, 4] == 1
                    found += _links_between(fps[of][~second], fps[of][second])
                a, b = (np.concatenate([np.zeros(0, np.uint64), *[f[k] for f in found]]) for k in (0, 1))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            last = int(np.argmax((rows[:, 1:4] == rows[-1, 1:4]).all(1)))  # where the run that may go on begins
            if last:
                yield from out(np.concatenate([*held, rows[:last]]))
                held = [rows[last:]]
            elif held and (held[0][0, 1:4] != rows[0, 1:4]).any():
                yield from out(np.concatenate(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield from out(np.concatenate(held))

    sorted_postings = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = sorted_postings.select("fp", "key", "i", "j", "second").mapInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- components -----------------------------------------------------------------------------------------------------


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, row_hash, fp, component (its fingerprint of the least id), component_id (the least id reachable by links), one row per row.

    A node of the link graph is a fingerprint together with the least id that has it, ids first in its order, so the least
    node of a component tells its least id and nothing has to be gathered by component. Fingerprints that many rows share
    meet their component by a broadcast of at most ``HOT`` rows, the others by a shuffle.
    """
    rows = written(fingerprints(df, id_col, text_col, words), "simhash")
    node = F.struct(F.min(id_col).isNull().alias("none"), F.min(id_col).alias("id"), F.col("fp").alias("fp"))
    distinct = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), node.alias("node")), "simhash-distinct")
    end = lambda c: distinct.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    edges = links(distinct).join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    stars = connected_components(edges)
    of_fp = distinct.join(stars, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("c"))
    total = rows.count()
    hot = of_fp.filter(F.col("n") * HOT > total).select("fp", F.col("c").alias("hot"))
    rows = rows.join(F.broadcast(hot), "fp", "left")
    cold = rows.filter("hot is null").drop("hot").join(of_fp.filter(F.col("n") * HOT <= total).select("fp", "c"), "fp")
    both = rows.filter("hot is not null").withColumnRenamed("hot", "c").unionByName(cold)
    return both.select(id_col, "row_hash", "fp", F.col("c.fp").alias("component"), F.col("c.id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``df`` with one row of each component, all its columns, whatever their names: that of the least id (then of the least hash of the text).

    Components are told apart by their own name and not by component_id, which unrelated ones share where ids are null or repeated.
    """
    key, other, nth = free_names(df, "_key", "_other", "_nth")
    found = near_duplicates(df, id_col, text_col, words)
    kept = found.groupBy("component").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("row_hash").alias("h"))).alias(other)
    ).select(other).distinct()
    rows = df.select(
        "*", F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(F.col(text_col)).alias("h")).alias(key)
    ).join(kept, F.col(key) == F.col(other))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(other).orderBy(F.lit(0))))  # by the kept rows' key, whose type the join deals by
    return rows.filter(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in df.columns])

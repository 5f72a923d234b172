"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 10).

Nearness is the inner product. Vectors are scaled by the greatest norm and given one more coordinate that brings all
to length 1; queries are scaled to length 1. Then the nearest by distance are those of the greatest inner product,
and p-stable (Gaussian) projections floor((a.x + b) / w) hash near vectors alike. A table's bucket is named by
``HASHES`` projections; of each of ``TABLES`` tables a query visits ``PROBES`` buckets: its own, then those reached by
perturbing projections, in the order of estimated success (Lv et al., 2007), which follows from how close the query
lies to each slot's edges.

Index rows are dealt by bucket to cells, queries go once to each cell that holds buckets they visit, and a cell
returns each query's best candidates by exact distance on the original vectors; the cells' answers are merged. A
bucket beyond ``BUCKET_ROWS`` is split by a hash of the id, and its visitors go to all parts, so a very common vector
overloads no task. A query that meets fewer than k candidates is compared with all rows, in blocks.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no part;
null ids neither; of repeated ids all vectors take part, and none of the query's own id is a candidate; an empty
table gives an empty result; columns other than the two named are ignored. Ids are of an integer type, and the answers'
ids long integers; other types are refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import spans, written

HASHES, TABLES, PROBES, WIDTH, SEED = 12, 6, 256, 3.0, 11
#: Rows of a bucket from which it is split (at least; one in 10,000 of the table beyond), index rows of a cell, queries of a block.
BUCKET_ROWS, CELL_ROWS, QUERY_ROWS = 20_000, 50_000, 64


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vec of the rows that take part."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is of type {kind.simpleString()}, not of an integer type")
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    )
    rows = rows.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (common[0]["n"] if common else 0))


def _norm(vec: str) -> Column:
    """A vector's Euclidean norm in double precision, by its greatest component, so that no square overflows or vanishes."""
    x = F.transform(vec, lambda v: F.abs(v.cast("double")))
    most = F.array_max(x)
    return most * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v / most) * (v / most)))


def _power(x: np.ndarray) -> float:
    """A power of two that brings the greatest component to between 0.5 and 1; products with it are exact."""
    return float(np.ldexp(1.0, -min(max(int(np.frexp(np.abs(x).max())[1]), -1000), 1000)))


def probe_sets(hashes: int, count: int) -> list[tuple[int, ...]]:
    """Sets of places in the order of distance to the 2 * hashes slot edges, by their expected score, the empty set first.

    Places j and 2 * hashes - 1 - j are the two edges of one projection (expected order), so no set holds both.
    """
    m = hashes

    def expected(j: int) -> float:
        j += 1
        if j <= m:
            return j * (j + 1) / (4 * (m + 1) * (m + 2))
        k = 2 * m + 1 - j
        return 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))

    score = [expected(j) for j in range(2 * m)]
    out, heap = [()], [(score[0], (0,))]
    while heap and len(out) < count:
        s, at = heapq.heappop(heap)
        if all(2 * m - 1 - j not in at for j in at):
            out.append(at)
        if at[-1] + 1 < 2 * m:
            heapq.heappush(heap, (s - score[at[-1]] + score[at[-1] + 1], (*at[:-1], at[-1] + 1)))
            heapq.heappush(heap, (s + score[at[-1] + 1], (*at, at[-1] + 1)))
    return out


class Hashing:
    """The projections of all tables, and the codes of vectors and of the buckets that queries visit."""

    def __init__(self, dim: int, norm: float, tables: int, hashes: int, probes: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim + 1, hashes)) / width
        self.b = rng.random((tables, hashes))
        self.mix = rng.integers(1, 2**63, (tables, hashes), dtype=np.uint64) | np.uint64(1)
        self.norm, self.sets = norm, probe_sets(hashes, probes)

    def _code(self, table: int, slots: np.ndarray) -> np.ndarray:
        code = (slots.astype(np.int64).view(np.uint64) * self.mix[table]).sum(-1, dtype=np.uint64) + np.uint64(table)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (code ^ (code >> np.uint64(29))).view(np.int64)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) codes."""
        x = x / self.norm
        x = np.column_stack((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))))
        return np.column_stack([self._code(t, np.floor(x @ self.a[t] + self.b[t])) for t in range(len(self.a))])

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """(queries, tables * probes) codes, in visiting order within a table."""
        q = q / np.abs(q).max(1, keepdims=True)
        q = np.column_stack((q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))))
        out = []
        for t in range(len(self.a)):
            f = q @ self.a[t] + self.b[t]
            slot = np.floor(f)
            low = f - slot
            n, m = slot.shape
            edge = np.concatenate((low, 1 - low), axis=1)  # to the slot below, to the slot above
            order = np.argsort(edge, axis=1, kind="stable")
            step = np.where(order < m, -1, 1)
            at = order % m
            for chosen in self.sets:
                moved = slot.copy()
                for j in chosen:
                    np.add.at(moved, (np.arange(n), at[:, j]), step[:, j])
                out.append(self._code(t, moved))
        return np.column_stack(out)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _nearest(
    rough: np.ndarray, slack: float, matrix: np.ndarray, ids: np.ndarray, at: np.ndarray, query: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows ``at``: places and scores of the k best ids, ties to the smaller id, each id once.

    ``rough`` scores, right to within ``slack``, pick candidates with room for it and for ids met in several tables; the
    scores that decide are summed in one fixed order, so equal vectors score alike wherever they stand.
    """
    take = 4 * k
    while True:
        near = at[rough >= np.partition(rough, len(rough) - take)[len(rough) - take] - slack] if len(rough) > take else at
        score = (matrix[near] * query).sum(1)
        order = np.lexsort((ids[near], -score))
        _, once = np.unique(ids[near[order]], return_index=True)
        if len(once) >= k or len(near) == len(rough):
            order = order[np.sort(once)[:k]]
            return near[order], score[order]
        take *= 2


def search_cells(rows: DataFrame, k: int, own: bool = True) -> DataFrame:
    """query_id, vec_id, score: each query's best in each cell.

    ``rows``: cell, kind (0 index, 1 query), id, vec, codes (an index row's bucket; the buckets a query visits, or none for all).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds, ids = (np.asarray(batch.column(i)) for i in range(3))
            vec, codes = _matrix(batch.column(3)), batch.column(4)
            ends = np.concatenate(([0], np.cumsum(np.diff(np.asarray(codes.offsets)))))
            flat = np.asarray(codes.flatten())
            cut = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                if cells[a] != cell:
                    cell, parts, index = cells[a], [], None
                if kinds[a] == 0:
                    parts.append((flat[ends[a] : ends[z]], ids[a:z], vec[a:z]))
                    continue
                if not parts:
                    continue
                if index is None:
                    bucket = np.concatenate([p[0] for p in parts])
                    order = np.argsort(bucket, kind="stable")
                    matrix = np.concatenate([p[2] for p in parts])[order]
                    scaled = matrix * _power(matrix)
                    longest = float(np.sqrt((scaled * scaled).sum(1).max()))
                    index = bucket[order], np.concatenate([p[1] for p in parts])[order], matrix, scaled.astype(np.float32), longest
                    parts = parts[:1]
                bucket, members, matrix, light, longest = index
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for r in range(a, z):
                    if (r - a) % QUERY_ROWS == 0:  # one product for a block of queries; a query's buckets then pick from its row
                        asked = np.array([q * _power(q) for q in vec[r : min(z, r + QUERY_ROWS)]])
                        block = asked.astype(np.float32) @ light.T
                    visits = flat[ends[r] : ends[r + 1]]
                    if len(visits):
                        lo = np.searchsorted(bucket, visits, "left")
                        at = spans(lo, np.searchsorted(bucket, visits, "right") - lo)
                    else:
                        at = np.arange(len(members))
                    if own:
                        at = at[members[at] != ids[r]]
                    if not len(at):
                        continue
                    own_q = asked[(r - a) % QUERY_ROWS]
                    slack = 1e-5 * longest * float(np.sqrt(own_q @ own_q))
                    near, score = _nearest(block[(r - a) % QUERY_ROWS, at], slack, matrix, members, at, vec[r], k)
                    out.append((np.full(len(near), ids[r]), members[near], score))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["query_id", "vec_id", "score"]
                    )

    return rows.select("cell", "kind", "id", "vec", "codes").mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES,
    hashes: int = HASHES, probes: int = PROBES, width: float = WIDTH, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
    cell_rows: int = CELL_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which ``is_query`` holds (of ``id``), its own id aside."""
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector_col)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max(_norm("vec")).alias("norm"), F.max(F.size("vec")).alias("dim")).first()
    n = about["n"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    table = spark.sparkContext.broadcast(Hashing(about["dim"], about["norm"], tables, hashes, probes, width, seed))
    item = rows.schema["vec"].dataType.elementType.simpleString()
    queries = rows.filter(is_query)
    cells = max(1, -(-tables * n // cell_rows))
    limit = max(bucket_rows, n // 10_000)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                codes = table.value.of_rows(_matrix(part.column(1)))
                times = pa.array(np.repeat(np.arange(part.num_rows), codes.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(times), part.column(1).take(times), pa.array(codes.ravel())], ["id", "vec", "code"]
                )

    index = rows.mapInArrow(coded, f"id long, vec array<{item}>, code long")
    slim = index.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    # At most tables * 10,000 buckets are this large, whatever the input: a bounded list.
    split = {r["code"]: -(-r["n"] // limit) for r in slim.collect()}
    parts = spark.sparkContext.broadcast(split)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = parts.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                codes = table.value.of_queries(_matrix(part.column(1)))
                out_row, out_cell, lists = [], [], []
                for r in range(part.num_rows):
                    own = np.unique(codes[r])
                    if large:
                        own = np.concatenate((own, *[_part_code(c, np.arange(1, large[c])) for c in own.tolist() if c in large]))
                    cell = own.view(np.uint64) % np.uint64(cells)
                    order = np.argsort(cell, kind="stable")
                    own, cell = own[order], cell[order].astype(np.int64)
                    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
                    out_row += [r] * len(first)
                    out_cell += cell[first].tolist()
                    lists += np.split(own, first[1:])
                take = pa.array(out_row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out_cell, pa.int64()), part.column(0).take(take), part.column(1).take(take),
                        pa.array(lists, pa.list_(pa.int64()))
                    ],
                    ["cell", "id", "vec", "codes"]
                )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = parts.value
        for batch in batches:
            code = np.asarray(batch.column(2)).copy()
            if large:
                ids = np.asarray(batch.column(0)).view(np.uint64)
                for c in set(np.unique(code).tolist()) & large.keys():
                    at = np.flatnonzero(code == c)
                    piece = (ids[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(large[c])
                    code[at] = _part_code(c, piece.astype(np.int64))
            cell = (code.view(np.uint64) % np.uint64(cells)).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32), pa.array(code))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1), lists], ["cell", "id", "vec", "codes"])

    shape = f"cell long, id long, vec array<{item}>, codes array<long>"
    dealt = index.mapInArrow(placed, shape).withColumn("kind", F.lit(0)).unionByName(
        queries.mapInArrow(visits, shape).withColumn("kind", F.lit(1))
    )
    dealt = dealt.repartition(cells, "cell").sortWithinPartitions("cell", "kind")
    found = written(_ranked(search_cells(dealt, k), k), "ann")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
    few = queries.join(
        enough, F.col("id") == F.col("query_id"), "left"
    ).filter(F.coalesce("got", F.lit(0)) < min(k, n - 1)).select("id", "vec")
    few = written(few, "ann-few")
    if few.isEmpty():
        return found
    blocks = max(1, -(-n // cell_rows))
    none = F.array().cast("array<long>")
    whole = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("cell"), F.lit(0).alias("kind"), "id", "vec",
        F.array(F.lit(0).cast("long")).alias("codes")
    )
    asked = few.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("cell"), F.lit(1).alias("kind"), "id", "vec",
        none.alias("codes")
    )
    again = _ranked(search_cells(whole.unionByName(asked).repartition(blocks, "cell").sortWithinPartitions("cell", "kind"), k), k)
    return found.join(few.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)


def _part_code(code: int, piece: np.ndarray) -> np.ndarray:
    """The code of each part of a split bucket; part 0 keeps the bucket's own."""
    apart = (np.uint64(code & (2**64 - 1)) + piece.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    return np.where(piece == 0, np.int64(code), apart)


def rows_met(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES,
    probes: int = PROBES, width: float = WIDTH, seed: int = SEED
) -> DataFrame:
    """query_id, met: the rows in the buckets that a query visits, a row counted once a table: what the probes leave to compare."""
    rows = valid_vectors(df, id_col, vector_col)
    about = rows.agg(F.max(_norm("vec")).alias("norm"), F.max(F.size("vec")).alias("dim")).first()
    table = df.sparkSession.sparkContext.broadcast(Hashing(about["dim"] or 1, about["norm"] or 1.0, tables, hashes, probes, width, seed))

    def codes(of: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    found = getattr(table.value, of)(_matrix(part.column(1)))
                    times = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(times), pa.array(found.ravel())], ["query_id", "code"])

        return run

    held = rows.mapInArrow(codes("of_rows"), "query_id long, code long").groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.filter(is_query).mapInArrow(codes("of_queries"), "query_id long, code long").distinct()
    return asked.join(held, "code", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"))


def exact(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", blocks: int = 8
) -> DataFrame:
    """The same by comparing every query with every row, in blocks: the measure of recall."""
    rows = valid_vectors(df, id_col, vector_col)
    whole = rows.select(
        F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("cell"), F.lit(0).alias("kind"), "id", "vec",
        F.array(F.lit(0).cast("long")).alias("codes")
    )
    asked = rows.filter(is_query).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("cell"), F.lit(1).alias("kind"), "id", "vec",
        F.array().cast("array<long>").alias("codes")
    )
    return _ranked(search_cells(whole.unionByName(asked).repartition(blocks, "cell").sortWithinPartitions("cell", "kind"), k), k)

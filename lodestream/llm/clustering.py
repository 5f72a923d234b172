"""Centroid clustering with PCA-rotated filtering and integer verification (operator 13).

Vectors become integers, floor(256 * x) a component. One pass gathers the moments of all vectors, whose covariance gives
a rotation; a second stores each vector's integers, its ``LEAD`` leading rotated coordinates and the norm of the rest.
The squared distance of leading coordinates plus the squared difference of the two norms never exceeds the squared
distance, so it rules out centroids: a vector is compared in integers with the centroid of the least bound, then with
those whose bound, less the rounding it may carry, does not exceed that distance. The rotation thus decides how much is
compared, never the result.

A round assigns within tasks and sums there, so the shuffle carries at most a few rows a centroid and task; the driver
holds the centroids (a fixed number) alone. Sums are exact, so results don't depend on the order of rows.

Vectors of another length, or with null or non-finite components, take no part, nor do null vectors. Components whose
integer is beyond 2**26 in size are kept and compared as whole numbers of any size; a distance, or a sum of distances,
beyond a long is given as the greatest long. Ties of first centroids by id (repeated ids) go by components, ascending; a
null id is hashed as empty; fewer vectors than ``k`` make as many centroids; an empty table gives an empty result;
columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

SIZE, SCALE, K, ROUNDS, LEAD = 64, 256, 40, 5, 48
#: Integers up to this size have squared distances within a long, and are kept as int32.
SMALL = 1 << 26
MOST = (1 << 63) - 1
#: Digits of the sums of large integers.
DIGIT = 30
_CHUNK = 4096


# --- vectors --------------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector has exactly ``SIZE`` components, all of them finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == SIZE) & ~F.exists(vector, bad), F.lit(False))


def _whole(x: float) -> int:
    """floor(SCALE * x), whatever the size of x."""
    return int(np.floor(x * SCALE)) if abs(x) < 1 << 40 else int(x) * SCALE


def _floats(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, SIZE)


def _scaled(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) as floats, and which rows are of small integers throughout."""
    with np.errstate(over="ignore"):
        v = np.floor(values * SCALE)
    return v, (np.abs(v) <= SMALL).all(1)


def rotation(found: DataFrame, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal directions (columns, greatest variance first) of all vectors, their components clipped to ``SMALL``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, moment, n = np.zeros(SIZE), np.zeros((SIZE, SIZE)), 0
        for batch in batches:
            v = np.clip(_scaled(_floats(batch.column(0)))[0], -SMALL, SMALL)
            total, moment, n = total + v.sum(0), moment + v.T @ v, n + len(v)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"i": list(range(SIZE)), "n": [n] * SIZE, "s": total.tolist(), "m": moment.tolist()},
                schema=pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("m", pa.list_(pa.float64()))])
            )

    parts = found.select(vector_col).mapInArrow(run, "i int, n long, s double, m array<double>")
    rows = parts.groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.array(*[F.sum(F.col("m")[j]) for j in range(SIZE)]).alias("m")
    ).orderBy("i").collect()
    if not rows:
        return np.zeros(SIZE), np.eye(SIZE)
    n, mean = rows[0]["n"], np.array([r["s"] for r in rows]) / rows[0]["n"]
    spread = np.array([r["m"] for r in rows]) / n - np.outer(mean, mean)
    return mean, np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1]


def stored(found: DataFrame, id_col: str, vector_col: str, lead: int = LEAD) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written table (id, ints, wide, lead, rest), the mean and the rotation. ``wide`` holds large integers as text, ``ints`` is null there."""
    kept = found.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(usable(F.col("vector")))
    mean, axes = rotation(kept, "vector")
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _floats(batch.column(1))
            v, small = _scaled(values)
            turned = (np.where(small[:, None], v, 0.0) - mean) @ axes
            ints = [row if ok else None for row, ok in zip(np.where(small[:, None], v, 0).astype(np.int32).tolist(), small, strict=True)]
            wide = [None if ok else [str(_whole(x)) for x in row.tolist()] for row, ok in zip(values, small, strict=True)]
            columns = [
                batch.column(0), pa.array(ints, pa.list_(pa.int32())), pa.array(wide, pa.list_(pa.string())),
                pa.array(turned[:, :lead].tolist(), pa.list_(pa.float64())), pa.array(np.linalg.norm(turned[:, lead:], axis=1))
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "ints", "wide", "lead", "rest"])

    rows = kept.mapInArrow(run, f"id {kind}, ints array<int>, wide array<string>, lead array<double>, rest double")
    return written(rows, "clustering"), mean, axes


# --- assignment -----------------------------------------------------------------------------------------------------


class Centroids:
    """Centroids as whole numbers, those of small ones as arrays with their rotated form."""

    def __init__(self, whole: list[list[int]], mean: np.ndarray, axes: np.ndarray, lead: int):
        self.whole, self.lead = whole, lead
        self.small = np.array([k for k, c in enumerate(whole) if max(map(abs, c)) <= SMALL], np.int64)
        self.large = [k for k, c in enumerate(whole) if max(map(abs, c)) > SMALL]
        self.ints = np.array([whole[k] for k in self.small], np.int64).reshape(-1, SIZE)
        turned = (self.ints - mean) @ axes
        self.head, self.rest = turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1)

    def bounds(self, head: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """For each vector and small centroid, a number that their squared distance is not below."""
        a, b = (head * head).sum(1)[:, None], (self.head * self.head).sum(1)[None, :]
        r, s = rest[:, None], self.rest[None, :]
        slack = 1e-9 * (a + b + r * r + s * s) + 1e-3
        return a + b - 2 * head @ self.head.T + (r - s) ** 2 - slack

    def exact(self, ints: list[int], k: int) -> int:
        return sum((x - y) ** 2 for x, y in zip(ints, self.whole[k], strict=True))

    def nearest_small(self, ints: np.ndarray, head: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """Cluster and squared distance of vectors of small integers, and how many distances were worked out."""
        n, worked = len(ints), 0
        if len(self.small):
            bound = self.bounds(head, rest)
            first = bound.argmin(1)
            apart = ints - self.ints[first]
            best = (apart * apart).sum(1)
            every = np.full(bound.shape, MOST, np.int64)
            every[np.arange(n), first] = best
            left = bound <= best[:, None]
            left[np.arange(n), first] = False
            rows, cents = np.nonzero(left)
            worked = n + len(rows)
            for a in range(0, len(rows), 4 * _CHUNK):
                r, c = rows[a : a + 4 * _CHUNK], cents[a : a + 4 * _CHUNK]
                apart = ints[r] - self.ints[c]
                every[r, c] = (apart * apart).sum(1)
            at = every.argmin(1)
            cluster, distance = self.small[at], every[np.arange(n), at].tolist()
        else:
            cluster, distance = np.full(n, -1), [None] * n
        for k in self.large:
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.array([min(max(x, -1e150), 1e150) for x in map(_float, self.whole[k])])
                near = (((ints - far) ** 2).sum(1) * (1 - 1e-9)).tolist()  # Python compares floats and whole numbers of any size
            for i in range(n):
                if distance[i] is None or near[i] <= distance[i]:
                    d, worked = self.exact(ints[i].tolist(), k), worked + 1
                    if distance[i] is None or (d, k) < (distance[i], cluster[i]):
                        cluster[i], distance[i] = k, d
        return cluster, distance, worked

    def nearest_wide(self, ints: list[int]) -> tuple[int, int]:
        d, k = min((self.exact(ints, k), k) for k in range(len(self.whole)))
        return k, d


def _float(x: int) -> float:
    return float(x) if abs(x) < 1 << 500 else (1e150 if x > 0 else -1e150)


def _assigned(batch: pa.RecordBatch, centroids: Centroids):
    """For chunks of a batch: the rows' numbers, their integers (an array, or a list for large ones), clusters, distances, distances worked out."""
    small = np.asarray(batch.column("ints").is_valid())
    at = np.flatnonzero(small)
    ints = np.asarray(batch.column("ints").flatten()).reshape(-1, SIZE).astype(np.int64)
    head = np.asarray(batch.column("lead").flatten()).reshape(-1, centroids.lead)[small]
    rest = np.asarray(batch.column("rest"))[small]
    for a in range(0, len(at), _CHUNK):
        part = slice(a, a + _CHUNK)
        yield at[part], ints[part], *centroids.nearest_small(ints[part], head[part], rest[part])
    for i in np.flatnonzero(~small):
        whole = [int(x) for x in batch.column("wide")[int(i)].as_py()]
        k, d = centroids.nearest_wide(whole)
        yield np.array([i]), [whole], np.array([k]), [d], len(centroids.whole)


def _digits(x: int) -> list[int]:
    """Signed digits of a whole number, the least first."""
    sign, x, out = (1 if x >= 0 else -1), abs(x), []
    while x:
        out.append(sign * (x & ((1 << DIGIT) - 1)))
        x >>= DIGIT
    return out


def _sums(rows: DataFrame, centroids: Centroids) -> DataFrame:
    """cluster, digit, n, worked, s: exact sums of each cluster's vectors; digit -1 has those of small integers, the others a digit of the large ones'."""
    schema = pa.schema(
        [("cluster", pa.int32()), ("digit", pa.int32()), ("n", pa.int64()), ("worked", pa.int64()), ("s", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.whole)
        total, count, worked, large = np.zeros((k, SIZE), np.int64), np.zeros(k, np.int64), 0, {}
        for batch in batches:
            for _, ints, cluster, _, tried in _assigned(batch, centroids):
                count += np.bincount(cluster, minlength=k)
                worked += tried
                if isinstance(ints, list):
                    large[int(cluster[0])] = [x + y for x, y in zip(large.get(int(cluster[0]), [0] * SIZE), ints[0], strict=True)]
                else:
                    np.add.at(total, cluster, ints)
        rows = [
            {
                "cluster": c, "digit": -1, "n": int(count[c]), "worked": worked * (c == 0), "s": total[c].tolist()
            } for c in range(k) if count[c] or c == 0
        ]
        for c, whole in large.items():
            digits = [_digits(x) for x in whole]
            rows += [
                {
                    "cluster": c, "digit": d, "n": 0, "worked": 0, "s": [x[d] if d < len(x) else 0 for x in digits]
                } for d in range(max(map(len, digits)))
            ]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    parts = rows.mapInArrow(run, "cluster int, digit int, n long, worked long, s array<long>")
    sums = F.array(*[F.sum(F.col("s")[j].cast("decimal(20,0)")) for j in range(SIZE)]).alias("s")
    return parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), F.sum("worked").alias("worked"), sums)


def first_centroids(rows: DataFrame, k: int = K) -> list[list[int]]:
    """The vectors of the least SHA-256 of "2:" and their id, ascending."""
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select(name.alias("h"), "ints", "wide").orderBy("h", F.col("ints").asc_nulls_last(), "wide").limit(k).collect()
    return [list(r["ints"]) if r["ints"] is not None else [int(x) for x in r["wide"]] for r in found]


def moved(rows: DataFrame, centroids: Centroids) -> tuple[list[list[int]], int]:
    """Centroids after a round, each the floor of its vectors' mean (empty ones stay), and how many distances the round worked out."""
    total, count, worked = {}, {}, 0
    for r in _sums(rows, centroids).collect():  # at most k rows a digit
        weight = 1 if r["digit"] < 0 else 1 << (DIGIT * r["digit"])
        own = total.setdefault(r["cluster"], [0] * SIZE)
        total[r["cluster"]] = [x + int(y) * weight for x, y in zip(own, r["s"], strict=True)]
        count[r["cluster"]] = count.get(r["cluster"], 0) + r["n"]
        worked += r["worked"]
    return [[x // count[k] for x in total[k]] if count.get(k) else c for k, c in enumerate(centroids.whole)], worked


def clustered(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, lead: int = LEAD
) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable vector."""
    rows, mean, axes = stored(df, id_col, vector_col, lead)
    whole = first_centroids(rows, k)
    for _ in range(rounds if whole else 0):
        whole, _ = moved(rows, Centroids(whole, mean, axes, lead))
    last = Centroids(whole, mean, axes, lead)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, _, k, d, _ in _assigned(batch, last):
                cluster[at], distance[at] = k, np.array([min(x, MOST) for x in d], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    done = written(rows.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    sums = {
        r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    }
    own = F.array(*[F.lit(min(sums.get(c, 0), MOST)).cast("long") for c in range(max(len(whole), 1))])
    names = F.array(*[F.lit(sha256(",".join(map(str, c)).encode()).hexdigest()) for c in whole] or [F.lit("")])
    at = F.col("cluster") + 1
    return done.select(
        F.col("id").alias(id_col), "cluster", "distance", F.element_at(own, at).alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST)).cast("long").alias("inertia"), F.element_at(names, at).alias("centroid_sha256"),
    )


def _oracle() -> str:
    """SQL of the clusters, a pair of tables a round."""
    near = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x))) = {SIZE})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c FROM v QUALIFY k < {K})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"""a{i} AS (SELECT r, vec_id, v, k, d FROM (SELECT v.*, c.k, {near} AS d FROM v CROSS JOIN c{i} c) QUALIFY row_number() OVER (PARTITION BY r
  ORDER BY d, k) = 1)"""
        )
        if i < ROUNDS:
            parts.append(
                f"""m{i} AS (SELECT k, list(f ORDER BY j) AS c FROM (SELECT k, j, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f"""
                f" FROM (SELECT k, unnest(v) AS x, unnest(range({SIZE})) AS j FROM a{i}) GROUP BY k, j) GROUP BY k),\n"
                f"c{i + 1} AS (SELECT k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))"
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k
"""


ORACLE_SQL = _oracle()

"""Windows over ages, ranks, running budgets and timelines."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import shared_folder

#: Hours of the age windows; a row is in every window that its age fits.
WINDOW_HOURS = {"24h": 24, "7d": 168, "30d": 720}


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def age_windows(ts: Column, now: Column) -> Column:
    """Names of all windows that hold the age; '30d+' only beyond 30 days; the future counts as age 0."""
    age = F.greatest(seconds(now) - seconds(ts), F.lit(0.0)) / 3600.0
    found = [F.when(age <= h, F.lit(w)) for w, h in WINDOW_HOURS.items()]
    return F.array_compact(F.array(*found, F.when(age > WINDOW_HOURS["30d"], F.lit("30d+"))))


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (which must break all ties)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def ranked(df: DataFrame, name: str, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def spread_ranked(
    df: DataFrame, name: str, keys: list[str], order: list[Column], total: str | None = None, part: str | None = None,
    deal: list[Column] | None = None, finer: dict[str, list[str]] | None = None,
) -> DataFrame:
    """``ranked`` for few keys with many rows each: no task holds a key.

    Rows are dealt by ranges of (keys, order), sorted and numbered within their part, and written once, so that the
    numbers stay; what a key has in earlier parts comes from one row a part and key, and so does ``total``, the number
    of its rows, where that is asked for. ``part`` names a column for the number of a row's part, parts being in order.
    Where the order has long values, ``deal`` gives shorter ones to deal by that agree with it (the beginnings of texts).
    ``finer`` names further ranks in the same order, each within the keys and more columns, from the same pass.
    """
    spark, key = df.sparkSession, F.struct(*keys) if keys else F.lit(0)
    first = [F.col(k).asc() for k in keys]
    rows = df.repartitionByRange(*first, *(deal or order)).sortWithinPartitions(*first, *order)
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_key", key)
    path = f"{shared_folder(spark)}/lodestream/ranked-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_key")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_base")
    parts = parts.select("_key", "_part", base, F.sum("_n").over(whole).alias("_total"))
    found = rows.join(parts, ["_key", "_part"]).withColumn(name, (F.col("_at") + F.col("_base")).cast("long"))
    for rank, columns in (finer or {}).items():
        fine = F.struct(*keys, *columns)
        own = Window.partitionBy("_fine", "_part").orderBy("_at")
        found = found.withColumn("_fine", fine).withColumn("_own", F.row_number().over(own))
        counts = rows.groupBy(fine.alias("_fine"), "_part").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_fine").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select("_fine", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        found = found.join(counts, ["_fine", "_part"]).withColumn(
            rank, (F.col("_own") + F.col("_before")).cast("long")
        ).drop("_fine", "_own", "_before")
    more = [*(finer or {}), *[F.col(c).alias(n) for c, n in (("_total", total), ("_part", part)) if n]]
    return found.select(*df.columns, name, *more)


def fitted(rows: Column, budget: int) -> Column:
    """Of an ordered array of struct(id, size): ids that fit a budget in turn; one too large is passed over, later ones may fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def step(s: Column, r: Column) -> Column:
        fits = s["used"] + r["size"] <= budget
        return F.struct(
            F.when(fits, s["used"] + r["size"]).otherwise(s["used"]).cast("long").alias("used"),
            F.when(fits, F.concat(s["kept"], F.array(r["id"].cast("long")))).otherwise(s["kept"]).alias("kept")
        )

    return F.aggregate(rows, start, step)


class _Fit:
    """Running least squares of one key's points, in order."""

    def __init__(self) -> None:
        self.rows = self.pairs = self.values = 0
        self.x = self.y = self.both = self.spread = self.total = 0.0

    def add(self, x: float | None, y: float | None) -> None:
        self.rows += 1
        if y is None:
            return
        self.total, self.values = self.total + y, self.values + 1
        if x is None:
            return
        self.pairs += 1
        apart = x - self.x
        self.x += apart / self.pairs
        self.y += (y - self.y) / self.pairs
        self.both = math.fma(apart, y - self.y, self.both)  # rounded once
        self.spread = math.fma(apart, x - self.x, self.spread)

    def slope(self) -> float | None:
        """Over the mean (1 at least); none where there is no spread."""
        if self.pairs < 2 or not self.spread:
            return None
        return (self.both / self.pairs) / (self.spread / self.pairs) / max(self.total / self.values, 1.0)


def slope(points: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Least-squares slope of y over x for each key, over the mean of y (1 at least); keys with fewer points have none.

    Points are taken in the order of x, one by one, and a product is rounded with the sum that it goes into, not before:
    where the exact slope is 0, what is left in the last digits, and whether that is above 0, is what the SQL has
    (``regr_slope`` in DuckDB). Points stream past; no row grows with a key's points.
    """
    out = T.StructType([*[points.schema[k] for k in keys], T.StructField("slope", T.DoubleType())])
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list) -> pa.RecordBatch:
            done = [(key, fit.slope()) for key, fit in done if fit.rows >= least]
            columns = [pa.array([key[i] for key, _ in done], kinds[i]) for i in range(len(keys))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s in done], pa.float64())], [*keys, "slope"])

        key, fit = None, None
        for batch in batches:
            done, kinds = [], batch.schema.types
            for *own, at, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if fit:
                        done.append((key, fit))
                    key, fit = own, _Fit()
                fit.add(at, value)
            yield made(done)
        if fit:
            yield made([(key, fit)])

    return rows.mapInArrow(run, out)


def min_max_scaled(df: DataFrame, value: str, name: str, keys: list[str]) -> DataFrame:
    """``df`` with ``value`` scaled to 0..1 between the least and the greatest of its keys; 1 above zero, else 0, where all are alike; 0 for none.

    The ends are one row a key, combined before the shuffle, and come back by a join; nothing is sorted.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col(value)
    scaled = F.when(v.isNull(), 0.0).when(F.col("_hi") <= F.col("_lo"), F.when(v > 0, 1.0).otherwise(0.0))
    scaled = scaled.otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))))
    ends = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_lo", "_hi")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(ends if keys else F.broadcast(ends), same).select(*df.columns, scaled.alias(name))  # without keys, one row

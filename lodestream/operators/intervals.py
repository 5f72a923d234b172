"""Joins of points in time with the intervals they fall in, and counts on a grid of intervals around anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import seconds

#: A bin of a key with more than one in HOT of all points is split; there are fewer than HOT of them.
HOT = 1000

_HOUR = 3600
#: The observation grid, hours from and to around the anchor; half open, but for the anchor itself and the last.
GRID = (
    ("T-7d", -168, -72, False), ("T-3d", -72, -24, False), ("T-24h", -24, -12, False), ("T-12h", -12, -6, False), ("T-6h", -6, 0, False),
    ("T0", 0, 0, True), ("T+6h", 0, 6, False), ("T+24h", 6, 24, False), ("T+3d", 24, 72, False), ("T+7d", 72, 168, True),
)


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", lo: str = "lo", hi: str = "hi", closed: bool = False,
    width: float | None = None
) -> DataFrame:
    """Every point with every interval of its keys that holds it: lo <= at < hi, or lo <= at <= hi if ``closed``.

    Times are numbers. Time is cut in bins; a point is in one bin, an interval is copied to each that it touches, and the
    two meet by equality on keys and bin. By default a bin is as wide as the longest interval, so an interval has two
    copies at most; where lengths differ much, give a ``width`` nearer to the usual one. A bin of a key that holds more than
    one in ``HOT`` of all points is dealt to parts by the points' hashes, and its intervals are copied to each part, so no
    task holds a key, nor a moment of it. Nulls in keys, times or ends meet nothing. Columns of the two must differ in name,
    but for the keys.
    """
    points = points.filter(F.col(at).isNotNull())
    intervals = intervals.filter(F.col(lo) <= F.col(hi))
    if width is None:
        width = intervals.agg(F.max(F.col(hi) - F.col(lo))).first()[0]
    width = float(width or 1)
    bin_of = lambda c: F.floor(F.col(c) / width)
    own, whole = [*keys, "_bin"], points.withColumn("_bin", bin_of(at))
    counts = whole.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    total = points.count()
    hot = counts.filter(F.col("_n") * HOT > total).select(*own, F.ceil(F.col("_n") * HOT / max(total, 1)).cast("int").alias("_parts"))
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*points.columns), "_parts")).cast("int")
    left = whole.join(F.broadcast(hot), own, "left").withColumn("_part", part).drop("_parts")
    right = intervals.withColumn("_bin", F.explode(F.sequence(bin_of(lo), bin_of(hi))))
    every = F.explode(F.when(F.col("_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = right.join(F.broadcast(hot), own, "left").withColumn("_part", every).drop("_parts")
    inside = (F.col(at) >= F.col(lo)) & ((F.col(at) <= F.col(hi)) if closed else (F.col(at) < F.col(hi)))
    return left.join(right, [*own, "_part"]).filter(inside).drop("_bin", "_part")


def grid_counts(
    anchors: DataFrame, events: DataFrame, keys: list[str], anchor: str, t0: str = "t0", at: str = "at", grid: tuple = GRID
) -> DataFrame:
    """keys, anchor, bucket, n: how many events fall in each bucket of the grid around each anchor; buckets without events have no row.

    A key may have any number of anchors, whose grids may overlap; an event counts for each of them, and twice where
    buckets of one grid overlap (the anchor's own moment). anchors: keys, anchor, t0; events: keys, at (timestamps).
    """
    first, last = min(g[1] for g in grid) * _HOUR, max(g[2] for g in grid) * _HOUR
    a = anchors.select(*keys, anchor, seconds(F.col(t0)).alias("_t0")).withColumns(
        {"_lo": F.col("_t0") + first, "_hi": F.col("_t0") + last}
    )
    e = events.select(*keys, seconds(F.col(at)).alias("_at"))
    apart = F.col("_at") - F.col("_t0")

    def within(lo: int, hi: int, closed: bool) -> Column:
        return (apart >= lo * _HOUR) & ((apart <= hi * _HOUR) if closed else (apart < hi * _HOUR))

    met = interval_join(e, a, keys, "_at", "_lo", "_hi", closed=True, width=last - first)
    buckets = F.array_compact(F.array(*[F.when(within(lo, hi, closed), F.lit(name)) for name, lo, hi, closed in grid]))
    return met.select(*keys, anchor, F.explode(buckets).alias("bucket")).groupBy(*keys, anchor, "bucket").agg(F.count(F.lit(1)).alias("n"))


def counts_within(
    points: DataFrame, asked: DataFrame, keys: list[str], ident: str, windows: dict[str, int], at: str = "at", now: str = "now"
) -> DataFrame:
    """``asked`` (keys, ident, now) with, for each named window of hours, the number of points in [now - window, now], both ends included."""
    widest = max(windows.values()) * _HOUR
    i = asked.select(*keys, ident, seconds(F.col(now)).alias("_hi")).withColumn("_lo", F.col("_hi") - widest)
    met = interval_join(points.select(*keys, seconds(F.col(at)).alias("_at")), i, keys, "_at", "_lo", "_hi", closed=True, width=widest)
    counts = {name: F.count_if(F.col("_at") >= F.col("_hi") - h * _HOUR) for name, h in windows.items()}
    found = met.groupBy(ident).agg(*[c.alias(n) for n, c in counts.items()])
    return asked.join(found, ident, "left").select(*asked.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in counts])

"""Point-in-time lookups: what was known of a key at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import saved


def known_at(
    moments: DataFrame, facts: DataFrame, keys: list[str], at: str, known: str, values: list[str], ties: list[Column] | None = None
) -> DataFrame:
    """``moments`` with ``values`` of the last fact of its keys that was known by then (``known`` <= ``at``), null if none was.

    Both sides are laid in one order of (keys, time), facts before moments of one time, and dealt by ranges of it; within
    a part the last fact before a moment is a window's last value, and one row a part and key tells what earlier parts
    leave to later ones. So a key of any number of facts and moments spreads over tasks, and nothing is multiplied.
    Of facts of one time, the last in the order of ``ties`` counts (by default, of their values). Facts without a time are
    never known, moments without one know nothing; null keys are keys like any other.
    """
    key = F.struct(*[F.col(k) for k in keys])
    rank = F.struct(*(ties or [F.col(v) for v in values]))
    fact = F.struct(*[F.col(v) for v in values])
    old = facts.filter(F.col(known).isNotNull()).select(
        key.alias("_key"), F.col(known).alias("_at"), F.lit(0).alias("_kind"), rank.alias("_tie"), fact.alias("_fact"),
        F.lit(None).cast(moments.schema).alias("_row")
    )
    own = F.struct(*[F.col(c) for c in moments.columns])
    new = moments.select(
        key.alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(old.schema["_tie"].dataType).alias("_tie"),
        F.lit(None).cast(old.schema["_fact"].dataType).alias("_fact"), own.alias("_row")
    )
    order = [F.col("_at").asc_nulls_first(), F.col("_kind").asc(), F.col("_tie").asc()]
    line = old.unionByName(new).repartitionByRange("_key", *order).sortWithinPartitions("_key", *order)
    line = saved(line.withColumn("_n", F.monotonically_increasing_id()), "known-at").withColumn("_part", F.shiftright("_n", 33))
    before = Window.partitionBy("_key", "_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    inside = line.withColumn("_seen", F.last("_fact", ignorenulls=True).over(before)).filter("_kind = 1")
    ends = line.groupBy("_key", "_part").agg(F.max_by("_fact", F.when(F.col("_kind") == 0, F.col("_n"))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part of a key
    carried = ends.select("_key", "_part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    found = inside.join(carried, ["_key", "_part"]).withColumn("_seen", F.coalesce("_seen", "_carried"))
    return found.select("_row.*", *[F.col("_seen")[v].alias(v) for v in values])

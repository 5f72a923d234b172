"""Mixing sources to target weights (operator 6).

Systematic sampling. Within a source every document's expected copies are target / source size, at most
``max_repeats``; documents are put in order of size (then of id), their expected copies are prefix-summed, one
random offset is added, and a copy is emitted at each whole number that the sum crosses. Ordering by size spreads
every size class evenly over the crossings, so a source's words come near its target.

The prefix sum needs each document's rank in its source, which is built in three levels so that no task holds a
source, however large: counts by (source, size), counts by one of 1,024 hash cells in a size, row numbers in a cell.
Only ids, sizes and hashes are shuffled, never texts.

Null texts and texts without words have size 0; the null source is a source of its own, last in order; repeated
rows are sampled each; an empty table gives an empty result; columns other than those named are ignored or, in
``sampled``, carried along. Windows over all sources, and over the distinct sizes of a source, run in one task: they
hold a row a source and a row a size, not a row a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_names, written

#: Relative weights of the sources in code point order, repeating; share of all sizes that the mix takes; most copies of a document.
WEIGHTS, SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """source, source_size, weight, target from (source, source_size): one row per source.

    Water filling: sources whose cap of ``max_repeats`` times their size is reached stop there, in order of cap per
    weight; the level that spends the rest on the others by weight follows from the running sums.
    """
    numbered = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_repeats)
    table = numbered.select("source", "source_size", weight.alias("weight"), cap.alias("_cap"), "_n")
    by_need = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), "_n")
    every = Window.partitionBy(F.lit(0))
    table = table.select(
        "*",
        F.coalesce(F.sum("_cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_capped"),
        F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
        (F.sum("source_size").over(every) * float(share)).alias("_all"),
    )
    level = (F.col("_all") - F.col("_capped")) / F.col("_open")  # if this source and all after it are open
    table = table.withColumn("_level", F.when(level * F.col("weight") <= F.col("_cap"), level))
    fill = F.min(
        F.when(F.col("_level").isNotNull(), F.struct((F.col("_cap") / F.col("weight")).alias("need"), F.col("_n"), F.col("_level")))
    ).over(every)["_level"]
    target = F.when(fill.isNull(), F.col("_cap")).otherwise(F.least(fill * F.col("weight"), F.col("_cap")))
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(
    df: DataFrame, seed: int = 20240131, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per document: id, ``row_hash`` of its text, source, size, source_size, target, copies, taken."""
    slim = df.select(
        F.col(id_col),
        F.xxhash64(F.col(text_col)).alias("row_hash"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    ).withColumn("_cell", F.pmod(F.xxhash64(F.col(id_col), F.col("row_hash")), F.lit(CELLS)).cast("int"))
    slim = written(slim, "mixing")
    null_key, key = F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source")
    keys = ["_no_source", "_source"]
    slim = slim.select("*", null_key, key)
    sizes = slim.groupBy(*keys).agg(F.sum("size").alias("source_size"))
    targets = source_targets(
        sizes.select(F.when(~F.col("_no_source"), F.col("_source")).alias("source"), "source_size"), weights, share, max_repeats
    )
    targets = targets.select(
        F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target"
    )

    cells = slim.groupBy(*keys, "size", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    before_size = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = cells.groupBy(*keys, "size").agg(F.sum("_rows").alias("_rows"))
    of_size = of_size.select(*keys, "size", F.coalesce(F.sum("_rows").over(before_size), F.lit(0)).alias("_size_base"))
    before_cell = Window.partitionBy(*keys, "size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "size", "_cell", F.coalesce(F.sum("_rows").over(before_cell), F.lit(0)).alias("_cell_base"))
    bases = cells.join(of_size, [*keys, "size"]).join(targets, keys)
    bases = bases.select(*keys, "size", "_cell", (F.col("_size_base") + F.col("_cell_base")).alias("_base"), "source_size", "target")

    in_cell = Window.partitionBy(*keys, "size", "_cell").orderBy(F.col(id_col), "row_hash")
    rows = slim.withColumn("_in_cell", F.row_number().over(in_cell)).join(bases, [*keys, "size", "_cell"])
    rank = F.col("_base") + F.col("_in_cell")  # from 1
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), "_no_source", "_source"), F.lit(1 << 30)) / float(1 << 30)
    crossed = lambda k: F.floor(k * rate + offset)
    copies = F.least(crossed(rank) - crossed(rank - 1), F.lit(max_repeats))
    rows = rows.withColumn("copies", copies.cast("int"))
    return rows.select(
        id_col, "row_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def sampled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``df``, all its columns, whatever their names, as often as it is taken; repeats stand together.

    Rows that share id and text are told apart by number, so each meets its own copies.
    """
    source = options.get("source_col", "source")
    key, other, copies, total, nth, own, k = free_names(df, "_key", "_other", "_copies", "_rows", "_nth", "_own", "_k")
    # A struct, so that null ids and sources are values like any other.
    keyed = lambda i, h, s: F.struct(F.col(i).alias("i"), h.alias("h"), F.col(s).alias("s"))
    plan = mix(df, id_col=id_col, text_col=text_col, **options)
    plan = plan.groupBy(keyed(id_col, F.col("row_hash"), "source").alias(other)).agg(
        F.sum("copies").alias(copies), F.count(F.lit(1)).alias(total)
    )
    rows = df.select(
        "*", keyed(id_col, F.xxhash64(F.col(text_col)), source).alias(key)
    ).join(plan.filter(F.col(copies) > 0), F.col(key) == F.col(other))
    # Equal rows share their group's copies: each takes an equal part, and the first ones the rest.
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(other).orderBy(F.lit(0))))  # by the plan's key, whose type the join deals by
    share = F.floor(F.col(copies) / F.col(total)) + F.when(F.col(nth) <= F.col(copies) % F.col(total), 1).otherwise(0)
    rows = rows.withColumn(own, share.cast("int")).filter(F.col(own) > 0)
    return rows.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(own)))).select(*[F.col(f"`{c}`") for c in df.columns])

"""Scans of snapshots and the items they hold, rankings of channels, and the stores that collections write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .windows import first_per, spread_ranked

#: Channels in display order.
CHANNELS = (
    "github_trending", "github_movers_trending_repos", "github_movers_repofomo", "github_search", "hn_search", "hn_top", "product_hunt",
    "huggingface_models", "huggingface_datasets", "huggingface_spaces", "npm_search", "pypi_newest", "pypi_updates", "x_seed_accounts",
    "x_tweets"
)
RETIRED = ("x_project_mentions", "ossinsight_trending", "ossinsight_trending_optional")
LABELS = {
    "github_trending": "GitHub Trending", "github_movers_trending_repos": "Trending Repos", "github_movers_repofomo": "RepoFOMO",
    "github_search": "GitHub Search", "hn_search": "HN Search", "hn_top": "HN Top", "product_hunt": "Product Hunt",
    "huggingface_models": "HF Models", "huggingface_datasets": "HF Datasets", "huggingface_spaces": "HF Spaces", "npm_search": "npm Search",
    "pypi_newest": "PyPI Newest", "pypi_updates": "PyPI Updates", "x_seed_accounts": "X Accounts", "x_tweets": "X Tweets"
}
WINDOW_OF_PERIOD = {"daily": "24h", "weekly": "7d", "monthly": "30d", "past_24_hours": "24h", "past_week": "7d", "past_month": "30d"}


def channel(source: Column) -> Column:
    """The channel a source is shown in; null for retired sources."""
    return F.when(source.isin(*RETIRED), None).when(
        source == "hn_algolia", "hn_search"
    ).when(source == "hn_firebase", "hn_top").otherwise(source)


def channel_label(name: Column) -> Column:
    out = name
    for k, v in LABELS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def item_window(window: Column, period: Column) -> Column:
    out = F.coalesce(period, F.lit("current"))
    for k, v in WINDOW_OF_PERIOD.items():
        out = F.when(period == k, v).otherwise(out)
    return F.coalesce(F.when(window != "", window), out)


def latest_snapshots(snapshots: DataFrame, by: str, ok_only: bool) -> DataFrame:
    """source and the greatest ``by`` of its snapshots; only complete ones where ``ok_only``."""
    rows = snapshots.filter("status = 'ok'") if ok_only else snapshots
    return rows.groupBy("source").agg(F.max(by).alias(by))


def latest_items(items: DataFrame, snapshots: DataFrame, by: str = "month", ok_only: bool = True) -> DataFrame:
    """Items of each source's latest snapshot. The latest table has one row a source and joins by broadcast when small."""
    return items.join(latest_snapshots(snapshots, by, ok_only), ["source", by])


def channel_ranks(items: DataFrame, order: list[Column], key: str = "channel", window: str = "window") -> DataFrame:
    """rank, channel_rank, window_rank: three running numbers in one order. Channels are few, so no task holds one."""
    place = F.coalesce(*[F.when(F.col(key) == c, i) for i, c in enumerate(CHANNELS)], F.lit(999))
    out = spread_ranked(items, "channel_rank", [key], order, finer={"window_rank": [window]})
    sizes = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", place)
    before = Window.orderBy("_place", key).rowsBetween(Window.unboundedPreceding, -1)  # one row a channel
    base = sizes.select(key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return out.join(base, key).withColumn("rank", F.col("_base") + F.col("channel_rank")).drop("_base")


#: Order of windows, and of a source's lists, within a channel.
WINDOW_ORDER = ("24h", "7d", "30d", "30d+", "current")
LIST_ORDER = ("topstories", "newstories", "beststories")
#: What each source ranks by, a field of its metadata; other sources rank by their own place.
NATIVE_METRIC = {
    "github_trending": "period_stars",
    "github_search": "stars",
    "github_movers_trending_repos": "stars_velocity",
    "github_movers_repofomo": "stars_7d",
    "product_hunt": "votes",
    "huggingface_models": "trending_score",
    "huggingface_datasets": "trending_score",
    "huggingface_spaces": "trending_score",
    "npm_search": "weekly_downloads",
    "x_seed_accounts": "followers_count",
}


def _field(metadata: Column, name: str) -> Column:
    return F.try_element_at(metadata, F.lit(name))


def _place(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(value == v, i) for i, v in enumerate(order)], F.lit(99))


def native_metric(source: Column, metadata: Column, rank: Column) -> Column:
    """The number that a source itself ranks by; stories have points, or a score where those are none or zero."""
    points = F.coalesce(F.nullif(_field(metadata, "points").try_cast("double"), F.lit(0.0)), _field(metadata, "score").try_cast("double"))
    out = F.when(source.isin("hn_algolia", "hn_firebase"), points)
    for name, field in NATIVE_METRIC.items():
        out = out.when(source == name, _field(metadata, field).try_cast("double"))
    return out.otherwise(rank.cast("double"))


def native_order(source: Column, window: Column, metadata: Column, rank: Column, name: Column) -> Column:
    """The place of an item among its source's, as a struct to sort by: window or list, scope or query, rank (10,000 if none), name."""
    scope = F.coalesce(F.nullif(_field(metadata, "scope_language"), F.lit("")), F.lit("all"))
    label = F.coalesce(F.nullif(_field(metadata, "query_label"), F.lit("")), _field(metadata, "query"), F.lit(""))
    windowed = source.isin("github_trending", "hn_algolia", "github_movers_trending_repos", "x_tweets")
    first = F.when(windowed, _place(window, WINDOW_ORDER)).when(
        source == "hn_firebase", _place(_field(metadata, "list"), LIST_ORDER)
    ).otherwise(0)
    second = F.when((source == "github_trending") & (scope != "all"), 1).otherwise(0)
    text = F.when(source == "github_trending", scope).when(source.isin("github_search", "hn_algolia", "npm_search"), label).otherwise("")
    return F.struct(
        first.alias("a"), second.alias("b"), text.alias("c"), F.coalesce(rank, F.lit(10_000)).cast("long").alias("d"), name.alias("e")
    )


def matches_text(columns: list[Column], metadata: Column, needle: str) -> Column:
    """Whether a row's fields, or the values of its metadata, hold the text, whatever the case."""
    return F.lower(F.concat_ws(" ", *columns, F.array_join(F.map_values(metadata), " "))).contains(needle.lower())


def in_range(metric: Column, window: Column, wanted: str) -> Column:
    """Whether a row belongs to a range: a window by its name, else any metric above zero."""
    return (window == wanted) if wanted in WINDOW_ORDER else F.coalesce(metric.try_cast("double"), F.lit(0.0)) > 0


def channel_view(
    rows: DataFrame, column: str, kind: str, descending: bool, keys: list[str], native: list[str], name: str, last: str,
    label: str = "place"
) -> DataFrame:
    """``rows`` with their place in each channel's view: sorted by a chosen column and direction, ties by native rank, name, ``last``.

    kind is what the column holds: "name" (in lower case), "time" (none is the epoch) or "number" (numbers before other
    text, which sorts in lower case). The native rank is the first of the given ranks that there is, else 999,999.
    """
    value = F.col(column)
    if kind == "time":
        sort = [F.coalesce(value.cast("string").try_cast("timestamp"), F.lit(0).cast("timestamp"))]
    elif kind == "number":
        number = value.cast("string").try_cast("double")
        sort = [number.isNull(), F.coalesce(number, F.lit(0.0)), F.lower(F.coalesce(value.cast("string"), F.lit("")))]
    else:
        sort = [F.lower(F.coalesce(value.cast("string"), F.lit("")))]
    chosen = [c.desc() if descending else c.asc() for c in sort]
    rank = F.coalesce(*[F.col(c).cast("long") for c in native], F.lit(999_999))
    return spread_ranked(rows, label, keys, [*chosen, rank.asc(), F.lower(F.coalesce(name, F.lit(""))).asc(), F.col(last).asc()])


def append_snapshot(batch: DataFrame, path: str) -> None:
    """Items of a run, the first of each (source, external_id), added to the folder by source and run. batch: source, run_id, external_id, ord, ..."""
    first_of_batch(
        batch, ["source", "run_id", "external_id"], [F.col("ord").asc()]
    ).write.mode("append").partitionBy("source", "run_id").parquet(path)


def latest_from_store(spark: SparkSession, path: str, snapshots: DataFrame) -> DataFrame:
    """Items of each source's latest complete snapshot out of the folder that ``append_snapshot`` writes.

    The folder is laid out by source and run, and the latest snapshots, one row a source, are the side that prunes it:
    files of other runs are not opened. snapshots: source, run_id, status.
    """
    stored = spark.read.option("basePath", path).parquet(path)
    kinds = {"source": "string", "run_id": "string"}
    stored = stored.select(
        *[
            F.col(c).cast(kinds[c]).alias(c) if c in kinds and stored.schema[c].dataType.simpleString() != "string" else F.col(c) for c in stored.columns
        ]
    )
    return stored.join(F.broadcast(latest_snapshots(snapshots, "run_id", ok_only=True)), ["source", "run_id"])  # a row a source


def replace_runs(rows: DataFrame, path: str) -> None:
    """Rows of whole runs in place of what the folder has of those runs; other runs stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def insert_absent(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The store and, once each, the new rows whose key it lacks."""
    return store.unionByName(new.dropDuplicates(keys).join(store.select(*keys).distinct(), keys, "left_anti"))


def referenced(ids: list[DataFrame], key: str) -> DataFrame:
    """Distinct ids of several tables of references."""
    out = ids[0].select(key)
    for other in ids[1:]:
        out = out.union(other.select(key))
    return out.distinct()


def persisted_entities(store: DataFrame, built: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The stored entities, and those built of which something refers to and which are not stored yet."""
    return insert_absent(store, built.join(ids.select(key).distinct(), key, "left_semi"), [key])


def since_date(cursors: DataFrame, handles: DataFrame, now: Column, fallback_days: int = 30, safety_days: int = 2) -> DataFrame:
    """since: two days before the oldest cursor if every handle has one, else the fallback. cursors: handle, latest_at; handles: handle."""
    name = F.regexp_replace(F.lower("handle"), "^@+", "")
    asked = handles.filter("handle != ''").select(name.alias("handle")).distinct()
    known = cursors.filter("latest_at is not null").groupBy(name.alias("handle")).agg(F.max("latest_at").alias("latest_at"))
    got = asked.join(known, "handle", "left").agg(
        F.count(F.lit(1)).alias("n"), F.count("latest_at").alias("k"), F.min("latest_at").alias("oldest")
    )
    since = F.when(
        (F.col("n") > 0) & (F.col("n") == F.col("k")), F.col("oldest") - F.expr(f"INTERVAL {safety_days} DAYS")
    ).otherwise(now - F.expr(f"INTERVAL {fallback_days} DAYS"))
    return got.select(F.date_format(since, "yyyy-MM-dd").alias("since"))


def source_channels(items: DataFrame, errors: DataFrame, hidden: tuple[str, ...]) -> DataFrame:
    """channel, label, place, count, windows, error: the channels that have items, in display order, hidden ones left out.

    items: source, window; errors: source, error (the latest of each source).
    """
    rows = items.withColumn("channel", channel(F.col("source"))).filter(F.col("channel").isNotNull() & ~F.col("channel").isin(*hidden))
    counts = rows.groupBy("channel", "window").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("channel").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.struct("window", "n"))).alias("windows"))
    bad = errors.withColumn("channel", channel(F.col("source"))).groupBy("channel").agg(F.max("error").alias("error"))
    return per.join(bad, "channel", "left").select(
        "channel", channel_label(F.col("channel")).alias("label"), _place(F.col("channel"), CHANNELS).alias("place"), "count", "windows",
        "error"
    )


def snapshot_status(error: Column, rows: Column) -> Column:
    return F.when(error.isNull(), "ok").when(rows > 0, "partial").otherwise("error")


def first_of_batch(batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Repeats of a key within a batch keep the first."""
    return first_per(batch, keys, order)


def upserted(store: DataFrame, batch: DataFrame, key: str, seen_first: str = "first_seen", seen_last: str = "last_seen") -> DataFrame:
    """The store after a batch: the batch's latest row of a key replaces the stored one, but the earliest first sight stays."""
    both = store.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    earliest = Window.partitionBy(key)
    latest = Window.partitionBy(key).orderBy(
        F.desc("_new"), F.desc(seen_last), *[F.desc(c) for c in sorted(store.columns) if c not in (key, seen_last)]
    )
    both = both.withColumn("_first", F.min(seen_first).over(earliest)).withColumn("_n", F.row_number().over(latest)).filter("_n = 1")
    return both.withColumn(seen_first, F.col("_first")).select(*store.columns)


def cursors(posts: DataFrame, author: str, at: str, post_id: str) -> DataFrame:
    """Per lower-cased author: latest time, the post it belongs to, and how many there are."""
    return posts.groupBy(F.lower(author).alias("author")).agg(
        F.max(at).alias("latest_at"), F.max(F.struct(F.col(at), F.col(post_id)))[post_id].alias("latest_id"),
        F.count(F.lit(1)).alias("posts")
    )


def pruned(items: DataFrame, keep: DataFrame, group: list[str], order: list[Column], most: int, key: str = "item_id") -> DataFrame:
    """Items among the first ``most`` of their group or referenced from ``keep``; ``key`` tells items apart.

    The first ones are an ordered prefix, which tasks cut short before the shuffle; the others come by a semi join.
    """
    first = first_per(items, group, order, most)
    referenced_ = items.join(keep.select(key).distinct(), key, "left_semi").select(*items.columns)
    return first.unionByName(referenced_).dropDuplicates([key])


def without_secrets(fields: Column) -> Column:
    """A map without local paths, and with secrets' values replaced."""
    secret = lambda k: F.lower(k).rlike("token|secret|password|authorization|api_key")
    return F.transform_values(
        F.map_filter(fields, lambda k, v: ~F.lower(k).isin("raw_file", "local_path", "file_path", "path")),
        lambda k, v: F.when(secret(k), "[redacted]").otherwise(v)
    )


def guarded_jobs(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Jobs after an upsert: a job that is completed or failed keeps its status and result."""
    n = new.select(*key, F.col("status").alias("_status"), F.col("priority").alias("_priority"))
    both = old.join(n, key, "full_outer")
    done = F.col("status").isin("completed", "failed")
    return both.select(
        *key, F.when(done, F.col("status")).otherwise(F.coalesce("_status", "status")).alias("status"),
        F.coalesce("_priority", "priority").alias("priority")
    )


def gated_import(store: DataFrame, batch: DataFrame, at: str, run: str, oldest: Column) -> DataFrame:
    """A batch whose newest row is older than ``oldest`` is refused whole; else it replaces the rows of its import runs."""
    fresh = batch.agg(F.max(at).alias("_newest")).filter(F.col("_newest") >= oldest)  # one row or none
    taken = batch.crossJoin(F.broadcast(fresh)).drop("_newest")
    return store.join(taken.select(run).distinct(), run, "left_anti").unionByName(taken.select(*store.columns))

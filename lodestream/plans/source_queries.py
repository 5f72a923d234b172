"""Readers of landed payloads over payloads that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.windows import ranked, spread_ranked
from lodestream.sources import landed as S

from .fixtures import ITEMS_SQL, items, now, with_sql
from .registry import query, table


def _array(*fields: Column, order: str) -> Column:
    """A JSON array of the group's rows in order; groups are pages of bounded size."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("v")))), lambda r: r["v"])
    return F.to_json(rows)


#: Rows of a landed page.
PAGE = 1000


def _pages(df: DataFrame, key: str, order: str, size: int = PAGE) -> GroupedData:
    """Rows grouped by key and page; ``before`` counts the rows of the key's earlier pages."""
    return spread_ranked(df, "_n", [key], [F.col(order).asc()]).groupBy(key, (F.floor((F.col("_n") - 1) / size) * size).alias("before"))


def _object(name: str, array: Column) -> Column:
    return F.concat(F.lit(f'{{"{name}":'), array, F.lit("}"))


@query("""SELECT 'github_search' AS source, o_orderpriority || ':o/' || o_orderkey AS external_id, n AS source_rank, CAST(o_custkey AS VARCHAR) AS stars,
  CAST(1 + (n - 1) // 100 AS VARCHAR) AS search_page FROM
  (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 500""")
def s2_repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread_ranked(table(spark, sf_dir, "orders"), "n", ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey").asc()])
    name = F.concat(F.lit("o/"), F.col("o_orderkey").cast("string"))
    pages = o.withColumn("page", (1 + F.floor((F.col("n") - 1) / 100)).cast("int")).groupBy("o_orderpriority", "page")
    landed = pages.agg(
        _object(
            "items", _array(name.alias("full_name"), name.alias("html_url"), F.col("o_custkey").alias("stargazers_count"), order="n")
        ).alias("payload")
    )
    landed = landed.select(F.col("o_orderpriority").alias("query"), F.col("o_orderpriority").alias("query_label"), "page", "payload")
    out = S.repository_search(landed, 500)
    return out.select(
        "source", "external_id", "source_rank", F.col("metadata")["stars"].alias("stars"),
        F.col("metadata")["search_page"].alias("search_page")
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT '24h:u' || user_id || ':' || item_id AS external_id, row_number() OVER (PARTITION BY user_id
  ORDER BY item_id) AS source_rank, CASE WHEN item_id % 3 = 0 THEN 'https://news.ycombinator.com/item?id=' || item_id ELSE url END AS url, CAST(CASE
  WHEN k % 4 = 0 THEN 0 ELSE k END AS VARCHAR) AS points FROM items WHERE source = 'hn_algolia'"""
    )
)
def s5_story_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).filter("source = 'hn_algolia'")
    hit = [
        F.col("item_id").cast("string").alias("objectID"), F.when(F.col("item_id") % 3 != 0, F.col("url")).alias("url"),
        F.when(F.col("k") % 4 != 0, F.col("k")).alias("points")
    ]
    landed = _pages(i, "user_id", "item_id").agg(_object("hits", _array(*hit, order="item_id")).alias("payload"))
    label = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    out = S.story_hits(landed.select(F.lit("24h").alias("window"), label.alias("query"), label.alias("query_label"), "before", "payload"))
    return out.select("external_id", "source_rank", "url", F.col("metadata")["points"].alias("points"))


@query(
    """SELECT 'list' || user_id || ':' || event_id AS external_id, n AS source_rank, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 30 AND event_id % 6 <> 0"""
)
def s6_story_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = ranked(e, "_n", ["user_id"], [F.col("event_id").asc()]).filter("_n <= 30")
    lists = first.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_list("event_id"))).alias("payload")).select(
        F.concat(F.lit("list"), F.col("user_id").cast("string")).alias("list"), "payload"
    )
    payloads = e.filter("event_id % 6 != 0").select(
        F.col("event_id").alias("item_id"),
        F.to_json(F.struct(F.floor("value").alias("score"), F.col("event_type").alias("title"))).alias("payload")
    )
    return S.story_lists(lists, payloads, 30).select("external_id", "source_rank", F.col("metadata")["score"].alias("score"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE n END AS source_rank, CAST(p_size AS VARCHAR) AS votes
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)"""
)
def s7_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct(
        F.struct(
            F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("dailyRank"),
            F.col("p_size").alias("votesCount")
        ).alias("node")
    )
    edges = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", node.alias("e")))), lambda r: r["e"])
    landed = _pages(table(spark, sf_dir, "part"), "p_brand", "p_partkey").agg(
        F.concat(F.lit('{"data":{"posts":{"edges":'), F.to_json(edges), F.lit("}}}")).alias("payload")
    )
    return S.launches(landed).select("external_id", "source_rank", F.col("metadata")["votes"].alias("votes"))


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT 'huggingface_models' AS source, 'm' || p_partkey AS external_id, n AS source_rank, CAST(coalesce(CASE
  WHEN p_size % 3 = 0 THEN p_size END, 0) AS VARCHAR) AS likes, CASE WHEN p_partkey % 2 = 0
  AND top <= 150 THEN 'https://github.com/o/r' || p_partkey END AS repository
  FROM (SELECT *, row_number() OVER (ORDER BY p_size DESC, n, p_partkey) AS top FROM p)""")
def s8_s9_model_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    entry = [
        key.alias("id"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("likes"),
        F.col("p_size").cast("double").alias("trendingScore")
    ]
    landed = _pages(part, "p_brand", "p_partkey").agg(_array(*entry, order="p_partkey").alias("payload")).select(
        F.lit("models").alias("resource"), "before", "payload"
    )
    cards = part.filter("p_partkey % 2 = 0").select(
        key.alias("external_id"),
        F.concat(F.lit("see https://github.com/o/r"), F.col("p_partkey").cast("string"), F.lit(".git now")).alias("text")
    )
    out = S.with_card_links(S.model_hub(landed), cards, 150)
    return out.select(
        "source", "external_id", "source_rank", F.col("metadata")["likes"].alias("likes"),
        F.try_element_at("metadata", F.lit("repository")).alias("repository")
    )


@query(
    """SELECT p_brand || ':' || 'pkg' || p_partkey AS external_id, row_number() OVER (PARTITION BY p_brand
  ORDER BY p_partkey) AS source_rank, CAST(2 + p_size % 2 AS VARCHAR) AS maintainers_count, CASE
  WHEN p_size % 5 = 0 THEN NULL ELSE CAST(1000 + p_size AS VARCHAR) || '.0' END AS weekly_downloads FROM part"""
)
def s10_package_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.array(F.struct(F.lit("a").alias("username")), F.struct(F.lit("b").alias("username")))
    package = F.struct(
        F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, who).otherwise(F.concat(who, F.slice(who, 1, 1))).alias("maintainers")
    )
    loads = F.struct(
        F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(
            F.concat(F.lit("1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
        ).alias("weekly")
    )
    landed = _pages(table(spark, sf_dir, "part"), "p_brand", "p_partkey").agg(
        _object("objects", _array(package.alias("package"), loads.alias("downloads"), order="p_partkey")).alias("payload")
    )
    out = S.package_search(landed.select(F.col("p_brand").alias("query"), F.col("p_brand").alias("query_label"), "before", "payload"))
    return out.select(
        "external_id", "source_rank", F.col("metadata")["maintainers_count"].alias("maintainers_count"),
        F.col("metadata")["weekly_downloads"].alias("weekly_downloads")
    )


@query(
    """SELECT CAST(event_id AS VARCHAR) AS post_id, 'user' || user_id AS author, ts AS created_at,
  CAST(floor(value) AS BIGINT) * 2 AS engagement, event_id % 7 = 0 AS is_reply FROM events WHERE event_id % 11 <> 0"""
)
def s14_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.floor("value")
    at = F.when(
        F.col("event_id") % 11 != 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    ).otherwise("soon")
    row = F.struct(
        F.col("event_id").cast("string").alias("id"), at.alias("createdAt"), n.alias("likeCount"), n.cast("string").alias("retweetCount"),
        F.struct(F.concat(F.lit("@user"), F.col("user_id").cast("string")).alias("userName")).alias("author"),
        F.when(F.col("event_id") % 7 == 0, True).alias("isReply")
    )
    landed = e.select(F.col("event_id").alias("ord"), F.to_json(row).alias("payload"))
    return S.posts(landed).select(
        "post_id", "author", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "engagement", "is_reply"
    )


@query("""WITH k AS (SELECT event_id, ts, user_id FROM events WHERE event_id % 5 <> 0 AND user_id % 2 = 0 AND ts BETWEEN TIMESTAMP '2024-01-24'
  AND TIMESTAMP '2024-01-31'),
r AS (SELECT event_id, ts, w, i FROM k, (VALUES ('24h', 1, 1), ('7d', 7, 2)) v(w, d, i) WHERE ts >= TIMESTAMP '2024-01-31' - to_days(CAST(d AS INTEGER)))
SELECT w || ':' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS external_id, n AS source_rank
  FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, lpad(CAST(event_id AS VARCHAR), 9, '0') DESC, i) AS n FROM r) WHERE n <= 300""")
def s15_stored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("ts").cast("timestamp_ntz") <= now())
    run = F.when(F.col("event_id") % 5 == 0, "archived")
    store = e.select(
        F.lpad(F.col("event_id").cast("string"), 9, "0").alias("post_id"),
        F.concat(F.lit("@U"), F.col("user_id").cast("string")).alias("author"), F.col("event_type").alias("text"), F.lit("").alias("url"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"), run.alias("import_run")
    )
    handles = e.filter("user_id % 2 = 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("author")).distinct()
    archived = store.select("import_run").filter("import_run is not null").distinct()
    return S.stored_posts(store, archived, handles, now(), ("24h", "7d"), 300).select("external_id", "source_rank")


@query(
    """SELECT 'user' || user_id AS username, max(metric) AS followers_count FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS metric FROM events
  WHERE user_id % 3 <> 0 AND event_type = 'click') WHERE metric > 0 GROUP BY user_id ORDER BY followers_count DESC, username LIMIT 50"""
)
def s12_s13_seed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    bio = F.when(F.col("user_id") % 3 == 0, "an AI company, founder").otherwise("founder of AI things")
    landed = e.select(
        F.col("event_id").alias("ord"),
        F.to_json(
            F.struct(
                F.concat(F.lit("@"), name, F.lit("_"), F.col("event_id").cast("string")).alias("userName"), bio.alias("description"),
                F.floor("value").alias("followersCount")
            )
        ).alias("payload")
    )
    accounts = S.followed_accounts(landed).withColumn("username", F.substring_index("username", "_", 1))
    return S.seed_accounts(accounts, ("openai",), e.select(name.alias("username")).limit(0), 50)

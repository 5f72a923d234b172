"""Views that give the driver's tables the shape of landed signals, each as a DataFrame and as SQL.

``NOW`` stands for the time of the run: queries never read the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import scalars as X

from .registry import table

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


#: events as links and running text.
LINKS_SQL = r"""links AS (SELECT event_id, user_id, k, u, 'See ' || u || ', and https://github.com/a/B' || k || ').' AS txt FROM (
  SELECT event_id, user_id, k, CASE event_id % 8
    WHEN 0 THEN 'https://github.com/Owner' || user_id || '/Repo.' || k || '.git#readme'
    WHEN 1 THEN 'https://www.npmjs.com/package/@scope/pkg' || k
    WHEN 2 THEN 'https://Blog.Site' || user_id || '.example/posts/' || k || '?a=1'
    WHEN 3 THEN 'http://github.com/only' || user_id
    WHEN 4 THEN 'git+https://github.com/Org' || user_id || '/tool' || k || '.git'
    WHEN 5 THEN 'http://10.0.0.' || k || '/x'
    WHEN 6 THEN 'https://www.producthunt.com/posts/x' || k
    ELSE 'https://app.Site' || user_id || '.co/a/b/?q=' || k || '#frag' END AS u
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    c = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    k, user, n = F.col("k").cast("string"), F.col("user_id").cast("string"), F.col("event_id") % 8
    u = (
        F.when(n == 0, c("https://github.com/Owner", user, "/Repo.", k, ".git#readme"))
        .when(n == 1, c("https://www.npmjs.com/package/@scope/pkg", k))
        .when(n == 2, c("https://Blog.Site", user, ".example/posts/", k, "?a=1"))
        .when(n == 3, c("http://github.com/only", user))
        .when(n == 4, c("git+https://github.com/Org", user, "/tool", k, ".git"))
        .when(n == 5, c("http://10.0.0.", k, "/x"))
        .when(n == 6, c("https://www.producthunt.com/posts/x", k))
        .otherwise(c("https://app.Site", user, ".co/a/b/?q=", k, "#frag"))
    )
    return e.withColumn("u", u).withColumn("txt", c("See ", F.col("u"), ", and https://github.com/a/B", k, ")."))


#: events as observed items of five sources, each of an entity.
ITEMS_SQL = r"""items AS (SELECT event_id AS item_id, ts, user_id, value, k, CAST(floor(value * 10) AS BIGINT) AS metric,
  CASE event_type WHEN 'click' THEN 'github_trending' WHEN 'view' THEN 'hn_algolia' WHEN 'purchase' THEN 'product_hunt'
  WHEN 'signup' THEN 'npm_registry' ELSE 'huggingface_models' END AS source,
  CASE event_type WHEN 'click' THEN 'github' WHEN 'view' THEN 'hn' WHEN 'purchase' THEN 'product_hunt'
  WHEN 'signup' THEN 'package_family' ELSE 'huggingface' END AS family,
  CASE user_id % 3 WHEN 0 THEN 'github:owner' || (user_id % 10) || '/repo' || user_id WHEN 1 THEN 'domain:' || CASE
  WHEN user_id % 5 = 0 THEN 'blog.' ELSE '' END || 'site' || user_id || '.example' ELSE 'name:project-' || user_id END AS entity_key,
  CASE user_id % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'domain' ELSE 'name' END AS key_type,
  'https://site' || user_id || '.example/' || CASE WHEN k % 4 = 0 THEN 'Blog' ELSE 'app' END || '/' || k AS url
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    t, user = F.col("event_type"), F.col("user_id").cast("string")
    pick = lambda a, b, c, d, z: F.when(t == "click", a).when(t == "view", b).when(t == "purchase", c).when(t == "signup", d).otherwise(z)
    kind = F.when(F.col("user_id") % 3 == 0, "github").when(F.col("user_id") % 3 == 1, "domain").otherwise("name")
    key = (
        F.when(kind == "github", F.concat(F.lit("github:owner"), (F.col("user_id") % 10).cast("string"), F.lit("/repo"), user))
        .when(kind == "domain", F.concat(F.lit("domain:"), F.when(F.col("user_id") % 5 == 0, "blog.").otherwise(""), F.lit("site"), user, F.lit(".example")))
        .otherwise(F.concat(F.lit("name:project-"), user))
    )
    url = F.concat(
        F.lit("https://site"), user, F.lit(".example/"), F.when(F.col("k") % 4 == 0, "Blog").otherwise("app"), F.lit("/"),
        F.col("k").cast("string")
    )
    return e.select(
        F.col("event_id").alias("item_id"), "ts", "user_id", "value", "k", F.floor(F.col("value") * 10).cast("long").alias("metric"),
        pick("github_trending", "hn_algolia", "product_hunt", "npm_registry", "huggingface_models").alias("source"),
        pick("github", "hn", "product_hunt", "package_family", "huggingface").alias("family"),
        key.alias("entity_key"), kind.alias("key_type"), url.alias("url"),
    )


#: orders as snapshots: a source and month, partial where any order is.
SNAPSHOTS_SQL = r"""snap_items AS (SELECT o_orderkey AS item_id, o_custkey, o_orderpriority AS source, date_trunc('month', o_orderdate) AS month, o_orderdate, o_totalprice, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_orderkey % 50 END AS source_rank FROM orders),
snapshots AS (SELECT source, month, CASE WHEN sum(CASE
  WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) * 50 > count(*) * 17 THEN 'partial' ELSE 'ok' END AS status, count(*) AS item_count FROM snap_items
  GROUP BY source, month)"""


def snap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("item_id"), "o_custkey", F.col("o_orderpriority").alias("source"),
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), "o_totalprice", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, 1 + F.col("o_orderkey") % 50).alias("source_rank")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = F.count_if(F.col("o_orderstatus") == "P") * 50 > F.count(F.lit(1)) * 17
    return snap_items(spark, sf_dir).groupBy("source", "month").agg(
        F.when(partial, "partial").otherwise("ok").alias("status"), F.count(F.lit(1)).alias("item_count")
    )


#: customers and their orders as scored groups with seven axes.
GROUPS_SQL = r"""groups AS (SELECT c_custkey AS group_id, c_name AS canonical_name, c_mktsegment AS segment, c_nationkey,
  CASE c_custkey % 4 WHEN 0 THEN 'high_potential' WHEN 1 THEN 'potential' ELSE 'edge_watch' END AS level,
  CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS level_rank,
  CAST(c_custkey * 7 % 101 AS DOUBLE) AS workflow_shift, CAST(c_custkey * 13 % 101 AS DOUBLE) AS technical_substance,
  CAST(c_custkey * 29 % 101 AS DOUBLE) AS product_market_fit,
  CAST(c_custkey * 31 % 101 AS DOUBLE) AS momentum, CAST(c_custkey * 37 % 101 AS DOUBLE) AS confidence,
  CAST(c_custkey * 3 % 26 AS DOUBLE) AS risk_penalty, CAST(c_custkey * 5 % 26 AS DOUBLE) AS derivative_news_penalty,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'article'
  WHEN 'MACHINERY' THEN 'news' ELSE 'tool' END AS object_type, c_custkey % 5 <> 0 AS is_product_or_repo, c_custkey % 9 <> 0 AS should_print, c_custkey % 17 = 0 AS failed,
  coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""
AXES = ("workflow_shift", "technical_substance", "product_market_fit", "momentum", "confidence", "risk_penalty", "derivative_news_penalty")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    axis = {
        a: (n * m % b).cast("double") for a, m, b in zip(AXES, (7, 13, 29, 31, 37, 3, 5), (101, 101, 101, 101, 101, 26, 26), strict=True)
    }
    level = F.when(n % 4 == 0, "high_potential").when(n % 4 == 1, "potential").otherwise("edge_watch")
    return c.join(orders, n == F.col("o_custkey"), "left").select(
        n.alias("group_id"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("segment"), "c_nationkey", level.alias("level"),
        F.when(n % 4 == 0, 3).when(n % 4 == 1, 2).otherwise(1).alias("level_rank"), *[v.alias(a) for a, v in axis.items()],
        F.when(F.col("c_mktsegment") == "BUILDING", "article").when(F.col("c_mktsegment") == "MACHINERY", "news").otherwise("tool").alias("object_type"),
        (n % 5 != 0).alias("is_product_or_repo"), (n % 9 != 0).alias("should_print"), (n % 17 == 0).alias("failed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"),
    )


def with_sql(*views: str, then: str = "") -> str:
    return "WITH " + ",\n".join(views) + "\n" + then


__all__ = [
    "AXES", "GROUPS_SQL", "ITEMS_SQL", "LINKS_SQL", "NOW", "SNAPSHOTS_SQL", "X", "groups", "items", "links", "now", "snap_items",
    "snapshots", "with_sql"
]

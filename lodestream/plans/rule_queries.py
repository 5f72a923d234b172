"""Entity resolution, rules and candidates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import entities as E
from lodestream.operators import rules as R

from .fixtures import ITEMS_SQL, LINKS_SQL, items, links, now, with_sql
from .registry import query, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def ago(days: int):
    return now() - F.expr(f"INTERVAL {days} DAYS")


# --- entities -------------------------------------------------------------------------------------------------------

_KEYS_SQL = r"""keyed AS (SELECT event_id AS item_id, list_sort(list_distinct(list_transform(regexp_extract_all(txt, 'https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 0), lambda g: 'github:' || lower(regexp_replace(regexp_replace(g, '^https?://github\.com/', ''), '\.git$', ''))))) AS keys
  FROM links)"""


@query(with_sql(LINKS_SQL, _KEYS_SQL, then="SELECT item_id, unnest(keys) AS key FROM keyed"))
def e1_item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = links(spark, sf_dir)
    keys = E.item_keys(F.array("u", "txt"), F.lit("x"), F.col("event_id"), F.lit(False))
    return i.select(F.col("event_id").alias("item_id"), F.explode(keys).alias("key"))


_NODES_SQL = """items2 AS (SELECT event_id AS item_id, user_id, CASE WHEN event_type = 'purchase'
  AND value >= 30 THEN ['u' || user_id, 'v' || CAST(round(value * 100) AS BIGINT)] ELSE ['u' || user_id] END AS keys, 'n' || (event_id % 50) AS name
  FROM events),
pairs AS (SELECT DISTINCT keys[1] AS u, keys[2] AS v FROM items2 WHERE len(keys) > 1),
adj AS (SELECT DISTINCT a.u AS x, b.u AS y FROM pairs a JOIN pairs b ON a.v = b.v),
reach(x, y) AS (SELECT DISTINCT keys[1], keys[1] FROM items2 UNION SELECT r.x, a.y FROM reach r JOIN adj a ON a.x = r.y),
roots AS (SELECT x AS u, min(least(y, coalesce(v, y))) AS root FROM reach LEFT JOIN pairs ON pairs.u = y GROUP BY x)"""


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with their user's key; a purchase has its value's key too."""
    e = table(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    value = F.concat(F.lit("v"), F.round(F.col("value") * 100).cast("long").cast("string"))
    return e.select(
        F.col("event_id").alias("item_id"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") >= 30), F.array(user, value)).otherwise(F.array(user)).alias("keys"),
        F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")).alias("name")
    )


@query("WITH RECURSIVE " + _NODES_SQL + " SELECT item_id, root FROM items2 JOIN roots ON roots.u = keys[1]")
def e2_resolved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resolve(_keyed_events(spark, sf_dir))


@query("WITH RECURSIVE " + _NODES_SQL + """, k AS (SELECT root, unnest(keys) AS key, name, item_id FROM items2 JOIN roots ON roots.u = keys[1])
SELECT root, 'entity:' || substr(sha1(min(key)), 1, 16) AS entity_id,
  min(key) AS canonical_key, min_by(name, struct_pack(n := length(name), a := name)) AS canonical_entity, count(DISTINCT item_id) AS n_items,
  count(DISTINCT name) AS n_aliases FROM k GROUP BY root""")
def e3_canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _keyed_events(spark, sf_dir)
    return E.entities(p, E.resolve(p))


# --- rules ----------------------------------------------------------------------------------------------------------

_R1 = f"""r1 AS (SELECT entity_key, 'github' AS family, 'github_trending_daily' AS rule, CASE WHEN m >= 3000 THEN 'high_potential'
  WHEN m >= 1000 THEN 'potential' ELSE 'watch' END AS level, 'stars_today' AS metric_name, CAST(m AS DOUBLE) AS metric, event_at
  FROM (SELECT entity_key, max(metric) AS m, max_by(ts, struct_pack(a := metric, b := -item_id)) AS event_at FROM items
  WHERE source = 'github_trending' AND ts BETWEEN {_NOW} - INTERVAL 1 DAY AND {_NOW} GROUP BY entity_key) WHERE m >= 300)"""
_R3 = f"""r3 AS (SELECT entity_key, 'github' AS family, 'repofomo' AS rule, level, CASE
  WHEN s30 > 0 THEN 'stars_accel_7d_vs_30d' ELSE 'stars_7d' END AS metric_name, CAST(CASE
  WHEN s30 > 0 THEN ratio ELSE s7 END AS DOUBLE) AS metric, event_at FROM (
  SELECT *, CASE WHEN s30 <= 0 THEN 'watch' WHEN ratio >= 3 THEN 'high_potential' WHEN ratio >= 2 THEN 'potential'
  WHEN ratio >= 1.2 THEN 'watch' ELSE 'none' END AS level FROM (
    SELECT *, CAST(s7 AS DOUBLE) / 7 / greatest(CAST(s30 AS DOUBLE) / 30, 1.0) AS ratio FROM (
      SELECT entity_key, coalesce(sum(k) FILTER (ts >= {_NOW} - INTERVAL 7 DAY), 0) AS s7, sum(CASE WHEN user_id % 11 = 0 THEN 0 ELSE k END) AS s30,
      max(ts) AS event_at FROM items WHERE source = 'github_trending' AND ts BETWEEN {_NOW} - INTERVAL 30 DAY AND {_NOW} GROUP BY entity_key)
      WHERE s7 >= 70)) WHERE level <> 'none')"""
_R4 = f"""r4 AS (SELECT entity_key, 'hn' AS family, 'hn_max_points_7d' AS rule, CASE
  WHEN p >= 200 THEN 'potential' ELSE 'watch' END AS level, 'hn_max_points_7d' AS metric_name, CAST(p AS DOUBLE) AS metric, event_at FROM (
  SELECT entity_key, max(points) AS p, max_by(ts, struct_pack(a := points, b := -item_id)) AS event_at FROM (SELECT *, k * 3 AS points FROM items
  WHERE source = 'hn_algolia' AND ts BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW} AND item_id % 10 <> 3
    AND (key_type = 'github' OR (key_type = 'domain' AND NOT starts_with(entity_key, 'domain:blog.') AND NOT contains(url, '/Blog/'))
    OR item_id % 10 = 7)) GROUP BY entity_key) WHERE p >= 30)"""
_R5 = """r5 AS (SELECT entity_key, 'product_hunt' AS family, 'product_hunt_rank' AS rule, CASE WHEN r <= 5 THEN 'potential' ELSE 'watch' END AS level, CASE
  WHEN d <= w THEN 'daily_rank' ELSE 'weekly_rank' END AS metric_name, CAST(r AS DOUBLE) AS metric, ts AS event_at
  FROM (SELECT *, least(d, w) AS r FROM (SELECT *, 1 + k % 20 AS d, coalesce(CASE WHEN k % 3 = 0 THEN 1 + k % 25 END, 999999) AS w FROM items
  WHERE source = 'product_hunt')) WHERE r <= 10)"""
_R6 = f"""r6 AS (SELECT entity_key, 'huggingface' AS family, 'huggingface_resources_48h' AS rule, CASE WHEN n >= 2
  AND starts_with(entity_key, 'github:') THEN 'potential' ELSE 'watch' END AS level, 'hf_resources_48h' AS metric_name,
  CAST(n AS DOUBLE) AS metric, event_at
  FROM (SELECT entity_key, count(DISTINCT item_id) AS n, min(ts) AS event_at FROM items
  WHERE source = 'huggingface_models' AND ts BETWEEN {_NOW} - INTERVAL 2 DAY AND {_NOW} GROUP BY entity_key))"""
_R7 = f"""r7 AS (SELECT entity_key, 'package_family' AS family, 'npm_registry_daily_downloads' AS rule, level, CASE
  WHEN w > 0 THEN 'daily_downloads_rising_ratio' ELSE 'daily_downloads' END AS metric_name, CAST(CASE
  WHEN w > 0 THEN ratio ELSE d END AS DOUBLE) AS metric, event_at FROM (
  SELECT *, CASE WHEN coalesce(w, 0) <= 0 THEN 'watch' WHEN ratio >= 3 THEN 'high_potential' WHEN ratio >= 2 THEN 'potential'
  WHEN ratio >= 1.3 THEN 'watch' ELSE 'none' END AS level FROM (
    SELECT *, CAST(d AS DOUBLE) / greatest(CAST(w AS DOUBLE) / 7, 100.0) AS ratio FROM (
      SELECT entity_key, k % 3 AS package, max(metric * 20) FILTER (k % 2 = 0) AS d,
      max(metric * 30) FILTER (k % 2 = 1) AS w, max_by(ts, struct_pack(a := metric, b := ts)) FILTER (k % 2 = 0) AS event_at FROM items
      WHERE source = 'npm_registry' AND ts >= {_NOW} - INTERVAL 7 DAY GROUP BY entity_key, k % 3) WHERE d >= 3000)) WHERE level <> 'none')"""
_COLS = "entity_key, family, rule, level, metric_name, metric, event_at"
_ALL = ["r1", "r3", "r4", "r5", "r6", "r7"]
_EVIDENCE = "evidence AS (" + " UNION ALL ".join(f"SELECT {_COLS} FROM {r}" for r in _ALL) + ")"
_R10 = f"""r10 AS (SELECT entity_key, 'verified_cross_source' AS family, 'verified_cross_source_two_weak_48h' AS rule, 'potential' AS level, 'weak_source_families_48h' AS metric_name,
  CAST(n AS DOUBLE) AS metric, {_NOW} AS event_at
  FROM (SELECT entity_key, count(DISTINCT family) AS n FROM evidence
  WHERE level = 'watch' AND event_at BETWEEN {_NOW} - INTERVAL 2 DAY AND {_NOW} AND NOT starts_with(entity_key, 'name:') GROUP BY entity_key)
  WHERE n >= 2)"""
_PROMOTED = """promoted AS (SELECT entity_key, ['none', 'watch', 'potential', 'high_potential'][max(CASE level WHEN 'high_potential' THEN 3 WHEN 'potential' THEN 2
  WHEN 'watch' THEN 1 ELSE 0 END) + 1] AS level,
  array_to_string(list_sort(list(DISTINCT family)), ',') AS families, array_to_string(list_sort(list(DISTINCT rule)), ',') AS reasons,
  min(event_at) AS first_trigger_at FROM (SELECT * FROM evidence UNION ALL SELECT * FROM r10) GROUP BY entity_key)"""
_RULES_SQL = (ITEMS_SQL, _R1, _R3, _R4, _R5, _R6, _R7)


def _rule(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("at", F.col("ts"))
    of = lambda source: i.filter(F.col("source") == source)
    if name == "r1":
        return R.daily_stars(of("github_trending").filter(F.col("ts").between(ago(1), now())).withColumn("stars", F.col("metric")))
    if name == "r3":
        recent = of("github_trending").filter(F.col("ts").between(ago(30), now()))
        agg = recent.groupBy("entity_key").agg(
            F.coalesce(F.sum(F.when(F.col("ts") >= ago(7), F.col("k"))), F.lit(0)).alias("stars_7d"),
            F.sum(F.when(F.col("user_id") % 11 == 0, 0).otherwise(F.col("k"))).alias("stars_30d"), F.max("ts").alias("at")
        )
        return R.star_acceleration(agg)
    if name == "r4":
        stories = of("hn_algolia").select(
            "entity_key", "key_type", "url", "item_id", F.col("item_id").alias("story_id"), (F.col("k") * 3).alias("points"), "at"
        )
        marks = stories.select("item_id")
        kept = R.qualified_stories(stories, marks.filter("item_id % 10 = 3"), marks.filter("item_id % 10 = 7"))
        return R.story_points(kept, ago(7), now())
    if name == "r5":
        return R.launch_rank(
            of("product_hunt").select(
                "entity_key", (1 + F.col("k") % 20).alias("daily_rank"),
                F.when(F.col("k") % 3 == 0, 1 + F.col("k") % 25).alias("weekly_rank"), "at"
            )
        )
    if name == "r6":
        return R.new_resources(
            of("huggingface_models").withColumn("resource_id", F.col("item_id")), ago(2), now(), F.col("entity_key").startswith("github:")
        )
    day = F.col("k") % 2 == 0
    rows = of("npm_registry").filter(F.col("ts") >= ago(7))
    return R.rising_downloads(
        rows.select(
            "entity_key", (F.col("k") % 3).alias("package"), F.when(day, "daily_downloads").otherwise("downloads_7d").alias("metric_name"),
            F.when(day, F.col("metric") * 20).otherwise(F.col("metric") * 30).alias("value"), "at"
        )
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rule(spark, sf_dir, _ALL[0])
    for name in _ALL[1:]:
        out = out.unionByName(_rule(spark, sf_dir, name))
    return out


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promoted(_evidence(spark, sf_dir), ago(2), now())


@query(with_sql(ITEMS_SQL, _R1, then=f"SELECT {_COLS} FROM r1"))
def r1_daily_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r1")


@query(f"""WITH m AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS mon, count(*) AS n FROM lineitem
  GROUP BY ALL), i AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY mon) - 1 AS x FROM m),
s AS (SELECT l_partkey, regr_slope(n, x) / greatest(avg(n), 1.0) AS slope, sum(n) AS total, max(mon) AS event_at FROM i GROUP BY l_partkey HAVING count(*) >= 3)
SELECT 'github:p/' || l_partkey AS entity_key, 'github' AS family, 'trending_repos_direction' AS rule, 'watch' AS level, 'trending_direction_slope' AS metric_name, slope AS metric, event_at
  FROM s WHERE (total * 5 >= 150 OR l_partkey % 100 >= 50) AND slope > 0""")
def r2_rising_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.operators import windows as W

    m = table(spark, sf_dir, "lineitem").groupBy(
        "l_partkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("mon")
    ).agg(F.count(F.lit(1)).alias("n"))
    points = W.ranked(m, "x", ["l_partkey"], [F.col("mon").asc()]).withColumn("x", F.col("x") - 1)
    s = W.slope(points, ["l_partkey"], "x", "n")
    totals = m.groupBy("l_partkey").agg((F.sum("n") * 5).alias("stars_velocity"), F.max("mon").alias("at"))
    rows = s.join(totals, "l_partkey").select(
        F.concat(F.lit("github:p/"), F.col("l_partkey").cast("string")).alias("entity_key"), "stars_velocity",
        (F.col("l_partkey") % 100).alias("forks_velocity"), "slope", "at"
    )
    return R.rising_direction(rows)


@query(with_sql(ITEMS_SQL, _R3, then=f"SELECT {_COLS} FROM r3"))
def r3_star_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r3")


@query(with_sql(ITEMS_SQL, _R4, then=f"SELECT {_COLS} FROM r4"))
def r4_f8_story_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r4")


@query(with_sql(ITEMS_SQL, _R5, then=f"SELECT {_COLS} FROM r5"))
def r5_launch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r5")


@query(with_sql(ITEMS_SQL, _R6, then=f"SELECT {_COLS} FROM r6"))
def r6_a7_new_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r6")


@query(with_sql(ITEMS_SQL, _R7, then=f"SELECT {_COLS} FROM r7"))
def r7_a8_rising_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, "r7")


@query(with_sql(ITEMS_SQL, then="""SELECT entity_key, 'x_social' AS family, 'x_social_tier' AS rule, ['watch', 'potential', 'high_potential'][r] AS level, 'x_tier' AS metric_name,
  CAST(r AS DOUBLE) AS metric, event_at FROM (
  SELECT entity_key, max(r) AS r, max_by(ts, struct_pack(a := r, b := -item_id)) AS event_at
  FROM (SELECT *, CASE k % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS r FROM items) WHERE r IS NOT NULL AND k % 2 = 0 GROUP BY entity_key)"""))
def r8_social_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    tier = F.when(k % 7 == 0, "watch").when(k % 7 == 1, "potential").when(k % 7 == 2, "high").otherwise("none")
    ref = F.when(k % 2 == 0, F.concat(F.lit("tweet:"), F.col("item_id").cast("string"))).otherwise("item:0")
    return R.social_tier(
        items(spark, sf_dir).select("entity_key", "item_id", tier.alias("tier"), ref.alias("ref"), F.col("ts").alias("at"))
    )


@query(f"""WITH s AS (SELECT 'github:p/' || l_partkey AS entity_key, count(*) FILTER (l_shipdate >= TIMESTAMP '2001-06-01') * 100 AS stars_24h,
  count(*) * 40 AS stars_7d FROM lineitem GROUP BY l_partkey),
u AS (SELECT entity_key, 'stars_24h' AS metric_name, stars_24h AS stars FROM s UNION ALL SELECT entity_key, 'stars_7d', stars_7d FROM s)
SELECT entity_key, 'github' AS family, 'github_backfill_' || metric_name AS rule, CASE WHEN stars >= 3000 THEN 'high_potential'
  WHEN stars >= 1000 THEN 'potential' ELSE 'watch' END AS level, metric_name, CAST(stars AS DOUBLE) AS metric, {_NOW} AS event_at FROM u
  WHERE stars >= 300""")
def r9_c11_backfilled_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_shipdate").cast("timestamp_ntz")
    s = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("github:p/"), F.col("l_partkey").cast("string")).alias("entity_key")).agg(
        (F.count_if(at >= F.lit("2001-06-01").cast("timestamp_ntz")) * 100).alias("stars_24h"), (F.count(F.lit(1)) * 40).alias("stars_7d")
    )
    return R.backfilled_stars(s, now())


@query(with_sql(*_RULES_SQL, _EVIDENCE, _R10, then=f"SELECT {_COLS} FROM r10"))
def r10_a10_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cross_source(_evidence(spark, sf_dir), ago(2), now())


@query(with_sql(*_RULES_SQL, _EVIDENCE, _R10, _PROMOTED, then="SELECT * FROM promoted"))
def r11_a11_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _promoted(spark, sf_dir)
    return p.select(
        "entity_key", "level", F.array_join("families", ",").alias("families"), F.array_join("reasons", ",").alias("reasons"),
        "first_trigger_at"
    )


@query(
    with_sql(
        *_RULES_SQL, _EVIDENCE, _R10, _PROMOTED,
        then="""SELECT 'entity:' || substr(sha1(entity_key), 1, 16) AS entity_id, level, families, reasons, CASE
  WHEN level = 'watch' THEN 'edge_watch' ELSE 'candidate' END AS list FROM promoted WHERE level <> 'none'"""
    )
)
def r12_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.functions.scalars import stable_id

    p = _promoted(spark, sf_dir).filter("level != 'none'")
    return p.select(
        stable_id("entity:", F.col("entity_key")).alias("entity_id"), "level", F.array_join("families", ",").alias("families"),
        F.array_join("reasons", ",").alias("reasons"), F.when(F.col("level") == "watch", "edge_watch").otherwise("candidate").alias("list")
    )


@query(with_sql(*_RULES_SQL, _EVIDENCE, _R10, _PROMOTED, """i AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k END AS source_rank, ts - to_days(CAST(k * 2 AS INTEGER)) AS created FROM items),
turn AS (SELECT *, struct_pack(a := source_rank IS NULL, b := coalesce(source_rank, 0), c := item_id) AS turn FROM i),
known AS (SELECT entity_key FROM promoted WHERE level IN ('potential', 'high_potential') UNION SELECT entity_key FROM items
  WHERE source = 'github_trending' AND user_id % 4 = 0),
jobs AS (SELECT entity_key, 'potential_candidate' AS reason, CAST(1000000 + CASE level WHEN 'high_potential' THEN 3 ELSE 2 END AS DOUBLE) AS priority
  FROM promoted WHERE starts_with(entity_key, 'github:') AND level IN ('potential', 'high_potential')
  UNION ALL SELECT entity_key, 'github_search_velocity_prefilter', max_by(speed, turn) FROM (SELECT *, metric * 20 / greatest(date_diff('microsecond', created, """ + _NOW + """) / 1000000.0 / 86400, 1.0) AS speed FROM turn WHERE source = 'hn_algolia' AND key_type = 'github')
    WHERE speed >= 50 AND ts >= """ + _NOW + """ - INTERVAL 14 DAY AND created >= """ + _NOW + """ - INTERVAL 180 DAY AND entity_key NOT IN (SELECT entity_key FROM items WHERE source = 'github_trending' AND user_id % 2 = 0) GROUP BY entity_key
  UNION ALL SELECT entity_key, 'trending_repos_rising_watch', 100000 + CAST(max(metric) AS DOUBLE) FROM items
  WHERE source = 'github_trending' AND key_type = 'github' AND (metric >= 150 OR k >= 50) AND k % 10 > 3 AND entity_key NOT IN (SELECT entity_key
  FROM known) GROUP BY entity_key
  UNION ALL SELECT entity_key, 'package_downloads:pkg' || (k % 7), 500000 + CAST(max_by(metric * 30, turn) AS DOUBLE) FROM turn
  WHERE source = 'npm_registry' AND metric * 30 >= 3000 AND k % 7 > 0 GROUP BY entity_key, k % 7)""",
  then="SELECT * FROM jobs ORDER BY priority DESC, entity_key, reason LIMIT 40"))
def r13_w14_four_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = items(spark, sf_dir).withColumn("source_rank", F.when(F.col("k") % 5 != 0, F.col("k"))), F.col("k")
    of = lambda source: i.filter(F.col("source") == source)
    search = of("hn_algolia").select(
        "entity_key", "item_id", "source_rank", (F.col("metric") * 20).alias("stars"),
        (F.col("ts") - F.make_dt_interval(k.cast("int") * 2)).alias("created"), F.col("ts").alias("pushed")
    )
    trending = of("github_trending").select(
        "entity_key", F.col("metric").alias("stars_velocity"), k.alias("forks_velocity"), (k % 10 - 3).alias("slope")
    )
    package = F.when(k % 7 > 0, F.concat(F.lit(" pkg"), (k % 7).cast("string"))).otherwise(" ")
    packages = of("npm_registry").select(
        "entity_key", "item_id", "source_rank", package.alias("package"), (F.col("metric") * 30).alias("weekly")
    )
    boards = of("github_trending")
    return R.backfill_jobs(
        R.backfill_producers(
            _promoted(spark, sf_dir), search, trending, packages, boards.filter("user_id % 2 = 0"), boards.filter("user_id % 4 = 0"), now()
        )
    )

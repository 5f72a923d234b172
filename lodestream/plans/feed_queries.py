"""Mentions, checks of responses, groups, scores, feed sections, read models and evaluations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import scalars as X
from lodestream.operators import grouping as G
from lodestream.operators import mentions as M
from lodestream.operators import quality as V
from lodestream.operators import scoring as L
from lodestream.operators import snapshots as S
from lodestream.operators import windows as W

from .fixtures import GROUPS_SQL, ITEMS_SQL, groups, items, now, with_sql
from .registry import query, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# --- joins ----------------------------------------------------------------------------------------------------------


@query(with_sql(ITEMS_SQL, then="SELECT c_custkey, c_name, item_id, metric FROM customer JOIN items ON user_id = c_custkey"))
def j2_j4_items_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(items(spark, sf_dir), F.col("c_custkey") == F.col("user_id")).select("c_custkey", "c_name", "item_id", "metric")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id FROM items WHERE item_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND user_id IN (SELECT o_custkey FROM orders
  WHERE o_orderstatus = 'P')"""
    )
)
def j5_j9_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("item_id"))
    marked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    return items(spark, sf_dir).join(noise, "item_id", "left_anti").join(marked, "user_id", "left_semi").select("item_id")


@query("""WITH refs AS (SELECT e.event_id AS owner, r.ref AS ref
  FROM events e, LATERAL (SELECT unnest([e.event_id + 1, e.event_id + 1, e.event_id + 7, e.event_id * 2]) AS ref) AS r),
d AS (SELECT DISTINCT owner, ref FROM refs), j AS (SELECT d.owner, e.event_id AS item_id, e.event_type, row_number() OVER (PARTITION BY d.owner
  ORDER BY e.event_id) AS n FROM d JOIN events e ON e.event_id = d.ref)
SELECT owner, item_id, event_type FROM j WHERE n <= 2""")
def j6_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References name items by a key in them, so a suffix match becomes an equality join."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    i = F.col("event_id")
    refs = e.select(
        i.alias("owner"),
        F.explode(F.array(*[F.concat(F.lit("item:"), x.cast("string")) for x in (i + 1, i + 1, i + 7, i * 2)])).alias("ref")
    )
    wanted = refs.select("owner", F.regexp_extract("ref", "^item:([0-9]+)$", 1).cast("long").alias("item_id")).distinct()
    found = wanted.join(e.select(i.alias("item_id"), "event_type"), "item_id")
    return W.first_per(found, ["owner"], [F.col("item_id").asc()], 2).select("owner", "item_id", "event_type")


_ALIAS_SQL = """aliases AS (SELECT o_custkey AS entity_key, CASE o_orderkey % 4 WHEN 0 THEN 'github:o/' WHEN 1 THEN 'domain:d'
  WHEN 2 THEN 'npm:p' ELSE 'name:n' END || o_orderkey AS alias, CASE
  WHEN o_orderkey % 10 = 0 THEN 'resolver' ELSE 'rule' END AS origin, o_custkey % 3 AS external, o_orderkey % 5 <> 0 AS approved, o_orderkey AS id
  FROM orders)"""


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "github:o/").when(k % 4 == 1, "domain:d").when(k % 4 == 2, "npm:p").otherwise("name:n")
    return o.select(
        F.col("o_custkey").alias("entity_key"), F.concat(kind, k.cast("string")).alias("alias"),
        F.when(k % 10 == 0, "resolver").otherwise("rule").alias("origin"), (F.col("o_custkey") % 3).alias("external"),
        (k % 5 != 0).alias("approved"), k.alias("id")
    )


@query(
    with_sql(
        _ALIAS_SQL,
        then="""SELECT entity_key, alias FROM (SELECT *, row_number() OVER (PARTITION BY entity_key
  ORDER BY CASE WHEN origin = 'resolver' AND external = 1 THEN 0 WHEN origin = 'resolver' THEN 1 WHEN starts_with(alias, 'github:') THEN 2
  WHEN starts_with(alias, 'domain:') THEN 3 ELSE 4 END, id) AS n FROM aliases WHERE approved AND NOT starts_with(alias, 'name:')) WHERE n = 1"""
    )
)
def j7_alias_for_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_alias(_aliases(spark, sf_dir), F.lit(1))


@query(
    with_sql(
        _ALIAS_SQL,
        then="""SELECT entity_key, alias FROM (SELECT *, row_number() OVER (PARTITION BY entity_key
  ORDER BY CASE WHEN starts_with(alias, 'github:') THEN 0 WHEN starts_with(alias, 'npm:') THEN 1 ELSE 2 END, id) AS n FROM aliases
  WHERE approved AND NOT starts_with(alias, 'name:')) WHERE n = 1"""
    )
)
def j7_alias_for_presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_alias(_aliases(spark, sf_dir), F.lit(1), "presentation")


@query("""SELECT c.conv_id, left(max_by(c.text, c.turn), 1000) AS preview FROM conversations c WHERE c.role = 'assistant' GROUP BY c.conv_id""")
def j8_c12_latest_cached_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.substring(F.max_by("text", "turn"), 1, 1000).alias("preview"))


@query(
    with_sql(
        GROUPS_SQL,
        then="""SELECT g.group_id, g.level, CASE WHEN g.group_id % 3 <> 0 AND g.group_id % 2 = 0 THEN 'unchanged'
  WHEN g.group_id % 3 <> 0 THEN 'changed' ELSE 'new' END AS state FROM groups g"""
    )
)
def j10_previous_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).withColumn("h", F.sha2(F.col("canonical_name"), 256))
    before = g.filter("group_id % 3 != 0").select(
        "group_id", F.when(F.col("group_id") % 2 == 0, F.col("h")).otherwise("other").alias("old")
    )
    state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("h"), "unchanged").otherwise("changed")
    return g.join(before, "group_id", "left").select("group_id", "level", state.alias("state"))


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT DISTINCT i.item_id FROM items i WHERE i.entity_key IN (SELECT entity_key FROM items GROUP BY entity_key HAVING max(metric) >= 1000)"""
    )
)
def j11_candidate_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    hot = i.groupBy("entity_key").agg(F.max("metric").alias("m")).filter("m >= 1000")
    return i.join(hot, "entity_key", "left_semi").select("item_id")


@query(
    """SELECT doc_id, CASE WHEN sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0) THEN 'hit' ELSE 'miss' END AS cached FROM documents"""
)
def j12_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = d.filter("doc_id % 4 = 0").select("h", F.lit("hit").alias("cached")).distinct()
    return d.join(cache, "h", "left").select("doc_id", F.coalesce("cached", F.lit("miss")).alias("cached"))


@query("""WITH l AS (SELECT lower(p_type) AS name_key, p_brand AS ref, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS n FROM part
  WHERE p_partkey % 3 = 0)
SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_brand END, l.ref, 'fuzzy:' || lower(p_type)) AS ref FROM part LEFT
  JOIN l ON l.name_key = lower(p_type) AND l.n = 1""")
def j13_linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lower("p_type").alias("name_key"))
    linked = p.filter("p_partkey % 3 = 0")
    first = linked.groupBy("name_key").agg(F.min_by("p_brand", "p_partkey").alias("ref"))
    own = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    return p.join(first, "name_key", "left").select("p_partkey", F.coalesce(own, "ref", F.concat(F.lit("fuzzy:"), "name_key")).alias("ref"))


@query("""WITH a AS (SELECT l_partkey AS key, min(l_shipdate) + INTERVAL 700 DAY AS t0 FROM lineitem
  GROUP BY l_partkey), d AS (SELECT l_partkey AS key, date_diff('day', t0, l_shipdate) AS d FROM lineitem JOIN a ON key = l_partkey)
SELECT key, CASE WHEN d < -30 THEN -365 WHEN d < 0 THEN -30 WHEN d < 30 THEN 0 WHEN d < 90 THEN 30 ELSE 90 END AS bucket, count(*) AS n FROM d
  WHERE d >= -365 AND d <= 365 GROUP BY ALL""")
def j14_relative_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"))  # noqa: E741
    anchors = l.groupBy("key").agg((F.min("at") + F.expr("INTERVAL 700 DAYS")).alias("t0"))
    return G.relative_buckets(anchors, l, [-365, -30, 0, 30, 90, 365])


@query(
    """SELECT lower(event_type) AS handle, min_by(avatar, event_id) AS avatar
  FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'a' || event_id WHEN event_id % 7 = 0 THEN 'b' || event_id END AS avatar FROM events)
  WHERE avatar IS NOT NULL GROUP BY lower(event_type)"""
)
def j16_first_avatar(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    avatar = F.coalesce(
        F.when(i % 5 == 0, F.concat(F.lit("a"), i.cast("string"))), F.when(i % 7 == 0, F.concat(F.lit("b"), i.cast("string")))
    )
    e = table(spark, sf_dir, "events").select(
        F.lower("event_type").alias("handle"), "event_id", avatar.alias("avatar")
    ).filter("avatar is not null")
    return e.groupBy("handle").agg(F.min_by("avatar", "event_id").alias("avatar"))


@query(
    """SELECT owner, array_to_string(list(event_type ORDER BY n), ',') AS types FROM (SELECT e.event_id AS owner, e2.event_type, r.n
  FROM events e, LATERAL (SELECT unnest([e.event_id + 3, e.event_id * 2, e.event_id + 1]) AS ref, unnest([1, 2, 3]) AS n) AS r
  JOIN events e2 ON e2.event_id = r.ref) GROUP BY owner"""
)
def j17_rows_for_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id")
    refs = e.select(i.alias("owner"), F.posexplode(F.array(i + 3, i * 2, i + 1)).alias("n", "ref"))
    found = refs.join(e, F.col("ref") == i)
    return found.groupBy("owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_type"))), lambda r: r["event_type"]), ",").alias("types")
    )


# --- mentions and checks --------------------------------------------------------------------------------------------


@query(with_sql(ITEMS_SQL, then=f"""SELECT window_name, project, count(*) AS tweet_count, CAST(sum(metric) AS BIGINT) AS engagement_sum, CAST(sum(k) AS BIGINT) AS view_sum,
  count(DISTINCT source) AS n_accounts, array_to_string(list(item_id ORDER BY item_id)[1:5], ',') AS sample FROM (
  SELECT i.*, unnest(['p' || (k % 10), 'q' || (user_id % 5)]) AS project FROM items i) j, (VALUES ('24h', 24.0), ('7d', 168.0)) v(window_name, h)
  WHERE greatest(epoch({_NOW}) - epoch(ts), 0) / 3600.0 <= h GROUP BY window_name, project"""))
def a2_mention_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.filter(W.age_windows(F.col("ts"), now()), lambda w: w.isin("24h", "7d"))
    posts = items(spark, sf_dir).select(
        F.col("item_id").alias("post_id"), F.col("source").alias("author"), F.col("metric").alias("engagement"), F.col("k").alias("views"),
        age.alias("windows"),
        F.array(
            F.concat(F.lit("p"), (F.col("k") % 10).cast("string")), F.concat(F.lit("q"), (F.col("user_id") % 5).cast("string"))
        ).alias("projects"),
        F.col("item_id").alias("ord")
    )
    out = M.mention_buckets(posts)
    return out.select(
        "window_name", "project", "tweet_count", "engagement_sum", "view_sum", "n_accounts",
        F.array_join(F.transform("sample", lambda s: s.cast("string")), ",").alias("sample")
    )


_A3 = f"""wins AS (SELECT entity_key, window_name, count(DISTINCT source) AS distinct_authors, count(DISTINCT CASE
  WHEN source IN ('hn_algolia', 'product_hunt') THEN source END) AS credible_authors, count(*) AS mention_count
  FROM items, (VALUES ('24h', 1), ('7d', 7)) v(window_name, d) WHERE ts >= {_NOW} - to_days(CAST(d AS INTEGER)) GROUP BY entity_key, window_name)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("entity_key", F.col("source").alias("author"), F.col("ts").alias("at"))
    return M.entity_windows(i, now(), F.col("author").isin("hn_algolia", "product_hunt"))


@query(with_sql(ITEMS_SQL, _A3, then="SELECT * FROM wins"))
def a3_mention_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir)


@query(
    with_sql(
        ITEMS_SQL, _A3,
        then="""SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY window_name DESC) AS n FROM wins) WHERE n = 1
  ORDER BY credible_authors DESC, mention_count DESC, distinct_authors DESC, window_name = '24h' DESC, entity_key DESC LIMIT 25"""
    )
)
def a4_chosen_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.chosen_windows(_windows(spark, sf_dir), 25)


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT unit_key, min(item_id) AS item_id, max(metric) AS best_score, max(k) AS best_comments, count(*) AS row_count, max(CASE WHEN k > 90 THEN 2
  WHEN k > 70 THEN 1 ELSE 0 END) AS impact, 4 AS likeness FROM (SELECT *, 'url:' || regexp_replace(url, '/[0-9]+$', '') AS unit_key FROM items)
  GROUP BY unit_key ORDER BY best_score DESC, impact DESC, likeness DESC, best_comments DESC, row_count DESC, unit_key DESC LIMIT 30"""
    )
)
def a5_c1_story_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = items(spark, sf_dir).select(
        F.concat(F.lit("url:"), F.regexp_replace("url", "/[0-9]+$", "")).alias("unit_key"), "item_id", F.col("metric").alias("score"),
        k.alias("comments"), F.lit("a title").alias("title"), "url", F.when(k > 90, 2).when(k > 70, 1).otherwise(0).alias("impact")
    )
    return M.story_units(rows, 30).select("unit_key", "item_id", "best_score", "best_comments", "row_count", "impact", "likeness")


@query(
    """SELECT event_id, CAST(floor((n - 1) / 40) AS BIGINT) AS batch FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type
  ORDER BY ts DESC, event_id) AS n FROM events)"""
)
def c2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.batches(
        table(spark, sf_dir, "events"), [F.desc("ts"), F.col("event_id").asc()], 40, ["event_type"]
    ).select("event_id", "batch")


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'missing field' WHEN event_id % 5 = 0 THEN 'projectness'
  WHEN event_id % 100 >= 90 THEN 'confidence' END AS error, CASE WHEN event_id % 6 <> 0 THEN CASE
  WHEN event_id % 2 = 0 THEN 2 ELSE 1 END END AS kept_links FROM events"""
)
def c3_response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    s = lambda x: x.cast("string")
    links = F.concat(
        F.lit('"links":[{"type":"github","url":"https://github.com/a/b"},{"type":"odd","url":"x"}'),
        F.when(i % 2 == 0, ',{"type":"npm","url":"u"}').otherwise(""), F.lit("]")
    )
    name = F.when(i % 6 == 0, "").otherwise(',"canonical_name":"n","summary":"s"')
    payload = F.concat(
        F.lit('{"item_id":'), s(i), F.lit(',"projectness":"'), F.when(i % 5 == 0, "odd").otherwise("project"), F.lit('","confidence":'),
        F.when(i % 100 >= 90, "1.5").otherwise("0.5"), name, F.lit(","), links, F.lit("}")
    )
    out = M.checked_responses(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")))
    return out.select("event_id", "error", F.when(i % 6 != 0, F.col("kept_links")).alias("kept_links"))


@query("""SELECT o_orderkey, CASE WHEN tier = 'none' OR o_orderkey % 5 = 0 THEN 'none' WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 3 = 0
  AND tier IN ('potential', 'high') THEN 'watch' WHEN tier = 'high' AND o_custkey % 6 < 3 AND o_custkey % 4 < 3
  AND o_orderkey % 13 <> 0 THEN 'potential' ELSE tier END AS accepted
FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'watch' WHEN 2 THEN 'potential' ELSE 'high' END AS tier FROM orders)""")
def c4_accepted_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tier = F.when(k % 4 == 0, "none").when(k % 4 == 1, "watch").when(k % 4 == 2, "potential").otherwise("high")
    key = F.when(k % 11 == 0, "term:AI").otherwise("github:a/b")
    out = M.accepted_tier(
        tier, key, F.when(k % 3 == 0, "fuzzy_name").otherwise("linked"), F.when(k % 5 == 0, 0).otherwise(2), c % 6, c % 4, k % 13 == 0,
        ("ai", "agent")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", out.alias("accepted"))


@query(
    """SELECT event_id, m AS metric_name, v AS metric_value FROM (SELECT event_id, unnest(['x_tier', 'x_engagement', 'x_views']) AS m, unnest([event_type,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), CAST(user_id AS VARCHAR)]) AS v FROM events)"""
)
def c5_c6_c10_unpivoted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("x_tier"), F.floor("value").cast("string").alias("x_engagement"),
        F.col("user_id").cast("string").alias("x_views")
    )
    return e.unpivot(["event_id"], ["x_tier", "x_engagement", "x_views"], "metric_name", "metric_value")


@query("""SELECT p_partkey, starts_with(p_name || '', 'zzz') OR lower(regexp_extract(key, '[^/:]+$', 0)) = slug OR (starts_with(key, 'domain:')
  AND string_split(regexp_replace(key, '^[a-z]+:', ''), '.')[1] = slug) AS exact FROM (
  SELECT p_partkey, p_name, 'brand-' || (p_size % 5) AS slug, CASE p_partkey % 3 WHEN 0 THEN 'github:org/brand-' || (p_partkey % 5)
  WHEN 1 THEN 'npm:@s/brand-' || (p_partkey % 5) ELSE 'domain:brand-' || (p_partkey % 5) || '.dev' END AS key FROM part)""")
def c8_c9_exact_name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n = (k % 5).cast("string")
    key = F.when(
        k % 3 == 0, F.concat(F.lit("github:org/brand-"), n)
    ).when(k % 3 == 1, F.concat(F.lit("npm:@s/brand-"), n)).otherwise(F.concat(F.lit("domain:brand-"), n, F.lit(".dev")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", M.exact_name_link(F.concat(F.lit("name:brand-"), (F.col("p_size") % 5).cast("string")), key).alias("exact")
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, CASE WHEN k % 3 = 0 THEN CASE WHEN length('tool-' || k) >= 6 THEN 'term:tool-' || k ELSE 'term:Tool ' || k END
  WHEN k % 3 = 1 THEN 'name:my-project-' || k ELSE entity_key END AS key FROM items"""
    )
)
def c7_canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    raw = F.when(F.col("k") % 3 == 0, F.concat(F.lit("term:Tool "), k)).when(
        F.col("k") % 3 == 1, F.concat(F.lit("name:My Project "), k)
    ).otherwise(F.col("entity_key"))
    return items(spark, sf_dir).select("item_id", F.when(F.col("k") % 3 == 2, raw).otherwise(X.canonical_entity_key(raw)).alias("key"))


# --- groups ---------------------------------------------------------------------------------------------------------

_G1_SQL = """src AS (SELECT 'e' || c_custkey AS entity_key, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'potential' ELSE 'watch' END AS level,
  CASE c_custkey % 3 WHEN 0 THEN 2 ELSE 1 END AS level_rank,
  CASE c_custkey % 5 WHEN 0 THEN 'github:o/r' || (c_custkey // 20) WHEN 1 THEN 'domain:medium.com'
  WHEN 2 THEN 'domain:s' || (c_custkey // 10) || '.dev' ELSE 'name:n' || c_custkey END AS canonical_key,
  CASE WHEN c_custkey % 7 = 0 THEN 'github:o/r' || (c_custkey // 20) END AS alias, CASE
  WHEN c_custkey % 11 = 0 THEN 'github:src/' || (c_custkey // 50) END AS source_key, c_mktsegment AS family FROM customer),
keyed AS (SELECT *, coalesce(alias, CASE WHEN starts_with(canonical_key, 'github:') OR (starts_with(canonical_key, 'domain:')
  AND canonical_key <> 'domain:medium.com') THEN canonical_key END, source_key, 'entity:' || entity_key) AS presentation_key FROM src),
g AS (SELECT presentation_key, min_by(entity_key, struct_pack(a := -level_rank, b := lower(name), c := entity_key)) AS canonical_entity, min_by(level, struct_pack(a := -level_rank, b := lower(name), c := entity_key)) AS level, list_sort(list(DISTINCT entity_key)) AS ents, list_sort(list(DISTINCT family)) AS fams
  FROM keyed GROUP BY presentation_key),
m AS (SELECT *, list_concat([canonical_entity], list_filter(ents, lambda e: e <> canonical_entity)) AS members FROM g)"""


@query(
    with_sql(
        _G1_SQL,
        then="""SELECT presentation_key, 'group:' || substr(sha1(array_to_string(members, '|')), 1, 12) AS group_id, canonical_entity, level, array_to_string(members, ',') AS members, array_to_string(fams, ',') AS families
  FROM m"""
    )
)
def g1_g2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    s = lambda x: x.cast("long").cast("string")
    repo = F.concat(F.lit("github:o/r"), s(F.floor(c / 20)))
    key = F.when(c % 5 == 0, repo).when(c % 5 == 1, "domain:medium.com").when(
        c % 5 == 2, F.concat(F.lit("domain:s"), s(F.floor(c / 10)), F.lit(".dev"))
    ).otherwise(F.concat(F.lit("name:n"), s(c)))
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("e"), s(c)).alias("entity_key"), F.col("c_name").alias("name"), F.when(c % 3 == 0, "potential").otherwise("watch").alias("level"), F.when(c % 3 == 0, 2).otherwise(1).alias("level_rank"),
        key.alias("canonical_key"), F.when(c % 7 == 0, repo).alias("alias"), F.when(c % 11 == 0, F.concat(F.lit("github:src/"), s(F.floor(c / 50)))).alias("source_key"), F.col("c_mktsegment").alias("family"),
    )
    return G.groups(rows).select(
        "presentation_key", "group_id", "canonical_entity", "level", F.array_join("members", ",").alias("members"),
        F.array_join("families", ",").alias("families")
    )


def _bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.col("family"), F.lit(": m "), F.floor(F.col("metric") / 100).cast("string"))
    strength = F.when(F.col("k") % 2 == 0, "strong").otherwise("weak")
    return items(spark, sf_dir).select(
        "entity_key", label.alias("label"), "family", F.lit("rule").alias("origin"), F.lit("rule").alias("badge"),
        F.col("item_id").alias("id"), strength.alias("strength"), (F.col("k") % 7).alias("ref"),
    )


@query(with_sql(ITEMS_SQL, then="""SELECT entity_key, family || ': m ' || (metric // 100) AS label, min_by(CASE WHEN k % 2 = 0 THEN 'strong' ELSE 'weak' END, item_id) AS strength,
  count(DISTINCT k % 7) AS refs FROM items GROUP BY entity_key, family || ': m ' || (metric // 100)"""))
def a12_g3_merged_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merged_bullets(_bullets(spark, sf_dir)).select("entity_key", "label", "strength", "refs")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT entity_key, family || ': m ' || (metric // 100) AS label, k % 7 AS ref, min(item_id) AS id FROM items GROUP BY ALL"""
    )
)
def a12_bullet_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refs of the merged bullets, a row each."""
    return G.bullet_refs(_bullets(spark, sf_dir)).select("entity_key", "label", "ref", "id")


_HASH = "printf('%08x', CAST(sum(CAST('0x' || substr(h, {0}, 8) AS BIGINT)) % 4294967296 AS BIGINT))"


@query(
    with_sql(
        ITEMS_SQL,
        then="SELECT entity_key, " + " || ".join(
            _HASH.format(i) for i in range(1, 65, 8)
        ) + """ || '-' || count(*) AS evidence_hash FROM (SELECT entity_key, sha256(item_id || '|' || source || '|' || metric) AS h FROM items) GROUP BY entity_key"""
    )
)
def g4_evidence_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.evidence_hash(items(spark, sf_dir), "entity_key", ["item_id", "source", "metric"])


# --- scores and feed ------------------------------------------------------------------------------------------------

_L2 = """scored AS (SELECT *, CASE WHEN object_type IN ('news', 'article') AND NOT is_product_or_repo THEN least(s2, 55.0) ELSE s2 END AS score FROM (
  SELECT *, CASE WHEN greatest(workflow_shift, technical_substance, product_market_fit) < 70 THEN least(s1, 69.0) ELSE s1 END AS s2 FROM (
    SELECT *, round(greatest(0.0, least(100.0, 0.25 * least(workflow_shift, 100) + 0.25 * least(technical_substance, 100) + 0.20 * least(product_market_fit, 100) + 0.15 * least(momentum, 100) + 0.15 * least(confidence, 100) - (least(risk_penalty, 25) + least(derivative_news_penalty, 25)))), 2) AS s1
    FROM groups)))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).withColumn("score", L.investigator_score(F.col("object_type"), F.col("is_product_or_repo")))


@query(
    with_sql(
        GROUPS_SQL, _L2,
        then="""SELECT group_id, score, round(greatest(0.0, least(100.0, 0.25 * momentum + 0.25 * workflow_shift + 0.20 * technical_substance + 0.15 * product_market_fit + 0.15 * confidence - derivative_news_penalty)), 2) AS legacy
  FROM scored"""
    )
)
def l2_l3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("group_id", "score", L.legacy_score().alias("legacy"))


@query(
    with_sql(
        GROUPS_SQL,
        then="""SELECT group_id, ok AND strong > 0 AS included, CASE
  WHEN NOT ok THEN CAST(0 AS DOUBLE) ELSE CAST([0.35, 0.75, 0.85, 0.95][strong + 1] AS DOUBLE) END AS scout_score
  FROM (SELECT group_id, is_product_or_repo AND object_type NOT IN ('article', 'news') AS ok,
  CAST(workflow_shift >= 70 AS INT) + CAST(technical_substance >= 70 AS INT) + CAST(product_market_fit >= 70 AS INT) AS strong FROM groups)"""
    )
)
def l4_scout_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [F.when(F.col(a) >= 70, "strong").otherwise("weak") for a in L.NOVELTY]
    included, score = L.scout_decision(F.col("is_product_or_repo"), F.col("object_type"), axes)
    return groups(spark, sf_dir).select("group_id", included.alias("included"), score.alias("scout_score"))


_FEED = """elig AS (SELECT *, row_number() OVER (ORDER BY score DESC, level_rank DESC, group_id) AS n FROM scored
  WHERE score >= 70 AND is_product_or_repo AND object_type NOT IN ('article', 'news') AND should_print AND NOT failed AND group_id % 50 <> 0),
brief AS (SELECT * FROM elig WHERE n <= 8 OR (n <= 10 AND score = (SELECT score FROM elig WHERE n = 8))),
routed AS (SELECT s.*, b.n AS brief_rank, CASE WHEN s.failed THEN 'candidate_error' WHEN NOT (s.should_print AND s.is_product_or_repo
  AND s.object_type NOT IN ('article', 'news')) THEN 'suppress_or_low' WHEN b.n IS NOT NULL THEN 'score_plus_deepdive'
  WHEN s.score >= 50 THEN 'score_only' ELSE 'suppress_or_low' END AS route FROM scored s LEFT JOIN brief b USING (group_id)),
feed AS (SELECT group_id, section, route, row_number() OVER (PARTITION BY section
  ORDER BY coalesce(brief_rank, 0), CASE WHEN route = 'score_only' THEN 0 ELSE 1 END, score DESC, group_id) AS place
  FROM (SELECT *, CASE route WHEN 'candidate_error' THEN 'diagnostics' WHEN 'score_plus_deepdive' THEN 'today_focus' ELSE 'scored' END AS section
  FROM routed))"""


@query(with_sql(GROUPS_SQL, _L2, _FEED, then="SELECT group_id, n AS brief_rank FROM brief"))
def w11_brief_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.selected_for_brief(_scored(spark, sf_dir).filter("group_id % 50 != 0")).select("group_id", "brief_rank")


@query(with_sql(GROUPS_SQL, _L2, _FEED, then="SELECT group_id, section, place, route FROM feed"))
def l6_l7_w12_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.feed(_scored(spark, sf_dir), F.col("group_id") % 50 == 0)


@query(with_sql(GROUPS_SQL, _L2, _FEED, then="SELECT route, count(*) AS n FROM feed GROUP BY route"))
def a14_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.routed(_scored(spark, sf_dir), F.col("group_id") % 50 == 0).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_sql(
        GROUPS_SQL, _L2,
        then="SELECT group_id FROM scored WHERE score >= 60 ORDER BY score DESC, level_rank DESC, lower(canonical_name) LIMIT 15"
    )
)
def w18_legacy_deepdives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter("score >= 60").orderBy(
        F.desc("score"), F.desc("level_rank"), F.lower("canonical_name")
    ).limit(15).select("group_id")


@query(with_sql(GROUPS_SQL, then="""SELECT group_id, CASE WHEN same THEN 'skipped' WHEN n > CASE WHEN level = 'edge_watch' THEN 50 ELSE 100 END THEN 'pending'
  WHEN level = 'edge_watch' THEN 'scout' ELSE 'score_now' END AS lane FROM (
  SELECT *, row_number() OVER (PARTITION BY same, level = 'edge_watch' ORDER BY level_rank DESC, lower(canonical_name), group_id) AS n
  FROM (SELECT *, group_id % 6 = 0 AS same FROM groups))"""))
def w10_w13_g5_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).withColumn("evidence_hash", F.sha2("canonical_name", 256))
    before = g.filter("group_id % 2 = 0").select(
        "group_id", F.when(F.col("group_id") % 3 == 0, F.col("evidence_hash")).otherwise("old").alias("evidence_hash")
    )
    return L.scheduled(g, before, 100, 50)


@query(
    """SELECT doc_id AS claim_id, CASE WHEN doc_id % 7 = 0 THEN 'missing text' WHEN doc_id % 5 = 0 THEN 'no evidence'
  WHEN doc_id % 3 = 0 THEN 'unknown evidence' WHEN doc_id % 11 = 0 THEN 'unknown axis' WHEN doc_id % 13 = 0 THEN 'claim type' END AS error
  FROM documents"""
)
def l5_claim_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    refs = F.when(d % 5 == 0, F.array().cast("array<string>")).when(d % 3 == 0, F.array(F.lit("doc:none"))).otherwise(
        F.array(F.concat(F.lit("doc:"), d.cast("string")))
    )
    docs = table(spark, sf_dir, "documents")
    claims = docs.select(
        d.alias("claim_id"), F.when(d % 7 == 0, " ").otherwise("a claim").alias("claim"), refs.alias("evidence_refs"),
        F.when(d % 11 == 0, F.array(F.lit("odd"))).otherwise(F.array(F.lit("momentum"))).alias("supports_axes"),
        F.when(d % 13 == 0, "guess").otherwise("observed").alias("claim_type")
    )
    return L.checked_claims(claims, docs.select(F.concat(F.lit("doc:"), d.cast("string")).alias("ref")), ("momentum", "workflow_shift"))


@query(with_sql(ITEMS_SQL, then="""SELECT entity_key, CASE WHEN resolved THEN 'strong' ELSE 'medium' END AS identity, CASE WHEN rich THEN 'strong'
  WHEN ctx > 0 THEN 'medium' ELSE 'weak' END AS workflow_shift, CASE WHEN rich THEN 'strong'
  WHEN repo THEN 'medium' ELSE 'weak' END AS technical_substance, CASE WHEN fam >= 3 THEN 'strong' ELSE 'medium' END AS momentum, CASE WHEN resolved
  AND rich AND n >= 2 AND n % 3 > 0 THEN 'score_from_context' ELSE 'investigate' END AS mode
FROM (SELECT entity_key, starts_with(entity_key, 'github:') AS repo, NOT starts_with(entity_key, 'name:') AS resolved, starts_with(entity_key, 'github:')
  AND max(metric) >= 180 AS rich, max(k) AS ctx, count(DISTINCT family) AS fam, count(*) AS n FROM items GROUP BY entity_key)"""))
def l1_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).groupBy("entity_key").agg(
        F.max("metric").alias("readme"), F.max("k").alias("ctx"), F.count_distinct("family").alias("fam"), F.count(F.lit(1)).alias("n")
    )
    known = L.preflight(F.col("readme"), F.col("ctx"), F.col("n"), F.col("fam"), F.col("entity_key"), open_matters=F.col("n") % 3 == 0)
    return e.select("entity_key", *[known[c].alias(c) for c in ("identity", "workflow_shift", "technical_substance", "momentum", "mode")])


@query(
    """SELECT conv_id, array_to_string(list(left(trim(text), 40) ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn)[1:3], '|') AS facts
  FROM conversations WHERE trim(text) <> '' GROUP BY conv_id"""
)
def l8_l9_fact_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("trim(text) != ''")
    first = F.when(F.col("role") == "user", 0).otherwise(1)
    top = W.first_per(c.withColumn("a", first), ["conv_id"], [F.col("a").asc(), F.col("turn").asc()], 3)
    fact = F.struct("a", "turn", F.substring(F.trim("text"), 1, 40).alias("t"))
    return top.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(fact)), lambda f: f["t"]), "|").alias("facts"))


@query(
    """SELECT conv_id, CAST(sum(CASE WHEN role = 'system' THEN e ELSE 0 END) AS BIGINT) AS fixed, CAST(sum(e) AS BIGINT) AS total, sum(e) <= 28500 AS fits
  FROM (SELECT conv_id, role, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS e FROM conversations) GROUP BY conv_id"""
)
def l10_context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.token_estimate(F.col("text"))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "system", e).otherwise(0)).alias("fixed"), F.sum(e).alias("total")
    )
    return c.withColumn("fits", F.col("total") <= 32_000 - 3_000 - 500)


# --- read models and evaluations ------------------------------------------------------------------------------------


@query(
    with_sql(
        GROUPS_SQL, _L2, _FEED,
        then="""SELECT f.group_id, f.section, f.place, s.canonical_name, s.score, o.vote FROM feed f JOIN scored s USING (group_id) LEFT
  JOIN (SELECT o_custkey AS group_id, max_by(CASE o_orderkey % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'clear' END, o_orderkey) AS vote FROM orders
  GROUP BY o_custkey) o ON o.group_id = f.group_id AND o.vote <> 'clear'"""
    )
)
def j3_q1_q5_feed_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed rows with score and the reader's last vote; a cleared vote is none."""
    scored, k = _scored(spark, sf_dir), F.col("o_orderkey")
    vote = F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").otherwise("clear")
    votes = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("group_id")
    ).agg(F.max_by(vote, k).alias("vote")).filter("vote != 'clear'")
    feed = L.feed(scored, F.col("group_id") % 50 == 0)
    return feed.join(scored.select("group_id", "canonical_name", "score"), "group_id").join(votes, "group_id", "left").select(
        "group_id", "section", "place", "canonical_name", "score", "vote"
    )


@query(
    with_sql(
        GROUPS_SQL,
        then="""SELECT group_id, row_number() OVER (PARTITION BY segment ORDER BY CASE level WHEN 'high_potential' THEN 0
  WHEN 'potential' THEN 1 ELSE 2 END, lower(canonical_name)) AS place, n_name AS nation FROM groups JOIN nation ON n_nationkey = c_nationkey"""
    )
)
def q2_candidate_read_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir).join(  # a fixed list of nations
        F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))),
        "c_nationkey"
    )
    return W.spread_ranked(g, "place", ["segment"], [F.desc("level_rank"), F.lower("canonical_name")]).select("group_id", "place", "nation")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, entity_key, row_number() OVER (PARTITION BY entity_key ORDER BY ts DESC, item_id DESC) AS place FROM items
  WHERE entity_key IN (SELECT entity_key FROM items WHERE metric > 1000)"""
    )
)
def q3_evidence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    wanted = i.filter("metric > 1000").select("entity_key").distinct()
    return W.spread_ranked(
        i.join(wanted, "entity_key", "left_semi"), "place", ["entity_key"], [F.desc("ts"), F.desc("item_id")]
    ).select("item_id", "entity_key", "place")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT source AS channel, count(*) AS n, max(metric) AS top, count(DISTINCT entity_key) AS entities FROM items WHERE source <> 'huggingface_models'
  GROUP BY source"""
    )
)
def q4_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("channel", F.col("source")).filter("channel != 'huggingface_models'")
    return i.groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.max("metric").alias("top"), F.count_distinct("entity_key").alias("entities")
    )


@query(with_sql(ITEMS_SQL, then="SELECT family, count(DISTINCT entity_key) AS n FROM items GROUP BY family"))
def a15_source_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).groupBy("entity_key").agg(F.collect_set("family").alias("families"))
    return e.select(F.explode("families").alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT DISTINCT source, CASE source WHEN 'hn_algolia' THEN 'hn_search' ELSE source END AS channel, CASE source WHEN 'hn_algolia' THEN 'HN Search'
  WHEN 'github_trending' THEN 'GitHub Trending' WHEN 'product_hunt' THEN 'Product Hunt'
  WHEN 'huggingface_models' THEN 'HF Models' ELSE source END AS label FROM items"""
    )
)
def s16_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.channel(F.col("source"))
    return items(spark, sf_dir).select("source", c.alias("channel"), S.channel_label(c).alias("label")).distinct()


_EVAL = """cases AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.quality = 1 THEN 'project' ELSE 'other' END AS expected,
  CAST(d.n_chars % 101 AS DOUBLE) AS score, d.n_chars >= 500 AS printed, CASE l.quality WHEN 1 THEN CASE
  WHEN l.toxic = 1 THEN 'medium' ELSE 'high' END ELSE 'low' END AS expected_band FROM documents d JOIN labels l USING (doc_id))"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        "doc_id", "lang", "quality", F.when(F.col("quality") == 1, "project").otherwise("other").alias("expected"),
        (F.col("n_chars") % 101).cast("double").alias("score"), (F.col("n_chars") >= 500).alias("printed"),
        F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "medium").otherwise("high").alias("expected_band")
    )


@query(
    with_sql(
        _EVAL,
        then="""SELECT expected_band, count(*) AS total, count(*) FILTER (NOT ((expected_band = 'high' AND score >= 70 AND printed) OR (expected_band = 'medium'
  AND score >= 60 AND score < 75 AND printed) OR (expected_band = 'low' AND score < 60 AND NOT printed))) AS mismatches,
  count(*) FILTER (score >= 70) AS high, count(*) FILTER (score >= 60 AND score < 70) AS medium FROM cases GROUP BY expected_band"""
    )
)
def v1_scoring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, got = V.band_matches(F.col("expected_band"), F.col("score"), F.col("printed")), V.band(F.col("score"))
    return _cases(spark, sf_dir).groupBy("expected_band").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("mismatches"), F.count_if(got == "high").alias("high"),
        F.count_if(got == "medium").alias("medium")
    )


@query(
    with_sql(
        _EVAL,
        then="""SELECT doc_id, array_to_string(list_filter([CASE WHEN (quality = 1) <> printed THEN 'printed' END, CASE WHEN expected = 'project'
  AND score < 50 THEN 'score' END], lambda x: x IS NOT NULL), ',') AS failures FROM cases"""
    )
)
def v2_expected_against_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.array_compact(
        F.array(
            F.when((F.col("quality") == 1) != F.col("printed"), "printed"),
            F.when((F.col("expected") == "project") & (F.col("score") < 50), "score")
        )
    )
    return _cases(spark, sf_dir).select("doc_id", F.array_join(wrong, ",").alias("failures"))


@query(
    with_sql(
        _EVAL,
        then="""SELECT lang, count(*) AS total, count(*) FILTER (expected = 'project') AS project_cases,
  coalesce(avg(score) FILTER (expected = 'project'), 0) AS mean_project, coalesce(avg(score) FILTER (expected <> 'project'), 0) AS mean_other,
  coalesce(max(score) FILTER (expected = 'project') - coalesce(max(score) FILTER (expected <> 'project'), 0), 0) AS margin,
  coalesce(max(score) FILTER (expected = 'project') - coalesce(max(score) FILTER (expected <> 'project'), 0), 0) > 0 AS ok FROM cases GROUP BY lang"""
    )
)
def v3_project_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.project_margin(_cases(spark, sf_dir), ["lang"])


@query(
    with_sql(
        _EVAL,
        then="""SELECT count(*) FILTER (quality = 1 AND printed) AS tp, count(*) FILTER (quality = 0 AND printed) AS fp, count(*) FILTER (quality = 1
  AND NOT printed) AS fn, count(*) FILTER (quality = 0 AND NOT printed) AS tn FROM cases"""
    )
)
def v4_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("quality") == 1, F.col("printed")
    return _cases(spark, sf_dir).agg(
        F.count_if(q & p).alias("tp"), F.count_if(~q & p).alias("fp"), F.count_if(q & ~p).alias("fn"), F.count_if(~q & ~p).alias("tn")
    )


@query("SELECT DISTINCT role || '-' || (turn % 3) AS stage FROM conversations WHERE conv_id % 2 = 0")
def v5_completed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log is JSON lines; only stages that ended with return code 0 count."""
    c = table(spark, sf_dir, "conversations")
    line = F.to_json(
        F.struct(F.concat_ws("-", "role", (F.col("turn") % 3).cast("string")).alias("stage"), (F.col("conv_id") % 2).alias("returncode"))
    )
    log = c.select(F.from_json(line, "stage string, returncode int").alias("l"))
    return log.filter("l.returncode = 0").select("l.stage").distinct()


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (text IS NULL OR lang IS NULL) AS incomplete FROM documents GROUP BY source HAVING count(*) > 1"""
)
def v6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull() | F.col("lang").isNull()).alias("incomplete")
    )
    return d.filter("n > 1")

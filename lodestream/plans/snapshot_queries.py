"""Scans, sinks, rankings, set operations and plain aggregations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import snapshots as S
from lodestream.operators import windows as W

from .fixtures import GROUPS_SQL, ITEMS_SQL, SNAPSHOTS_SQL, groups, items, snap_items, snapshots, with_sql
from .registry import query, table



def _rank_order():
    return [F.col("source_rank").asc_nulls_last(), F.col("item_id").asc()]


_LATEST_OK = "latest AS (SELECT source, max(month) AS month FROM snapshots WHERE status = 'ok' GROUP BY source)"


@query(with_sql(SNAPSHOTS_SQL, _LATEST_OK, then="SELECT item_id, source, source_rank FROM snap_items JOIN latest USING (source, month)"))
def f1_latest_ok_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_items(snap_items(spark, sf_dir), snapshots(spark, sf_dir)).select("item_id", "source", "source_rank")


@query(
    with_sql(
        SNAPSHOTS_SQL, "latest AS (SELECT source, max(month) AS month FROM snapshots GROUP BY source)",
        then="SELECT item_id, source FROM snap_items JOIN latest USING (source, month)"
    )
)
def f2_latest_items_any_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_items(snap_items(spark, sf_dir), snapshots(spark, sf_dir), ok_only=False).select("item_id", "source")


@query(
    with_sql(
        SNAPSHOTS_SQL,
        then="""SELECT source, max_by(status, month) AS status, max(month) AS month FROM snapshots WHERE source <> '5-LOW' GROUP BY source"""
    )
)
def f3_latest_status_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).filter("source != '5-LOW'").groupBy("source").agg(
        F.max_by("status", "month").alias("status"), F.max("month").alias("month")
    )


@query(with_sql(SNAPSHOTS_SQL, then="SELECT source, month FROM snapshots WHERE status = 'ok' ORDER BY month DESC, source LIMIT 1"))
def f4_latest_successful_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots(spark, sf_dir).filter("status = 'ok'").orderBy(F.desc("month"), "source").limit(1).select("source", "month")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', text, source, lang)), 'apache license')")
def f9_free_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(
        F.lower(F.concat_ws(" ", "text", "source", "lang")).contains("apache license")
    ).select("doc_id", "source")


@query(
    with_sql(
        ITEMS_SQL, then="SELECT item_id, metric FROM items WHERE coalesce(TRY_CAST(k AS DOUBLE), 0) > 0 AND source = 'github_trending'"
    )
)
def f10_metric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(
        (F.coalesce(F.col("k").cast("double"), F.lit(0)) > 0) & (F.col("source") == "github_trending")
    ).select("item_id", "metric")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT entity_key FROM items GROUP BY entity_key HAVING bool_or(family IN ('hn', 'huggingface')) AND max(metric) >= 300"""
    )
)
def f11_level_and_family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).groupBy("entity_key").agg(F.collect_set("family").alias("families"), F.max("metric").alias("m"))
    return e.filter(F.arrays_overlap("families", F.array(F.lit("hn"), F.lit("huggingface"))) & (F.col("m") >= 300)).select("entity_key")


@query(
    """SELECT part_name, p_partkey FROM (SELECT n.n_name AS part_name, p.p_partkey, row_number() OVER (PARTITION BY n.n_name ORDER BY p.p_partkey DESC) AS r
  FROM nation n JOIN part p ON contains(p.p_brand || ' ' || p.p_type, '#' || (n.n_nationkey % 5 + 1))) WHERE r <= 20"""
)
def f12_fuzzy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup list is a fixed dimension (a few dozen names), so it is the broadcast side of the containment join."""
    names = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("part_name"), F.concat(F.lit("#"), (F.col("n_nationkey") % 5 + 1).cast("string")).alias("_n")
    )
    text = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("_t"))
    return W.first_per(
        text.join(F.broadcast(names), F.col("_t").contains(F.col("_n"))), ["part_name"], [F.desc("p_partkey")], 20
    ).select("part_name", "p_partkey")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, CASE source WHEN 'github_trending' THEN metric WHEN 'hn_algolia' THEN k * 3 WHEN 'product_hunt' THEN 1 + k % 20
  WHEN 'npm_registry' THEN metric * 7 ELSE k END AS native_metric FROM items"""
    )
)
def f13_native_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k, m = F.col("source"), F.col("k"), F.col("metric")
    native = F.when(s == "github_trending", m).when(s == "hn_algolia", k * 3).when(
        s == "product_hunt", 1 + k % 20
    ).when(s == "npm_registry", m * 7).otherwise(k)
    return items(spark, sf_dir).select("item_id", native.alias("native_metric"))


@query(
    """SELECT c_custkey AS group_id, min_by(n_name, n_nationkey) AS owner FROM customer
  JOIN nation ON c_nationkey = n_nationkey OR right(c_name, 2) = lpad(CAST(n_nationkey AS VARCHAR), 2, '0') GROUP BY c_custkey"""
)
def f14_identity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any identity value of a group may name an owner; the first owner in declared order wins. Values are exploded, so the join is by equality."""
    c = table(spark, sf_dir, "customer")
    values = c.select(
        F.col("c_custkey").alias("group_id"),
        F.explode(F.array(F.col("c_nationkey"), F.substring("c_name", -2, 2).try_cast("int"))).alias("n_nationkey")
    ).distinct()
    return values.join(table(spark, sf_dir, "nation"), "n_nationkey").groupBy("group_id").agg(
        F.min_by("n_name", "n_nationkey").alias("owner")
    )


@query(with_sql(SNAPSHOTS_SQL, then="""SELECT source, month, count(*) AS kept, CASE WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 0 THEN 'ok'
  WHEN count(*) > 0 THEN 'partial' ELSE 'error' END AS status FROM
  (SELECT *, row_number() OVER (PARTITION BY source, month, o_custkey ORDER BY item_id) AS n FROM snap_items) WHERE n = 1 GROUP BY source, month"""))
def k1_snapshot_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = S.first_of_batch(snap_items(spark, sf_dir), ["source", "month", "o_custkey"], [F.col("item_id").asc()])
    error = F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, "partial payload")
    out = first.groupBy("source", "month").agg(F.count(F.lit(1)).alias("kept"), error.alias("error"))
    return out.select("source", "month", "kept", S.snapshot_status(F.col("error"), F.col("kept")).alias("status"))


@query("""WITH old AS (SELECT user_id AS id, min(ts) AS first_seen, max(ts) AS last_seen, max_by(value, struct_pack(a := ts, b := event_id)) AS value
  FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY user_id),
new AS (SELECT user_id AS id, min(ts) AS first_seen, max(ts) AS last_seen, max_by(value, struct_pack(a := ts, b := event_id)) AS value FROM events
  WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id)
SELECT id, least(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen, CASE
  WHEN n.last_seen IS NULL THEN o.value ELSE n.value END AS value FROM old o FULL JOIN new n USING (id)""")
def k2_keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("id")).agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("value", F.struct("ts", "event_id")).alias("value")
        )

    return S.upserted(
        state(e.filter("ts < timestamp_ntz'2024-01-20 00:00:00'")), state(e.filter("ts >= timestamp_ntz'2024-01-15 00:00:00'")), "id"
    )


@query(
    """SELECT lower(event_type) AS author, max(ts) AS latest_at, max_by(event_id, struct_pack(a := ts, b := event_id)) AS latest_id, count(*) AS posts
  FROM events GROUP BY lower(event_type)"""
)
def k3_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cursors(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")), "event_type", "ts", "event_id")


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS run FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0"""
)
def k4_run_scoped_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the rewritten run go before its new rows are added; other runs stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = o.filter("o_orderkey % 2 = 0 and o_orderkey % 3 != 0").withColumn("run", F.lit(1)).unionByName(
        o.filter("o_orderkey % 5 = 0").withColumn("run", F.lit(2))
    )
    rewritten = o.filter("o_orderkey % 3 = 0").withColumn("run", F.lit(2))
    return stored.join(rewritten.select("run").distinct(), "run", "left_anti").unionByName(rewritten)


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 4 IN (0, 1)")
def k5_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    stored = o.filter("o_orderkey % 4 = 0").select("o_custkey", "o_orderpriority").distinct()
    new = o.filter("o_orderkey % 4 = 1").select("o_custkey", "o_orderpriority").distinct()
    return stored.unionByName(new.join(stored, ["o_custkey", "o_orderpriority"], "left_anti"))


@query("""WITH o AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  CAST(o_orderkey % 10 AS DOUBLE) AS priority FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS job, 'pending' AS status, CAST(o_orderkey % 7 AS DOUBLE) AS priority FROM orders WHERE o_orderkey % 2 = 0)
SELECT job, CASE WHEN o.status IN ('completed', 'failed') THEN o.status ELSE coalesce(n.status, o.status) END AS status,
  coalesce(n.priority, o.priority) AS priority FROM o FULL JOIN n USING (job)""")
def k6_guarded_job_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    old = o.filter(key % 3 != 0).select(key.alias("job"), status.alias("status"), (key % 10).cast("double").alias("priority"))
    new = o.filter(key % 2 == 0).select(key.alias("job"), F.lit("pending").alias("status"), (key % 7).cast("double").alias("priority"))
    return S.guarded_jobs(old, new, ["job"])


@query(
    with_sql(
        GROUPS_SQL,
        then="""SELECT level, (n - 1) // 1000 AS part, '[' || string_agg('{"id":' || group_id || ',"name":"' || canonical_name || '"}', ','
  ORDER BY group_id) || ']' AS document FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY group_id) AS n FROM groups WHERE n_orders > 5)
  GROUP BY level, (n - 1) // 1000"""
    )
)
def k7_candidate_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered JSON arrays of each list, a thousand rows a part, so that no part grows with the list."""
    g = W.spread_ranked(groups(spark, sf_dir).filter("n_orders > 5"), "n", ["level"], [F.col("group_id").asc()])
    row = F.struct(F.col("group_id").alias("id"), F.col("canonical_name").alias("name"))
    return g.groupBy("level", F.floor((F.col("n") - 1) / 1000).alias("part")).agg(
        F.to_json(F.array_sort(F.collect_list(row))).alias("document")
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT source, item_id, n AS place FROM (SELECT source, item_id, row_number() OVER (PARTITION BY source ORDER BY metric DESC, item_id) AS n
  FROM items) WHERE n <= 20"""
    )
)
def k8_top_20_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = W.ranked(items(spark, sf_dir), "place", ["source"], [F.desc("metric"), F.col("item_id").asc()])
    return top.filter("place <= 20").select("source", "item_id", "place")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, source, '[redacted]' AS api_token, url FROM (SELECT *, row_number() OVER (PARTITION BY source, date_trunc('day', ts)
  ORDER BY metric DESC, item_id) AS n FROM items) WHERE n <= 3 OR item_id % 100 = 0"""
    )
)
def k9_pruned_redacted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts"))
    out = S.pruned(i, i.filter("item_id % 100 = 0"), ["source", "day"], [F.desc("metric"), F.col("item_id").asc()], 3)
    fields = S.without_secrets(
        F.create_map(F.lit("api_token"), F.col("metric").cast("string"), F.lit("raw_file"), F.col("url"), F.lit("url"), F.col("url"))
    )
    return out.withColumn("f", fields).select(
        "item_id", "source", F.col("f")["api_token"].alias("api_token"), F.col("f")["url"].alias("url")
    )


@query(
    """SELECT o_orderkey, run FROM (SELECT o_orderkey, o_orderkey % 5 AS run FROM orders WHERE o_orderkey % 2 = 0) WHERE run NOT IN (1, 2)
  UNION ALL SELECT o_orderkey, o_orderkey % 5 AS run FROM orders WHERE o_orderkey % 5 IN (1, 2) AND o_orderkey % 3 = 0"""
)
def k10_gated_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("run"), "o_orderdate")
    store, batch = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 5 in (1, 2) and o_orderkey % 3 = 0")
    return S.gated_import(store, batch, "o_orderdate", "run", F.lit("1990-01-01").cast("timestamp")).select("o_orderkey", "run")


@query(
    """SELECT c.conv_id, c.turn, c.role || CASE WHEN c.turn % 2 = 0 THEN '_ok' ELSE '_error' END AS status, CASE
  WHEN c.turn % 2 = 1 THEN left(regexp_replace('sk-secret' || c.conv_id || ' ' || c.text, '(?i)sk-[A-Za-z0-9._-]+', '[redacted]', 'g'), 100) END AS error
  FROM conversations c"""
)
def k11_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.functions.scalars import redacted

    odd = F.col("turn") % 2 == 1
    text = F.concat(F.lit("sk-secret"), F.col("conv_id").cast("string"), F.lit(" "), "text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat("role", F.when(odd, "_error").otherwise("_ok")).alias("status"),
        F.when(odd, redacted(text, 100)).alias("error")
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT source, CASE WHEN GROUPING(w) = 1 THEN NULL ELSE w END AS window_name, count(*) AS n
  FROM (SELECT source, CASE WHEN k % 3 = 0 THEN '24h' ELSE 'current' END AS w FROM items) GROUP BY ROLLUP (source, w) HAVING source IS NOT NULL"""
    )
)
def a1_counts_by_channel_and_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.item_window(F.lit(None).cast("string"), F.when(F.col("k") % 3 == 0, "daily"))
    out = items(spark, sf_dir).withColumn("window_name", w).rollup("source", "window_name").agg(F.count(F.lit(1)).alias("n"))
    return out.filter("source is not null")


@query(
    """SELECT conv_id, count(*) FILTER (turn % 2 = 1) AS errors, count(*) FILTER (turn % 2 = 0 AND role <> 'system') AS successes, CASE
  WHEN count(*) FILTER (turn % 2 = 1) > 0 AND count(*) FILTER (turn % 2 = 0 AND role <> 'system') > 0 THEN 'ok_with_errors'
  WHEN count(*) FILTER (turn % 2 = 1) > 0 THEN 'error' ELSE 'ok' END AS status FROM conversations GROUP BY conv_id"""
)
def a13_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.operators.quality import run_status

    c = table(spark, sf_dir, "conversations")
    status = F.when(F.col("turn") % 2 == 1, "scoring_error").when(F.col("role") == "system", "llm_call_ok").otherwise("scoring_ok")
    return run_status(c.withColumn("status", status), ["conv_id"])


@query(
    """SELECT role AS component, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS size, avg(length(text)) AS mean_size, max(length(text)) AS largest
  FROM conversations GROUP BY role"""
)
def a18_call_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("component")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(n).alias("size"), F.avg(n).alias("mean_size"), F.max(n).alias("largest")
    )


@query(
    """SELECT count(*) AS n_rows, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS ids, count(DISTINCT user_id) AS candidates, least(50,
  count(DISTINCT user_id)) AS planned FROM events"""
)
def a16_preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.get_json_object("props", "$.k").cast("long")).alias("ids"),
        F.count_distinct("user_id").alias("candidates")
    )
    return out.withColumn("planned", F.least(F.lit(50), "candidates"))


@query(
    """SELECT strftime(min(latest) - INTERVAL 2 DAY, '%Y-%m-%d') AS since, count(*) AS handles FROM (SELECT user_id, max(ts) AS latest FROM events GROUP BY user_id)"""
)
def a17_since_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("latest"))
    return latest.agg(
        F.date_format(F.min("latest") - F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd").alias("since"), F.count(F.lit(1)).alias("handles")
    )


@query(
    """SELECT l_partkey AS repo, count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '2001-11-03' AND TIMESTAMP '2001-11-04') AS stars_24h,
  count(*) FILTER (l_shipdate BETWEEN TIMESTAMP '2001-10-28' AND TIMESTAMP '2001-11-04') AS stars_7d FROM lineitem GROUP BY l_partkey"""
)
def a9_star_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_shipdate").cast("timestamp_ntz")
    end = F.lit("2001-11-04 00:00:00").cast("timestamp_ntz")
    within = lambda days: F.count_if(at.between(end - F.expr(f"INTERVAL {days} DAYS"), end))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("repo")).agg(
        within(1).alias("stars_24h"), within(7).alias("stars_7d")
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT source AS channel, item_id, row_number() OVER (PARTITION BY source
  ORDER BY metric DESC, item_id) AS channel_rank, row_number() OVER (PARTITION BY source, k % 3
  ORDER BY metric DESC, item_id) AS window_rank, row_number() OVER (ORDER BY CASE source WHEN 'github_trending' THEN 0 WHEN 'product_hunt' THEN 6
  WHEN 'huggingface_models' THEN 7 ELSE 999 END, source, metric DESC, item_id) AS rank FROM items"""
    )
)
def w1_w2_channel_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select(F.col("source").alias("channel"), "item_id", "metric", (F.col("k") % 3).alias("window"))
    return S.channel_ranks(i, [F.desc("metric"), F.col("item_id").asc()]).select(
        "channel", "item_id", "channel_rank", "window_rank", "rank"
    )


@query(
    with_sql(
        ITEMS_SQL, then="SELECT entity_key, max_by(item_id, struct_pack(m := metric, o := -item_id)) AS best FROM items GROUP BY entity_key"
    )
)
def w3_best_row_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("entity_key").agg(F.max_by("item_id", F.struct("metric", -F.col("item_id"))).alias("best"))


@query(
    """SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5"""
)
def w4_cap_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_per(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id")


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events WHERE value > 20""")
def w5_metric_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.spread_ranked(
        table(spark, sf_dir, "events").filter("value > 20"), "place", ["event_type"], [F.desc("value"), F.col("event_id").asc()]
    ).select("event_id", "place")


@query(
    with_sql(
        GROUPS_SQL,
        then="""SELECT group_id, row_number() OVER (PARTITION BY segment ORDER BY momentum DESC, level_rank DESC, lower(canonical_name)) AS place FROM groups
  WHERE n_orders > 0"""
    )
)
def w6_channel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.spread_ranked(
        groups(spark, sf_dir).filter("n_orders > 0"), "place", ["segment"],
        [F.desc("momentum"), F.desc("level_rank"), F.lower("canonical_name")]
    ).select("group_id", "place")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, row_number() OVER (PARTITION BY entity_key ORDER BY CASE family WHEN 'github' THEN 0 WHEN 'hn' THEN 1
  WHEN 'package_family' THEN 3 ELSE 6 END, item_id) AS place FROM items"""
    )
)
def w7_evidence_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("family")
    order = F.when(f == "github", 0).when(f == "hn", 1).when(f == "x_social", 2).when(f == "package_family", 3).otherwise(6)
    return W.spread_ranked(items(spark, sf_dir), "place", ["entity_key"], [order.asc(), F.col("item_id").asc()]).select("item_id", "place")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT entity_key, count(*) AS rows_kept, array_to_string(list(item_id ORDER BY ts DESC, item_id DESC), ',') AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY ts DESC, item_id DESC) AS n FROM items) WHERE n <= 80 GROUP BY entity_key"""
    )
)
def w8_newest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = W.first_per(items(spark, sf_dir), ["entity_key"], [F.desc("ts"), F.desc("item_id")], 80)
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "item_id"))))
    return top.groupBy("entity_key").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.array_join(F.transform(ordered, lambda r: r["item_id"].cast("string")), ",").alias("ids")
    )


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(ceil(strlen(props || event_type) * event_id / 4.0) AS BIGINT) % 60 + 1 AS size,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events),
f(user_id, n, used, kept) AS (SELECT user_id, 0, CAST(0 AS BIGINT), CAST('' AS VARCHAR) FROM r GROUP BY user_id
  UNION ALL SELECT f.user_id, f.n + 1, CASE WHEN f.used + r.size <= 100 THEN f.used + r.size ELSE f.used END, CASE
  WHEN f.used + r.size <= 100 THEN f.kept || ',' || r.event_id ELSE f.kept END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1
  WHERE f.n < 80)
SELECT user_id, max_by(used, n) AS used, max_by(kept, n) AS kept FROM f GROUP BY user_id""")
def w9_budgeted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.ceil(F.octet_length(F.concat("props", "event_type")) * F.col("event_id") / 4.0) % 60 + 1
    e = table(spark, sf_dir, "events").withColumn("size", size)
    top = W.ranked(e, "n", ["user_id"], [F.desc("value"), F.col("event_id").asc()]).filter("n <= 80")
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct("n", F.col("event_id").alias("id"), "size"))),
        lambda r: F.struct(r["id"].alias("id"), r["size"].alias("size"))
    )
    out = top.groupBy("user_id").agg(rows.alias("rows")).withColumn("f", W.fitted(F.col("rows"), 100))
    kept = F.concat(F.lit(","), F.array_join(F.transform(F.col("f.kept"), lambda i: i.cast("string")), ","))
    return out.select("user_id", F.col("f.used").alias("used"), F.when(F.size("f.kept") > 0, kept).otherwise("").alias("kept"))


@query("""WITH m AS (SELECT l_partkey AS repo, date_trunc('month', l_shipdate) AS mon, count(*) AS stars FROM lineitem GROUP BY ALL),
d AS (SELECT *, stars - lag(stars) OVER (PARTITION BY repo ORDER BY mon) AS speed FROM m), a AS (SELECT *, speed - lag(speed) OVER (PARTITION BY repo
  ORDER BY mon) AS acceleration FROM d)
SELECT repo, max(speed) AS top_speed, max(acceleration) AS top_acceleration, max_by(mon, struct_pack(s := stars, t := -epoch(mon))) AS peak FROM a GROUP BY repo""")
def w15_velocity_and_acceleration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("repo"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("at")
    ).agg(F.count(F.lit(1)).alias("stars"))
    w = Window.partitionBy("repo").orderBy("at")
    d = m.withColumn("speed", F.col("stars") - F.lag("stars").over(w)).withColumn("acceleration", F.col("speed") - F.lag("speed").over(w))
    return d.groupBy("repo").agg(
        F.max("speed").alias("top_speed"), F.max("acceleration").alias("top_acceleration"),
        F.max_by("at", F.struct("stars", -W.seconds(F.col("at")))).alias("peak")
    )


@query(
    with_sql(
        SNAPSHOTS_SQL,
        then="""SELECT o_custkey, source, coalesce(p, first_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY source)) AS filled
  FROM (SELECT o_custkey, source, max(CASE WHEN item_id % 3 = 0 THEN item_id END) AS p FROM snap_items GROUP BY o_custkey, source)"""
    )
)
def w16_fill_across_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = snap_items(spark, sf_dir).groupBy("o_custkey", "source").agg(F.max(F.when(F.col("item_id") % 3 == 0, F.col("item_id"))).alias("p"))
    w = Window.partitionBy("o_custkey").orderBy("source")
    return p.select("o_custkey", "source", F.coalesce("p", F.first("p", ignorenulls=True).over(w)).alias("filled"))


@query("""WITH m AS (SELECT l_partkey AS repo, date_trunc('month', l_shipdate) AS mon, count(*) AS stars FROM lineitem
  GROUP BY ALL), n AS (SELECT repo, stars, row_number() OVER (PARTITION BY repo ORDER BY mon) - 1 AS i FROM m)
SELECT repo, regr_slope(stars, i) / greatest(avg(stars), 1.0) AS slope FROM n GROUP BY repo HAVING count(*) >= 3""")
def w17_sparkline_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("repo"), F.date_trunc("month", "l_shipdate").alias("at")
    ).agg(F.count(F.lit(1)).alias("stars"))
    n = W.ranked(m, "i", ["repo"], [F.col("at").asc()]).withColumn("i", F.col("i") - 1)
    return W.slope(n, ["repo"], "i", "stars")


@query(with_sql(ITEMS_SQL, then="SELECT DISTINCT entity_key FROM items WHERE key_type = 'github' AND (metric >= 1000 OR k >= 90)"))
def u1_union_of_repo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).filter("key_type = 'github'")
    return i.filter("metric >= 1000").select("entity_key").union(i.filter("k >= 90").select("entity_key")).distinct()


@query(with_sql(GROUPS_SQL, then="SELECT group_id, level, CASE WHEN level = 'edge_watch' THEN canonical_name END AS reason FROM groups"))
def u2_concatenated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = groups(spark, sf_dir)
    return g.filter("level != 'edge_watch'").select("group_id", "level").unionByName(
        g.filter("level = 'edge_watch'").select("group_id", "level", F.col("canonical_name").alias("reason")), allowMissingColumns=True
    )


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') OR c_custkey IN (SELECT user_id FROM events
  WHERE event_type = 'error')"""
)
def u3_referenced_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    b = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(a.union(b).distinct(), "c_custkey", "left_semi").select("c_custkey")


@query(
    """SELECT user_id AS entity, 'built' AS origin FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT c_custkey FROM customer
  WHERE c_custkey % 2 = 0) GROUP BY user_id UNION ALL SELECT c_custkey, 'stored' FROM customer WHERE c_custkey % 2 = 0"""
)
def u4_added_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("entity"), F.lit("stored").alias("origin")
    )
    named = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("entity")).distinct()
    return stored.unionByName(named.join(stored, "entity", "left_anti").withColumn("origin", F.lit("built")))


@query(
    """SELECT DISTINCT o_custkey, o_orderpriority FROM orders a WHERE o_orderkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM orders b
  WHERE b.o_orderkey % 2 = 1 AND b.o_custkey = a.o_custkey AND b.o_orderpriority = a.o_orderpriority)"""
)
def u5_stale_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    old, new = o.filter("o_orderkey % 2 = 0").drop("o_orderkey").distinct(), o.filter("o_orderkey % 2 = 1").drop("o_orderkey").distinct()
    return old.join(new, ["o_custkey", "o_orderpriority"], "left_anti")



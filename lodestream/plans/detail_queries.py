"""Latest runs and stores, company owners, canonical JSON, lasting entity ids, stage counts, votes and comparers, each whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import scalars as X
from lodestream.operators import entities as E
from lodestream.operators import facts, identities, quality, rules, runs
from lodestream.operators import snapshots as S
from lodestream.operators import windows as W
from lodestream.operators.components import saved, shared_folder
from lodestream.streaming import live

from .fixtures import ITEMS_SQL, SNAPSHOTS_SQL, items, snap_items, snapshots, with_sql
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- stores and runs ------------------------------------------------------------------------------------------------


@query(with_sql(SNAPSHOTS_SQL, """latest AS (SELECT source, max(month) AS month FROM snapshots WHERE status = 'ok' GROUP BY source)""", then="""SELECT source, strftime(month, '%Y-%m') AS run_id, 'c' || o_custkey AS external_id, min(item_id) AS ord
FROM snap_items JOIN latest USING (source, month) GROUP BY source, month, o_custkey"""))
def f1_latest_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All snapshots are appended by source and run; each source's latest sound one is read back, and no other run's files."""
    path, run = _folder(spark, "store"), F.date_format("month", "yyyy-MM").alias("run_id")
    rows = snap_items(spark, sf_dir).select(
        "source", run, F.concat(F.lit("c"), _s("o_custkey")).alias("external_id"), F.col("item_id").alias("ord")
    )
    S.append_snapshot(rows, path)
    return S.latest_from_store(
        spark, path, snapshots(spark, sf_dir).select("source", run, "status")
    ).select("source", "run_id", "external_id", "ord")


_RUNS_SQL = """r AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'ok'
  WHEN 'P' THEN 'ok_with_errors' ELSE 'running' END AS status, o_orderdate AS started, CASE
  WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 90) END AS completed, o_custkey FROM orders)"""


@query(f"""WITH {_RUNS_SQL}, d AS (SELECT run_id FROM r WHERE status <> 'running' ORDER BY coalesce(completed, started) DESC, started DESC, run_id DESC LIMIT 1),
f AS (SELECT run_id FROM r WHERE status = 'running'
  ORDER BY started DESC, run_id DESC LIMIT 1), s AS (SELECT run_id, strftime(started, '%Y-%m-%d') AS at FROM r WHERE status = 'ok'
  ORDER BY run_id DESC LIMIT 1)
SELECT d.run_id AS decision, d.run_id AS served, f.run_id AS fallen_back, CAST(NULL AS BIGINT) AS none,
  CAST(s.run_id AS VARCHAR) AS source_run, s.at AS fetched_at FROM d, f, s""")
def f4_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run for decisions, for serving (which may fall back to one that runs), and of the sources; each is one row."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "ok_with_errors").otherwise("running")
    started = F.col("o_orderdate").cast("timestamp_ntz")
    r = o.select(
        k.alias("run_id"), status.alias("status"), started.alias("started_at"),
        F.when(k % 3 != 0, started + F.make_dt_interval(days=(k % 90).cast("int"))).alias("completed_at")
    )
    only = r.filter("status = 'running'")
    found = [runs.latest_run(r), runs.latest_run(r, True), runs.latest_run(only, True), runs.latest_run(only)]
    source = runs.latest_source_run(
        r.select(
            F.col("run_id").alias("id"), _s("run_id").alias("run_id"), "status",
            F.date_format("started_at", "yyyy-MM-dd").alias("fetched_at")
        )
    )
    one = source.select(F.col("run_id").alias("source_run"), "fetched_at")
    for name, row in zip(("decision", "served", "fallen_back", "none"), found, strict=True):
        one = one.crossJoin(F.broadcast(row.select(F.col("run_id").alias(name))))  # one row each
    return one


@query(
    with_sql(
        SNAPSHOTS_SQL,
        then="""SELECT source, CASE WHEN status = 'partial' THEN 'partial payload of ' || item_count END AS error FROM snapshots WHERE source <> '5-LOW'
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY month DESC) = 1"""
    )
)
def f3_latest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error text of each source's latest snapshot; one source is named as a retired one and left out."""
    s = snapshots(spark, sf_dir)
    source = F.when(F.col("source") == "5-LOW", S.RETIRED[1]).otherwise(F.col("source"))
    error = F.when(F.col("status") == "partial", F.concat(F.lit("partial payload of "), _s("item_count")))
    return runs.latest_errors(s.select(source.alias("source"), F.col("month").alias("id"), error.alias("error")))


@query("""WITH v AS (SELECT 'run' || (o_orderkey % 3) AS feed_run_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'g' || o_custkey END AS group_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'clear' WHEN 3 THEN 'maybe' END AS vote, o_orderkey AS ord FROM orders)
SELECT feed_run_id, group_id, vote FROM (SELECT feed_run_id, group_id, max_by(vote, ord) AS vote FROM v
  WHERE group_id <> '' AND vote IN ('up', 'down', 'clear') GROUP BY ALL) WHERE vote <> 'clear'""")
def q5_standing_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes by run and group: the last valid one stands, a cleared one is none, others are rejected."""
    k = F.col("o_orderkey")
    vote = F.when(k % 5 == 0, "up").when(k % 5 == 1, "down").when(k % 5 == 2, "clear").when(k % 5 == 3, "maybe")
    group = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("g"), _s("o_custkey")))
    return runs.standing_votes(
        table(spark, sf_dir, "orders").select(
            F.concat(F.lit("run"), _s(k % 3)).alias("feed_run_id"), group.alias("group_id"), vote.alias("vote"), k.alias("ord")
        )
    )


@query(
    """SELECT role || '_ok' AS status, count(*) AS n_rows, count(*) FILTER (turn % 2 = 1) AS odd, max(length(text)) AS longest,
  CAST(NULL AS VARCHAR) AS error FROM conversations GROUP BY role"""
)
def k11_a13_observed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage a role writes its turns and leaves an event with what it counted while writing; the events are read back."""
    c, out, events = table(spark, sf_dir, "conversations"), _folder(spark, "stages"), _folder(spark, "stage-events")
    for role in ("system", "user", "assistant"):
        rows = c.filter(F.col("role") == role)
        runs.observed_stage(
            rows, lambda df, role=role: df.write.parquet(f"{out}/{role}"), events, "run-1", role, "2024-01-31T00:00:00Z", {"role": role},
            odd=F.count_if(F.col("turn") % 2 == 1), longest=F.max(F.length("text"))
        )
    number = lambda name: X.nested(F.col("metadata_json"), name).cast("long").alias("n_rows" if name == "rows" else name)
    return spark.read.schema(runs.EVENT).parquet(events).select(
        "status", number("rows"), number("odd"), number("longest"), "error"
    ).filter("n_rows > 0")


# --- identities and content -----------------------------------------------------------------------------------------

_NAMED = (
    "'github:' || CASE k % 3 WHEN 0 THEN 'Googleapis' WHEN 1 THEN 'nvlabs' ELSE 'Supplier-' || k END || '/tool' || k",
    "'https://' || CASE k % 4 WHEN 0 THEN 'www.OpenAI.com' WHEN 1 THEN 'u:p@docs.azure.microsoft.com:8443' WHEN 2 THEN 'a.b.supplier-' || (k % 7) || '.example' ELSE 'site' || k || '.dev' END || '/x?y=openai.com'"
)
_COMPANIES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS place, '{label}' AS label, '{kind}' AS kind, '{v}' AS value" for i,
    (label, o, h) in enumerate(identities.COMPANIES) for kind, vs in (("owner", o), ("host", h)) for v in vs
)


@query(f"""WITH known AS ({_COMPANIES_SQL} UNION ALL SELECT 100 + s_suppkey, s_name, 'owner', 'supplier-' || s_suppkey FROM supplier
  UNION ALL SELECT 100 + s_suppkey, s_name, 'host', 'supplier-' || s_suppkey || '.example' FROM supplier),
i AS (SELECT c_custkey AS id, lower(CASE WHEN c_custkey % 5 = 0 THEN '@Anthropics/x'
  WHEN c_custkey % 5 = 1 THEN 'npm:@google/y' ELSE c_name END) AS name, lower(CASE
  WHEN k % 2 = 0 THEN {_NAMED[0]} END) AS key, lower({_NAMED[1]}) AS link FROM (SELECT *, c_custkey % 60 AS k FROM customer)),
o AS (SELECT id, 'owner' AS kind, regexp_extract(name, '^(?:npm:)?@([^/]*)', 1) AS value FROM i
  UNION ALL SELECT id, 'owner', regexp_extract(key, '^github:([^/]*)', 1) FROM i WHERE key IS NOT NULL
  UNION ALL SELECT id, 'owner', string_split(link, '/')[1] FROM i
  UNION ALL SELECT id, 'host', unnest([h, array_to_string(string_split(h, '.')[-2:], '.'), array_to_string(string_split(h, '.')[-3:], '.')])
  FROM (SELECT id, regexp_replace(regexp_replace(regexp_extract(link, '^https?://([^/?#]*)', 1), '^.*@|:[0-9]+$', '', 'g'), '^www\\.', '') AS h
  FROM i))
SELECT id, coalesce(min_by(label, place), '') AS company FROM i LEFT JOIN (SELECT id, place, label FROM o JOIN known USING (kind, value)) m USING (id) GROUP BY id""")
def f14_company_of_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The company of each customer's name, key and link, out of the fixed list and, after it, one entry a supplier."""
    k, text = F.col("c_custkey") % 60, lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    owner = F.when(k % 3 == 0, "Googleapis").when(k % 3 == 1, "nvlabs").otherwise(text("Supplier-", k))
    host = F.when(k % 4 == 0, "www.OpenAI.com").when(k % 4 == 1, "u:p@docs.azure.microsoft.com:8443").when(
        k % 4 == 2, text("a.b.supplier-", k % 7, ".example")
    ).otherwise(text("site", k, ".dev"))
    name = F.when(
        F.col("c_custkey") % 5 == 0, "@Anthropics/x"
    ).when(F.col("c_custkey") % 5 == 1, "npm:@google/y").otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), name.alias("canonical_name"),
        F.when(k % 2 == 0, text("github:", owner, "/tool", k)).alias("canonical_key"),
        text("https://", host, "/x?y=openai.com").alias("canonical_link")
    )
    s = table(spark, sf_dir, "supplier")
    more = lambda kind, end: s.select(
        (F.col("s_suppkey") + 100).cast("int").alias("place"), F.col("s_name").alias("label"), F.lit(kind).alias("kind"),
        text("supplier-", F.col("s_suppkey"), end).alias("value")
    )
    return identities.company_of(rows, identities.companies(spark).union(more("owner", "")).union(more("host", ".example")), "id")


_SORTED = """'{"a":[' || k || ',{"x":"é' || user_id || ' 1.0","y":null}],"b":{"c":{"d":{"e":' || event_id || ',"f":' || k || '.5}}},"z":true}'"""


@query(
    with_sql(
        ITEMS_SQL.replace("event_id AS item_id, ", "event_id AS item_id, event_id, "),
        then=f"SELECT item_id, {_SORTED} AS canonical, sha256({_SORTED}) AS content_hash FROM items"
    )
)
def x18_canonical_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON in two orders of keys, with blanks and other forms of numbers, by its item: one form, one hash."""
    t = lambda c: F.col(c).cast("string")
    k, user, ident = t("k"), t("user_id"), t("item_id")
    one = F.concat(
        F.lit('{ "z":true, "b": {"c":{"d":{"f":'), k, F.lit('.50,"e":'), ident, F.lit('.0}}}, "a":['), k, F.lit(',{"y":null,"x":"é'), user,
        F.lit(' 1.0"}]}')
    )
    two = F.concat(
        F.lit('{"a":['), k, F.lit('.00, {"x":"\\u00e9'), user, F.lit(' 1.0","y":null}],"z":true,"b":{"c":{"d":{"e":'), ident,
        F.lit(',"f":'), k, F.lit(".5}}}}")
    )
    text = F.when(F.col("item_id") % 2 == 0, one).otherwise(two)
    return items(spark, sf_dir).select("item_id", X.canonical_json(text).alias("canonical"), X.content_hash(text).alias("content_hash"))


_DAYS = ("2024-01-08", "2024-01-16", "2024-01-24", "2024-02-01")


def keyed_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their user's key, some with that of their value too, and the first of four days by which they had happened."""
    e = table(spark, sf_dir, "events")
    user, value = F.concat(F.lit("u"), _s("user_id")), F.concat(F.lit("v"), _s(F.round(F.col("value") * 100).cast("long")))
    keys = F.when((F.col("event_type") == "purchase") & (F.col("value") >= 30), F.array(user, value)).otherwise(F.array(user))
    day = F.coalesce(*[F.when(F.col("ts") < F.lit(d).cast("timestamp"), d) for d in _DAYS])
    return e.select(F.col("event_id").alias("item_id"), keys.alias("keys"), day.alias("day"))


@query("""WITH RECURSIVE items2 AS (SELECT event_id AS item_id, user_id, CASE WHEN event_type = 'purchase'
  AND value >= 30 THEN ['u' || user_id, 'v' || CAST(round(value * 100) AS BIGINT)] ELSE ['u' || user_id] END AS keys FROM events),
pairs AS (SELECT DISTINCT keys[1] AS u, keys[2] AS v FROM items2 WHERE len(keys) > 1), adj AS (SELECT DISTINCT a.u AS x, b.u AS y FROM pairs a JOIN pairs b ON a.v = b.v),
reach(x, y) AS (SELECT DISTINCT keys[1], keys[1] FROM items2 UNION SELECT r.x, a.y FROM reach r
  JOIN adj a ON a.x = r.y), roots AS (SELECT x AS u, min(y) AS root FROM reach GROUP BY x)
SELECT item_id, min(item_id) OVER (PARTITION BY root) AS first_item FROM items2 JOIN roots ON roots.u = keys[1]""")
def e2_e4_resolved_day_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four days resolved one after another, each against the labels so far: the groups are those of one run over all days."""
    rows = keyed_by_day(spark, sf_dir)
    labels = spark.createDataFrame([], "key string, root string, since string")
    for day in _DAYS:
        changed, _ = E.resolve_day(labels, rows.filter(F.col("day") == day), day)
        labels = saved(E.relabelled(labels, changed), "labels")
    found = E.labelled(rows, labels)
    return found.join(found.groupBy("root").agg(F.min("item_id").alias("first_item")), "root").select("item_id", "first_item")


# --- rules, answers and measures ------------------------------------------------------------------------------------


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT entity_key, 'item:' || item_id AS ref FROM items WHERE entity_key IN (SELECT entity_key FROM items GROUP BY entity_key
  HAVING max(metric // 2) BETWEEN 300 AND 999)"""
    )
)
def r12_edge_watch_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of entities that daily stars, half an item's metric, alone bring to level watch."""
    i = items(spark, sf_dir)
    evidence = rules.daily_stars(i.select("entity_key", "item_id", F.floor(F.col("metric") / 2).alias("stars"), F.col("ts").alias("at")))
    return rules.edge_watch_refs(rules.promoted(evidence), i)


@query("""WITH s AS (SELECT l_partkey AS p, count(*) FILTER (l_shipdate >= TIMESTAMP '2001-11-03') AS a, count(*) AS b FROM lineitem
  WHERE l_shipdate BETWEEN TIMESTAMP '2001-10-28' AND TIMESTAMP '2001-11-04' GROUP BY l_partkey),
j AS (SELECT 'github:p/' || p_partkey AS entity_key, coalesce(a, 0) AS a, coalesce(b, 0) AS b, p_size AS f, CASE
  WHEN p_partkey % 5 = 0 THEN 'lower_bound_due_to_page_cap' ELSE 'complete_recent_pages' END AS note FROM part LEFT JOIN s ON p = p_partkey)
SELECT entity_key, 'github_stars_24h' AS metric_name, CAST(a AS VARCHAR) AS metric_value, 'as_of_safe' AS historical_safety, note FROM j
  UNION ALL SELECT entity_key, 'github_stars_7d', CAST(b AS VARCHAR), 'as_of_safe', note FROM j
UNION ALL SELECT entity_key, 'github_forks_total', CAST(f AS VARCHAR), 'partial_as_of', 'repo metadata snapshot' FROM j""")
def c11_backfill_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of the day and week before the run and forks of every repository, capped pages told as lower bounds."""
    p, part = table(spark, sf_dir, "part"), F.col("p_partkey")
    jobs = p.select(F.concat(F.lit("github:p/"), _s(part)).alias("entity_key"), part.alias("repo"))
    stars = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("repo"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"))
    return rules.backfill_evidence(
        jobs, stars, p.select(part.alias("repo"), F.col("p_size").alias("forks"), (part % 5 == 0).alias("lower_bound")),
        F.lit("2001-11-04 00:00:00").cast("timestamp_ntz")
    )


_ANSWERS = """a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'project' ELSE 'news' END AS e_proj, CASE
  WHEN doc_id % 3 = 0 THEN 'news' ELSE 'project' END AS a_proj, toxic = 1 AS noise, doc_id % 4 = 0 AS odd, ['none', 'watch', 'potential', 'high'][CAST(doc_id % 4 + 1 AS INT)] AS tier, ['none', 'watch', 'potential', 'high'][CAST(doc_id % 5 % 4 + 1 AS INT)] AS most
  FROM labels)"""


@query(f"""WITH {_ANSWERS}, f AS (SELECT doc_id, 'story' AS kind, list_filter([CASE
  WHEN e_proj <> a_proj THEN 'projectness expected ' || e_proj || ' got ' || a_proj END, CASE
  WHEN noise <> odd THEN 'noise expected ' || noise || ' got ' || odd END, CASE WHEN doc_id % 2 = 0
  AND NOT odd THEN 'expected deterministic alias link' END], lambda x: x IS NOT NULL) AS l FROM a
UNION ALL SELECT doc_id, 'tier', list_filter([CASE
  WHEN list_position(['none', 'watch', 'potential', 'high'], tier) > list_position(['none', 'watch', 'potential', 'high'], most) THEN 'accepted tier ' || tier || ' exceeds max_tier ' || most END,
  CASE WHEN tier <> 'none' AND doc_id % 3 = 0 THEN 'accepted non-none tier without citations' END, CASE WHEN noise
  AND tier <> 'none' THEN 'noise expected none got ' || tier END], lambda x: x IS NOT NULL) FROM a
UNION ALL SELECT doc_id, 'triage', list_filter([CASE WHEN noise AND doc_id % 3 <> 0 THEN 'noise case should not request closer look' END, CASE
  WHEN NOT noise AND doc_id % 5 = 0 THEN 'expected at least one product signal' END], lambda x: x IS NOT NULL) FROM a)
SELECT kind, array_to_string(l, '; ') AS failures, count(*) AS cases, sum(count(*)) OVER (PARTITION BY kind) AS total, sum(CASE
  WHEN len(l) = 0 THEN count(*) ELSE 0 END) OVER (PARTITION BY kind) AS passed FROM f GROUP BY kind, l""")
def v2_three_comparers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Story, tier and triage answers against what their cases expect: how often each set of failures, and what passed."""
    i = F.col("doc_id")
    yes, none = F.col("toxic") == 1, F.lit(None).cast("string")
    tiers = F.array(*[F.lit(t) for t in quality.TIERS])
    tier = lambda n: F.element_at(tiers, (n + 1).cast("int"))
    expected = {
        "projectness": F.when(F.col("quality") == 1, "project").otherwise("news"), "noise": yes, "requires_alias": i % 2 == 0,
        "deterministic_link_type": none, "x_tier": none, "max_tier": tier(i % 5 % 4), "requires_citations": F.lit(True)
    }
    actual = {
        "projectness": F.when(i % 3 == 0, "news").otherwise("project"), "noise": i % 4 == 0, "has_alias": i % 4 == 0,
        "deterministic_link_type": none, "accepted_x_tier": tier(i % 4), "cited": i % 3, "closer_look": i % 3, "product_signals": i % 5
    }
    e, a = expected.__getitem__, actual.__getitem__
    kinds = (("story", quality.story_failures), ("tier", quality.tier_failures), ("triage", quality.triage_failures))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f(e, a).alias("failures")) for k, f in kinds]))
    cases = table(spark, sf_dir, "labels").select(each.alias("c")).select("c.*")
    totals = quality.case_totals(cases, ["kind"])
    found = cases.groupBy("kind", F.array_join("failures", "; ").alias("failures")).agg(F.count(F.lit(1)).alias("cases"))
    return found.join(totals, "kind").select("kind", "failures", "cases", "total", "passed")


@query("SELECT role AS component, count(*) AS n, true AS p50_near, true AS p95_near FROM conversations GROUP BY role")
def a18_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of text lengths kept a run and role, merged over runs: their quantiles have about the rank they stand for."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("component"), (F.col("conv_id") % 8).alias("run"), F.length("text").alias("latency_ms")
    )
    kept = saved(quality.latency_sketches(c, ["run", "component"]), "sketches")
    merged = quality.merged_quantiles(kept, ["component"], {"p50": 0.5, "p95": 0.95})
    below = lambda q, name: F.abs(
        F.count_if(F.col("latency_ms") <= F.col(name)) / F.count(F.lit(1)) - q
    ) <= F.lit(0.03) + F.count_if(F.col("latency_ms") == F.col(name)) / F.count(F.lit(1))
    return c.join(merged, "component").groupBy("component", "n").agg(
        below(0.5, "p50").alias("p50_near"), below(0.95, "p95").alias("p95_near")
    )


@query("""WITH n AS (SELECT max(ts) - INTERVAL 1 SECOND AS t FROM events)
SELECT CAST(user_id AS VARCHAR) AS entity_key, count(*) FILTER (ts >= t - INTERVAL 24 HOUR) AS mentions_24h,
  count(DISTINCT event_type) FILTER (ts >= t - INTERVAL 24 HOUR) AS authors_24h,
count(*) FILTER (ts >= t - INTERVAL 168 HOUR) AS mentions_7d, count(DISTINCT event_type) FILTER (ts >= t - INTERVAL 168 HOUR) AS authors_7d
  FROM events, n GROUP BY user_id""")
def a3_counts_as_of_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of posts: what stands once all are read and what is past has aged out of the counts."""
    path, out = f"{sf_dir}/events.parquet".rstrip("/"), _folder(spark, "as-of-now")
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern of one name, for a folder or a single file
    at = F.col("ts").cast("timestamp")
    posts = e.select(
        _s("event_id").alias("post_id"), _s("user_id").alias("entity_key"), F.col("event_type").alias("author"), at.alias("created_at"),
        at.alias("seen_at")
    )
    with live.settings(spark):
        told = live.keep(live.counts_as_of_now(posts, parts=4), f"{out}/told", f"{out}/progress", available_now=True)
    told.awaitTermination()
    return live.standing(spark.read.schema(live.AGING).parquet(f"{out}/told"))


@query(with_sql(ITEMS_SQL, then="""SELECT item_id, CASE source WHEN 'github_trending' THEN '窗口=daily|窗口新增star=' || metric || '|总star=' || k || '.25'
  WHEN 'hn_algolia' THEN '搜索词=' || CASE WHEN k % 2 = 0 THEN 'q' || k ELSE 'agents' END || '|分数=' || metric || '|评论=None|作者=u' || user_id || '|创建=None'
  WHEN 'product_hunt' THEN '票数=None|评论=None|日榜=' || k || '|周榜=None|featured=None'
  WHEN 'npm_registry' THEN '搜索词=' || CASE
  WHEN k % 2 = 0 THEN 'q' || k ELSE 'agents' END || '|版本=None|周下载=' || metric || '.00|月下载=|dependents=|score=|quality=|popularity=|maintenance=' || CASE
  WHEN k % 3 > 0 THEN '|keywords=' || array_to_string(list_transform(range(1, least(k % 9, 6) + 1), lambda i: 'w' || i), ', ') ELSE '' END
  ELSE '类型=model|like=None|下载=' || metric || '|pipeline=None' END AS facts FROM items"""))
def f13_row_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that each item's row shows, by its source."""
    k, text = F.col("k"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    words = F.when(  # k % 9 is above 0 where k % 3 is
        k % 3 > 0, F.transform(F.sequence(F.lit(1), (k % 9).cast("int")), lambda i: text("w", i))
    ).otherwise(F.array().cast("array<string>"))
    fields = {
        "period": F.lit("daily"), "period_stars": _s("metric"), "stars_total": text(k, ".25"), "query": F.lit("agents"), "query_label": F.when(k % 2 == 0, text("q", k)).otherwise(""),
        "points": _s("metric"), "author": text("u", F.col("user_id")), "daily_rank": _s("k"), "weekly_downloads": _s("metric"), "keywords": F.to_json(words), "resource": F.lit("model"), "downloads": _s("metric"),
    }
    metadata = F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*fields.values()))
    source = F.when(F.col("source") == "npm_registry", "npm_search").otherwise(F.col("source"))
    return items(spark, sf_dir).select("item_id", F.array_join(facts.row_facts(source, metadata), "|").alias("facts"))


@query(with_sql(ITEMS_SQL, then="""SELECT item_id, CASE source WHEN 'github_trending' THEN '{"archived":false,"created_at":null,"default_branch":null,"fork":null,"has_discussions":null,"has_issues":null,"has_pages":null,"homepage":null,"is_template":null,"license":"L' || (k % 3) || '","open_issues_count":null,"owner":"o' || user_id || '","pushed_at":null,"size":' || k || ',"updated_at":null,"visibility":null,"watchers_count":' || metric || '}'
  WHEN 'huggingface_models' THEN '{"author":null,"disabled":null,"gated":null,"library_name":null,"modelId":"m' || k || '","private":null,"sdk":null,"sha":null,"trendingScore":' || metric || '}'
  WHEN 'hn_algolia' THEN '{"id":' || item_id || '}' ELSE '{"id":' || item_id || ',"raw":{"a":[' || k || ']}}' END AS raw FROM items"""))
def f13_compact_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each item's raw payload, as canonical JSON."""
    k, text = F.col("k"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    repo = text(
        '{"watchers_count":', F.col("metric"), ',"size":', k, '.0,"archived":false,"name":"x","license":{"name":"L', k % 3,
        '","spdx_id":null},"owner":{"login":"o', F.col("user_id"), '","id":1}}'
    )
    model = text('{"trendingScore":', F.col("metric"), ',"tags":["a"],"modelId":"m', k, '"}')
    other = text('{"raw":{"a":[', k, ']},"id":', F.col("item_id"), "}")
    s = F.col("source")
    source = F.when(s == "github_trending", "github_search").when(s == "hn_algolia", "x_tweets").otherwise(s)
    raw = F.when(s == "github_trending", repo).when(s == "huggingface_models", model).otherwise(other)
    return items(spark, sf_dir).select("item_id", facts.compact_raw(source, raw).alias("raw"))

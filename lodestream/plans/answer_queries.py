"""Checks of model answers, request tables and open questions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import answers as A
from lodestream.operators import mentions as M
from lodestream.operators.components import spread

from .fixtures import ITEMS_SQL, LINKS_SQL, items, links, now, with_sql
from .registry import query, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _filled(template: str, **parts) -> Column:
    """JSON text with each ``<name>`` replaced by a column."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit(f"<{name}>"), part.cast("string"))
    return out


_TRIAGE = '{"triage":[{"tweet_id":<id>,"about_concrete_project":<bool>,"closer_look":false,"product_names":<names>,"product_links":[],"project_refs":[{"entity_key":"<key>","entity_name":"n","entity_confidence":"linked","confidence":<sure>}],"expression_strength":"<strength>","evidence_quote":"q"<reason>}]}'


@query("""SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'not an object' WHEN event_id % 23 = 0 THEN 'missing field' WHEN event_id % 19 = 0 THEN 'text'
  WHEN event_id % 17 = 0 THEN 'boolean' WHEN event_id % 13 = 0 THEN 'list'
  WHEN event_id % 11 = 0 THEN 'strength' WHEN event_id % 7 = 0 OR event_id % 100 >= 90 THEN 'ref' END AS error FROM events""")
def c3_triage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    payload = _filled(
        _TRIAGE, id=F.when(i % 19 == 0, "5").otherwise('"5"'), bool=F.when(i % 17 == 0, '"true"').otherwise("true"), names=F.when(i % 13 == 0, '["a",1]').otherwise('["a"]'), key=F.when(i % 7 == 0, "untyped").otherwise("github:a/b"),
        sure=(i % 100 + 11) / 100.0, strength=F.when(i % 11 == 0, "loud").otherwise("mixed"), reason=F.when(i % 23 == 0, "").otherwise(',"reason":"r"'),
    )
    return spread(table(spark, sf_dir, "events").select("event_id")).select(
        "event_id", A.triage_error(F.when(i % 29 == 0, "no answer").otherwise(payload)).alias("error")
    )


_TIER = '{"entity_key":"<key>","x_tier":"<tier>","entity_confidence":"<sure>","x_expression_strength":"neutral","cited_tweet_ids":<cited>,"rationale":<why>,"cross_source_notes":[]}'


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'entity_key' WHEN o_orderkey % 11 = 0 THEN 'x_tier' WHEN o_orderkey % 5 = 0 THEN 'list'
  WHEN o_orderkey % 17 = 0 THEN 'text' END AS error,
  CASE WHEN o_orderkey % 13 = 0 THEN 'entity_key' WHEN o_orderkey % 11 = 0 THEN 'x_tier' WHEN o_orderkey % 5 = 0 THEN 'list'
  WHEN o_orderkey % 17 = 0 THEN 'text' WHEN o_custkey % 4 > 0 AND o_orderkey % 3 = 0 THEN 'no citation'
    WHEN o_custkey % 4 > 1 AND o_custkey % 7 = 0 THEN 'unsure binding' END AS promoting_error FROM orders""")
def c3_tier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    tier = F.when(o % 11 == 0, "huge").otherwise(F.element_at(F.array(*[F.lit(t) for t in M.TIERS]), (c % 4 + 1).cast("int")))
    payload = _filled(
        _TIER, key=F.when(o % 13 == 0, "plain").otherwise("name:x"), tier=tier, sure=F.when(c % 7 == 0, "fuzzy_name").otherwise("linked"),
        cited=F.when(o % 5 == 0, '"1"').when(o % 3 == 0, "[]").otherwise('["1","2"]'), why=F.when(o % 17 == 0, "null").otherwise('"w"')
    )
    rows = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return rows.select("o_orderkey", A.tier_errors(payload).alias("errors")).select("o_orderkey", "errors.error", "errors.promoting_error")


_KNOWN = '"information_sufficiency":{"identity":"<level>","workflow_shift":"weak","technical_substance":"weak","product_market_fit":"medium","momentum":"strong"}'
_TOOLS = '{"action":"use_tools",' + _KNOWN + ',"information_need":{"question":"<asked>","target_axes":<axes>,"expected_decision_impact":"i"},"tool_requests":<requests><more>}'
_FINAL = (
    '{"action":"final",' + _KNOWN + ',"score":{"object_type":"repo","is_product_or_repo":true,"axes":{"workflow_shift":1,"technical_substance":2,"product_market_fit":3.5,"momentum":4,"confidence":<sure>,"risk_penalty":<risk>,"derivative_news_penalty":0},'
    '"supporting_evidence":[{"claim":"c","evidence_refs":<refs>,"supports_axes":["momentum"],"claim_type":"observed"}],"negative_evidence":[],"known_gaps":[],"primary_reason":"p","rationale_short":"<why>","topic_tags":["t"],"caveats":[],"should_print":<shown>}<more>}'
)


@query("""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'sufficiency' WHEN event_id % 29 = 0 THEN 'fields' WHEN event_id % 2 = 0 THEN CASE
  WHEN event_id % 5 = 0 OR event_id % 3 = 0 THEN 'need' WHEN event_id % 7 = 0 THEN 'requests' END
  ELSE CASE WHEN event_id % 5 = 0 THEN 'boolean' WHEN event_id % 40 > 25 THEN 'axes' WHEN event_id % 3 = 0 THEN 'claims'
  WHEN event_id % 7 = 0 THEN 'texts' END END AS error FROM events""")
def c3_scoring_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    level, more = F.when(i % 31 == 0, "odd").otherwise("strong"), F.when(i % 29 == 0, ',"extra":1').otherwise("")
    tools = _filled(
        _TOOLS, level=level, more=more, asked=F.when(i % 5 == 0, "").otherwise("q"),
        axes=F.when(i % 3 == 0, '["momentum","momentum"]').otherwise('["momentum"]'),
        requests=F.when(i % 7 == 0, "[]").otherwise('[{"name":"readme","arguments":{"a":1}}]')
    )
    final = _filled(
        _FINAL, level=level, more=more, sure=F.lit("90"), risk=i % 40, refs=F.when(i % 3 == 0, "[]").otherwise('["item:1"]'),
        why=F.when(i % 7 == 0, "").otherwise("w"), shown=F.when(i % 5 == 0, '"yes"').otherwise("false")
    )
    rows = spread(table(spark, sf_dir, "events").select("event_id"))
    return rows.select("event_id", A.scoring_error(F.when(i % 2 == 0, tools).otherwise(final)).alias("error"))


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, request, sha256(request) AS content_hash
  FROM (SELECT item_id, '{"item_id":' || item_id || ',"source":"' || source || '","title":' || CASE
  WHEN k % 5 = 0 THEN 'null' ELSE '"Title ' || k || '"' END || ',"url":"' || url || '"}' AS request FROM items WHERE family = 'hn')"""
    )
)
def c1_story_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every story as a request to be classified, and the hash that tells whether it was asked before."""
    rows = items(spark, sf_dir).filter("family = 'hn'").withColumn(
        "title", F.when(F.col("k") % 5 != 0, F.concat(F.lit("Title "), F.col("k").cast("string")))
    )
    return A.requests(rows, "item_id", ["url", "title", "source", "item_id"])


@query(with_sql(LINKS_SQL, """e AS (SELECT l.event_id, CASE WHEN l.event_id % 2 = 0 THEN l.txt ELSE '' END || ' ' || l.u AS said, v.ts FROM links l
  JOIN events v ON v.event_id = l.event_id)""",
  then=rf"""SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(said, 'https?://github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)', 0), lambda g: 'github:' || lower(regexp_replace(regexp_replace(g, '^https?://github\.com/', ''), '\.git$', ''))))), ',') AS hints
  FROM e WHERE ts BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW}"""))
def c2_link_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys named by the texts and expanded links of the last week's posts."""
    at = table(spark, sf_dir, "events").select("event_id", "ts").filter(F.col("ts").between(now() - F.expr("INTERVAL 7 DAYS"), now()))
    text = F.when(F.col("event_id") % 2 == 0, F.col("txt"))
    return links(spark, sf_dir).join(at, "event_id").select("event_id", F.array_join(A.link_hints(text, F.array("u")), ",").alias("hints"))


@query(with_sql(ITEMS_SQL, """e AS (SELECT entity_key, CASE WHEN max(k) % 3 > 0 THEN 'https://' || CASE WHEN max(k) % 3 = 1 THEN 'github.com/a/b' ELSE 'site.dev' END END AS url,
  min(k) * 10 AS readme, max(k) AS ctx, count(*) AS n FROM items GROUP BY entity_key)""",
  then="""SELECT entity_key, array_to_string(list_filter([CASE WHEN starts_with(entity_key, 'name:')
  AND coalesce(url, '') <> 'https://site.dev' THEN 'Resolve the candidate identity and canonical first-party source.' END,
  CASE WHEN url IS NOT NULL AND greatest(readme, ctx) < 80 THEN 'Retrieve an attributable first-party product description.' END, CASE
  WHEN starts_with(entity_key, 'github:') AND readme < 180 THEN 'Confirm the documented workflow and technical implementation.' END,
  CASE WHEN n > 80 THEN 'Review omitted attributable evidence before final scoring.' END, CASE
  WHEN n % 2 = 0 THEN 'Verify whether independent momentum evidence changes the decision.' END], lambda x: x IS NOT NULL), '|') AS questions FROM e"""))
def l1_open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).groupBy("entity_key").agg(
        F.max("k").alias("ctx"), (F.min("k") * 10).alias("readme"), F.count(F.lit(1)).alias("n")
    )
    url = F.when(F.col("ctx") % 3 == 1, "https://github.com/a/b").when(F.col("ctx") % 3 == 2, "https://site.dev")
    needs = A.candidate_needs(F.col("entity_key"), url, F.col("readme"), F.col("ctx"), rich=180)
    asked = A.open_questions(**needs, has_retrievable_evidence=F.col("n") > 80, needs_momentum_verification=F.col("n") % 2 == 0)
    return e.select("entity_key", F.array_join(asked, "|").alias("questions"))

"""Lookups whose both sides grow: names within texts, times within intervals, what was known at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import asof, containment, intervals
from lodestream.operators import mentions as M
from lodestream.operators.components import spread

from .registry import query, table


@query("""WITH n AS (SELECT DISTINCT lower(name) AS name FROM (SELECT regexp_extract(text, '^(\\S+ \\S+)', 1) AS name FROM conversations
  UNION ALL SELECT string_split(p_name, ' ')[-1] FROM part) WHERE name <> ''),
m AS (SELECT name, doc_id, row_number() OVER (PARTITION BY name ORDER BY doc_id DESC) AS r FROM n JOIN documents ON contains(lower(text), name))
SELECT name, doc_id FROM m WHERE r <= 20""")
def f12_names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 documents that hold each name: first words of conversations' turns, and kinds of parts."""
    said = table(spark, sf_dir, "conversations").select(F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("name"))
    kinds = table(spark, sf_dir, "part").select(F.substring_index("p_name", " ", -1).alias("name"))
    found = containment.newest_containing(said.union(kinds), table(spark, sf_dir, "documents"), 20, ident="doc_id")
    return found.select("name", F.col("id").alias("doc_id"))


_GRID_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS bucket, {lo} AS lo, {hi} AS hi, {'true' if c else 'false'} AS closed" for n, lo, hi, c in intervals.GRID
)


@query(f"""WITH g AS ({_GRID_SQL}), a AS (SELECT user_id, event_id AS anchor, ts AS t0 FROM events WHERE event_type = 'purchase'),
d AS (SELECT a.user_id, anchor, epoch_us(e.ts) - epoch_us(t0) AS apart FROM a JOIN events e ON e.user_id = a.user_id)
SELECT user_id, anchor, bucket, count(*) AS n FROM d JOIN g ON apart >= lo * 3600000000 AND (apart < hi * 3600000000 OR closed AND apart = hi * 3600000000) GROUP BY ALL""")
def j14_grids_of_many_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events on the grid around each of its purchases; grids of one user overlap."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("at"))
    anchors = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("anchor"), F.col("at").alias("t0"))
    return intervals.grid_counts(anchors, e, ["user_id"], "anchor")


@query("""WITH s AS (SELECT l_partkey AS repo, l_shipdate AS t FROM lineitem), q AS (SELECT o_orderkey AS job, o_custkey % 97 AS repo, o_orderdate AS o FROM orders)
SELECT job, q.repo, o AS "now", count(t) FILTER (t >= o - INTERVAL 24 HOUR) AS stars_24h, count(t) AS stars_7d FROM q LEFT
  JOIN s ON s.repo = q.repo AND t BETWEEN o - INTERVAL 168 HOUR AND o GROUP BY job, q.repo, o""")
def j15_stars_up_to_each_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every job, at its own time, the stars of its repository in the day and the week before, both ends included."""
    stars = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("repo"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"))
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job"), (F.col("o_custkey") % 97).alias("repo"), F.col("o_orderdate").cast("timestamp_ntz").alias("now")
    )
    return intervals.counts_within(stars, jobs, ["repo"], "job", {"stars_24h": 24, "stars_7d": 168})


@query("""WITH a AS (SELECT user_id, ts AS known_at, event_id AS alias_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
  WHERE event_type IN ('signup', 'click'))
SELECT event_id, user_id, (SELECT max_by('github:o/' || k, struct_pack(t := known_at, i := alias_id)) FROM a
  WHERE a.user_id = e.user_id AND a.known_at <= e.ts) AS alias FROM events e WHERE event_type IN ('view', 'error', 'click')""")
def j7_alias_known_at_the_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with the alias that its entity had when it was seen, its own moment included."""
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("at"), F.get_json_object("props", "$.k").alias("k")
    )
    aliases = e.filter("event_type in ('signup', 'click')").select(
        "user_id", F.col("at").alias("known_at"), F.col("event_id").alias("alias_id"), F.concat(F.lit("github:o/"), "k").alias("alias")
    )
    seen = e.filter("event_type in ('view', 'error', 'click')").select("event_id", "user_id", "at")
    return asof.known_at(
        seen, aliases, ["user_id"], "at", "known_at", ["alias"], [F.col("alias_id")]
    ).select("event_id", "user_id", "alias")


@query("""WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, left((SELECT max_by(t.text, t.turn) FROM t WHERE t.conv_id = c.conv_id AND t.turn <= c.turn), 1000) AS preview
  FROM conversations c WHERE c.role = 'user'""")
def j8_text_known_at_the_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the latest assistant's text before it, its first thousand characters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    texts = c.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("fetched"), F.substring("text", 1, 1000).alias("preview"))
    return asof.known_at(c.filter("role = 'user'").select("conv_id", "turn"), texts, ["conv_id"], "turn", "fetched", ["preview"])


@query("""WITH e AS (SELECT DISTINCT 'brand-' || substr(p_brand, 7) AS slug FROM part),
m AS (SELECT slug, p_partkey, substr(p_brand, 7) AS b, row_number() OVER (PARTITION BY slug ORDER BY p_partkey DESC) AS n
  FROM e JOIN part ON contains('brand ' || substr(p_brand, 7), replace(slug, '-', ' '))),
f AS (SELECT DISTINCT slug, unnest(['github:org/brand-' || CASE WHEN p_partkey % 2 = 0 THEN b ELSE 'x' END,
  CASE WHEN p_partkey % 3 = 0 THEN 'npm:@s/brand-' || b ELSE 'npm:other' END, 'domain:brand-' || b || '.dev']) AS key FROM m WHERE n <= 20)
SELECT 'name:' || slug AS entity_key, key, 1.0::DOUBLE AS confidence FROM f
  WHERE key IN ('github:org/' || slug, 'npm:@s/' || slug, 'domain:' || slug || '.dev')""")
def c8_links_of_looked_up_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named by brands are looked up in the items' texts, and the newest matches' links taken where they bear the exact name."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    key, brand = F.col("p_partkey"), F.substring("p_brand", 7, 9)
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    repo = text("see https://github.com/Org/Brand-", F.when(key % 2 == 0, brand).otherwise("x"), ".")
    package = F.when(key % 3 == 0, text("https://www.npmjs.com/package/@s/brand-", brand)).otherwise("https://npmjs.com/package/other")
    items = spread(parts).select(
        key.alias("item_id"), text("Brand ", brand).alias("name"), text("https://www.brand-", brand, ".dev/x").alias("url"),
        repo.alias("description"), F.create_map(F.lit("homepage"), package).alias("metadata"),
    )
    entities = parts.select(text("name:brand-", brand).alias("entity_key")).distinct()
    return M.internal_links(containment.matched_items(entities, items), items)

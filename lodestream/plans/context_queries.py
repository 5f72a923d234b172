"""Context, read models, checks, sinks and page readers over the driver's tables: the whole form of operators that other modules show in part."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import context as C
from lodestream.operators import mentions as M
from lodestream.operators import quality as V
from lodestream.operators import scoring as L
from lodestream.operators import snapshots as S
from lodestream.operators.components import shared_folder
from lodestream.operators.windows import spread_ranked
from lodestream.sources import landed as P

from .feed_queries import _FEED, _L2, _scored
from .fixtures import GROUPS_SQL, ITEMS_SQL, LINKS_SQL, groups, items, links, now, with_sql
from .registry import query, table

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lodestream/{name}-{uuid.uuid4().hex}"


# --- page readers ---------------------------------------------------------------------------------------------------


def _page(df: DataFrame, key: str, order: str, size: int):
    return spread_ranked(df, "_n", [key], [F.col(order).asc()]).groupBy(key, F.floor((F.col("_n") - 1) / size).alias("page"))


def _joined(block: Column, order: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("v")))), lambda r: r["v"]), "\n"
    )


_PART_PAGES = "p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)"


@query(with_sql(_PART_PAGES, then="""SELECT 'daily:own' || p_size || '/repo' || p_partkey AS external_id, n % 25 + 1 AS source_rank, 'about ' || lower(p_type) AS description,
  CAST(p_size AS VARCHAR) AS period_stars, CAST(1000 + p_size AS VARCHAR) AS stars_total,
  CASE WHEN p_partkey % 3 = 0 THEN 'Rust' ELSE p_brand END AS language, '24h' AS "window" FROM p"""))
def s1_trending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 25 repositories, written as HTML and read again."""
    size, key = _s("p_size"), _s("p_partkey")
    block = _cat(
        '<article class="Box-row"><h2 class="h3 lh-condensed"><a href="/own', size, "/repo", key, '">x</a></h2><p class="col-9 color-fg-muted my-1">about&nbsp;<b>', F.lower("p_type"), "</b></p>",
        F.when(F.col("p_partkey") % 3 == 0, '<span itemprop="programmingLanguage">Rust</span>').otherwise(""), '<a href="/own/repo/stargazers" class="m">1,', F.lpad(size, 3, "0"), "</a> ", size, " stars today</article>",
    )
    landed = _page(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 25).agg(_joined(block, "p_partkey").alias("payload"))
    out = P.trending_pages(landed.select(F.lit("daily").alias("period"), F.col("p_brand").alias("language"), "payload"))
    m = F.col("metadata")
    return out.select(
        "external_id", "source_rank", "description", m["period_stars"].alias("period_stars"), m["stars_total"].alias("stars_total"),
        m["language"].alias("language"), m["window"].alias("window")
    )


@query(with_sql(_PART_PAGES, then="""SELECT 'trending-repos:' || period || ':o/r' || p_partkey AS external_id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE n % 60 + 1 END AS source_rank,
  '[' || p_size || '.0,1.0]' AS sparkline, CASE WHEN period = 'past_24_hours'
  AND p_partkey % 2 = 1 THEN 'past_24_hours' ELSE 'past_week' END AS line_from FROM p, (VALUES ('past_24_hours'), ('past_week')) v(period)
  WHERE n % 60 < 30"""))
def s3_mover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of two periods in script chunks; a daily row without a sparkline takes the weekly one; 30 rows of a period count."""
    name, rank = _cat("o/r", _s("p_partkey")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    line = F.array(F.col("p_size").cast("double"), F.lit(1.0))
    row = lambda own: F.struct(name.alias("fullName"), rank.alias("rank"), own.alias("sparkline"))
    daily = row(F.when(F.col("p_partkey") % 2 == 1, line).otherwise(F.array().cast("array<double>")))
    rows = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("o"), v.alias("v")))), lambda r: r["v"])
    pages = _page(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 60).agg(rows(daily).alias("d"), rows(row(line)).alias("w"))
    text = _cat('{"x":{"initialRepositories":', F.to_json(F.struct(F.col("d").alias("past_24_hours"), F.col("w").alias("past_week"))), "}}")
    quoted = F.expr("substring(j, 6, length(j) - 6)")  # the text as a JSON string
    landed = pages.withColumn("j", F.to_json(F.struct(text.alias("t")))).select(
        _cat("<html><script>self.__next_f.push([1,", quoted, "])</script></html>").alias("payload")
    )
    out = P.mover_pages(landed, ("past_24_hours", "past_week"), 30)
    return out.select(
        "external_id", "source_rank", F.col("metadata")["sparkline"].alias("sparkline"),
        F.col("metadata")["sparkline_source_period"].alias("line_from")
    )


@query(
    with_sql(
        _PART_PAGES,
        then="""SELECT 'repofomo:o/r' || p_partkey AS external_id, n % 100 + 1 AS source_rank, CAST(CAST(1000 + p_size AS DOUBLE) AS VARCHAR) AS stars_total,
  CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS stars_7d, CAST(p_size + 0.5 AS VARCHAR) AS growth FROM p"""
    )
)
def s4_leaderboard_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _s("p_size")
    row = F.create_map(
        F.lit("name"), _cat("o/r", _s("p_partkey")), F.lit("tot_stars"), _cat("1,", F.lpad(size, 3, "0")), F.lit("7d_new"), size,
        F.lit("7d%"), _cat(size, ".5%")
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.to_json(row).alias("v")))), lambda r: r["v"])
    landed = _page(table(spark, sf_dir, "part"), "p_brand", "p_partkey", 100).agg(
        _cat("const data = [", F.array_join(rows, ",\n"), "];\nrender(data);").alias("payload")
    )
    m = F.col("metadata")
    return P.leaderboard_script(landed, 100).select(
        "external_id", "source_rank", m["stars_total"].alias("stars_total"), m["stars_7d"].alias("stars_7d"),
        m["growth_7d_percent"].alias("growth")
    )


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'newest' ELSE 'updates' END AS feed, row_number() OVER (PARTITION BY p_partkey % 2
  ORDER BY p_partkey) - 1 AS n FROM part)
SELECT CASE feed WHEN 'newest' THEN 'newest:pkg' || p_partkey || ':' ELSE 'updates:pkg' || p_partkey || ':1.' || p_size END AS external_id, n + 1 AS source_rank,
  CASE WHEN p_partkey % 5 > 0 THEN 'a ' || lower(p_type) WHEN n < 300 AND p_partkey % 3 > 0 THEN 'sum ' || p_partkey ELSE '' END AS description, CASE
  WHEN n < 300 AND p_partkey % 3 > 0 THEN '2024-02-0' || (1 + p_size % 9) END AS uploaded FROM p WHERE n < 400""")
def s11_package_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds written as XML and read by items; the first 400 of each count, and the first 300 look for their package."""
    part = table(spark, sf_dir, "part").withColumn("feed", F.when(F.col("p_partkey") % 2 == 0, "newest").otherwise("updates"))
    rows = spread_ranked(part, "n", ["feed"], [F.col("p_partkey").asc()])
    name = _cat("pkg", _s("p_partkey"))
    title = F.when(F.col("feed") == "newest", _cat(name, " added to PyPI")).otherwise(_cat(name, " 1.", _s("p_size")))
    told = F.when(F.col("p_partkey") % 5 > 0, _cat("&lt;p&gt;a ", F.lower("p_type"), "&lt;/p&gt;")).otherwise("")
    item = _cat(
        "<item><feed>", F.col("feed"), "</feed><pos>", _s(F.col("n") - 1), "</pos><title>", title,
        "</title><link>https://pypi.org/project/", name, "/</link><description>", told, "</description></item>"
    )
    path = _folder(spark, "feeds")
    documents = rows.groupBy("feed", F.floor((F.col("n") - 1) / 1000).alias("page")).agg(
        _cat("<rss><channel>", _joined(item, "n"), "</channel></rss>").alias("value")
    )
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a file is a document
    entries = spark.read.format("xml").option("rowTag", "item").schema(
        "feed string, pos long, title string, link string, description string, pubDate string, author string"
    ).load(path)
    body = F.to_json(
        F.struct(
            F.struct(_cat("sum ", _s("p_partkey")).alias("summary")).alias("info"),
            F.array(
                F.struct(F.lit("2024-01-01").alias("upload_time_iso_8601")),
                F.struct(_cat("2024-02-0", _s(1 + F.col("p_size") % 9)).alias("upload_time_iso_8601"))
            ).alias("urls")
        )
    )
    packages = part.filter("p_partkey % 3 > 0").select(name.alias("name"), body.alias("payload"))
    out = P.package_feeds(entries, packages, 400, 300)
    return out.select("external_id", "source_rank", "description", F.col("metadata")["latest_upload_time"].alias("uploaded"))


@query(
    with_sql(
        LINKS_SQL,
        then=r"""SELECT event_id, array_to_string(list_filter([CASE WHEN k % 5 > 0 THEN '@user' || k END, '#tag' || (k % 3), CASE event_id % 2
  WHEN 0 THEN 'github:own/repo' || k ELSE 'domain:site' || user_id || '.example' END, CASE
  WHEN k % 4 = 0 THEN 'term:agent kit' END], lambda x: x IS NOT NULL), ',') AS projects FROM links"""
    )
)
def x11_projects_in_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user = _s("k"), _s("user_id")
    url = F.when(
        F.col("event_id") % 2 == 0, _cat("https://github.com/Own/Repo", k, ".git")
    ).otherwise(_cat("https://site", user, ".example/a?b"))
    text = _cat(
        "hi @User", k, " and #Tag", _s(F.col("k") % 3), " #tag", _s(F.col("k") % 3), " see ", url,
        F.when(F.col("k") % 4 == 0, " the Agent Kit.").otherwise(" the agent kits")
    )
    author = F.when(F.col("k") % 5 == 0, _cat("uSER", k)).otherwise("someone")
    return links(spark, sf_dir).select("event_id", F.array_join(P.projects_in(text, author, ("agent kit",)), ",").alias("projects"))


# --- native metrics and order, filters ------------------------------------------------------------------------------

_META_SQL = """meta AS (SELECT *, CASE source WHEN 'npm_registry' THEN 'npm_search' WHEN 'huggingface_models' THEN CASE
  WHEN k % 2 = 0 THEN 'x_tweets' ELSE 'huggingface_models' END ELSE source END AS src, CASE WHEN k % 7 > 0 THEN k END AS rank, CASE k % 3
  WHEN 0 THEN '24h' WHEN 1 THEN '7d' ELSE 'current' END AS win FROM items)"""


def _with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = items(spark, sf_dir), F.col("k")
    src = F.when(F.col("source") == "npm_registry", "npm_search").when(
        (F.col("source") == "huggingface_models") & (k % 2 == 0), "x_tweets"
    ).otherwise(F.col("source"))
    pairs = {
        "period_stars": F.col("metric"), "points": k % 4, "score": F.col("metric"), "votes": k, "trending_score": F.lit("n/a"),
        "weekly_downloads": F.col("metric") * 7, "query_label": _cat("q", _s(k % 5)),
        "scope_language": F.when(k % 2 == 0, "all").otherwise("rust")
    }
    meta = F.map_from_arrays(F.array(*[F.lit(p) for p in pairs]), F.array(*[v.cast("string") for v in pairs.values()]))
    window = F.when(k % 3 == 0, "24h").when(k % 3 == 1, "7d").otherwise("current")
    return i.withColumns({"src": src, "metadata": meta, "rank": F.when(k % 7 > 0, k), "win": window})


@query(
    with_sql(
        ITEMS_SQL, _META_SQL,
        then="""SELECT item_id, CASE src WHEN 'github_trending' THEN metric WHEN 'hn_algolia' THEN CASE WHEN k % 4 > 0 THEN k % 4 ELSE metric END
  WHEN 'product_hunt' THEN k WHEN 'npm_search' THEN metric * 7 WHEN 'x_tweets' THEN rank END * 1.0::DOUBLE AS native FROM meta"""
    )
)
def f13_native_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_metadata(spark, sf_dir).select("item_id", S.native_metric(F.col("src"), F.col("metadata"), F.col("rank")).alias("native"))


@query(with_sql(ITEMS_SQL, _META_SQL, """o AS (SELECT *, CASE WHEN src IN ('github_trending', 'hn_algolia', 'x_tweets') THEN CASE win WHEN '24h' THEN 0
  WHEN '7d' THEN 1 ELSE 4 END ELSE 0 END AS a, CASE WHEN src = 'github_trending' AND k % 2 = 1 THEN 1 ELSE 0 END AS b,
  CASE src WHEN 'github_trending' THEN CASE WHEN k % 2 = 0 THEN 'all' ELSE 'rust' END WHEN 'hn_algolia' THEN 'q' || (k % 5)
  WHEN 'npm_search' THEN 'q' || (k % 5) ELSE '' END AS c, coalesce(rank, 10000) AS d FROM meta)""",
  then="""SELECT item_id, row_number() OVER (PARTITION BY src ORDER BY a, b, c, d, entity_key, item_id) AS channel_rank,
  row_number() OVER (PARTITION BY src, win ORDER BY a, b, c, d, entity_key, item_id) AS window_rank FROM o"""))
def w1_w2_native_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = S.native_order(F.col("src"), F.col("win"), F.col("metadata"), F.col("rank"), F.col("entity_key"))
    rows = _with_metadata(spark, sf_dir).select("item_id", F.col("src").alias("channel"), F.col("win").alias("window"), order.alias("o"))
    return S.channel_ranks(rows, [F.col("o").asc(), F.col("item_id").asc()]).select("item_id", "channel_rank", "window_rank")


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT item_id, k % 5 = 3 OR contains(lower(entity_key), 'q3')
  OR contains(CAST(metric AS VARCHAR), 'q3') AS found, metric > 0 AS positive, k % 3 = 1 AS week FROM items"""
    )
)
def f9_f10_text_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _with_metadata(spark, sf_dir)
    found = S.matches_text([F.col("entity_key"), F.col("url")], F.col("metadata"), "Q3")
    return r.select(
        "item_id", found.alias("found"), S.in_range(F.col("metadata")["period_stars"], F.col("win"), "stars").alias("positive"),
        S.in_range(F.col("metric"), F.col("win"), "7d").alias("week")
    )


@query(with_sql(GROUPS_SQL, then="SELECT group_id, group_id % 10 = 0 OR group_id % 7 = 0 OR group_id % 13 = 1 AS known FROM groups"))
def f14_known_paradigms(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("group_id")
    key = F.when(g % 10 == 0, " GitHub:Some/Agent ").otherwise(_cat("domain:s", _s(g), ".dev"))
    link = F.when(g % 7 == 0, "https://github.com/Some/Agent/tree/main/").otherwise(_cat("https://github.com/o/r", _s(g)))
    name = F.when(g % 13 == 1, "The Agent").otherwise(F.col("canonical_name"))
    return groups(spark, sf_dir).select("group_id", C.known_paradigm([name, key, link], ("github:some/agent", "the agent")).alias("known"))


# --- context --------------------------------------------------------------------------------------------------------

_BUNDLE_SQL = """keyed AS (SELECT *, 'https://github.com/' || regexp_replace(entity_key, '^[a-z]+:', '') AS gh, 'https://' || regexp_replace(entity_key, '^[a-z]+:', '') AS dom
  FROM items),
al AS (SELECT entity_key, min(CASE WHEN k % 13 = 0 THEN 'github:al/r' || user_id END) AS g, min(CASE WHEN k % 11 = 0
  AND k % 13 > 0 THEN 'npm:pkg' || user_id END) AS p FROM items WHERE k % 11 = 0 OR k % 13 = 0 GROUP BY entity_key),
src AS (SELECT entity_key, min_by(url, item_id) FILTER (k % 3 = 0) AS u, min(item_id) FILTER (k % 2 = 0) AS d FROM items GROUP BY entity_key),
ev AS (SELECT entity_key, count(DISTINCT family || ':' || (metric // 100)) AS evidence_count, array_to_string(list_sort(list(DISTINCT family)), ',') AS families,
  count(*) AS source_link_count, array_to_string(list(CASE WHEN k % 3 = 0 THEN url ELSE 'none' END ORDER BY item_id)[1:12], ' ') AS source_links
  FROM items GROUP BY entity_key),
e AS (SELECT DISTINCT entity_key, key_type, user_id FROM items)"""


@query(with_sql(ITEMS_SQL, _BUNDLE_SQL, then="""SELECT entity_key, CASE key_type WHEN 'github' THEN 'https://github.com/' || regexp_replace(entity_key, '^[a-z]+:', '')
  WHEN 'domain' THEN 'https://' || regexp_replace(entity_key, '^[a-z]+:', '')
  ELSE coalesce('https://github.com/' || regexp_replace(g, '^[a-z]+:', ''), 'https://www.npmjs.com/package/' || regexp_replace(p, '^[a-z]+:', ''), u) END AS canonical_link,
  CASE WHEN key_type <> 'name' THEN 'verified' WHEN coalesce(g, p) IS NOT NULL THEN 'resolved' WHEN u IS NOT NULL THEN 'weak' ELSE 'none' END AS binding,
  CASE WHEN (key_type = 'github' OR g IS NOT NULL) AND user_id % 4 > 0 THEN 'Read me ' || user_id ELSE coalesce('about ' || d, '') END AS context_preview,
  (key_type = 'github' OR g IS NOT NULL) AND user_id % 4 > 0 AS has_readme, evidence_count, families, source_link_count, source_links FROM e LEFT
  JOIN al USING (entity_key) LEFT JOIN src USING (entity_key) LEFT JOIN ev USING (entity_key)"""))
def g3_context_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bundles(spark, sf_dir)
    return out.withColumns({"families": F.array_join("families", ","), "source_links": F.array_join("source_links", " ")})


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k, user = items(spark, sf_dir), F.col("k"), _s("user_id")
    entities = i.select("entity_key", F.col("entity_key").alias("canonical_key")).distinct()
    alias = F.when(k % 13 == 0, _cat("github:al/r", user)).otherwise(_cat("npm:pkg", user))
    aliases = i.filter("k % 11 = 0 or k % 13 = 0").select(
        "entity_key", alias.alias("alias"), F.lit("rule").alias("origin"), F.lit("x").alias("external"), F.lit(True).alias("approved"),
        F.col("item_id").alias("id")
    )
    sources = i.select(
        "entity_key", "item_id", F.when(k % 3 == 0, F.col("url")).otherwise("none").alias("url"),
        F.when(k % 2 == 0, _cat("about **", _s("item_id"), "**")).otherwise("").alias("description")
    )
    users = i.select("entity_key", "user_id").distinct()
    repo = F.explode(F.array(F.regexp_replace("entity_key", "^github:", ""), _cat("al/r", user)))
    texts = users.select(
        repo.alias("key"), F.when(F.col("user_id") % 4 > 0, "ok").otherwise("error").alias("status"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), "user_id"
    )
    texts = texts.withColumn("text", F.when(F.col("at") == 2, _cat("# Read\n`me` ", user)).otherwise("old"))
    label = F.concat(F.col("family"), F.lit(":"), _s(F.floor(F.col("metric") / 100)))
    evidence = i.select(
        "entity_key", label.alias("label"), "family", F.lit("rule").alias("origin"), F.lit("rule").alias("badge"),
        F.col("item_id").alias("id"), F.lit("weak").alias("strength"), F.col("item_id").alias("ref")
    )
    return C.context_bundles(entities, aliases, sources, texts, evidence)


@query(with_sql(ITEMS_SQL, """best AS (SELECT entity_key, max(metric) AS m, min(user_id) AS u FROM items GROUP BY entity_key)""", _BUNDLE_SQL, then="""SELECT b.entity_key, CASE WHEN m >= 1200 THEN 'high_potential' WHEN m >= 900 THEN 'potential' ELSE 'edge_watch' END AS level,
  row_number() OVER (ORDER BY CASE WHEN m >= 1200 THEN 0 WHEN m >= 900 THEN 1 ELSE 2 END, 'Entity ' || b.u, b.entity_key) AS place, CASE
  WHEN key_type <> 'name' THEN 'verified' WHEN coalesce(g, p) IS NOT NULL THEN 'resolved' WHEN s.u IS NOT NULL THEN 'weak' ELSE 'none' END AS binding
  FROM best b JOIN e USING (entity_key) LEFT JOIN al USING (entity_key) LEFT JOIN src s USING (entity_key)"""))
def q2_j2_candidates_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by level, then name, each with its context bundle."""
    best = items(spark, sf_dir).groupBy("entity_key").agg(F.max("metric").alias("m"), F.min("user_id").alias("u"))
    level = F.when(F.col("m") >= 1200, "high_potential").when(F.col("m") >= 900, "potential").otherwise("edge_watch")
    rows = best.select(
        "entity_key", level.alias("level"), _cat("Entity ", _s("u")).alias("name")
    ).join(bundles(spark, sf_dir), "entity_key")
    order = F.when(F.col("level") == "high_potential", 0).when(F.col("level") == "potential", 1).otherwise(2)
    return spread_ranked(
        rows.select("entity_key", "level", "name", "binding"), "place", [], [order.asc(), F.col("name").asc(), F.col("entity_key").asc()]
    ).drop("name")


@query("""WITH m AS (SELECT c_nationkey AS group_id, c_custkey AS ord, CASE c_custkey % 4 WHEN 0 THEN 'name:n' || c_custkey
  WHEN 1 THEN 'domain:s' || c_custkey || '.dev' ELSE '' END AS ck, CASE WHEN c_custkey % 97 = 0 THEN 'github:A/b' || c_custkey
  WHEN c_custkey % 5 = 0 THEN 'npm:p' || c_custkey END AS alias FROM customer)
SELECT group_id, coalesce(min_by(CASE WHEN starts_with(alias, 'github:') THEN 'https://github.com/' || lower(substr(alias, 8)) END, ord) FILTER (starts_with(alias, 'github:')),
  min_by(coalesce(CASE WHEN starts_with(ck, 'domain:') THEN 'https://' || substr(ck, 8) END, CASE
  WHEN starts_with(alias, 'npm:') THEN 'https://www.npmjs.com/package/' || substr(alias, 5) END), ord) FILTER (starts_with(ck, 'domain:')
  OR starts_with(alias, 'npm:')), '') AS link FROM m GROUP BY group_id""")
def g2_best_group_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = F.col("c_custkey"), _s("c_custkey")
    canonical = F.when(c % 4 == 0, _cat("name:n", key)).when(c % 4 == 1, _cat("domain:s", key, ".dev")).otherwise("")
    alias = F.when(c % 97 == 0, _cat("github:A/b", key)).when(c % 5 == 0, _cat("npm:p", key))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("group_id"), c.alias("ord"), key.alias("entity_key"), canonical.alias("canonical_key"),
        alias.alias("alias")
    )
    return C.best_group_links(rows.select("group_id", "ord", "entity_key"), rows.select("entity_key", "canonical_key", "alias"))


@query("""WITH f AS (SELECT conv_id AS group_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id
  ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn) AS n FROM conversations WHERE trim(text) <> '' AND turn % 5 <> 4),
a AS (SELECT group_id, array_to_string(list(left(t, 1000) ORDER BY n), '|') AS facts FROM f WHERE n <= 12 GROUP BY group_id),
r AS (SELECT group_id, ref, min(n * 10 + i) AS pos
  FROM (SELECT group_id, n, unnest(['turn:' || turn, 'pair:' || (turn // 2)]) AS ref, unnest([1, 2]) AS i FROM f WHERE n <= 12)
  GROUP BY group_id, ref)
SELECT group_id, facts, refs FROM a JOIN (SELECT group_id, array_to_string(list(ref ORDER BY pos)[1:12], ',') AS refs FROM r GROUP BY group_id) USING (group_id)""")
def l8_fact_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    refs = F.when(t % 5 != 4, F.array(_cat("turn:", _s("turn")), _cat("pair:", _s(F.floor(t / 2)))))
    polarity = F.when(F.col("role") == "user", "supporting").otherwise("negative")
    claims = c.select(
        F.col("conv_id").alias("group_id"), polarity.alias("polarity"), t.alias("ord"), F.col("text").alias("claim"),
        refs.alias("evidence_refs"), F.array(F.lit("momentum")).alias("supports_axes"), F.lit("observed").alias("claim_type")
    )
    out = C.fact_packets(claims)
    return out.select(
        "group_id", F.array_join(F.transform("facts", lambda f: f["fact"]), "|").alias("facts"), F.array_join("refs", ",").alias("refs")
    )


@query("""WITH m AS (SELECT c_nationkey AS group_id, c_custkey AS ord, CASE
  WHEN c_custkey % 3 = 0 THEN 'about ' || (c_custkey % 20) END AS preview, c_custkey % 50 = 0 AS readme, CASE
  WHEN c_custkey % 4 = 0 THEN 'note ' || (c_custkey % 7) END AS note, 'src' || (c_custkey % 2) AS source, 'title ' || (c_custkey % 11) AS title
  FROM customer),
p AS (SELECT group_id, preview, min(ord) AS o FROM m WHERE preview IS NOT NULL GROUP BY ALL), n AS (SELECT group_id, note, min(ord) AS o FROM m
  WHERE note IS NOT NULL GROUP BY ALL), s AS (SELECT group_id, source || '/' || title || '/' AS e, min(ord) AS o FROM m GROUP BY ALL)
SELECT group_id, bool_or(readme) AS has_readme, (SELECT array_to_string(list(preview ORDER BY o)[1:8], '|') FROM p
  WHERE p.group_id = m.group_id) AS project_context, (SELECT array_to_string(list(note ORDER BY o)[1:8], '|') FROM n
  WHERE n.group_id = m.group_id) AS summaries, (SELECT array_to_string(list(e ORDER BY o)[1:12], '|') FROM s WHERE s.group_id = m.group_id) AS sources
  FROM m GROUP BY group_id""")
def l9_scout_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group_id"), c.alias("ord"))
    k = F.col("ord")
    members = m.select(
        "group_id", "ord", F.when(k % 3 == 0, _cat(" about\n", _s(k % 20))).otherwise(" ").alias("context_preview"),
        (k % 50 == 0).alias("has_readme")
    )
    notes = m.select("group_id", "ord", F.when(k % 4 == 0, _cat("note  ", _s(k % 7))).alias("note"))
    sources = m.select(
        "group_id", "ord", _cat("src", _s(k % 2)).alias("source"), _cat("title ", _s(k % 11)).alias("title"), F.lit("").alias("url")
    )
    out = C.scout_contexts(members, notes, sources)
    entries = F.transform("source_context", lambda x: F.concat_ws("/", x["source"], x["title"], x["url"]))
    return out.select(
        "group_id", "has_readme", F.array_join("project_context", "|").alias("project_context"),
        F.array_join("qualitative_summaries", "|").alias("summaries"), F.array_join(entries, "|").alias("sources")
    )


@query("""WITH s AS (SELECT conv_id AS id, turn % 4 = 3 AS raw, CAST(ceil(strlen(text) / 4.0) AS BIGINT) * 40 AS tokens
  FROM conversations), t AS (SELECT id, sum(tokens) AS a, coalesce(sum(tokens) FILTER (raw), 0) AS r, count(*) FILTER (raw) AS n FROM s GROUP BY id)
SELECT id, CAST(CASE WHEN a > 4000 AND n > 0 THEN a - r ELSE a END AS BIGINT) AS total, a > 4000 AND n > 0 AS dropped_raw, CASE WHEN a > 4000
  AND n > 0 THEN a - r ELSE a END > 4000 AS rejected FROM t""")
def l10_fitted_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.functions.scalars import token_estimate

    section = F.when(F.col("turn") % 4 == 3, "recent_raw_tool_results").otherwise(F.col("role"))
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), section.alias("section"), (token_estimate(F.col("text")) * 40).alias("tokens")
    )
    return C.fitted_contexts(c, most=4000)


@query("""WITH RECURSIVE r AS (SELECT user_id AS id, event_id, event_id % 37 + 1 AS t, event_id % 3 > 0 AS ok, row_number() OVER (PARTITION BY user_id
  ORDER BY value DESC, event_id) AS n FROM events),
f(id, n, used, a, b, c) AS (SELECT id, 0, CAST(0 AS BIGINT), '', '', '' FROM r GROUP BY id
  UNION ALL SELECT f.id, f.n + 1, CASE WHEN f.used + r.t <= 120 THEN f.used + r.t ELSE f.used END, CASE
  WHEN f.used + r.t <= 120 THEN f.a || ',' || r.event_id ELSE f.a END,
  CASE WHEN f.used + r.t > 120 AND r.ok THEN f.b || ',' || r.event_id ELSE f.b END, CASE WHEN f.used + r.t > 120
  AND NOT r.ok THEN f.c || ',' || r.event_id ELSE f.c END FROM f JOIN r ON r.id = f.id AND r.n = f.n + 1 WHERE f.n < 80)
SELECT id, substr(max_by(a, n), 2) AS included, substr(max_by(b, n), 2) AS retrievable, substr(max_by(c, n), 2) AS excluded FROM f GROUP BY id""")
def l10_allocated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), e.alias("item_id"), "value", (e % 37 + 1).alias("tokens"), (e % 3 > 0).alias("retrievable")
    )
    out = C.allocated(rows, 120)
    return out.select("id", *[F.array_join(F.transform(c, _s), ",").alias(c) for c in ("included", "retrievable", "excluded")])


@query(with_sql(GROUPS_SQL, _L2, _FEED, then="""SELECT f.group_id, f.section, f.place, s.canonical_name, s.score, CASE WHEN f.group_id % 3 = 0 THEN 'report ' || f.group_id END AS report, CASE
  WHEN f.group_id % 4 = 0 THEN 'brief ' || f.group_id END AS brief, o.vote, f.group_id % 40 = 0 AS known_paradigm,
  CASE WHEN f.section = 'today_focus' THEN 'focus' WHEN f.section = 'scored' OR f.route = 'suppress_or_low' THEN CASE
  WHEN f.route = 'score_only' THEN 'signals' ELSE 'low' END ELSE 'diagnostics' END AS shown_as
  FROM feed f JOIN scored s USING (group_id) LEFT JOIN (SELECT o_custkey AS group_id, max_by(CASE o_orderkey % 3 WHEN 0 THEN 'up'
  WHEN 1 THEN 'down' ELSE 'clear' END, o_orderkey) AS vote FROM orders GROUP BY o_custkey) o ON o.group_id = f.group_id AND o.vote <> 'clear'"""))
def j3_q1_full_feed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, g, k = _scored(spark, sf_dir), F.col("group_id"), F.col("o_orderkey")
    vote = F.when(k % 3 == 0, "up").when(k % 3 == 1, "down").otherwise("clear")
    votes = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").alias("group_id")
    ).agg(F.max_by(vote, k).alias("vote")).filter("vote != 'clear'")
    shown = scored.select(
        "group_id", "canonical_name", F.when(g % 40 == 0, "GitHub:Some/Agent").otherwise("").alias("canonical_key"),
        F.lit("").alias("canonical_link")
    )
    made = lambda n, name: scored.filter(g % n == 0).select("group_id", _cat(f"{name} ", _s("group_id")).alias(name))
    out = C.feed_read_model(
        L.feed(scored, g % 50 == 0), shown, scored.select("group_id", "score"), made(3, "report"), made(4, "brief"), votes,
        ("github:some/agent",)
    )
    return out.select("group_id", "section", "place", "canonical_name", "score", "report", "brief", "vote", "known_paradigm", "shown_as")


# --- classifier answers, links, registries --------------------------------------------------------------------------

_UNITS_SQL = """r AS (SELECT item_id, 'x' || item_id AS external_id, 'u' || user_id AS unit_key, user_id AS u FROM items WHERE source = 'hn_algolia')"""


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i, u = items(spark, sf_dir), F.col("user_id")
    units = i.filter("source = 'hn_algolia'").select(
        _cat("u", _s("user_id")).alias("unit_key"), "item_id", _cat("x", _s("item_id")).alias("external_id"),
        F.lit("a title").alias("title")
    )
    sure = F.when(u % 4 == 0, F.array().cast("array<string>")).when(u % 4 == 1, F.array(_cat("github:o/r", _s(u)))).otherwise(
        F.array(_cat("github:o/r", _s(u)), _cat("npm:p", _s(u)))
    )
    proposed = F.when(
        u % 3 == 0, F.array(F.struct(_cat("domain:s", _s(u), ".dev").alias("key"), F.lit(0.5).alias("confidence")))
    ).otherwise(F.array().cast("array<struct<key:string,confidence:double>>"))
    answer = F.when(u % 5 == 0, "project").when(u % 5 == 1, "company_product").otherwise("news_article")
    outputs = i.select("user_id").distinct().select(
        _cat("u", _s(u)).alias("unit_key"), answer.alias("projectness"),
        F.when(u % 2 == 0, _cat("Name ", _s(u))).otherwise("").alias("canonical_name"), F.lit("says so").alias("summary"),
        sure.alias("sure_links"), proposed.alias("proposed_links")
    )
    return M.classified(outputs, units)


@query(with_sql(ITEMS_SQL, _UNITS_SQL, then="""SELECT CASE WHEN u % 4 = 0 THEN 'hn:' || item_id ELSE 'github:o/r' || u END AS entity_key, item_id, CASE u % 5 WHEN 0 THEN 'project'
  WHEN 1 THEN 'company_product' ELSE 'news_article' END AS metric_value, CASE u % 5 WHEN 0 THEN 'watch'
  WHEN 1 THEN 'context' ELSE 'noise' END AS signal_label,
  CASE WHEN u % 2 = 0 THEN 'Name ' || u ELSE 'a title' END || ': says so' AS note, 'item:' || item_id AS ref FROM r"""))
def c5_classifier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)[0].drop("metric_name")


@query(with_sql(ITEMS_SQL, _UNITS_SQL, then="""SELECT entity_key, alias, min(external_id) AS external_id, NULL::DOUBLE AS confidence
  FROM (SELECT 'github:o/r' || u AS entity_key, external_id, unnest(CASE
  WHEN u % 4 = 1 THEN ['github:o/r' || u] ELSE ['github:o/r' || u, 'npm:p' || u] END) AS alias FROM r WHERE u % 4 > 0) GROUP BY entity_key, alias
UNION ALL SELECT CASE WHEN u % 4 = 0 THEN 'hn:' || item_id ELSE 'github:o/r' || u END, 'domain:s' || u || '.dev', NULL, 0.5 FROM r WHERE u % 3 = 0"""))
def c5_aliases_and_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, aliases, proposals = _classified(spark, sf_dir)
    return aliases.unionByName(proposals.select("entity_key", F.col("orphan").alias("alias"), "confidence"), allowMissingColumns=True)


@query("""SELECT event_id, m AS metric_name, v AS metric_value
  FROM (SELECT event_id, unnest(['x_tier', 'x_summary', 'x_confidence', 'x_authors', 'x_credible', 'x_mentions', 'x_acceleration']) AS m,
  unnest([event_type, 'about ' || user_id, CAST(event_id % 10 AS VARCHAR), CAST(event_id % 5 AS VARCHAR), CAST(event_id % 3 AS VARCHAR),
  CAST(event_id % 7 AS VARCHAR), CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 4 AS VARCHAR) END]) AS v FROM events) WHERE v IS NOT NULL""")
def c6_seven_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    named = {
        "x_tier": F.col("event_type"), "x_summary": _cat("about ", _s("user_id")), "x_confidence": _s(e % 10), "x_authors": _s(e % 5),
        "x_credible": _s(e % 3), "x_mentions": _s(e % 7), "x_acceleration": F.when(e % 4 > 0, _s(e % 4))
    }
    wide = table(spark, sf_dir, "events").select("event_id", *[v.alias(n) for n, v in named.items()])
    return wide.unpivot(["event_id"], list(named), "metric_name", "metric_value").filter("metric_value is not null")


_LINKS_SQL = """pp AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS n, 'brand-' || lower(substr(p_brand, 7)) AS slug FROM part),
found AS (SELECT DISTINCT 'name:' || slug AS entity_key, unnest(['github:org/brand-' || substr(p_brand, 7, 1) || CASE
  WHEN p_partkey % 2 = 0 THEN substr(p_brand, 8) ELSE 'x' END, CASE
  WHEN p_partkey % 3 = 0 THEN 'npm:@s/' || slug ELSE 'npm:other' END, 'domain:' || slug || '.dev']) AS key, slug FROM pp WHERE n <= 20),
kept AS (SELECT entity_key, key FROM found WHERE key IN ('github:org/' || slug, 'npm:@s/' || slug, 'domain:' || slug || '.dev'))"""


def _internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    slug = _cat("brand-", F.lower(F.substring("p_brand", 7, 9)))
    matches = p.select(_cat("name:", slug).alias("entity_key"), key.alias("item_id"))
    repo = _cat(
        "see https://github.com/Org/Brand-", F.substring("p_brand", 7, 1),
        F.when(key % 2 == 0, F.substring("p_brand", 8, 9)).otherwise("x"), "."
    )
    home = F.create_map(
        F.lit("homepage"),
        F.when(key % 3 == 0, _cat("https://www.npmjs.com/package/@s/", slug)).otherwise("https://npmjs.com/package/other")
    )
    return M.internal_links(
        matches,
        p.select(
            key.alias("item_id"), F.col("p_name").alias("name"), _cat("https://www.", slug, ".dev/x").alias("url"),
            repo.alias("description"), home.alias("metadata")
        )
    )


@query(with_sql(_LINKS_SQL, then="SELECT entity_key, key, 1.0::DOUBLE AS confidence FROM kept"))
def c8_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _internal_links(spark, sf_dir)


@query(with_sql(_LINKS_SQL, """l AS (SELECT entity_key, key, CASE WHEN starts_with(key, 'npm:') THEN 0.6 ELSE 1.0 END AS c
  FROM kept), known AS (SELECT entity_key, unnest(['domain:' || substr(entity_key, 6) || '.dev', 'domain:old.dev']) AS key
  FROM (SELECT DISTINCT entity_key FROM found WHERE length(slug) % 2 = 0))""",
  then="""SELECT 'alias' AS lane, entity_key, key FROM l WHERE c >= 0.8 AND NOT EXISTS (SELECT 1 FROM known k
  WHERE k.entity_key = l.entity_key AND k.key = l.key) UNION ALL SELECT 'proposal', entity_key, key FROM l WHERE c < 0.8
  UNION ALL SELECT 'kept', entity_key, key FROM known k WHERE EXISTS (SELECT 1 FROM l WHERE l.c >= 0.8 AND l.entity_key = k.entity_key AND l.key = k.key)"""))
def c9_confidence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New aliases, proposals, and the known aliases that stay."""
    found = _internal_links(spark, sf_dir).withColumn("entity_id", F.col("entity_key"))
    found = found.withColumn("confidence", F.when(F.col("key").startswith("npm:"), 0.6).otherwise(F.col("confidence")))
    slugs = table(spark, sf_dir, "part").select(
        _cat("name:brand-", F.lower(F.substring("p_brand", 7, 9))).alias("entity_key")
    ).distinct().filter((F.length("entity_key") - 5) % 2 == 0)
    known = slugs.select(
        F.col("entity_key").alias("entity_id"), "entity_key",
        F.explode(F.array(_cat("domain:", F.substring("entity_key", 6, 99), ".dev"), F.lit("domain:old.dev"))).alias("key")
    )
    aliases, proposals = M.split_links(found, known)
    kept = M.kept_aliases(known, found.filter("confidence >= 0.8").select("entity_id", "key"))
    lane = lambda df, name: df.select(F.lit(name).alias("lane"), F.col("entity_id").alias("entity_key"), "key")
    return lane(aliases, "alias").unionByName(lane(proposals, "proposal")).unionByName(lane(kept, "kept"))


_JOBS_SQL = """j AS (SELECT c_custkey AS job_id, 'e' || c_custkey AS entity_key, c_custkey % 7 > 0
  AND c_custkey % 5 > 0 AS done, c_custkey % 2 = 0 AS weekly, c_custkey % 3 = 0 AS repo FROM customer)"""


def _downloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, key = F.col("c_custkey"), _s("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(c.alias("job_id"), _cat("e", key).alias("entity_key"), _cat("pkg", key).alias("package"))
    repo = F.when(c % 3 == 0, _cat(',"repository":{"url":"git+https://github.com/Own/R', key, '.git"}')).otherwise("")
    metadata = F.when(c % 7 > 0, _cat('{"name":"pkg', key, '"', repo, "}")).otherwise("gone")
    day = F.when(c % 5 > 0, _cat('{"downloads":', key, "}")).otherwise('{"downloads":"many"}')
    kinds = F.array(
        *[
            F.struct(F.lit(n).alias("kind"), v.alias("payload")) for n,
            v in (("metadata", metadata), ("last-day", day), ("last-week", F.when(c % 2 == 0, _cat('{"downloads":', _s(c * 7), "}"))))
        ]
    )
    responses = table(spark, sf_dir, "customer").select(_cat("pkg", key).alias("package"), F.inline(kinds)).filter("payload is not null")
    return M.download_signals(jobs, responses)


@query(
    with_sql(
        _JOBS_SQL,
        then="""SELECT entity_key, 'daily_downloads' AS metric_name, CAST(job_id AS VARCHAR) AS metric_value FROM j WHERE done
  UNION ALL SELECT entity_key, 'downloads_7d', CAST(job_id * 7 AS VARCHAR) FROM j WHERE done AND weekly
  UNION ALL SELECT entity_key, 'npm_repository_link', 'github:own/r' || job_id FROM j WHERE done AND repo"""
    )
)
def c10_download_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _downloads(spark, sf_dir)[0].drop("package")


@query(
    with_sql(
        _JOBS_SQL,
        then="""SELECT job_id, CASE WHEN done THEN 'completed' ELSE 'failed' END AS status, CASE WHEN done AND repo THEN 'github:own/r' || job_id END AS alias FROM j"""
    )
)
def c10_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, aliases, states = _downloads(spark, sf_dir)
    return states.withColumn("entity_key", _cat("e", _s("job_id"))).join(aliases, "entity_key", "left").select("job_id", "status", "alias")


@query("""WITH t AS (SELECT 'k' || conv_id AS key, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT key, left(text, 8000) AS excerpt, left(text, 1000) AS preview, length(left(text, 8000)) AS chars FROM t WHERE CAST(substr(key, 2) AS BIGINT) % 3 <> 0""")
def c12_text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a cached text that was read well, and what landed for them; a key whose cached read failed is read again."""
    c = table(spark, sf_dir, "conversations")
    key = _cat("k", _s("conv_id"))
    cached = c.select(key.alias("key"), F.when(F.col("conv_id") % 3 == 0, "ok").otherwise("error").alias("status"))
    keys = M.uncached(c.select(key.alias("key")), cached)
    return C.excerpts(keys, c.filter("role = 'assistant'").select(key.alias("key"), F.col("turn").alias("at"), "text"))


@query(with_sql(ITEMS_SQL, then=f"""SELECT unit_key, min(item_id) AS item_id, max(metric) AS best_score, count(*) AS row_count
  FROM (SELECT *, 'url:' || regexp_replace(url, '/[0-9]+$', '') AS unit_key FROM items
  WHERE metric >= 300 AND ts BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW}) GROUP BY unit_key
  ORDER BY best_score DESC, max(CASE WHEN k > 90 THEN 2 WHEN k > 70 THEN 1 ELSE 0 END) DESC, 4 DESC, max(k) DESC, row_count DESC, unit_key DESC LIMIT 30""".replace(", 4 DESC, max(k) DESC", ", max(k) DESC")))
def a5_c1_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story units of the last week above the score floor."""
    k = F.col("k")
    rows = items(spark, sf_dir).select(
        _cat("url:", F.regexp_replace("url", "/[0-9]+$", "")).alias("unit_key"), "item_id", F.col("metric").alias("score"),
        k.alias("comments"), F.lit("a title").alias("title"), "url", F.when(k > 90, 2).when(k > 70, 1).otherwise(0).alias("impact"),
        F.col("ts").alias("at")
    )
    return M.story_units(rows, 30, 300, now() - F.expr("INTERVAL 7 DAYS"), now()).select("unit_key", "item_id", "best_score", "row_count")


@query(
    with_sql(
        ITEMS_SQL,
        then=f"""SELECT item_id AS post_id, (n - 1) // 40 AS batch FROM (SELECT item_id, row_number() OVER (ORDER BY ts DESC, item_id) AS n FROM items
  WHERE ts BETWEEN {_NOW} - INTERVAL 7 DAY AND {_NOW}) WHERE n <= 400"""
    )
)
def c2_newest_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 400 newest posts of the last week, 40 a batch."""
    rows = items(spark, sf_dir).select(F.col("item_id").alias("post_id"), F.col("ts").alias("at"))
    return M.batches(
        M.newest(rows, now() - F.expr("INTERVAL 7 DAYS"), now(), 400), [F.desc("at"), F.col("post_id").asc()], 40, []
    ).select("post_id", "batch")


@query(
    with_sql(
        ITEMS_SQL,
        then=f"""SELECT w AS window_name, entity_key, 'tweet:' || item_id AS ref FROM items, (VALUES ('24h', 1), ('7d', 7)) v(w, d)
  WHERE ts >= {_NOW} - to_days(CAST(d AS INTEGER))"""
    )
)
def a3_window_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("entity_key", F.col("ts").alias("at"), _cat("tweet:", _s("item_id")).alias("ref"))
    return M.window_refs(i.union(i), now()).select("window_name", "entity_key", "ref")


@query(
    with_sql(
        ITEMS_SQL,
        then=f"""SELECT DISTINCT w AS window_name, 'p' || (k % 10) AS project, source AS author FROM items, (VALUES ('24h', 24.0), ('7d', 168.0)) v(w, h)
  WHERE greatest(epoch({_NOW}) - epoch(ts), 0) / 3600.0 <= h"""
    )
)
def a2_mention_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestream.operators.windows import age_windows

    names = F.filter(age_windows(F.col("ts"), now()), lambda w: w.isin("24h", "7d"))
    return M.mention_accounts(
        items(spark, sf_dir).select(
            names.alias("windows"), F.array(_cat("p", _s(F.col("k") % 10))).alias("projects"), F.col("source").alias("author")
        )
    )


# --- sinks, ids, logs and checks ------------------------------------------------------------------------------------


@query(
    """SELECT source, run_id, external_id, min(ord) AS ord FROM (SELECT o_orderpriority AS source, CASE
  WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r2' END AS run_id, 'c' || o_custkey AS external_id, o_orderkey AS ord FROM orders) GROUP BY ALL"""
)
def k1_appended_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one folder, by source and run; the first of a key within a run counts."""
    o, path = table(spark, sf_dir, "orders"), _folder(spark, "snapshots")
    for run, rest in (("r1", 0), ("r2", 1)):
        batch = o.filter(F.col("o_orderkey") % 2 == rest).select(
            F.col("o_orderpriority").alias("source"), F.lit(run).alias("run_id"), _cat("c", _s("o_custkey")).alias("external_id"),
            F.col("o_orderkey").alias("ord")
        )
        S.append_snapshot(batch, path)
    return spark.read.parquet(path).select("source", "run_id", "external_id", "ord")


@query(
    """SELECT o_orderkey, 'run' || CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS run_id FROM orders
  WHERE o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0)"""
)
def k4_replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs are written, then one of them is written anew over its own partition."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey"), _folder(spark, "runs")
    of = lambda what, run: o.filter(what).withColumn("run_id", F.lit(run))
    S.replace_runs(of("o_orderkey % 2 = 0 and o_orderkey % 3 != 0", "run1").unionByName(of("o_orderkey % 5 = 0", "run2")), path)
    S.replace_runs(of("o_orderkey % 3 = 0", "run2"), path)
    return spark.read.parquet(path).select("o_orderkey", "run_id")


@query(
    """SELECT o_orderkey, run, gate FROM (SELECT o_orderkey, o_orderkey % 5 AS run, gate FROM orders, (VALUES ('fresh'), ('stale')) v(gate)
  WHERE o_orderkey % 2 = 0) WHERE gate = 'stale' OR run NOT IN (1, 2) UNION ALL SELECT o_orderkey, o_orderkey % 5, 'fresh' FROM orders
  WHERE o_orderkey % 5 IN (1, 2) AND o_orderkey % 3 = 0"""
)
def k10_gate_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch against a gate that it passes and against one that refuses it whole."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("run"), "o_orderdate")
    store, batch = o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 5 in (1, 2) and o_orderkey % 3 = 0")
    gated = lambda name, day: S.gated_import(
        store, batch, "o_orderdate", "run", F.lit(day).cast("timestamp")
    ).select("o_orderkey", "run", F.lit(name).alias("gate"))
    return gated("fresh", "1990-01-01").unionByName(gated("stale", "2090-01-01"))


_IDS_SQL = """ids AS (SELECT entity_key FROM items GROUP BY entity_key HAVING max(metric) >= 2500 UNION SELECT entity_key FROM items
  WHERE k >= 97 AND user_id % 7 = 1 UNION SELECT entity_key FROM items
  WHERE source = 'hn_algolia' AND k = 5 AND user_id % 5 = 2 UNION SELECT entity_key FROM items
  WHERE source = 'product_hunt' AND k = 7 AND user_id % 3 = 1)"""


def _four_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    candidates = i.groupBy("entity_key").agg(F.max("metric").alias("m")).filter("m >= 2500")
    sets = (
        "k >= 97 and user_id % 7 = 1", "source = 'hn_algolia' and k = 5 and user_id % 5 = 2",
        "source = 'product_hunt' and k = 7 and user_id % 3 = 1"
    )
    return S.referenced([candidates, *[i.filter(x) for x in sets]], "entity_key")


@query(with_sql(ITEMS_SQL, _IDS_SQL, then="SELECT entity_key FROM ids"))
def u3_four_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _four_sets(spark, sf_dir)


@query(
    with_sql(
        ITEMS_SQL, _IDS_SQL,
        then="""SELECT DISTINCT entity_key, CASE WHEN user_id % 4 = 0 THEN 'stored' ELSE 'built' END AS origin FROM items
  WHERE user_id % 4 = 0 OR entity_key IN (SELECT entity_key FROM ids)"""
    )
)
def e4_persisted_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    store = i.filter("user_id % 4 = 0").select("entity_key", F.lit("stored").alias("origin")).distinct()
    return S.persisted_entities(store, i.select("entity_key", F.lit("built").alias("origin")), _four_sets(spark, sf_dir), "entity_key")


@query(
    """SELECT a.since AS all_known, b.since AS one_new FROM (SELECT strftime(min(latest) - INTERVAL 2 DAY, '%Y-%m-%d') AS since
  FROM (SELECT max(ts) AS latest FROM events GROUP BY user_id)) a, (SELECT '2024-01-01' AS since) b"""
)
def a17_since_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every handle has a cursor; then one more has none."""
    e = table(spark, sf_dir, "events")
    cursors = e.groupBy(_cat("@User", _s("user_id")).alias("handle")).agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("latest_at"))
    handles = e.select(_cat("user", _s("user_id")).alias("handle")).distinct()
    more = handles.unionByName(e.select(F.lit("@newcomer").alias("handle")).distinct())
    one, two = (S.since_date(cursors, h, now()) for h in (handles, more))
    return one.withColumnRenamed("since", "all_known").crossJoin(two.withColumnRenamed("since", "one_new"))  # a row each


@query(
    """SELECT role AS component, count(*) AS calls, count(*) FILTER (turn % 6 = 5) AS failed, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens,
  CAST(sum(turn) AS BIGINT) AS completion_tokens, avg(conv_id * 10 + turn) AS mean_latency, quantile_disc(conv_id * 10 + turn, 0.5) AS median_latency, quantile_disc(conv_id * 10 + turn, 0.95) AS p95_latency
  FROM conversations GROUP BY role"""
)
def a18_token_and_latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations")
    return V.call_rollup(
        c.select(
            F.col("role").alias("component"), F.when(t % 6 == 5, "error").otherwise("ok").alias("status"),
            F.length("text").alias("prompt_tokens"), t.alias("completion_tokens"), (F.col("conv_id") * 10 + t).alias("latency_ms")
        )
    )


@query(
    with_sql(
        ITEMS_SQL,
        then="""SELECT family, CASE family WHEN 'github' THEN 'GitHub' WHEN 'hn' THEN 'Hacker News' WHEN 'product_hunt' THEN 'Product Hunt'
  WHEN 'package_family' THEN 'npm' ELSE 'Hugging Face' END AS label, CASE family WHEN 'github' THEN 0 WHEN 'hn' THEN 1 WHEN 'product_hunt' THEN 3
  WHEN 'package_family' THEN 4 ELSE 6 END AS place, count(DISTINCT entity_key) AS n FROM items GROUP BY family"""
    )
)
def a15_ordered_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = items(spark, sf_dir).groupBy("entity_key").agg(F.collect_set("family").alias("f"))
    return V.source_facets(e.select(F.concat("f", F.array(F.lit("rule"), F.lit(""))).alias("families")))


@query(with_sql(ITEMS_SQL, then="""SELECT CASE source WHEN 'hn_algolia' THEN 'hn_search' ELSE source END AS channel, CASE source WHEN 'hn_algolia' THEN 'HN Search'
  WHEN 'github_trending' THEN 'GitHub Trending' WHEN 'product_hunt' THEN 'Product Hunt' ELSE source END AS label, CASE source
  WHEN 'github_trending' THEN 0 WHEN 'hn_algolia' THEN 4 WHEN 'product_hunt' THEN 6 ELSE 99 END AS place,
  CAST(sum(n) AS BIGINT) AS count, array_to_string(list(w || '=' || n
  ORDER BY w), ',') AS windows, CASE source WHEN 'hn_algolia' THEN 'late' END AS error
  FROM (SELECT source, CASE WHEN k % 3 = 0 THEN '24h' ELSE '7d' END AS w, count(*) AS n FROM items WHERE source <> 'huggingface_models' GROUP BY ALL)
  GROUP BY source"""))
def q4_dashboard_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("source", F.when(F.col("k") % 3 == 0, "24h").otherwise("7d").alias("window"))
    errors = i.filter("source = 'hn_algolia'").select("source", F.lit("late").alias("error")).distinct()
    out = S.source_channels(i, errors, ("huggingface_models", "huggingface_datasets", "x_seed_accounts"))
    return out.withColumn("windows", F.array_join(F.transform("windows", lambda w: F.concat_ws("=", w["window"], _s(w["n"]))), ","))


@query("SELECT DISTINCT role || '-' || (turn % 3) AS stage FROM conversations WHERE conv_id % 2 = 0 AND turn % 2 = 0")
def v5_stages_of_a_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log file of JSON lines, broken ones among them, written and read as text."""
    c, path = table(spark, sf_dir, "conversations"), _folder(spark, "log")
    line = F.to_json(
        F.struct(
            F.concat_ws("-", "role", _s(F.col("turn") % 3)).alias("stage"),
            F.when(F.col("turn") % 2 == 0, "completed").otherwise("started").alias("event"), (F.col("conv_id") % 2).alias("returncode")
        )
    )
    c.select(F.explode(F.array(line, F.lit("{not json"), F.lit(""))).alias("value")).write.text(path)
    return V.stages_of_log(spark.read.text(path))


@query("""WITH c AS (SELECT source || '-' || (doc_id % 50) AS name, doc_id % 20 = 0 AS no_input, doc_id % 30 = 1 AS no_expected FROM documents WHERE doc_id % 3 = 0)
SELECT name, 'duplicate' AS problem FROM c GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT name, 'incomplete' FROM c
  WHERE no_input OR no_expected UNION ALL SELECT DISTINCT source || '-' || (doc_id % 60), 'missing' FROM documents
  WHERE source || '-' || (doc_id % 60) NOT IN (SELECT name FROM c)""")
def v6_coverage_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    cases = d.filter(i % 3 == 0).select(
        F.concat_ws("-", "source", _s(i % 50)).alias("name"), F.when(i % 20 != 0, "x").alias("input"),
        F.when(i % 30 != 1, "y").alias("expected")
    )
    return V.coverage_problems(cases, d.select(F.concat_ws("-", "source", _s(i % 60)).alias("name")))


# --- channel views and linked names ---------------------------------------------------------------------------------

_VIEW_SQL = """v AS (SELECT group_id, segment, canonical_name, momentum, CASE
  WHEN group_id % 3 > 0 THEN CAST(momentum AS VARCHAR) ELSE 'N' || (group_id % 5) END AS mixed,
  CASE WHEN group_id % 4 > 0 THEN date '2024-01-01' + CAST(group_id % 50 AS INTEGER) END AS seen, coalesce(CASE
  WHEN group_id % 5 > 0 THEN group_id % 7 END, CASE WHEN group_id % 2 = 0 THEN group_id % 11 END, 999999) AS native FROM groups)"""


@query(with_sql(GROUPS_SQL, _VIEW_SQL, then="""SELECT group_id,
  row_number() OVER (PARTITION BY segment ORDER BY lower(canonical_name) DESC, native, group_id) AS by_name,
  row_number() OVER (PARTITION BY segment ORDER BY coalesce(seen, date '1970-01-01'), native, lower(canonical_name), group_id) AS by_time,
  row_number() OVER (PARTITION BY segment ORDER BY TRY_CAST(mixed AS DOUBLE) IS NULL DESC,
  coalesce(TRY_CAST(mixed AS DOUBLE), 0) DESC, lower(mixed) DESC, native, lower(canonical_name), group_id) AS by_number
FROM v"""))
def w6_chosen_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three views of the same rows: by name down, by time up, by a number down."""
    g = F.col("group_id")
    rows = groups(spark, sf_dir).select(
        "group_id",
        "segment",
        "canonical_name",
        F.when(g % 3 > 0, _s("momentum")).otherwise(_cat("N", _s(g % 5))).alias("mixed"),
        F.when(g % 4 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (g % 50).cast("int"))).alias("seen"),
        F.when(g % 5 > 0, g % 7).alias("window_rank"),
        F.when(g % 2 == 0, g % 11).alias("source_rank"),
    )
    for label, column, kind, descending in (
        ("by_name", "canonical_name", "name", True), ("by_time", "seen", "time", False), ("by_number", "mixed", "number", True)
    ):
        rows = S.channel_view(
            rows, column, kind, descending, ["segment"], ["window_rank", "source_rank"], "canonical_name", "group_id", label
        )
    return rows.select("group_id", "by_name", "by_time", "by_number")


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 7 > 0 AS look, lower(p_type) AS name, CASE p_partkey % 4 WHEN 0 THEN 'linked' WHEN 1 THEN 'exact_handle'
  WHEN 2 THEN 'fuzzy_name' END AS confidence FROM part),
k AS (SELECT *, CASE WHEN length(name) >= 6 THEN 'name:' || regexp_replace(name, '[^a-z0-9]+', '-', 'g') END AS key FROM p WHERE look),
f AS (SELECT key, min(id) AS first FROM k WHERE confidence IN ('linked', 'exact_handle') AND key IS NOT NULL GROUP BY key)
SELECT id AS post_id, 'github:own/r' || id AS entity_key, 'Tool of ' || id AS entity_name, confidence AS entity_confidence FROM k WHERE confidence IS NOT NULL
UNION ALL
SELECT id, CASE WHEN first IS NULL THEN key ELSE 'github:own/r' || first END, CASE WHEN first IS NULL THEN name ELSE 'Tool of ' || first END,
  CASE WHEN first IS NULL THEN 'fuzzy_name' WHEN first % 4 = 0 THEN 'linked' ELSE 'exact_handle' END FROM k LEFT JOIN f USING (key)
  WHERE confidence IS NULL AND key IS NOT NULL""")
def j13_first_linked_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as posts: three in four have a reference of their own, the others a product name alone."""
    k = F.col("p_partkey")
    confidence = F.when(k % 4 == 0, "linked").when(k % 4 == 1, "exact_handle").otherwise("fuzzy_name")
    ref = F.struct(
        _cat("github:own/r", _s(k)).alias("entity_key"), _cat("Tool of ", _s(k)).alias("entity_name"), confidence.alias("entity_confidence")
    )
    posts = table(spark, sf_dir, "part").select(
        k.alias("post_id"), k.alias("ord"), (F.col("p_size") % 7 > 0).alias("closer_look"), F.when(k % 4 < 3, F.array(ref)).alias("refs"),
        F.array(F.lower("p_type")).alias("names")
    )
    return M.mentioned(posts)

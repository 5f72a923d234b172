"""Mentions of projects in posts, story units, response checks and link resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalars import name_key

#: What a classifier may answer.
PROJECTNESS = ("project", "package", "news_article", "topic_discussion", "research_paper", "unknown")
TIERS, CONFIDENCES = ("none", "watch", "potential", "high"), ("linked", "exact_handle", "fuzzy_name")


def mention_buckets(posts: DataFrame, samples: int = 5) -> DataFrame:
    """Per window and project: posts, engagement, views, distinct accounts, and the first sample posts.

    posts: post_id, author, engagement, views, windows array, projects array, ord (the order of first sight).
    """
    long = posts.withColumn("window_name", F.explode("windows")).withColumn("project", F.explode("projects"))
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "post_id"))), 1, samples), lambda s: s["post_id"])
    from .windows import first_per

    sample = first_per(long, ["window_name", "project"], [F.col("ord").asc(), F.col("post_id").asc()], samples)
    sample = sample.groupBy("window_name", "project").agg(first.alias("sample"))
    total = long.groupBy("window_name", "project").agg(
        F.count(F.lit(1)).alias("tweet_count"), F.sum("engagement").alias("engagement_sum"), F.sum("views").alias("view_sum"),
        F.count_distinct("author").alias("n_accounts")
    )
    return total.join(sample, ["window_name", "project"])


def mention_accounts(posts: DataFrame) -> DataFrame:
    """The accounts themselves, a row for each window, project and account."""
    return posts.withColumn(
        "window_name", F.explode("windows")
    ).withColumn("project", F.explode("projects")).select("window_name", "project", "author").distinct()


def entity_windows(mentions: DataFrame, now: Column, credible: Column) -> DataFrame:
    """Per entity and window (24h, 7d): distinct and credible authors, mentions. Only the window's beginning bounds it.

    Both windows come from one exploded pass over the mentions of the longer one.
    """
    day, week = (now - F.expr(f"INTERVAL {d} DAYS") for d in (1, 7))
    names = F.array_compact(F.array(F.when(F.col("at") >= day, F.lit("24h")), F.when(F.col("at") >= week, F.lit("7d"))))
    long = mentions.withColumn("window_name", F.explode(names))
    author = F.lower("author")
    return long.groupBy("entity_key", "window_name").agg(
        F.count_distinct(author).alias("distinct_authors"), F.count_distinct(F.when(credible, author)).alias("credible_authors"),
        F.count(F.lit(1)).alias("mention_count")
    )


def chosen_windows(windows: DataFrame, most: int) -> DataFrame:
    """Each entity's week, else its day, most credible first, the first ``most``."""
    one = windows.groupBy("entity_key").agg(
        F.max(
            F.struct((F.col("window_name") == "7d").alias("w"), "window_name", "distinct_authors", "credible_authors", "mention_count")
        ).alias("m")
    ).select("entity_key", "m.*").drop("w")
    order = [F.desc(c) for c in ("credible_authors", "mention_count", "distinct_authors")]
    return one.orderBy(*order, F.desc(F.col("window_name") == "24h"), F.desc("entity_key")).limit(most)


def story_units(
    rows: DataFrame, most: int, floor: float | None = None, since: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Stories of one link or title as a unit: representative, best score and comments, rows, impact, likeness.

    rows: unit_key, item_id, score, comments, title, url, impact, and at where a window is given. Rows under the floor or
    out of the window count for nothing; a unit without others is none.
    """
    if floor is not None:
        rows = rows.filter(F.coalesce("score", F.lit(0)) >= floor)
    if since is not None:
        rows = rows.filter(F.col("at").between(since, now))
    u = rows.groupBy("unit_key").agg(
        F.min("item_id").alias("item_id"), F.min_by("title", "item_id").alias("title"), F.min_by("url", "item_id").alias("url"),
        F.max("score").alias("best_score"), F.max("comments").alias("best_comments"), F.count(F.lit(1)).alias("row_count"),
        F.max("impact").alias("impact")
    )
    t = F.lower("title")
    like = F.when(
        t.startswith("show hn:") | t.startswith("launch hn:") | t.startswith("launch:"), 20
    ).otherwise(0) + F.when(F.col("url").contains("github.com/"), 12).otherwise(0) + F.when(
        F.col("url").contains("npmjs.com/package/"), 10
    ).otherwise(0) + F.when(F.col("unit_key").startswith("url:"), 4).otherwise(0)
    u = u.withColumn("likeness", like)
    return u.orderBy(*[F.desc(c) for c in ("best_score", "impact", "likeness", "best_comments", "row_count", "unit_key")]).limit(most)


def newest(rows: DataFrame, since: Column, now: Column, most: int) -> DataFrame:
    """The ``most`` newest posts of the window, to be dealt to batches. rows: post_id, at, ..."""
    return rows.filter(F.col("at").between(since, now)).orderBy(F.desc("at"), "post_id").limit(most)


def batches(rows: DataFrame, order: list[Column], size: int, keys: list[str]) -> DataFrame:
    """Rows dealt to numbered batches of ``size`` within each key."""
    from .windows import spread_ranked

    return spread_ranked(rows, "_n", keys, order).withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def checked_responses(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Responses with ``error``: null if all required fields are there, typed and in range; bad links go, not the row."""
    shape = "item_id long, projectness string, confidence double, canonical_name string, summary string, links array<struct<type:string,url:string,key:string>>"
    r = raw.withColumn("r", F.from_json(payload, shape))
    ok = lambda x: x["url"].isNotNull() & (x["url"] != "") & x["type"].isin("github", "domain", "npm")
    error = (
        F.when(F.col("r.item_id").isNull() | F.col("r.canonical_name").isNull() | F.col("r.summary").isNull() | F.col("r.links").isNull(), "missing field")
        .when(~F.coalesce("r.projectness", F.lit("")).isin(*PROJECTNESS), "projectness")
        .when(~F.coalesce(F.col("r.confidence").between(0, 1), F.lit(False)), "confidence")
    )
    return r.select(
        *raw.columns, error.alias("error"), F.size(F.filter("r.links", ok)).alias("kept_links"), F.col("r.projectness").alias("projectness")
    )


def accepted_tier(
    tier: Column, key: Column, confidence: Column, citations: Column, credible: Column, authors: Column, verified: Column,
    generic: tuple[str, ...]
) -> Column:
    """The tier after its gates: cited, not a general term, linked for more than watch, enough authors for high."""
    term = F.lower(F.trim(F.regexp_replace(key, "^term:", "")))
    return (
        F.when((tier == "none") | (citations < 1), "none")
        .when(key.startswith("term:") & term.isin(*generic), "none")
        .when((confidence == "fuzzy_name") & tier.isin("potential", "high"), "watch")
        .when((tier == "high") & (credible < 3) & (authors < 3) & ~verified, "potential")
        .otherwise(tier)
    )


def exact_name_link(entity_key: Column, key: Column) -> Column:
    """Whether a link's last part is the slug of a name key; other keys accept any link."""
    slug = F.regexp_replace(entity_key, "^name:", "")
    rest = F.lower(F.regexp_replace(key, "^[a-z]+:", ""))
    labels = F.split(rest, r"\.")
    by_host = (labels[0] == slug) | (F.concat_ws("-", labels[0], F.element_at(labels, -1)) == slug)
    last = F.element_at(F.split(rest, "/"), -1)
    return ~entity_key.startswith("name:") | F.when(key.startswith("domain:"), by_host).otherwise(last == slug)


def split_links(links: DataFrame, known: DataFrame, floor: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Aliases (sure enough, once per entity and key, not known yet) and merge proposals (the others).

    links: entity_id, key, confidence, ... known: entity_id, key of the resolver's aliases so far.
    """
    named, sure = links.filter(F.col("key") != ""), F.coalesce("confidence", F.lit(0.0)) >= floor
    aliases = named.filter(sure).select("entity_id", "key").distinct().join(
        known.select("entity_id", "key"), ["entity_id", "key"], "left_anti"
    )
    return aliases, named.filter(~sure)


def uncached(keys: DataFrame, cached: DataFrame) -> DataFrame:
    """Keys without a cached text that was read well. keys: key. cached: key, status."""
    return keys.select("key").distinct().join(cached.filter("status = 'ok'").select("key"), "key", "left_anti")


#: What admits a story's project, and where an item names its home.
ADMITTED, LINK_FIELDS = ("project", "package"), ("repository", "repo", "homepage", "website", "url")


def window_refs(mentions: DataFrame, now: Column) -> DataFrame:
    """entity_key, window_name, ref: the distinct posts of each entity's windows, a row each. mentions: entity_key, at, ref."""
    day, week = (now - F.expr(f"INTERVAL {d} DAYS") for d in (1, 7))
    names = F.array_compact(F.array(F.when(F.col("at") >= day, F.lit("24h")), F.when(F.col("at") >= week, F.lit("7d"))))
    return mentions.select("entity_key", F.explode(names).alias("window_name"), "ref").distinct()


def internal_links(matches: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """entity_key, key, confidence: keys in the texts of the newest items that a lookup matched; name keys take exact names only.

    matches: entity_key, item_id; items: item_id, name, url, description, metadata.
    """
    from lodestream.functions import scalars as X

    from .windows import first_per

    newest = first_per(matches.select("entity_key", "item_id").distinct(), ["entity_key"], [F.desc("item_id")], most)
    found = [F.try_element_at("metadata", F.lit(f)) for f in LINK_FIELDS]
    texts = items.select("item_id", F.concat_ws(" ", "name", "url", "description", *found).alias("text"))
    links = F.regexp_extract_all("text", F.lit(X.LINK), F.lit(0))
    tidy = F.transform(links, lambda u: F.regexp_replace(u, r"[.,;:!?)\"\]}']+$", ""))
    keys = F.array_distinct(
        F.concat(
            X.github_keys_in_prose(F.col("text")), X.domain_keys(F.col("text"), F.lit(False)), F.array_compact(F.transform(tidy, X.npm_key))
        )
    )
    rows = newest.join(texts, "item_id").select("entity_key", F.explode(keys).alias("key")).distinct()
    return rows.filter(exact_name_link(F.col("entity_key"), F.col("key"))).withColumn("confidence", F.lit(1.0))


def kept_aliases(known: DataFrame, selected: DataFrame) -> DataFrame:
    """Resolver aliases after a run: of a name key that got new aliases only those stay that the run named again.

    known: entity_id, entity_key, key; selected: entity_id, key.
    """
    renewed = selected.select("entity_id").distinct().withColumn("_renewed", F.lit(True))
    again = selected.select("entity_id", "key").distinct().withColumn("_again", F.lit(True))
    rows = known.join(renewed, "entity_id", "left").join(again, ["entity_id", "key"], "left")
    return rows.filter(
        ~F.col("entity_key").startswith("name:") | F.col("_renewed").isNull() | F.col("_again").isNotNull()
    ).select(*known.columns)


def classified(outputs: DataFrame, unit_rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, aliases and proposals of classified stories: a unit's answer goes to each of its rows.

    outputs: unit_key, projectness, canonical_name, summary, sure_links (array of key), proposed_links (array of key,
    confidence); unit_rows: unit_key, item_id, external_id, title. The entity is the first sure link, else the story itself.
    """
    rows = unit_rows.join(outputs, "unit_key")
    entity = F.coalesce(F.try_element_at("sure_links", F.lit(1)), F.concat(F.lit("hn:"), F.col("item_id").cast("string")))
    rows = rows.withColumn("entity_key", entity)
    label = F.when(F.col("projectness").isin(*ADMITTED), "watch").when(
        F.col("projectness") == "company_product", "context"
    ).otherwise("noise")
    name = F.coalesce(F.nullif("canonical_name", F.lit("")), "title")
    evidence = rows.select(
        "entity_key", "item_id", F.lit("hn_projectness").alias("metric_name"), F.col("projectness").alias("metric_value"),
        label.alias("signal_label"), F.trim(F.concat(name, F.lit(": "), F.col("summary"))).alias("note"),
        F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("ref")
    )
    aliases = rows.select(
        "entity_key", "external_id", F.explode("sure_links").alias("alias")
    ).groupBy("entity_key", "alias").agg(F.min("external_id").alias("external_id"))
    proposals = rows.select("entity_key", "item_id", F.explode("proposed_links").alias("p")).select(
        "entity_key", "item_id", F.col("p.key").alias("orphan"), F.col("p.confidence").alias("confidence")
    )
    return evidence, aliases, proposals


def download_signals(jobs: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, repository aliases and job states from landed registry responses.

    jobs: job_id, entity_key, package; responses: package, kind (metadata, last-day, last-week), payload. A job without
    readable metadata or daily downloads has failed and gives nothing; weekly downloads and a repository are welcome.
    """
    from lodestream.functions.scalars import repository_key

    of = lambda kind, path: F.max(F.when(F.col("kind") == kind, F.get_json_object("payload", path)))
    got = responses.groupBy("package").agg(
        of("metadata", "$.name").alias("name"), of("metadata", "$.repository.url").alias("url"),
        of("metadata", "$.repository").alias("plain"), of("last-day", "$.downloads").alias("day"),
        of("last-week", "$.downloads").alias("week")
    )
    rows = jobs.join(got, "package", "left").withColumns(
        {"day": F.col("day").try_cast("long"), "week": F.col("week").try_cast("long"), "repo": repository_key(F.coalesce("url", "plain"))}
    )
    done = F.col("name").isNotNull() & F.col("day").isNotNull()
    states = rows.select("job_id", F.when(done, "completed").otherwise("failed").alias("status"))
    good = rows.filter(done)
    metrics = F.array(
        *[
            F.struct(F.lit(n).alias("metric_name"), F.col(c).cast("string").alias("metric_value")) for n,
            c in (("daily_downloads", "day"), ("downloads_7d", "week"), ("npm_repository_link", "repo"))
        ]
    )
    evidence = good.select("entity_key", "package", F.inline(F.filter(metrics, lambda m: m["metric_value"].isNotNull())))
    aliases = good.filter("repo is not null").select("entity_key", F.col("repo").alias("alias")).distinct()
    return evidence, aliases, states


def mentioned(posts: DataFrame) -> DataFrame:
    """post_id, entity_key, entity_name, entity_confidence: what each post that deserves a closer look speaks of.

    posts: post_id, ord (a total order of the posts), closer_look, refs (array of struct entity_key, entity_name,
    entity_confidence), names (array of product names). A post's own references count. One without any speaks of its
    names: of the first linked reference, in order of posts, references and names, that goes with an equal name, else of
    the name itself. Names without a key are dropped. The first reference of a name is a minimum that combines before the
    shuffle, so no task holds a name.
    """
    looked = posts.filter(F.coalesce("closer_look", F.lit(False))).select("post_id", "ord", "refs", "names")
    own = looked.select("post_id", F.explode("refs").alias("r")).select("post_id", "r.entity_key", "r.entity_name", "r.entity_confidence")
    refs = looked.select("ord", "names", F.posexplode("refs").alias("at", "r")).filter(F.col("r.entity_confidence").isin(*CONFIDENCES[:2]))
    known = refs.select(
        "ord", "at", "r",
        F.posexplode(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array("r.entity_name"))).alias("nth", "name")
    )
    known = known.withColumn("key", name_key(F.col("name"))).filter("key is not null")
    known = known.groupBy("key").agg(F.min_by("r", F.struct("ord", "at", "nth")).alias("linked"))
    bare = looked.filter(F.coalesce(F.size("refs"), F.lit(0)) <= 0).select(
        "post_id", F.explode("names").alias("name")
    ).withColumn("key", name_key(F.col("name"))).filter("key is not null")
    named = bare.join(known, "key", "left").select(
        "post_id",
        F.coalesce("linked.entity_key", "key").alias("entity_key"),
        F.when(F.col("linked").isNotNull(), F.col("linked.entity_name")).otherwise(F.col("name")).alias("entity_name"),
        F.coalesce("linked.entity_confidence", F.lit(CONFIDENCES[2])).alias("entity_confidence"),
    )
    return own.unionByName(named)

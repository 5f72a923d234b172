"""Threshold, acceleration and cross-source rules: items to evidence, evidence to candidates.

Each rule returns rows of (entity_key, family, rule, level, metric_name, metric, event_at). Promotion is one
aggregation over all evidence, so its result does not depend on the order in which rules fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import scalars as X
from lodestream.operators.windows import seconds

#: Thresholds and floors of the rules.
RULES = {
    "momentum": {"watch": 1.2, "potential": 2.0, "high_potential": 3.0, "min_baseline_stars_per_day": 1.0, "min_baseline_daily_downloads": 100.0},
    "github_trending": {"watch": 300, "potential": 1000, "high_potential": 3000},
    "trending_repos": {"stars_velocity_floor": 150, "forks_velocity_floor": 50},
    "repofomo": {"stars_7d_floor": 70},
    "hn": {"points_floor_watch": 30, "points_breakthrough_potential": 200, "window_days": 7},
    "product_hunt": {"rank_potential": 5, "rank_watch": 10},
    "huggingface": {"exact_resources_48h_potential": 2, "single_resource_watch": 1},
    "npm_registry": {"daily_downloads_floor": 3000, "watch": 1.3, "potential": 2.0, "high_potential": 3.0},
    "verified_cross_source": {"weak_signals_48h_potential": 2},
    "backfill": {"min_stars_per_day": 50, "pushed_within_days": 14, "created_within_days": 180, "max_jobs": 40},
}
COLUMNS = ("entity_key", "family", "rule", "level", "metric_name", "metric", "event_at")


def _ladder(value: Column, t: dict) -> Column:
    return X.level(value, t.get("watch"), t.get("potential"), t.get("high_potential"))


def _evidence(
    df: DataFrame, family: str, rule: str, level: Column, metric_name: Column | str, metric: Column, event_at: Column
) -> DataFrame:
    name = metric_name if isinstance(metric_name, Column) else F.lit(metric_name)
    out = df.select(
        "entity_key", F.lit(family).alias("family"), F.lit(rule).alias("rule"), level.alias("level"), name.alias("metric_name"),
        metric.cast("double").alias("metric"), event_at.alias("event_at")
    )
    return out.filter("level != 'none'")


def daily_stars(rows: DataFrame) -> DataFrame:
    """The best daily row of each entity against fixed thresholds; of equal ones the first seen. rows: entity_key, item_id, stars, at."""
    best = rows.groupBy("entity_key").agg(F.max_by(F.struct("stars", "at"), F.struct("stars", -F.col("item_id"))).alias("b"))
    return _evidence(
        best, "github", "github_trending_daily", _ladder(F.col("b.stars"), RULES["github_trending"]), "stars_today", F.col("b.stars"),
        F.col("b.at")
    )


def _rises() -> Column:
    t = RULES["trending_repos"]
    return (
        (F.col("stars_velocity") >= t["stars_velocity_floor"]) | (F.col("forks_velocity") >= t["forks_velocity_floor"])
    ) & (F.col("slope") > 0)


def rising_direction(rows: DataFrame) -> DataFrame:
    """Rows with enough velocity whose sparkline rises. rows: entity_key, stars_velocity, forks_velocity, slope, at."""
    return _evidence(
        rows.filter(_rises()), "github", "trending_repos_direction", F.lit("watch"), "trending_direction_slope", F.col("slope"), F.col("at")
    )


def star_acceleration(rows: DataFrame) -> DataFrame:
    """Stars a day over 7 days against 30; without a baseline only watch. rows: entity_key, stars_7d, stars_30d, at."""
    m = RULES["momentum"]
    based = F.col("stars_30d") > 0
    ratio = X.floored_ratio(F.col("stars_7d"), 7, F.col("stars_30d"), 30, m["min_baseline_stars_per_day"])
    rows = rows.filter(F.col("stars_7d") >= RULES["repofomo"]["stars_7d_floor"])
    return _evidence(
        rows, "github", "repofomo", F.when(based, _ladder(ratio, m)).otherwise("watch"),
        F.when(based, "stars_accel_7d_vs_30d").otherwise("stars_7d"), F.when(based, ratio).otherwise(F.col("stars_7d")), F.col("at")
    )


def qualified_stories(rows: DataFrame, noise: DataFrame, projects: DataFrame) -> DataFrame:
    """Stories that are no noise and either have a strong entity or are classified as projects. rows: item_id, key_type, entity_key, url, ..."""
    domain = F.regexp_replace("entity_key", "^domain:", "")
    strong = (F.col("key_type") == "github") | ((F.col("key_type") == "domain") & ~X.content_domain(domain) & ~X.content_path(F.col("url")))
    kept = rows.join(noise.select("item_id").distinct(), "item_id", "left_anti").join(
        projects.select("item_id").distinct().withColumn("_project", F.lit(True)), "item_id", "left"
    )
    return kept.filter(strong | F.coalesce("_project", F.lit(False))).drop("_project")


def story_points(rows: DataFrame, since: Column, now: Column) -> DataFrame:
    """Best points of an entity's distinct stories in the window. rows: entity_key, item_id, story_id, points, at."""
    t = RULES["hn"]
    story = rows.filter(F.col("at").between(since, now)).groupBy("entity_key", "story_id").agg(
        F.max_by(F.struct("points", "at", "item_id"), F.struct("points", -F.col("item_id"))).alias("s")
    )
    best = story.groupBy("entity_key").agg(
        F.max_by("s", F.struct("s.points", -F.col("s.item_id"))).alias("b"), F.count(F.lit(1)).alias("stories")
    )
    level = X.level(F.col("b.points"), t["points_floor_watch"], t["points_breakthrough_potential"], None)
    return _evidence(best, "hn", "hn_max_points_7d", level, "hn_max_points_7d", F.col("b.points"), F.col("b.at"))


def launch_rank(rows: DataFrame) -> DataFrame:
    """The better of daily and weekly rank, row by row. rows: entity_key, daily_rank, weekly_rank, at."""
    t = RULES["product_hunt"]
    daily, weekly = F.coalesce("daily_rank", F.lit(999999)), F.coalesce("weekly_rank", F.lit(999999))
    rank = F.least(daily, weekly)
    level = F.when(rank <= t["rank_potential"], "potential").when(rank <= t["rank_watch"], "watch").otherwise("none")
    return _evidence(
        rows, "product_hunt", "product_hunt_rank", level, F.when(daily <= weekly, "daily_rank").otherwise("weekly_rank"), rank, F.col("at")
    )


def new_resources(rows: DataFrame, since: Column, now: Column, linked: Column) -> DataFrame:
    """Distinct resources of 48 hours; potential needs two and a repository link. rows: entity_key, resource_id, at, and what ``linked`` reads."""
    t = RULES["huggingface"]
    n = rows.filter(F.col("at").between(since, now)).groupBy("entity_key").agg(
        F.count_distinct("resource_id").alias("n"), F.min("at").alias("at"), F.bool_or(linked).alias("linked")
    )
    level = F.when(
        (F.col("n") >= t["exact_resources_48h_potential"]) & F.col("linked"), "potential"
    ).when(F.col("n") >= t["single_resource_watch"], "watch").otherwise("none")
    return _evidence(n, "huggingface", "huggingface_resources_48h", level, "hf_resources_48h", F.col("n"), F.col("at"))


def rising_downloads(rows: DataFrame) -> DataFrame:
    """Greatest daily against greatest weekly downloads of each package. rows: entity_key, package, metric_name, value, at."""
    t, m = RULES["npm_registry"], RULES["momentum"]
    day, week = F.col("metric_name") == "daily_downloads", F.col("metric_name") == "downloads_7d"
    p = rows.groupBy("entity_key", "package").agg(
        F.max(F.when(day, F.col("value"))).alias("daily"), F.max(F.when(week, F.col("value"))).alias("weekly"),
        F.max_by("at", F.when(day, F.struct("value", "at"))).alias("at")
    )
    p = p.filter(F.col("daily") >= t["daily_downloads_floor"])
    based = F.coalesce(F.col("weekly") > 0, F.lit(False))
    ratio = F.col("daily") / F.greatest(F.col("weekly") / 7, F.lit(m["min_baseline_daily_downloads"]))
    return _evidence(
        p, "package_family", "npm_registry_daily_downloads", F.when(based, _ladder(ratio, t)).otherwise("watch"),
        F.when(based, "daily_downloads_rising_ratio").otherwise("daily_downloads"), F.when(based, ratio).otherwise(F.col("daily")),
        F.col("at")
    )


def social_tier(rows: DataFrame, enabled: bool = True) -> DataFrame:
    """The best tier that cites a post. rows: entity_key, item_id, tier, ref, at."""
    level = F.when(
        F.col("tier").isin("high", "high_potential"), "high_potential"
    ).when(F.col("tier").isin("watch", "potential"), F.col("tier"))
    rows = rows.filter(F.lit(enabled) & level.isNotNull() & F.col("ref").contains("tweet:")).withColumn("_level", level)
    best = rows.groupBy("entity_key").agg(
        F.max_by(F.struct("_level", "at"), F.struct(X.level_rank(F.col("_level")), -F.col("item_id"))).alias("b")
    )
    return _evidence(best, "x_social", "x_social_tier", F.col("b._level"), "x_tier", X.level_rank(F.col("b._level")), F.col("b.at"))


def backfilled_stars(rows: DataFrame, now: Column) -> DataFrame:
    """Counted stars against the daily thresholds. rows: entity_key, stars_24h, stars_7d."""
    long = rows.unpivot(["entity_key"], ["stars_24h", "stars_7d"], "metric_name", "stars")
    out = _evidence(
        long, "github", "github_backfill", _ladder(F.col("stars"), RULES["github_trending"]), F.col("metric_name"), F.col("stars"), now
    )
    return out.withColumn("rule", F.concat(F.lit("github_backfill_"), "metric_name"))


def cross_source(evidence: DataFrame, since: Column, now: Column) -> DataFrame:
    """Entities with a repository or domain and weak signals of two families or more in 48 hours."""
    weak = evidence.filter(
        (F.col("level") == "watch") & F.col("event_at").between(since, now) & F.col("entity_key").rlike("^(github|domain):")
    )
    n = weak.groupBy("entity_key").agg(F.count_distinct("family").alias("n")).filter(
        F.col("n") >= RULES["verified_cross_source"]["weak_signals_48h_potential"]
    )
    return _evidence(
        n, "verified_cross_source", "verified_cross_source_two_weak_48h", F.lit("potential"), "weak_source_families_48h", F.col("n"), now
    )


def promoted(evidence: DataFrame, since: Column | None = None, now: Column | None = None) -> DataFrame:
    """entity_key, level, families, reasons, first_trigger_at: the greatest level, the sets, the least time.

    With ``since`` and ``now`` the cross-source rule counts too: its weak families are gathered in the same aggregation,
    so the evidence is read once and not once more for the rule that reads the others' results.
    """
    weak = F.lit(False)
    if since is not None:
        weak = (F.col("level") == "watch") & F.col("event_at").between(since, now) & F.col("entity_key").rlike("^(github|domain):")
    out = evidence.groupBy("entity_key").agg(
        F.max(X.level_rank(F.col("level"))).alias("r"), F.array_sort(F.collect_set("family")).alias("families"), F.array_sort(F.collect_set("rule")).alias("reasons"),
        F.min("event_at").alias("first_trigger_at"), F.size(F.collect_set(F.when(weak, F.col("family")))).alias("weak"),
    )
    crossed = F.col("weak") >= RULES["verified_cross_source"]["weak_signals_48h_potential"]
    more = lambda c, x: F.when(crossed, F.array_sort(F.array_append(c, F.lit(x)))).otherwise(F.col(c))
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("none", "watch", "potential", "high_potential")]),
        F.when(crossed, F.greatest("r", F.lit(2))).otherwise(F.col("r")) + 1
    )
    first = F.col("first_trigger_at") if now is None else F.when(
        crossed, F.least("first_trigger_at", now)
    ).otherwise(F.col("first_trigger_at"))
    return out.select(
        "entity_key", level.alias("level"), more("families", "verified_cross_source").alias("families"),
        more("reasons", "verified_cross_source_two_weak_48h").alias("reasons"), first.alias("first_trigger_at")
    )


def _in_turn() -> Column:
    """The order in which a source's rows are read: by rank, those without one last, then by id."""
    return F.struct(F.col("source_rank").isNull(), "source_rank", "item_id")


def backfill_producers(
    promoted: DataFrame, search: DataFrame, trending: DataFrame, packages: DataFrame, boards: DataFrame, repofomo: DataFrame, now: Column
) -> list[DataFrame]:
    """The four producers of backfill jobs, each with reasons of its own; where rows of a producer make one job, the last wins.

    promoted: entity_key, level. search: entity_key, item_id, source_rank, stars, created, pushed. trending: entity_key, stars_velocity,
    forks_velocity, slope. packages: entity_key, item_id, source_rank, package, weekly. boards, repofomo: entity_key of what is on them.
    """
    b, github = RULES["backfill"], F.col("entity_key").startswith("github:")
    potential = promoted.filter(F.col("level").isin("potential", "high_potential"))
    candidates = potential.filter(github).select(
        "entity_key", F.lit("potential_candidate").alias("reason"), (1_000_000 + X.level_rank(F.col("level"))).alias("priority")
    )

    found = search.filter(github).withColumn(
        "_speed", F.col("stars") / F.greatest((seconds(now) - seconds(F.col("created"))) / 86400, F.lit(1.0))
    )
    within = lambda at, days: F.col(at) >= now - F.expr(f"INTERVAL {days} DAYS")
    found = found.filter(
        (
            F.col("_speed") >= b["min_stars_per_day"]
        ) & within("pushed", b["pushed_within_days"]) & within("created", b["created_within_days"])
    )
    fast = found.join(
        boards.select("entity_key").distinct(), "entity_key", "left_anti"
    ).groupBy("entity_key").agg(F.max_by("_speed", _in_turn()).alias("priority"))
    fast = fast.withColumn("reason", F.lit("github_search_velocity_prefilter"))

    known = repofomo.select("entity_key").union(potential.select("entity_key")).distinct()
    rising = trending.filter(github & _rises()).join(known, "entity_key", "left_anti")
    rising = rising.groupBy("entity_key").agg(
        (100_000 + F.max(F.coalesce("stars_velocity", F.lit(0)))).alias("priority")
    ).withColumn("reason", F.lit("trending_repos_rising_watch"))

    named = packages.withColumn("package", F.trim("package")).filter(
        (F.col("package") != "") & (F.col("weekly") >= RULES["npm_registry"]["daily_downloads_floor"])
    )
    downloads = named.groupBy(
        "entity_key", F.concat(F.lit("package_downloads:"), "package").alias("reason")
    ).agg((500_000 + F.max_by("weekly", _in_turn())).alias("priority"))
    return [candidates, fast, rising, downloads]


def backfill_jobs(producers: list[DataFrame], most: int = RULES["backfill"]["max_jobs"]) -> DataFrame:
    """Jobs of all producers, (entity_key, reason, priority) each: the last producer of a job wins; the most urgent are kept."""
    rows = None
    for k, p in enumerate(producers):
        p = p.select("entity_key", "reason", F.col("priority").cast("double").alias("priority"), F.lit(k).alias("_k"))
        rows = p if rows is None else rows.unionByName(p)
    last = rows.groupBy("entity_key", "reason").agg(F.max_by("priority", "_k").alias("priority"))
    return last.orderBy(F.desc("priority"), "entity_key", "reason").limit(most)


def edge_watch_refs(promoted: DataFrame, items: DataFrame) -> DataFrame:
    """entity_key, ref: all items of each entity at level watch, a row a reference, so no row grows with an entity. items: entity_key, item_id."""
    watched = promoted.filter("level = 'watch'").select("entity_key")
    refs = items.filter(F.col("item_id").isNotNull()).select(
        "entity_key", F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("ref")
    )
    return refs.join(watched, "entity_key", "left_semi")


#: What backfilled metrics are safe for, and how their completeness is noted.
BACKFILL_SAFETY = {"github_stars_24h": "as_of_safe", "github_stars_7d": "as_of_safe", "github_forks_total": "partial_as_of"}
BACKFILL_NOTES = ("lower_bound_due_to_page_cap", "complete_recent_pages", "repo metadata snapshot")


def backfill_evidence(jobs: DataFrame, stars: DataFrame, repos: DataFrame, now: Column) -> DataFrame:
    """entity_key, metric_name, metric_value (text), historical_safety, note: three rows a job, over landed star events and repository records.

    Star counts of the last day and week include both ends; where a repository's pages were capped they are lower bounds,
    and say so. jobs: entity_key, repo; stars: repo, at; repos: repo, forks, lower_bound.
    """
    at, hours = F.col("at"), lambda h: now - F.expr(f"INTERVAL {h} HOURS")
    within = lambda h: F.count_if((at >= hours(h)) & (at <= now))
    recent = stars.filter((at >= hours(168)) & (at <= now)).groupBy("repo").agg(within(24).alias("s24"), within(168).alias("s7"))
    rows = jobs.join(recent, "repo", "left").join(repos.select("repo", "forks", "lower_bound"), "repo", "left")
    bound = F.when(F.coalesce("lower_bound", F.lit(False)), BACKFILL_NOTES[0]).otherwise(BACKFILL_NOTES[1])
    values = (F.coalesce("s24", F.lit(0)), F.coalesce("s7", F.lit(0)), F.coalesce("forks", F.lit(0)))
    notes = (bound, bound, F.lit(BACKFILL_NOTES[2]))
    out = [
        F.struct(F.lit(name).alias("metric_name"), value.cast("long").cast("string").alias("metric_value"), F.lit(safety).alias("historical_safety"), note.alias("note"))
        for (name, safety), value, note in zip(BACKFILL_SAFETY.items(), values, notes, strict=True)
    ]
    return rows.select("entity_key", F.explode(F.array(*out)).alias("e")).select("entity_key", "e.*")

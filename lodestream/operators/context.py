"""What is known of an entity or group, bounded for those who judge it: link, description, evidence, facts, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalars import key_url, preview

from .grouping import best_alias, merged_bullets
from .windows import first_per

#: Links of a bundle; characters of a stored text, of its preview, of a scout's snippet, note and title; snippets and sources of a scout.
SOURCE_LINKS, EXCERPT, PREVIEW, SNIPPET, NOTE, TITLE, SUMMARIES, SOURCES = 12, 8000, 1000, 4000, 600, 240, 8, 12
#: Facts and references of a brief; tokens of a model's context, of its answer, of the margin.
FACTS, FACT_REFS, CONTEXT_TOKENS, ANSWER_TOKENS, MARGIN_TOKENS = 12, 12, 32_000, 3_000, 500
KNOWN_PARADIGMS = ("github:nousresearch/hermes-agent",)


def _in_order(order: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda r: r["v"])


def excerpts(keys: DataFrame, landed: DataFrame) -> DataFrame:
    """key, excerpt, preview, chars of the landed texts of the keys. keys: key; landed: key, at, text (the latest counts)."""
    text = landed.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by("text", "at").alias("t"))
    cut = F.substring(F.coalesce("t", F.lit("")), 1, EXCERPT)
    return text.select("key", cut.alias("excerpt"), F.substring(cut, 1, PREVIEW).alias("preview"), F.length(cut).alias("chars"))


def context_bundles(entities: DataFrame, aliases: DataFrame, sources: DataFrame, texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per entity: canonical_link and its binding, context_preview, has_readme, evidence_count, families, source_link_count, source_links.

    The link is that of the canonical key (verified), of the best alias (resolved) or of the best source (weak); the preview
    is the repository's latest well-read text, else the first description.

    entities: entity_key, canonical_key; aliases: as ``best_alias`` takes them; sources: entity_key, item_id, url,
    description; texts: key (owner/repo), status, at, text; evidence: as ``merged_bullets`` takes it, ref being an item id.
    """
    known = entities.select("entity_key", "canonical_key")
    alias = best_alias(aliases.join(known, "entity_key"), F.col("canonical_key"))
    url = F.trim("url")
    kind = F.when(url.startswith("https://github.com/"), 0).when(url.startswith("https://www.npmjs.com/package/"), 1).otherwise(2)
    source = sources.groupBy("entity_key").agg(
        F.min_by(F.when(url.rlike("^https?://"), url), F.when(url.rlike("^https?://"), F.struct(kind, "item_id"))).alias("source_url"),
        F.min_by("description", F.when(F.col("description") != "", F.col("item_id"))).alias("description"),
    )
    read = texts.filter("status = 'ok'").groupBy(F.col("key").alias("repo")).agg(F.max_by("text", "at").alias("readme"))
    bullets = merged_bullets(evidence)
    counted = bullets.groupBy("entity_key").agg(
        F.count(F.lit(1)).alias("evidence_count"), F.array_sort(F.collect_set("family")).alias("families")
    )
    refs = evidence.filter("ref is not null").select("entity_key", "ref").distinct().join(
        sources.select(F.col("item_id").alias("ref"), F.col("url").alias("ref_url")).distinct(), "ref"
    )
    total = refs.groupBy("entity_key").agg(F.count(F.lit(1)).alias("source_link_count"))
    first = first_per(
        refs, ["entity_key"], [F.col("ref").asc(), F.col("ref_url").asc()], SOURCE_LINKS
    ).groupBy("entity_key").agg(_in_order("ref", "ref_url").alias("source_links"))
    repo = lambda c: F.when(F.col(c).startswith("github:"), F.regexp_replace(c, "^github:", ""))
    out = known.join(alias, "entity_key", "left").join(source, "entity_key", "left").withColumn(
        "repo", F.coalesce(repo("canonical_key"), repo("alias"))
    )
    out = out.join(read, "repo", "left").join(
        counted, "entity_key", "left"
    ).join(total, "entity_key", "left").join(first, "entity_key", "left")
    own, other = key_url(F.col("canonical_key")), key_url(F.col("alias"))
    readme = F.substring(preview(F.coalesce("readme", F.lit(""))), 1, PREVIEW)
    return out.select(
        "entity_key", F.coalesce(own, other, "source_url").alias("canonical_link"),
        F.when(own.isNotNull(), "verified").when(other.isNotNull(), "resolved").when(F.col("source_url").isNotNull(), "weak").otherwise("none").alias("binding"),
        F.when(readme != "", readme).otherwise(preview(F.coalesce("description", F.lit("")))).alias("context_preview"), (readme != "").alias("has_readme"),
        F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("source_link_count", F.lit(0)).alias("source_link_count"), F.coalesce("source_links", F.array().cast("array<string>")).alias("source_links"),
    )


def best_group_links(members: DataFrame, keys: DataFrame) -> DataFrame:
    """group_id, link: the first repository alias over the members in order, else the first link of a canonical key or an alias.

    members: group_id, ord, entity_key (the canonical entity first); keys: entity_key, canonical_key, alias.
    """
    rows = members.join(keys, "entity_key", "left")
    alias = key_url(F.lower("alias"))
    any_link = F.coalesce(key_url(F.lower("canonical_key")), alias)
    repo = F.when(F.col("alias").startswith("github:"), F.col("ord"))
    found = rows.groupBy("group_id").agg(
        F.min_by(alias, repo).alias("a"), F.min_by(any_link, F.when(any_link.isNotNull(), F.col("ord"))).alias("b")
    )
    return found.select("group_id", F.coalesce("a", "b", F.lit("")).alias("link"))


def identity_value(value: Column) -> Column:
    """A name, key or link as it is compared: lower case, no slash at its end, repository links as keys; null if empty."""
    text = F.regexp_replace(F.lower(F.trim(value)), "/+$", "")
    repo = F.regexp_extract(text, r"^https?://github\.com/([^/]+/[^/]+)", 1)
    return F.when(repo != "", F.concat(F.lit("github:"), repo)).when(text != "", text)


def known_paradigm(columns: list[Column], known: tuple[str, ...] = KNOWN_PARADIGMS) -> Column:
    """Whether any identity value of a row is one of the configured keys (a short list)."""
    keys = [k.strip().lower().rstrip("/") for k in known]
    return F.coalesce(
        F.exists(F.array(*[identity_value(c) for c in columns]), lambda v: v.isin(*keys)), F.lit(False)
    ) if keys else F.lit(False)


def fact_packets(claims: DataFrame) -> DataFrame:
    """group_id, facts, refs: supporting, then negative claims with text and references, twelve at most, and their distinct references.

    claims: group_id, polarity, ord, claim, evidence_refs, supports_axes, claim_type.
    """
    good = claims.filter((F.trim(F.coalesce("claim", F.lit(""))) != "") & (F.coalesce(F.size("evidence_refs"), F.lit(0)) > 0))
    good = good.withColumn("_p", F.when(F.col("polarity") == "supporting", 0).otherwise(1))
    top = first_per(good, ["group_id"], [F.col("_p").asc(), F.col("ord").asc()], FACTS)
    fact = F.struct(
        F.substring(F.trim("claim"), 1, 1000).alias("fact"), F.slice("evidence_refs", 1, 8).alias("evidence_refs"), F.slice("supports_axes", 1, 8).alias("supports_axes"),
        F.coalesce("claim_type", F.lit("observed")).alias("fact_type"), "polarity",
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct("_p", "ord", fact.alias("f")))), lambda r: r["f"])
    out = top.groupBy("group_id").agg(rows.alias("facts"))
    return out.withColumn("refs", F.slice(F.array_distinct(F.flatten(F.transform("facts", lambda f: f["evidence_refs"]))), 1, FACT_REFS))


def scout_contexts(members: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """group_id, has_readme, project_context, qualitative_summaries, source_context: bounded texts in lists of distinct entries.

    members: group_id, ord, context_preview, has_readme; notes: group_id, ord, note; links: group_id, ord, source, title, url.
    """

    def firsts(df: DataFrame, value: str, most: int) -> DataFrame:
        distinct = df.filter(F.col(value).isNotNull()).groupBy("group_id", value).agg(F.min("ord").alias("ord"))
        return first_per(
            distinct, ["group_id"], [F.col("ord").asc(), F.col(value).asc()], most
        ).groupBy("group_id").agg(_in_order("ord", value).alias(value))

    clean = lambda c, n: F.nullif(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, n), F.lit(""))
    base = members.groupBy("group_id").agg(F.max(F.coalesce("has_readme", F.lit(False))).alias("has_readme"))
    project = firsts(
        members.select("group_id", "ord", clean("context_preview", SNIPPET).alias("project_context")), "project_context", SUMMARIES
    )
    summary = firsts(
        notes.select("group_id", "ord", clean("note", NOTE).alias("qualitative_summaries")), "qualitative_summaries", SUMMARIES
    )
    entry = F.struct(
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce(clean("title", TITLE), F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url")
    )
    source = firsts(links.select("group_id", "ord", entry.alias("source_context")), "source_context", SOURCES)
    return base.join(project, "group_id", "left").join(summary, "group_id", "left").join(source, "group_id", "left")


def fitted_contexts(
    sections: DataFrame, raw: str = "recent_raw_tool_results", most: int = CONTEXT_TOKENS - ANSWER_TOKENS - MARGIN_TOKENS
) -> DataFrame:
    """id, total, dropped_raw, rejected: the raw section goes if the whole is too large; what then is too large still is rejected.

    sections: id, section, tokens.
    """
    own = sections.groupBy("id").agg(
        F.sum("tokens").alias("_all"), F.coalesce(F.sum(F.when(F.col("section") == raw, F.col("tokens"))), F.lit(0)).alias("_raw"),
        F.count_if(F.col("section") == raw).alias("_n")
    )
    drop = (F.col("_all") > most) & (F.col("_n") > 0)
    total = F.when(drop, F.col("_all") - F.col("_raw")).otherwise(F.col("_all"))
    return own.select("id", total.alias("total"), drop.alias("dropped_raw"), (total > most).alias("rejected"))


def allocated(rows: DataFrame, budget: int, most: int = 80) -> DataFrame:
    """id, included, retrievable, excluded (item ids): rows that fit the budget in order, and of the others those that can be asked for.

    rows: id, item_id, value (greatest first), tokens, retrievable. A bundle has at most ``most`` rows.
    """
    top = first_per(rows, ["id"], [F.desc("value"), F.col("item_id").asc()], most)
    one = F.struct(
        (-F.col("value")).alias("o"), F.col("item_id").alias("i"), F.col("tokens").cast("long").alias("t"),
        F.coalesce("retrievable", F.lit(True)).alias("r")
    )
    none = F.array().cast("array<long>")
    start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("included"), none.alias("retrievable"), none.alias("excluded"))

    def step(s: Column, x: Column) -> Column:
        fits, add = s["used"] + x["t"] <= budget, lambda name: F.concat(s[name], F.array(x["i"].cast("long")))
        return F.struct(
            F.when(fits, s["used"] + x["t"]).otherwise(s["used"]).alias("used"), F.when(fits, add("included")).otherwise(s["included"]).alias("included"),
            F.when(~fits & x["r"], add("retrievable")).otherwise(s["retrievable"]).alias("retrievable"), F.when(~fits & ~x["r"], add("excluded")).otherwise(s["excluded"]).alias("excluded"),
        )

    return top.groupBy("id").agg(
        F.aggregate(F.array_sort(F.collect_list(one)), start, step).alias("s")
    ).select("id", "s.included", "s.retrievable", "s.excluded")


def feed_read_model(
    feed: DataFrame, groups: DataFrame, scores: DataFrame, reports: DataFrame, briefs: DataFrame, votes: DataFrame,
    known: tuple[str, ...] = KNOWN_PARADIGMS
) -> DataFrame:
    """Feed rows with what there is of their group: ⋈ groups, ⟕ score, report, brief and vote, and how they are shown.

    All have group_id; feed also section, place, route; groups canonical_name, canonical_key, canonical_link; votes vote.
    """
    out = feed.join(groups, "group_id")
    for other in (scores, reports, briefs, votes):
        out = out.join(other, "group_id", "left")
    paradigm = known_paradigm([F.col("canonical_name"), F.col("canonical_key"), F.col("canonical_link")], known)
    scored = (F.col("section") == "scored") | (F.col("route") == "suppress_or_low")
    shown = F.when(F.col("section") == "today_focus", "focus").when(
        scored & (F.col("route") == "score_only"), "signals"
    ).when(scored, "low").otherwise("diagnostics")
    return out.withColumn("known_paradigm", paradigm).withColumn("shown_as", shown)

"""Resolving items to entities by their link keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import scalars as X

from .components import connected_components, saved


def item_keys(texts: Column, name: Column, item_id: Column, keep_subdomain: Column) -> Column:
    """Merge keys of an item: its repositories, else its domains, else its name, else itself."""
    joined = F.array_join(texts, "\n")
    repos, domains, named = X.github_keys(joined), X.domain_keys(joined, keep_subdomain), X.name_key(name)
    own = F.array(F.coalesce(named, F.concat(F.lit("item:"), item_id.cast("string"))))
    return F.when(F.size(repos) > 0, repos).when(F.size(domains) > 0, domains).otherwise(own)


def resolve(items: DataFrame, item_id: str = "item_id", keys: str = "keys") -> DataFrame:
    """item_id, root: items that share a key, directly or through others, have one root (the least key of all).

    Only items with two keys or more make edges; the rest follow their key's group.
    """
    exploded = items.select(item_id, F.explode(keys).alias("key"))
    edges = items.filter(F.size(keys) > 1).select(F.explode(F.slice(keys, 2, 1 << 30)).alias("b"), F.element_at(keys, 1).alias("a"))
    roots = connected_components(edges).withColumnRenamed("node", "key")
    rooted = exploded.join(roots, "key", "left").select(item_id, F.coalesce("component", "key").alias("root"))
    return rooted.groupBy(item_id).agg(F.min("root").alias("root"))


def entities(items: DataFrame, roots: DataFrame, item_id: str = "item_id", keys: str = "keys", alias: str = "name") -> DataFrame:
    """root, entity_id, canonical_key, canonical_entity, n_items, n_aliases.

    The canonical key is the strongest kind's least; the canonical name is the shortest alias, then the least.
    """
    rows = items.join(roots, item_id)
    key = rows.select("root", F.explode(keys).alias("key")).groupBy("root").agg(
        F.min_by("key", F.struct(-X.key_strength(F.col("key")), F.col("key"))).alias("canonical_key")
    )
    a = F.when(F.trim(alias) != "", F.trim(alias))
    names = rows.groupBy("root").agg(
        F.min(F.when(a.isNotNull(), F.struct(F.length(a).alias("n"), a.alias("a"))))["a"].alias("_name"),
        F.count(F.lit(1)).alias("n_items"), F.count_distinct(a).alias("n_aliases")
    )
    out = key.join(names, "root")
    return out.select(
        "root", X.stable_id("entity:", F.col("canonical_key")).alias("entity_id"), "canonical_key",
        F.coalesce("_name", "canonical_key").alias("canonical_entity"), "n_items", "n_aliases"
    )


def resolve_day(labels: DataFrame, items: DataFrame, day: str, item_id: str = "item_id", keys: str = "keys") -> tuple[DataFrame, DataFrame]:
    """What a day's items change of the labels, and which roots it merges: (key, root, since) and (root, into, day).

    The day's keys are looked up, its edges contracted to the roots that they have, and components found among those
    alone, so the rounds work on the day's edges, however long the history. A new group takes its least key as root; where
    groups meet, the root of the earliest day stays (then the least), so ids last, and the others are written as merged.
    Changed labels are those of new keys and of merged groups; ``relabelled`` applies them.
    """
    exploded = items.select(F.explode(keys).alias("key")).distinct()
    known = exploded.join(labels, "key", "left").select("key", F.coalesce("root", "key").alias("node"), "since")
    known = saved(known, "day-keys")
    ends = items.filter(F.size(keys) > 1).select(
        F.element_at(keys, 1).alias("a"), F.explode(F.slice(keys, 2, 1 << 30)).alias("b")
    ).distinct()
    of = lambda c: known.select(F.col("key").alias(c), F.col("node").alias(f"{c}_node"))
    edges = ends.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    met = connected_components(edges)
    nodes = known.groupBy("node").agg(F.min("since").alias("since")).join(met, "node", "left").select(
        "node", "since", F.coalesce("component", "node").alias("group")
    )
    oldest = F.struct(F.coalesce("since", F.lit(day)).alias("since"), F.col("since").isNull().alias("new"), F.col("node"))
    heads = nodes.groupBy("group").agg(F.min(oldest).alias("head")).select(
        "group", F.col("head.node").alias("into"), F.col("head.since").alias("head_since")
    )
    nodes = saved(nodes.join(heads, "group").select("node", "since", "into", "head_since"), "day-groups")
    merges = nodes.filter("since is not null and node != into").select(F.col("node").alias("root"), "into", F.lit(day).alias("day"))
    new = known.filter("since is null").join(nodes, "node").select("key", F.col("into").alias("root"), F.col("head_since").alias("since"))
    moved = labels.join(
        nodes.filter("since is not null and node != into").select(F.col("node").alias("root"), "into", "head_since"), "root"
    )
    return new.unionByName(moved.select("key", F.col("into").alias("root"), F.col("head_since").alias("since"))), merges


def relabelled(labels: DataFrame, changed: DataFrame) -> DataFrame:
    """The labels after a day: changed ones in place of what there was."""
    return labels.join(changed, "key", "left_anti").unionByName(changed)


def labelled(items: DataFrame, labels: DataFrame, item_id: str = "item_id", keys: str = "keys") -> DataFrame:
    """item_id, root of items of any day, by the label of their first key."""
    return items.select(item_id, F.element_at(keys, 1).alias("key")).join(labels, "key").select(item_id, "root")

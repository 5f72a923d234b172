"""Groups of candidates that stand for one project, with their aliases, evidence and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.scalars import content_domain, key_url

from .windows import first_per


def best_alias(aliases: DataFrame, canonical: Column, order: str = "context") -> DataFrame:
    """entity_key, alias: the first approved alias by kind, then id. aliases: entity_key, alias, origin, external, approved, id.

    ``context`` puts the resolver's aliases first, ``presentation`` goes by link kind alone.
    """
    a = F.col("alias")
    kind = F.when(a.startswith("github:"), 2).when(a.startswith("domain:"), 3).when(a.startswith("npm:"), 4).otherwise(5)
    if order == "context":
        rank = F.when(
            (F.col("origin") == "resolver") & (F.col("external") == canonical), 0
        ).when(F.col("origin") == "resolver", 1).otherwise(kind)
    else:
        rank = F.when(a.startswith("github:"), 0).when(a.startswith("npm:"), 1).when(a.startswith("domain:"), 2).otherwise(3)
    ok = aliases.filter(F.col("approved") & a.rlike("^(github|domain|npm):"))
    return first_per(ok, ["entity_key"], [rank.asc(), F.col("id").asc()]).select("entity_key", "alias")


def link_group_key(key: Column) -> Column:
    """The key itself if it names a project: repositories, packages, domains that are no media site."""
    low = F.lower(key)
    domain = F.regexp_replace(low, "^domain:", "")
    return F.when(key.rlike("^(github|npm):"), low).when(key.startswith("domain:") & ~content_domain(domain), low)


def groups(rows: DataFrame) -> DataFrame:
    """Candidates of one presentation key as a group. rows: entity_key, name, level, level_rank, canonical_key, alias, source_key, family."""
    key = F.coalesce(
        link_group_key(F.col("alias")), link_group_key(F.col("canonical_key")), F.concat(F.lit("link:"), F.lower(key_url(F.col("alias")))),
        F.col("source_key"), F.concat(F.lit("entity:"), F.col("entity_key"))
    )
    r = rows.withColumn("presentation_key", key)
    first = F.struct(-F.col("level_rank"), F.lower("name"), F.col("entity_key"))
    one = r.groupBy("presentation_key", "entity_key").agg(
        F.first("name").alias("name"), F.first("level").alias("level"), F.first("level_rank").alias("level_rank"),
        F.collect_set("family").alias("f")
    )
    g = one.groupBy("presentation_key").agg(
        F.min_by(F.struct("entity_key", "name", "level"), first).alias("c"), F.array_sort(F.collect_set("entity_key")).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))).alias("families")
    )
    members = F.concat(F.array("c.entity_key"), F.filter("all", lambda e: e != F.col("c.entity_key")))
    g = g.withColumn("members", members)
    return g.select(
        "presentation_key", F.concat(F.lit("group:"), F.substring(F.sha1(F.array_join("members", "|")), 1, 12)).alias("group_id"),
        F.col("c.entity_key").alias("canonical_entity"), F.col("c.level").alias("level"), "members", "families"
    )


BULLET = ["entity_key", "label", "family", "origin", "badge"]


def _bullet_refs(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BULLET, "ref").agg(F.min("id").alias("id"), F.min_by("strength", "id").alias("strength"))


def merged_bullets(rows: DataFrame) -> DataFrame:
    """Bullets of one label, family, origin and badge as one: the first strength and how many refs. rows also: id, strength, ref.

    The refs themselves are rows (``bullet_refs``), so no row grows with a bullet.
    """
    return _bullet_refs(rows).groupBy(*BULLET).agg(F.min_by("strength", "id").alias("strength"), F.count("ref").alias("refs"))


def bullet_refs(rows: DataFrame) -> DataFrame:
    """The distinct refs of each merged bullet, a row each, with the least id that brought it, by which they are in order."""
    return _bullet_refs(rows).filter("ref is not null").select(*BULLET, "ref", "id")


def evidence_hash(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A content hash of all evidence of a key, free of row order: the sums of its rows' hashes in 32-bit parts, and their number.

    Sums, unlike exclusive-ors, tell repeated rows. It combines before the shuffle, so a key with any number of rows (below
    2**31, where a sum would overflow) costs one row a task.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)
    part = lambda i: F.sum(F.conv(F.substring("_h", i, 8), 16, 10).cast("long")) % (1 << 32)
    hexed = lambda i: F.lpad(F.lower(F.hex(part(i))), 8, "0")
    return rows.withColumn("_h", h).groupBy(key).agg(
        F.concat(*[hexed(i) for i in range(1, 65, 8)], F.lit("-"), F.count(F.lit(1)).cast("string")).alias("evidence_hash")
    )


def relative_buckets(anchors: DataFrame, events: DataFrame, edges: list[int]) -> DataFrame:
    """Events around each anchor in half-open buckets of days, the last one closed. anchors: key, t0; events: key, at."""
    days = F.datediff("at", "t0")
    joined = events.join(anchors, "key")
    out = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        end = (days <= hi) if hi == edges[-1] else (days < hi)
        out = F.when((days >= lo) & end, F.lit(lo)) if out is None else out.when((days >= lo) & end, F.lit(lo))
    return joined.withColumn("bucket", out).filter("bucket is not null").groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))

"""Scores, routes, schedules and feed sections of candidate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.scalars import bounded_strings, clamped

from .windows import spread_ranked

#: Kinds of objects that are no product, for deep dives and for scouting.
NO_DEEPDIVE = ("article", "funding", "model_release", "news", "resource_list", "tutorial")
NO_SCOUTING = ("model", "article", "tutorial", "discussion", "news", "unknown")
NOVELTY = ("workflow_shift", "technical_substance", "product_market_fit")
CLAIM_TYPES = ("observed", "inferred")


def investigator_score(object_type: Column, product: Column) -> Column:
    """Weighted axes less both penalties, 0 to 100; at most 69 without a strong core axis, 55 for news that is no product."""
    a = {n: clamped(F.col(n), 0, 100) for n in ("workflow_shift", "technical_substance", "product_market_fit", "momentum", "confidence")}
    penalty = clamped(F.col("risk_penalty"), 0, 25) + clamped(F.col("derivative_news_penalty"), 0, 25)
    raw = 0.25 * a["workflow_shift"] + 0.25 * a[
        "technical_substance"
    ] + 0.20 * a["product_market_fit"] + 0.15 * a["momentum"] + 0.15 * a["confidence"] - penalty
    score = F.round(clamped(raw, 0, 100), 2)
    score = F.when(F.greatest(*[a[n] for n in NOVELTY]) < 70, F.least(score, F.lit(69.0))).otherwise(score)
    return F.when(object_type.isin("news", "article") & ~product, F.least(score, F.lit(55.0))).otherwise(score)


def legacy_score() -> Column:
    """Other weights, and only the news penalty."""
    raw = 0.25 * F.col("momentum") + 0.25 * F.col("workflow_shift") + 0.20 * F.col("technical_substance") + 0.15 * F.col("product_market_fit") + 0.15 * F.col("confidence") - F.col(
        "derivative_news_penalty"
    )
    return F.round(clamped(raw, 0, 100), 2)


def scout_decision(concrete: Column, object_type: Column, axes: list[Column]) -> tuple[Column, Column]:
    """(included, score): a concrete product with a strong axis; 0.35, 0.75, 0.85, 0.95 by how many are strong."""
    strong = sum((F.when(a == "strong", 1).otherwise(0) for a in axes[1:]), F.when(axes[0] == "strong", 1).otherwise(0))
    ok = concrete & ~object_type.isin(*NO_SCOUTING)
    return ok & (strong > 0), F.when(~ok, 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0.35, 0.75, 0.85, 0.95)]), strong + 1))


def product_or_repo(object_type: Column, flag: Column) -> Column:
    return flag & ~F.lower(F.trim(F.coalesce(object_type, F.lit("unknown")))).isin(*NO_DEEPDIVE)


def selected_for_brief(scored: DataFrame, minimum: float = 70, target: int = 8, most: int = 10) -> DataFrame:
    """The top ``target``, and those that tie with the last of them, up to ``most``. One ordered prefix of at most ``most`` rows."""
    order = [F.desc("score"), F.desc("level_rank"), F.asc("group_id")]
    ok = (F.col("score") >= minimum) & product_or_repo(
        F.col("object_type"), F.col("is_product_or_repo")
    ) & F.col("should_print") & ~F.col("failed")
    top = scored.filter(ok).orderBy(*order).limit(most)
    w = Window.orderBy(*order)  # over ``most`` rows
    top = top.withColumn("brief_rank", F.row_number().over(w))
    cut = F.max(F.when(F.col("brief_rank") == min(target, most), F.col("score"))).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("_cut", cut).filter((F.col("brief_rank") <= target) | (F.col("score") == F.col("_cut"))).drop("_cut")


def route(selected: Column, score_only: float = 50) -> Column:
    ok = F.col("should_print") & product_or_repo(F.col("object_type"), F.col("is_product_or_repo"))
    return F.when(F.col("failed"), "candidate_error").when(~ok, "suppress_or_low").when(selected, "score_plus_deepdive").when(
        F.col("score") >= score_only, "score_only"
    ).otherwise("suppress_or_low")


def routed(scored: DataFrame, known: Column) -> DataFrame:
    """``scored`` with brief_rank, route and section. What is known keeps its route but gets no brief."""
    chosen = selected_for_brief(scored.filter(~known)).select("group_id", "brief_rank")
    out = scored.join(F.broadcast(chosen), "group_id", "left")  # at most ten rows
    out = out.withColumn("route", route(F.col("brief_rank").isNotNull()))
    return out.withColumn(
        "section",
        F.when(F.col("route") == "candidate_error", "diagnostics").when(
            F.col("route") == "score_plus_deepdive", "today_focus"
        ).otherwise("scored")
    )


def feed(scored: DataFrame, known: Column) -> DataFrame:
    """group_id, section, place, route: focus by brief rank, scored (score only, then suppressed, one running place), diagnostics."""
    lane = F.when(F.col("route") == "score_only", 0).otherwise(1)
    order = [F.coalesce("brief_rank", F.lit(0)), lane, F.desc("score"), F.asc("group_id")]
    rows = routed(scored, known).select("group_id", "section", "route", "brief_rank", "score")
    return spread_ranked(rows, "place", ["section"], order).select("group_id", "section", "place", "route")


def scheduled(groups: DataFrame, previous: DataFrame, score_cap: int | None, scout_cap: int = 50) -> DataFrame:
    """group_id, lane: unchanged hashes are skipped; the rest goes, most urgent first, to its lane up to the lane's cap.

    A lane's first rows are an ordered prefix of as many rows as its cap, so no task sorts a lane.
    """
    before = previous.select("group_id", F.col("evidence_hash").alias("_before"))
    g = groups.join(before, "group_id", "left").withColumn("_same", F.coalesce(F.col("_before") == F.col("evidence_hash"), F.lit(False)))
    scout = F.col("level") == "edge_watch"
    order = [F.desc("level_rank"), F.lower("canonical_name"), F.col("group_id")]
    first = lambda of, cap: g.filter(~F.col("_same") & of).orderBy(*order).limit(cap).select("group_id", F.lit(True).alias("_in"))
    chosen, capped = first(scout, scout_cap), bool(score_cap and score_cap > 0)
    if capped:
        chosen = chosen.union(first(~scout, score_cap))
    g = g.join(F.broadcast(chosen), "group_id", "left")  # as many rows as both caps
    within = F.col("_in").isNotNull() | (F.lit(not capped) & ~scout)
    return g.select(
        "group_id", F.when(F.col("_same"), "skipped").when(~within, "pending").when(scout, "scout").otherwise("score_now").alias("lane")
    )


def checked_claims(claims: DataFrame, refs: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """claim_id, error: what is wrong with a claim, null for good ones. claims: claim_id, claim, evidence_refs, supports_axes, claim_type."""
    cited = claims.select("claim_id", F.explode(bounded_strings(F.col("evidence_refs"), 8, 160)).alias("ref"))
    unknown = cited.join(
        refs.select("ref").distinct(), "ref", "left_anti"
    ).select("claim_id").distinct().withColumn("_unknown", F.lit(True))
    bad_axis = F.exists("supports_axes", lambda a: ~a.isin(*axes))
    error = (
        F.when(F.trim(F.coalesce("claim", F.lit(""))) == "", "missing text")
        .when(F.coalesce(F.size("evidence_refs"), F.lit(0)) < 1, "no evidence")
        .when(F.col("_unknown"), "unknown evidence")
        .when(F.coalesce(F.size("supports_axes"), F.lit(0)) < 1, "no axes")
        .when(bad_axis, "unknown axis")
        .when(~F.coalesce("claim_type", F.lit("")).isin(*CLAIM_TYPES), "claim type")
    )
    return claims.join(unknown, "claim_id", "left").select("claim_id", error.alias("error"))


#: Characters of a rich readme, and how much attributable evidence lets a candidate be scored at once.
RICH_README, ENOUGH_EVIDENCE = 180, 2


def preflight(
    readme_chars: Column, context_chars: Column, evidence: Column, families: Column, key: Column, open_matters: Column | None = None
) -> dict[str, Column]:
    """How much is known for each axis, and how the candidate is to be scored.

    ``open_matters`` says whether evidence was left out or momentum is to be verified: then nothing is scored at once.
    """
    repo = key.startswith("github:")
    resolved = key.rlike("^(github|domain|npm):")
    rich = repo & (readme_chars >= RICH_README)
    ready = resolved & rich & (evidence >= ENOUGH_EVIDENCE)
    if open_matters is not None:
        ready &= ~F.coalesce(open_matters, F.lit(False))
    return {
        "identity": F.when(resolved, "strong").when((key != "") | (evidence > 0), "medium").otherwise("weak"),
        "workflow_shift": F.when(rich, "strong").when(context_chars > 0, "medium").otherwise("weak"),
        "technical_substance": F.when(rich, "strong").when(repo, "medium").otherwise("weak"),
        "product_market_fit": F.when((context_chars > 0) | (evidence > 0), "medium").otherwise("weak"),
        "momentum": F.when(families >= 3, "strong").when((families > 0) | (evidence > 0), "medium").otherwise("weak"),
        "mode": F.when((key == "") & (evidence == 0) & (readme_chars == 0), "cannot_score").when(ready, "score_from_context").otherwise("investigate"),
    }

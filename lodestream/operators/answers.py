"""Checks of what models answered, requests to ask them, and what is still open about a candidate.

Answers are JSON read as variants, so that a number in quotes is not a number and null is not absent. Each check gives
one error a row: null for good answers, else the first rule broken. Text that is no JSON object is ``not an object``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions import scalars as X

from .mentions import CONFIDENCES, TIERS

#: Strengths, kinds, levels and axes of answers, and the fields that they hold.
STRENGTHS = ("neutral", "recommendation", "strong_recommendation", "adoption_or_usage", "strong_emotion", "mixed")
OBJECT_TYPES = ("product", "repo", "package", "research_tool", "model_release", "article", "news", "unknown")
LEVELS = ("weak", "medium", "strong")
AXES = ("workflow_shift", "technical_substance", "product_market_fit", "momentum", "confidence", "risk_penalty", "derivative_news_penalty")
SUFFICIENCY = ("identity", "workflow_shift", "technical_substance", "product_market_fit", "momentum")
TRIAGE_FIELDS = (
    "tweet_id", "about_concrete_project", "closer_look", "product_names", "product_links", "project_refs", "expression_strength",
    "evidence_quote", "reason"
)
REF_FIELDS = ("entity_key", "entity_name", "entity_confidence", "confidence")
TIER_FIELDS = ("entity_key", "x_tier", "entity_confidence", "x_expression_strength", "cited_tweet_ids", "rationale", "cross_source_notes")
SCORE_FIELDS = (
    "object_type", "is_product_or_repo", "axes", "supporting_evidence", "negative_evidence", "known_gaps", "primary_reason",
    "rationale_short", "topic_tags", "caveats", "should_print"
)
CLAIM_FIELDS, CLAIM_KINDS = ("claim", "evidence_refs", "supports_axes", "claim_type"), ("observed", "inferred")

#: What is to be found out about a candidate, in the order it is asked, and from where a description is whole.
QUESTIONS = {
    "unresolved_identity": "Resolve the candidate identity and canonical first-party source.",
    "needs_product_description": "Retrieve an attributable first-party product description.",
    "needs_technical_evidence": "Confirm the documented workflow and technical implementation.",
    "has_retrievable_evidence": "Review omitted attributable evidence before final scoring.",
    "needs_momentum_verification": "Verify whether independent momentum evidence changes the decision.",
}
WHOLE_DESCRIPTION = 80


# --- parts of a variant ---------------------------------------------------------------------------------------------


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once a row, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _at(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _fields(v: Column, names: tuple[str, ...]) -> Column:
    """A struct of fields of an object; null for those that are absent."""
    return F.struct(*[_at(v, n).alias(n) for n in names])


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _one_of(v: Column, among: tuple[str, ...]) -> Column:
    """Whether it is one of these texts, words that no number, truth value, object or array is written as."""
    return F.coalesce(F.try_variant_get(v, "$", "string").isin(*among), F.lit(False))


def _items(v: Column) -> Column:
    """The members of an array; null if it is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def _all(items: Column, good) -> Column:
    """Whether it is an array all of whose members are good."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(False))


def _has(at: Column, fields: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [at[f].isNotNull() for f in fields])


def _exactly(v: Column, fields: tuple[str, ...]) -> Column:
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.sort_array(keys) == F.array(*[F.lit(f) for f in sorted(fields)]), F.lit(False))


def _number(v: Column, most: float) -> Column:
    """Whether it is a number (no boolean, no text) from 0 to ``most``."""
    return _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & F.coalesce(F.try_variant_get(v, "$", "double").between(0, most), F.lit(False))


def _bounded(v: Column, most: int) -> Column:
    return F.coalesce(F.length(_text(v)).between(1, most), F.lit(False))


def _texts(v: Column, items: int | None = None, chars: int | None = None, least: int = 0, among: tuple[str, ...] = ()) -> Column:
    """Whether it is a list of texts; with bounds given no text is empty, and among them none is repeated where one is needed."""

    def good(members: Column) -> Column:
        out = _all(members, lambda x: _bounded(x, chars) if chars else _kind(x) == "STRING")
        if items is not None:
            out &= F.coalesce(F.size(members).between(least, items), F.lit(False))
        if least:
            out &= F.coalesce(F.size(F.array_distinct(F.transform(members, _text))) == F.size(members), F.lit(False))
        if among:
            out &= _all(members, lambda x: _one_of(x, among))
        return out

    return _let(_items(v), good)


def _first_broken(v: Column, rules: dict[str, Column]) -> Column:
    """The name of the first rule that does not hold."""
    error = F.when(~_kind(v).startswith("OBJECT"), "not an object")
    for name, holds in rules.items():
        error = error.when(~F.coalesce(holds, F.lit(False)), name)
    return error


# --- checks ---------------------------------------------------------------------------------------------------------


def triage_error(payload: Column) -> Column:
    """What is wrong with an answer that triages posts: every post of it has all fields, typed; refs name typed keys."""

    def ref(r: Column) -> Column:
        return _let(_fields(r, REF_FIELDS), lambda at: _has(at, REF_FIELDS) & F.contains(_text(at["entity_key"]), F.lit(":")) & (
            _kind(at["entity_name"]) == "STRING"
        ) & _one_of(at["entity_confidence"], CONFIDENCES) & _number(at["confidence"], 1))

    def broken(v: Column, posts: Column) -> Column:
        fields = lambda kind, *names: _all(posts, lambda x: reduce(lambda a, b: a & b, [_kind(x[n]) == kind for n in names]))
        return _first_broken(v, {
            "triage": posts.isNotNull(),
            "missing field": _all(posts, lambda x: _has(x, TRIAGE_FIELDS)),
            "text": fields("STRING", "tweet_id", "evidence_quote", "reason"),
            "boolean": fields("BOOLEAN", "about_concrete_project", "closer_look"),
            "list": _all(posts, lambda x: _texts(x["product_names"]) & _texts(x["product_links"])),
            "strength": _all(posts, lambda x: _one_of(x["expression_strength"], STRENGTHS)),
            "ref": _all(posts, lambda x: _all(_items(x["project_refs"]), ref)),
        })

    posts = lambda v: F.transform(_items(_at(v, "triage")), lambda x: _fields(x, TRIAGE_FIELDS))
    return _let(F.try_parse_json(payload), lambda v: _let(posts(v), lambda p: broken(v, p)))


def tier_errors(payload: Column) -> Column:
    """What is wrong with an answer that gives an entity its tier: ``error``, and ``promoting_error``, which asks for citations
    and a sure binding too. Both come from one reading of the answer."""

    def broken(v: Column, at: Column) -> Column:
        return _first_broken(v, {
            "missing field": _has(at, TIER_FIELDS),
            "entity_key": F.contains(_text(at["entity_key"]), F.lit(":")),
            "x_tier": _one_of(at["x_tier"], TIERS),
            "entity_confidence": _one_of(at["entity_confidence"], CONFIDENCES),
            "strength": _one_of(at["x_expression_strength"], STRENGTHS),
            "list": _texts(at["cited_tweet_ids"]) & _texts(at["cross_source_notes"]),
            "text": _kind(at["rationale"]) == "STRING",
        })

    def both(at: Column, error: Column) -> Column:
        none, sure = _one_of(at["x_tier"], ("none",)), ~_one_of(at["entity_confidence"], ("fuzzy_name",))
        more = F.when(~none & ~(F.size(_items(at["cited_tweet_ids"])) > 0), "no citation")
        more = more.when(_one_of(at["x_tier"], ("potential", "high")) & ~sure, "unsure binding")
        return F.struct(error.alias("error"), F.coalesce(error, more).alias("promoting_error"))

    return _let(F.try_parse_json(payload), lambda v: _let(
        _fields(v, TIER_FIELDS), lambda at: _let(broken(v, at), lambda error: both(at, error))
    ))


def tier_error(payload: Column, promoting: bool = False) -> Column:
    """One of ``tier_errors``."""
    return tier_errors(payload)["promoting_error" if promoting else "error"]


def scoring_error(payload: Column) -> Column:
    """What is wrong with a scoring turn: exactly the fields of its action, at every level, within their bounds."""
    longest = max(map(len, AXES))
    need_fields = ("question", "target_axes", "expected_decision_impact")
    request = lambda r: _exactly(r, ("name", "arguments")) & _bounded(_at(r, "name"), 80) & _kind(_at(r, "arguments")).startswith("OBJECT")
    claim = lambda c: _exactly(c, CLAIM_FIELDS) & _bounded(_at(c, "claim"), 1000) & _texts(_at(c, "evidence_refs"), 8, 160, 1) & _texts(
        _at(c, "supports_axes"), len(AXES), longest, 1, AXES
    ) & _one_of(_at(c, "claim_type"), CLAIM_KINDS)
    claims = lambda v: _let(_items(v), lambda c: _all(c, claim) & F.coalesce(F.size(c) <= 8, F.lit(False)))
    requests = lambda v: _let(_items(v), lambda r: _all(r, request) & F.size(r).between(1, 8))
    levels = lambda v: _let(_fields(v, SUFFICIENCY), lambda at: reduce(lambda a, b: a & b, [_one_of(at[f], LEVELS) for f in SUFFICIENCY]))
    needed = lambda v: _let(_fields(v, need_fields), lambda n: _bounded(n["question"], 1000) & _bounded(n["expected_decision_impact"], 1000) & _texts(n["target_axes"], len(AXES), longest, 1, AXES))
    bounds = lambda v: _let(_fields(v, AXES), lambda at: reduce(lambda a, b: a & b, [_number(at[a], 25 if a.endswith("penalty") else 100) for a in AXES]))

    def broken(v: Column, top: Column, s: Column) -> Column:
        known, need, score = top["information_sufficiency"], top["information_need"], top["score"]
        both = lambda a, b: F.when(top["tools"], a).otherwise(b)
        yes = F.lit(True)
        return _first_broken(v, {
            "action": _one_of(top["action"], ("use_tools", "final")),
            "sufficiency": _exactly(known, SUFFICIENCY) & levels(known),
            "fields": both(_exactly(v, ("action", "information_sufficiency", "information_need", "tool_requests")), _exactly(v, ("action", "information_sufficiency", "score"))),
            "need": both(_exactly(need, need_fields) & needed(need), yes),
            "requests": both(requests(top["tool_requests"]), yes),
            "score": both(yes, _exactly(score, SCORE_FIELDS)),
            "object_type": both(yes, _one_of(s["object_type"], OBJECT_TYPES)),
            "boolean": both(yes, (_kind(s["is_product_or_repo"]) == "BOOLEAN") & (_kind(s["should_print"]) == "BOOLEAN")),
            "axes": both(yes, _exactly(s["axes"], AXES) & bounds(s["axes"])),
            "claims": both(yes, claims(s["supporting_evidence"]) & claims(s["negative_evidence"])),
            "texts": both(yes, _texts(s["known_gaps"], 8, 240) & _texts(s["topic_tags"], 8, 40) & _texts(s["caveats"], 8, 240) & _bounded(s["primary_reason"], 80) & _bounded(s["rationale_short"], 1000)),
        })

    names = ("action", "information_sufficiency", "information_need", "tool_requests", "score")
    top = lambda v: F.struct(*[_at(v, n).alias(n) for n in names], (_text(_at(v, "action")) == "use_tools").alias("tools"))
    return _let(F.try_parse_json(payload), lambda v: _let(
        top(v), lambda t: _let(_fields(t["score"], SCORE_FIELDS), lambda s: broken(v, t, s))
    ))


# --- requests -------------------------------------------------------------------------------------------------------


def requests(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, request (the fields as JSON, in order of their names) and content_hash: equal requests have equal hashes."""
    request = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
    return rows.select(key, request.alias("request")).withColumn("content_hash", F.sha2("request", 256))


def link_hints(text: Column, urls: Column) -> Column:
    """Repository keys that a post's text or its expanded links name."""
    return X.github_keys(F.concat_ws(" ", F.coalesce(text, F.lit("")), urls))


def open_questions(**needs: Column) -> Column:
    """The questions of those ``QUESTIONS`` whose condition holds, in their order; an unknown condition does not."""
    return F.array_compact(F.array(*[F.when(needs[name], asked) for name, asked in QUESTIONS.items() if name in needs]))


def candidate_needs(key: Column, url: Column, readme_chars: Column, context_chars: Column, rich: int) -> dict[str, Column]:
    """What a candidate's own texts leave open; ``rich`` is from how many characters a readme is enough."""
    repo = key.startswith("github:")
    described = F.greatest(F.coalesce(readme_chars, F.lit(0)), F.coalesce(context_chars, F.lit(0)))
    has_url = F.coalesce(url, F.lit("")) != ""
    to_repo = F.coalesce(url.rlike("^https?://(www\\.)?github\\.com/"), F.lit(False))
    return {
        "unresolved_identity": ~(key.rlike("^(github|domain|npm):") | (has_url & ~to_repo)),
        "needs_product_description": has_url & (described < WHOLE_DESCRIPTION),
        "needs_technical_evidence": repo & (F.coalesce(readme_chars, F.lit(0)) < rich),
    }

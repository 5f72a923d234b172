"""Checks of model answers at their edges."""

import json

from pyspark.sql import functions as F

from lodestream.operators import answers as A

TIER = {"entity_key": "name:x", "x_tier": "high", "entity_confidence": "linked", "x_expression_strength": "mixed", "cited_tweet_ids": ["1"], "rationale": "w", "cross_source_notes": []}
POST = {"tweet_id": "1", "about_concrete_project": True, "closer_look": False, "product_names": [], "product_links": [], "project_refs": [], "expression_strength": "neutral", "evidence_quote": "", "reason": ""}
REF = {"entity_key": "npm:p", "entity_name": "p", "entity_confidence": "fuzzy_name", "confidence": 1}
CLAIM = {"claim": "c", "evidence_refs": ["item:1"], "supports_axes": ["momentum"], "claim_type": "inferred"}
KNOWN = dict.fromkeys(A.SUFFICIENCY, "weak")
SCORE = {"object_type": "repo", "is_product_or_repo": True, "axes": dict.fromkeys(A.AXES, 25), "supporting_evidence": [CLAIM], "negative_evidence": [], "known_gaps": ["g"], "primary_reason": "p", "rationale_short": "r", "topic_tags": [], "caveats": [], "should_print": False}
FINAL = {"action": "final", "information_sufficiency": KNOWN, "score": SCORE}
TOOLS = {"action": "use_tools", "information_sufficiency": KNOWN, "information_need": {"question": "q", "target_axes": ["momentum"], "expected_decision_impact": "i"}, "tool_requests": [{"name": "n", "arguments": {}}]}


def errors(spark, check, answers):
    rows = [(i, a if a is None or isinstance(a, str) else json.dumps(a)) for i, a in enumerate(answers)]
    return [r.e for r in spark.createDataFrame(rows, "i int, p string").select("i", check(F.col("p")).alias("e")).orderBy("i").collect()]


def test_no_objects(spark):
    for check in (A.tier_error, A.triage_error, A.scoring_error):
        assert errors(spark, check, [None, "", "{", "[1]", "null", '"x"']) == ["not an object"] * 6


def test_tiers(spark):
    without = {k: v for k, v in TIER.items() if k != "rationale"}
    cases = [TIER, without, TIER | {"entity_key": 5}, TIER | {"cited_tweet_ids": [None]}, TIER | {"cited_tweet_ids": ["1", None]}, TIER | {"cited_tweet_ids": [1]}, TIER | {"rationale": None}, TIER | {"x_tier": None}, TIER | {"more": 1}]
    assert errors(spark, A.tier_error, cases) == [None, "missing field", "entity_key", "list", "list", "list", "text", "x_tier", None]
    strict = lambda p: A.tier_error(p, promoting=True)
    assert errors(spark, strict, [TIER, TIER | {"cited_tweet_ids": []}, TIER | {"entity_confidence": "fuzzy_name"}, TIER | {"x_tier": "watch", "entity_confidence": "fuzzy_name"}]) == [None, "no citation", "unsure binding", None]


def test_triage(spark):
    post = lambda **k: {"triage": [POST, POST | k]}
    cases = [{"triage": []}, {"triage": {}}, {}, post(), post(project_refs=[REF]), post(project_refs=[REF, REF | {"confidence": "1"}]), post(project_refs=None), post(closer_look=1), post(expression_strength="x"), {"triage": [1]}]
    assert errors(spark, A.triage_error, cases) == [None, "triage", "triage", None, None, "ref", "ref", "boolean", "strength", "missing field"]


def test_scoring(spark):
    score = lambda **k: FINAL | {"score": SCORE | k}
    claim = lambda **k: score(supporting_evidence=[CLAIM | k])
    cases = [FINAL, TOOLS, FINAL | {"tool_requests": []}, score(axes=SCORE["axes"] | {"risk_penalty": 25.5}), score(axes=SCORE["axes"] | {"momentum": True}), score(known_gaps=["g"] * 9), score(known_gaps=["g", "g"]), score(caveats=["x" * 241]), score(more=1),
             claim(evidence_refs=["a", "a"]), claim(supports_axes=["odd"]), score(supporting_evidence=[CLAIM] * 9), TOOLS | {"tool_requests": [{"name": "n", "arguments": []}]}, FINAL | {"information_sufficiency": KNOWN | {"momentum": "odd"}}, FINAL | {"action": "wait"}]
    assert errors(spark, A.scoring_error, cases) == [None, None, "fields", "axes", "axes", "texts", None, "texts", "score", "claims", "claims", "claims", "requests", "sufficiency", "action"]


def test_requests_tell_nulls_and_order(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, "b", None), (3, "b", None)], "id int, y string, x string")
    one, two, three = A.requests(df, "id", ["y", "x"]).orderBy("id").collect()
    assert one.request == '{"x":"b","y":null}' and two.content_hash == three.content_hash != one.content_hash


def test_a_post_without_references_takes_the_first_linked_one_of_its_name(spark):
    from lodestream.operators import mentions as M

    ref = "array<struct<entity_key string, entity_name string, entity_confidence string>>"
    rows = [
        (1, 1, True, [("github:a/a", "Other", "fuzzy_name")], ["My Tool"]),  # not linked, so it lends nothing
        (2, 2, False, [("github:b/b", "Other", "linked")], ["My Tool"]),  # not looked at
        (3, 4, True, [("github:c/c", "My Tool", "linked")], []),
        (4, 3, True, [("github:x/x", "Other", "fuzzy_name"), ("github:d/d", "Thing", "exact_handle")], ["my-tool"]),  # before 3 in order
        (5, 5, True, [], ["MY TOOL", "agent", "Lonely One"]),
        (6, 6, True, None, ["my tool"]),
        (7, 7, None, None, ["my tool"]),
        (8, 8, True, None, None),
    ]
    posts = spark.createDataFrame(rows, f"post_id int, ord int, closer_look boolean, refs {ref}, names array<string>")
    got = {(r.post_id, r.entity_key, r.entity_name, r.entity_confidence) for r in M.mentioned(posts).collect()}
    assert got == {
        (1, "github:a/a", "Other", "fuzzy_name"),
        (3, "github:c/c", "My Tool", "linked"),
        (4, "github:x/x", "Other", "fuzzy_name"),
        (4, "github:d/d", "Thing", "exact_handle"),
        (5, "github:d/d", "Thing", "exact_handle"),
        (5, "name:lonely-one", "Lonely One", "fuzzy_name"),
        (6, "github:d/d", "Thing", "exact_handle"),
    }


def test_a_channel_view_sorts_numbers_texts_and_times(spark):
    from lodestream.operators import snapshots as S

    rows = [(1, "c", "10", 5, "b", None), (2, "c", "9", 5, "a", "2024-02-01"), (3, "c", None, 1, "z", "bad"), (4, "c", "x", None, "y", "2024-01-01"), (5, "c", "9", 5, "A", None), (6, "d", "1", 1, "q", None)]
    items = spark.createDataFrame(rows, "id int, channel string, v string, rank int, name string, at string")

    def order(column, kind, descending):
        found = S.channel_view(items, column, kind, descending, ["channel"], ["rank"], "name", "id").filter("channel = 'c'")
        return [r.id for r in found.orderBy("place").collect()]

    assert order("v", "number", False) == [2, 5, 1, 3, 4]
    assert order("v", "number", True) == [4, 3, 1, 2, 5]
    assert order("at", "time", False) == [3, 5, 1, 4, 2]
    assert order("name", "name", False) == [2, 5, 1, 4, 3]


def parses(spark, check):
    """How often a plan parses an answer."""
    df = spark.createDataFrame([("{}",)], "p string").select(check(F.col("p")))
    return df._jdf.queryExecution().optimizedPlan().toString().count("parse_json(")


def test_scoring_turns_are_parsed_once(spark):
    assert parses(spark, A.scoring_error) == parses(spark, A.triage_error) == 1


def test_tiers_are_parsed_once(spark):
    assert parses(spark, A.tier_error) == parses(spark, lambda p: A.tier_error(p, promoting=True)) == 1


def test_both_errors_of_tiers_come_from_one_reading(spark, sf):
    from lodestream.plans import answer_queries as Q

    plan = Q.c3_tier_checks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_one_file_is_checked_by_more_than_one_task(spark, sf):
    from lodestream.plans import answer_queries as Q

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for q in (Q.c3_tier_checks, Q.c3_scoring_checks, Q.c3_triage_checks):
        assert q(spark, sf).rdd.getNumPartitions() == tasks > 1


def test_a_tier_in_quotes_within_another_kind_is_none(spark):
    cases = [TIER | {"x_tier": x} for x in (["high"], {"high": 1}, True, 5)] + [TIER | {"entity_confidence": ["linked"]}]
    assert errors(spark, A.tier_error, cases) == ["x_tier"] * 4 + ["entity_confidence"]
    strict = lambda p: A.tier_errors(p)["promoting_error"]
    assert errors(spark, strict, cases + [TIER | {"x_tier": "none", "cited_tweet_ids": []}]) == ["x_tier"] * 4 + ["entity_confidence", None]

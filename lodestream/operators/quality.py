"""Summaries of stage events and measures of labelled cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import spread_ranked

#: Statuses of the stage log that count as success, and those that only observe.
SUCCESSES = (
    "scheduled", "skipped_unchanged", "pending_budget", "scout_disabled", "scout_ok", "scout_filtered", "scoring_ok", "brief_selected"
)
OBSERVATIONS = ("llm_cache_hit", "llm_cache_miss", "llm_call_started", "llm_call_ok", "llm_call_error")


def run_status(events: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    """errors, successes and the run's status for each key; observing statuses count as neither."""
    s = F.col(status)
    counted = ~s.isin(*OBSERVATIONS)
    out = events.groupBy(*keys).agg(
        F.count_if(counted & s.endswith("_error")).alias("errors"), F.count_if(counted & s.isin(*SUCCESSES)).alias("successes")
    )
    return out.withColumn(
        "status",
        F.when((F.col("errors") > 0) & (F.col("successes") > 0), "ok_with_errors").when(F.col("errors") > 0, "error").otherwise("ok")
    )


def band(score: Column) -> Column:
    return F.when(score.isNull(), "invalid").when(score >= 70, "high").when(score >= 60, "medium").otherwise("low")


def band_matches(expected: Column, score: Column, printed: Column) -> Column:
    """High from 70, medium from 60 to below 75, both printed; low below 60 and not printed."""
    return F.coalesce(
        ((expected == "high") & (score >= 70) & printed) | (
            (expected == "medium") & (score >= 60) & (score < 75) & printed
        ) | ((expected == "low") & (score < 60) & ~printed),
        F.lit(False)
    )


def project_margin(cases: DataFrame, keys: list[str], expected: str = "expected", score: str = "score") -> DataFrame:
    """Means of project and other cases, and how far the best project is above the best other."""
    project = F.col(expected) == "project"
    out = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(project).alias("project_cases"),
        F.coalesce(F.avg(F.when(project, F.col(score))), F.lit(0.0)).alias("mean_project"), F.coalesce(F.avg(F.when(~project, F.col(score))), F.lit(0.0)).alias("mean_other"),
        F.max(F.when(project, F.col(score))).alias("_best"), F.coalesce(F.max(F.when(~project, F.col(score))), F.lit(0.0)).alias("_other"),
    )
    margin = F.coalesce(F.col("_best") - F.col("_other"), F.lit(0.0))
    return out.withColumn("margin", margin).withColumn("ok", F.col("margin") > 0).drop("_best", "_other")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys and a column for each named quantile: the least value that at least that share of a key's values do not exceed.

    Values are ranked over ranges, so no task holds a key; nulls do not count.
    """
    known = rows.select(*keys, value).filter(F.col(value).isNotNull())
    placed = spread_ranked(known, "_rank", keys, [F.col(value).asc()], total="_total")
    place = lambda q: F.greatest(F.ceil(F.lit(str(q)).cast("decimal(10,9)") * F.col("_total")), F.lit(1))
    is_at = {name: F.col("_rank") == place(q) for name, q in at.items()}
    kept = placed.filter(reduce(lambda a, b: a | b, is_at.values()))
    return kept.groupBy(*keys).agg(*[F.max(F.when(c, F.col(value))).alias(name) for name, c in is_at.items()])


def call_rollup(calls: DataFrame) -> DataFrame:
    """Model calls by component: how many, how many failed, tokens in and out, mean, median and 95th percentile of latency.

    calls: component, status, prompt_tokens, completion_tokens, latency_ms.
    """
    found = calls.groupBy("component").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.avg("latency_ms").alias("mean_latency"),
    )
    at = exact_quantiles(calls, ["component"], "latency_ms", {"median_latency": 0.5, "p95_latency": 0.95})
    at = at.withColumnRenamed("component", "_component")
    joined = found.join(at, F.col("component").eqNullSafe(F.col("_component")), "left")
    return joined.select(*found.columns, "median_latency", "p95_latency")


def stages_of_log(lines: DataFrame) -> DataFrame:
    """stage: those that a log of JSON lines says have ended well. Lines that are no JSON count for nothing. lines: value."""
    line = F.from_json("value", "stage string, event string, returncode int")
    return lines.select(line.alias("l")).filter(
        "l.event = 'completed' and l.returncode = 0 and l.stage is not null"
    ).select("l.stage").distinct()


def coverage_problems(cases: DataFrame, required: DataFrame) -> DataFrame:
    """name, problem: required names without a case, names of several cases, cases without input or expectation.

    cases: name, input, expected; required: name.
    """
    missing = required.select("name").distinct().join(
        cases.select("name").distinct(), "name", "left_anti"
    ).withColumn("problem", F.lit("missing"))
    repeated = cases.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.lit("duplicate").alias("problem"))
    partial = cases.filter("input is null or expected is null").select("name", F.lit("incomplete").alias("problem")).distinct()
    return missing.unionByName(repeated).unionByName(partial)


#: Families in the order they are offered, and their names.
FACETS = {
    "github": "GitHub", "hn": "Hacker News", "x_social": "X / social", "product_hunt": "Product Hunt", "package_family": "npm",
    "npm": "npm", "huggingface": "Hugging Face", "hf": "Hugging Face"
}
NO_FACETS = ("", "rule", "resolver", "cross_source")


def source_facets(candidates: DataFrame) -> DataFrame:
    """family, label, place, n: how many candidates each family has. candidates: families (an array)."""
    f = F.col("family")
    label, place = F.initcap(F.regexp_replace(f, "_", " ")), F.lit(99)
    for i, (name, shown) in enumerate(FACETS.items()):
        label, place = F.when(f == name, shown).otherwise(label), F.when(f == name, i).otherwise(place)
    rows = candidates.select(F.explode(F.array_distinct("families")).alias("family")).filter(~f.isin(*NO_FACETS))
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n")).select("family", label.alias("label"), place.alias("place"), "n")


#: Tiers in order.
TIERS = ("none", "watch", "potential", "high")


def _tier(name: Column) -> Column:
    return F.coalesce(*[F.when(name == t, i) for i, t in enumerate(TIERS)])


def _told(what: str, expected: Column, got: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(F.lit(f"{what} expected "), text(expected), F.lit(" got "), text(got))


def story_failures(e, a) -> Column:
    """What a story's answer misses of its case. e, a: functions from a field's name to a column; null expectations are absent.

    expected: projectness, noise, requires_alias, deterministic_link_type; actual: projectness, noise, has_alias, deterministic_link_type.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(~e("projectness").eqNullSafe(a("projectness")), _told("projectness", e("projectness"), a("projectness"))),
        F.when(e("noise").isNotNull() & ~e("noise").eqNullSafe(a("noise")), _told("noise", e("noise"), a("noise"))),
        F.when(yes(e("requires_alias")) & ~yes(a("has_alias")), "expected deterministic alias link"),
        F.when((F.coalesce(e("deterministic_link_type"), F.lit("")) != "") & ~e("deterministic_link_type").eqNullSafe(a("deterministic_link_type")), _told("deterministic_link_type", e("deterministic_link_type"), a("deterministic_link_type"))),
    ))


def tier_failures(e, a) -> Column:
    """What a tier's answer misses. expected: x_tier, max_tier, requires_citations, noise; actual: accepted_x_tier, cited (a count)."""
    got, given = a("accepted_x_tier"), lambda c: F.coalesce(c, F.lit("")) != ""
    none = got == "none"
    return F.array_compact(F.array(
        F.when(given(e("x_tier")) & (got != e("x_tier")), _told("x_tier", e("x_tier"), got)),
        F.when(given(e("max_tier")) & (_tier(got) > _tier(e("max_tier"))), F.concat(F.lit("accepted tier "), got, F.lit(" exceeds max_tier "), e("max_tier"))),
        F.when(F.coalesce(e("requires_citations"), F.lit(False)) & ~none & (a("cited") == 0), "accepted non-none tier without citations"),
        F.when((e("noise") == True) & ~none, _told("noise", F.lit("none"), got)),  # noqa: E712
        F.when((e("noise") == False) & e("max_tier").isNull() & none, "expected non-noise x signal"),  # noqa: E712
    ))


def triage_failures(e, a) -> Column:
    """What a first look misses. expected: noise; actual: closer_look, product_signals (counts)."""
    return F.array_compact(F.array(
        F.when((e("noise") == True) & (a("closer_look") != 0), "noise case should not request closer look"),  # noqa: E712
        F.when((e("noise") == False) & (a("product_signals") == 0), "expected at least one product signal"),  # noqa: E712
    ))


def case_totals(cases: DataFrame, keys: list[str], failures: str = "failures") -> DataFrame:
    """total, passed, failed for each key: a case without failures has passed."""
    passed = F.count_if(F.size(failures) == 0)
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"))


# --- quantiles that merge -------------------------------------------------------------------------------------------


def latency_sketches(calls: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """keys, n, sketch: a quantile sketch (KLL, a few kilobytes) of each key's values, to be kept a run and merged later."""
    v = F.col(value).cast("double")
    return calls.filter(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """keys, n and a column for each named quantile, of all sketches of a key together; ranks are within about 0.03 of exact."""
    merged = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("_s"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_double("_s", F.lit(q)).alias(name) for name, q in at.items()])

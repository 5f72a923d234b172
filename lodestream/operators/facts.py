"""What a row shows of its source: a line of facts from its metadata, and the part of its raw payload worth keeping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.scalars import canonical_json

#: For each source the facts it shows, in order: label, fields (the first that is not empty counts), form.
#: Forms: "text" as it stands, "None" if missing; "number" with two decimals, empty if missing; a number n, the first n of a
#: list, left out if there are none; "rank", a rank and a score; "account", a text after an at sign; "projects", named things.
_QUERY = ("query_label", "query")
FACTS = {
    "github_trending": (("窗口", ("period",), "text"), ("窗口新增star", ("period_stars",), "text"), ("总star", ("stars_total",), "number")),
    "github_search": (
        ("搜索词", _QUERY, "text"), ("star", ("stars",), "text"), ("fork", ("forks",), "text"), ("最后push", ("pushed_at",), "text"), ("topics", ("topics",), 4),
    ),
    "github_movers_trending_repos": (
        ("来源", ("provider",), "text"), ("窗口", ("period",), "text"), ("rank", ("language_rank", "source_score"), "rank"), ("source_score", ("source_score",), "number"),
        ("star速度", ("stars_velocity",), "number"), ("fork速度", ("forks_velocity",), "number"), ("最新sparkline", ("latest_sparkline_delta",), "text"), ("topics", ("topics",), 5),
    ),
    "github_movers_repofomo": (
        ("来源", ("provider",), "text"), ("FomoRank", ("fomo_rank",), "text"), ("7d新增star", ("stars_7d",), "number"), ("30d新增star", ("stars_30d",), "number"),
        ("60d新增star", ("stars_60d",), "number"), ("总star", ("stars_total",), "number"), ("new_forks", ("new_forks",), "number"),
        ("fork增长%", ("fork_growth_percent",), "number"), ("star_age天", ("star_age_days",), "number"),
    ),
    "hn_algolia": (("搜索词", _QUERY, "text"), ("分数", ("points",), "text"), ("评论", ("comments",), "text"), ("作者", ("author",), "text"), ("创建", ("created_at",), "text")),
    "hn_firebase": (("榜单", ("list",), "text"), ("分数", ("score",), "text"), ("评论", ("comments",), "text"), ("作者", ("author",), "text")),
    "product_hunt": (
        ("票数", ("votes",), "text"), ("评论", ("comments",), "text"), ("日榜", ("daily_rank",), "text"), ("周榜", ("weekly_rank",), "text"), ("featured", ("featured_at",), "text"),
    ),
    "huggingface_": (
        ("类型", ("resource",), "text"), ("like", ("likes",), "text"), ("下载", ("downloads",), "text"), ("pipeline", ("pipeline_tag",), "text"), ("tags", ("tags",), 5),
    ),
    "npm_search": (
        ("搜索词", _QUERY, "text"), ("版本", ("version",), "text"), ("周下载", ("weekly_downloads",), "number"), ("月下载", ("monthly_downloads",), "number"),
        ("dependents", ("dependents",), "number"), ("score", ("score_final",), "number"), ("quality", ("score_quality",), "number"),
        ("popularity", ("score_popularity",), "number"), ("maintenance", ("score_maintenance",), "number"), ("keywords", ("keywords",), 6),
    ),
    "pypi_": (
        ("feed", ("feed",), "text"), ("版本", ("version", "latest_version"), "text"), ("发布时间", ("pub_date",), "text"), ("requires_python", ("requires_python",), "text"),
        ("license", ("license",), "text"), ("classifiers", ("classifiers",), 4),
    ),
    "x_seed_accounts": (("粉丝", ("followers_count",), "text"), ("关注", ("following_count",), "text"), ("AI关键词分", ("keyword_score",), "text"), ("bio", ("bio",), "text")),
    "x_tweets": (("作者", ("author",), "account"), ("发布时间", ("created_at",), "text"), ("提及", ("mentioned_projects",), "projects")),
}
#: Fields kept of a raw payload, with where they stand in it; other sources keep theirs whole.
KEPT = {
    "github_search": {
        **{k: (k,) for k in ("watchers_count", "open_issues_count", "homepage", "default_branch", "updated_at", "created_at", "pushed_at", "archived", "fork", "is_template", "has_issues", "has_discussions", "has_pages", "size", "visibility")},
        "license": ("license.spdx_id", "license.name"), "owner": ("owner.login",),
    },
    "huggingface_": {k: (k,) for k in ("trendingScore", "library_name", "modelId", "author", "gated", "disabled", "sha", "sdk", "private")},
}
DROPPED = {"x_tweets": "raw"}


def _is(source: Column, name: str) -> Column:
    return source.startswith(name) if name.endswith("_") else source == name


def _number(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(text.isNull(), "").when(value.isNull(), text).otherwise(F.format_string("%.2f", value))


def _fact(metadata: Column, label: str, fields: tuple[str, ...], form: str | int) -> Column:
    at = lambda f: F.try_element_at(metadata, F.lit(f))
    named = lambda c: F.concat(F.lit(f"{label}="), c)
    first = F.coalesce(*[F.nullif(at(f), F.lit("")) for f in fields], at(fields[-1]))
    text = F.coalesce(first, F.lit("None"))
    if isinstance(form, int):
        values = F.array_compact(F.coalesce(F.from_json(at(fields[0]), "array<string>"), F.array().cast("array<string>")))
        return F.when(F.size(values) > 0, named(F.array_join(F.slice(values, 1, form), ", ")))
    if form == "projects":
        things = F.coalesce(
            F.from_json(at(fields[0]), "array<struct<name:string,key:string>>"), F.array().cast("array<struct<name:string,key:string>>")
        )
        names = F.transform(F.slice(things, 1, 5), lambda p: F.coalesce(F.nullif(p["name"], F.lit("")), p["key"], F.lit("None")))
        return F.when(F.size(names) > 0, named(F.array_join(names, ", ")))
    if form == "number":
        return named(_number(at(fields[0])))
    if form == "rank":
        return named(F.concat(F.coalesce(at(fields[0]), F.lit("")), F.lit("/"), F.coalesce(at(fields[1]), F.lit("None"))))
    return named(F.concat(F.lit("@"), text) if form == "account" else text)


def row_facts(source: Column, metadata: Column) -> Column:
    """The facts that a row of ``source`` shows of its metadata (a map of texts; lists and objects as JSON), empty for unknown sources."""
    out = F.array().cast("array<string>")
    for name, facts in FACTS.items():
        out = F.when(_is(source, name), F.array_compact(F.array(*[_fact(metadata, *f) for f in facts]))).otherwise(out)
    return out


def compact_raw(source: Column, raw: Column) -> Column:
    """Canonical JSON of what is kept of a raw payload (JSON text): chosen fields, null where missing; payloads that are no object stay whole."""
    value = F.try_parse_json(raw)
    out = canonical_json(raw)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    for name, fields in KEPT.items():
        path = lambda p: F.try_variant_get(value, f"$.{p}", "variant")
        some = lambda p: F.when(~F.is_variant_null(path(p)) & (F.to_json(path(p)) != '""'), path(p))
        kept = F.struct(*[(F.coalesce(some(at[0]), path(at[1])) if len(at) > 1 else path(at[0])).alias(k) for k, at in fields.items()])
        out = F.when(_is(source, name) & is_object, canonical_json(F.to_json(kept, {"ignoreNullFields": "false"}))).otherwise(out)
    for name, field in DROPPED.items():
        rest = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, _: k != F.lit(field))  # noqa: B023
        out = F.when(_is(source, name) & is_object, canonical_json(F.to_json(rest, {"ignoreNullFields": "false"}))).otherwise(out)
    return out

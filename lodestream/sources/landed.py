"""Landed payloads to observed items: leaderboards, searches, feeds, registries and social exports.

Every reader takes a table of landed payloads (what was asked, and the raw text) and returns rows of
``ITEM``: source, external_id, name, url, source_rank, description, metadata (a map of strings). Payloads are parsed
against schemas that are stated here; fields that are absent are null, and a payload that is no JSON gives no rows.
Only the cut of a balanced object out of script text is Python, in Arrow batches.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.functions import scalars as X
from lodestream.functions.markup import unescaped
from lodestream.operators.snapshots import WINDOW_OF_PERIOD
from lodestream.operators.windows import first_per, ranked

ITEM = ("source", "external_id", "name", "url", "source_rank", "description", "metadata")


def _meta(**fields: Column) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[v.cast("string") for v in fields.values()]))


def _window(period: Column) -> Column:
    out = period
    for k, v in WINDOW_OF_PERIOD.items():
        out = F.when(period == k, v).otherwise(out)
    return out


def _before(landed: DataFrame) -> Column:
    """How many rows of a result lie on earlier pages: the column ``before`` of landed pages, 0 where a payload is the whole."""
    return (F.col("before") if "before" in landed.columns else F.lit(0)).cast("long").alias("before")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _items(
    df: DataFrame, source: Column | str, external_id: Column, name: Column, url: Column, rank: Column, description: Column, metadata: Column
) -> DataFrame:
    source = source if isinstance(source, Column) else F.lit(source)
    return df.select(
        source.alias("source"), external_id.alias("external_id"), name.alias("name"), url.alias("url"),
        rank.cast("long").alias("source_rank"), description.alias("description"), metadata.alias("metadata")
    )


def _plain(markup: Column) -> Column:
    return X.stripped_html(_text(markup))


# --- repositories ---------------------------------------------------------------------------------------------------


def trending_pages(landed: DataFrame) -> DataFrame:
    """HTML boards. landed: period, language, payload. The rank is the block's place on the page."""
    block = F.regexp_extract_all("payload", F.lit(r'(?s)<article class="Box-row">(.*?)</article>'), F.lit(1))
    rows = landed.select("period", "language", F.posexplode(block).alias("pos", "b"))
    of = lambda p, g=1: F.regexp_extract("b", p, g)
    head = r'(?s)<h2 class="h3 lh-condensed".*?<a\b[^>]*href="/([^/]+)/([^"/]+)"'
    rows = rows.withColumn("owner", F.trim(of(head))).withColumn("repo", F.regexp_replace(of(head, 2), " ", "")).filter("owner != ''")
    name = F.concat_ws("/", "owner", "repo")
    language = F.coalesce(
        F.nullif(F.trim(of(r'(?s)<span itemprop="programmingLanguage">(.*?)</span>')), F.lit("")), F.nullif("language", F.lit("")),
        F.lit("unknown")
    )
    meta = _meta(
        period=F.col("period"), window=_window(F.col("period")), scope_language=F.coalesce(F.nullif("language", F.lit("")), F.lit("all")), language=language,
        period_stars=X.digits_only(of(r"(?i)([\d,]+)\s+stars?\s+(?:today|this week|this month)")), stars_total=X.digits_only(of(r'(?s)/stargazers".*?>([\s\d,]+)</a>')),
    )
    return _items(
        rows, "github_trending", F.concat_ws(":", "period", name), name, F.concat(F.lit("https://github.com/"), name), F.col("pos") + 1,
        _plain(of(r'(?s)<p[^>]*class="[^"]*\bcolor-fg-muted\b[^"]*"[^>]*>(.*?)</p>')), meta
    )


_REPO = "full_name string, html_url string, description string, stargazers_count long, forks_count long, created_at string, pushed_at string, language string, topics array<string>"


def repository_search(landed: DataFrame, most: int) -> DataFrame:
    """Search pages. landed: query, query_label, page, payload. One running rank over a query's pages, up to ``most``."""
    rows = landed.select(
        "query", "query_label", "page",
        F.posexplode(
            F.from_json("payload", f"items array<struct<{_REPO.replace(' ', ':').replace(',:', ',')}>>")["items"]
        ).alias("pos", "r")
    )
    rows = ranked(rows, "rank", ["query_label"], [F.col("page").asc(), F.col("pos").asc()]).filter(F.col("rank") <= most)
    meta = _meta(
        query=F.col("query"), query_label=F.col("query_label"), window=F.lit("current"), stars=F.col("r.stargazers_count"),
        forks=F.col("r.forks_count"), created_at=F.col("r.created_at"), pushed_at=F.col("r.pushed_at"), language=F.col("r.language"),
        topics=F.to_json("r.topics"), search_page=F.col("page")
    )
    return _items(
        rows, "github_search", F.concat_ws(":", "query_label", "r.full_name"), F.col("r.full_name"), F.col("r.html_url"), F.col("rank"),
        _text(F.col("r.description")), meta
    )


def balanced_object(text: str, marker: str) -> str | None:
    """The JSON object that follows the marker; braces within strings do not count."""
    begin = text.find("{", at + len(marker)) if (at := text.find(marker)) >= 0 else -1
    if begin < 0:
        return None
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text, begin)[0])
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _initial_rows(chunks: pd.Series) -> pd.Series:
    def cut(parts) -> str | None:
        texts = []
        for p in parts if parts is not None else ():
            try:
                value = json.loads(p)
            except ValueError:
                continue
            if isinstance(value, list) and len(value) > 1 and isinstance(value[1], str):
                texts.append(value[1])
        return balanced_object("".join(texts), '"initialRepositories"')

    return chunks.map(cut)


_MOVER = "map<string,array<struct<fullName:string,rank:int,description:string,starsCount:double,score:double,sparkline:array<double>,scoreComponents:struct<starsVelocity:double,forksVelocity:double>>>>"


def mover_pages(landed: DataFrame, periods: tuple[str, ...], most: int) -> DataFrame:
    """Boards embedded in script chunks. landed: payload. An empty sparkline is filled from the repository's first period that has one."""
    chunks = F.regexp_extract_all("payload", F.lit(r"(?s)<script>self\.__next_f\.push\((.*?)\)</script>"), F.lit(1))
    rows = landed.select(F.posexplode(F.from_json(_initial_rows(chunks), _MOVER)).alias("order", "period", "rows"))
    rows = rows.select("order", "period", F.posexplode("rows").alias("pos", "r")).filter("r.fullName != ''")
    some = rows.filter(F.size("r.sparkline") > 0)
    first = first_per(some, ["r.fullName"], [F.col("order").asc(), F.col("pos").asc()]).select(
        F.col("r.fullName").alias("_name"), F.col("r.sparkline").alias("_line"), F.col("period").alias("_from")
    )
    rows = rows.filter(F.col("period").isin(*periods) & (F.col("pos") < most)).join(first, F.col("r.fullName") == F.col("_name"), "left")
    own = F.size("r.sparkline") > 0
    line = F.when(own, F.col("r.sparkline")).otherwise(F.col("_line"))
    meta = _meta(
        period=F.col("period"), window=_window(F.col("period")), stars_count=F.col("r.starsCount"), source_score=F.col("r.score"),
        stars_velocity=F.col("r.scoreComponents.starsVelocity"), forks_velocity=F.col("r.scoreComponents.forksVelocity"),
        sparkline=F.to_json(line), sparkline_source_period=F.when(own, F.col("period")).otherwise(F.col("_from"))
    )
    name = F.col("r.fullName")
    return _items(
        rows, "github_movers_trending_repos", F.concat_ws(":", F.lit("trending-repos"), "period", name), name,
        F.concat(F.lit("https://github.com/"), name), F.coalesce(F.col("r.rank"), F.col("pos") + 1), _text(F.col("r.description")), meta
    )


def leaderboard_script(landed: DataFrame, most: int) -> DataFrame:
    """A leaderboard as an array in script text. landed: payload."""
    found = F.regexp_extract("payload", r"(?s)=\s*(\[\s*\{.*\}\s*\])\s*;?", 1)
    rows = landed.select(
        F.posexplode(F.from_json(found, "array<map<string,string>>")).alias("pos", "r")
    ).filter((F.col("pos") < most) & (F.col("r")["name"] != ""))
    n = lambda k: X.loose_number(F.col("r")[k])
    meta = _meta(
        window=F.lit("7d+30d+60d"), fomo_rank=F.col("pos") + 1, stars_total=n("tot_stars"), stars_7d=n("7d_new"), stars_30d=n("30d_new"),
        stars_60d=n("60d_new"), growth_7d_percent=n("7d%"), growth_30d_percent=n("30d%"), forks=n("forks"), new_forks=n("new_forks")
    )
    name = F.col("r")["name"]
    return _items(
        rows, "github_movers_repofomo", F.concat(F.lit("repofomo:"), name), name, F.concat(F.lit("https://github.com/"), name),
        F.col("pos") + 1, _text(F.col("r")["description"]), meta
    )


# --- stories and launches -------------------------------------------------------------------------------------------

_STORY_PAGE = "https://news.ycombinator.com/item?id="


def story_hits(landed: DataFrame) -> DataFrame:
    """Search hits. landed: window, query, query_label, payload. Points and comments default to 0, the link to the story's page."""
    hit = "hits array<struct<objectID:string,story_id:string,title:string,story_title:string,points:long,num_comments:long,url:string,story_text:string,author:string,created_at:string>>"
    rows = landed.select(
        "window", "query", "query_label", _before(landed), F.posexplode(F.from_json("payload", hit)["hits"]).alias("pos", "h")
    )
    story = F.coalesce("h.objectID", "h.story_id", F.lit(""))
    page = F.concat(F.lit(_STORY_PAGE), story)
    meta = _meta(
        query=F.col("query"), query_label=F.col("query_label"), window=F.col("window"), points=F.coalesce("h.points", F.lit(0)),
        comments=F.coalesce("h.num_comments", F.lit(0)), author=F.col("h.author"), created_at=F.col("h.created_at"), hn_url=page
    )
    return _items(
        rows, "hn_algolia", F.concat_ws(":", "window", "query_label", story), F.coalesce("h.title", "h.story_title", F.lit("(untitled)")),
        F.coalesce(F.nullif("h.url", F.lit("")), page), F.col("before") + F.col("pos") + 1, _plain(F.col("h.story_text")), meta
    )


def story_lists(lists: DataFrame, payloads: DataFrame, most: int) -> DataFrame:
    """Ranked id lists with their items. lists: list, payload (ids); payloads: item_id, payload. Ids without an item are left out."""
    ids = lists.select("list", F.posexplode(F.from_json("payload", "array<long>")).alias("pos", "item_id")).filter(F.col("pos") < most)
    item = F.from_json("payload", "title string, url string, score long, descendants long, text string, by string, time long")
    rows = ids.join(payloads.select("item_id", item.alias("i")).filter("i is not null"), "item_id")
    page = F.concat(F.lit(_STORY_PAGE), F.col("item_id").cast("string"))
    meta = _meta(
        list=F.col("list"), window=F.lit("current"), score=F.coalesce("i.score", F.lit(0)), comments=F.coalesce("i.descendants", F.lit(0)),
        author=F.col("i.by"), created_at_unix=F.col("i.time"), hn_url=page
    )
    return _items(
        rows, "hn_firebase", F.concat_ws(":", "list", F.col("item_id").cast("string")), _text(F.col("i.title")),
        F.coalesce(F.nullif("i.url", F.lit("")), page), F.col("pos") + 1, _plain(F.col("i.text")), meta
    )


def launches(landed: DataFrame) -> DataFrame:
    """Launch posts. landed: payload. The rank is the day's rank, else the place."""
    node = "id:string,slug:string,name:string,url:string,tagline:string,website:string,votesCount:long,commentsCount:long,dailyRank:long,weeklyRank:long,createdAt:string,featuredAt:string"
    rows = landed.select(
        _before(landed),
        F.posexplode(
            F.from_json("payload", f"data struct<posts:struct<edges:array<struct<node:struct<{node}>>>>>")["data"]["posts"]["edges"]
        ).alias("pos", "e")
    )
    n = F.col("e.node")
    key = F.coalesce(n["id"], n["slug"])
    meta = _meta(
        slug=n["slug"], window=F.lit("current"), website=n["website"], votes=F.coalesce(n["votesCount"], F.lit(0)),
        comments=F.coalesce(n["commentsCount"], F.lit(0)), daily_rank=n["dailyRank"], weekly_rank=n["weeklyRank"],
        created_at=n["createdAt"], featured_at=n["featuredAt"]
    )
    return _items(
        rows.filter(key.isNotNull()), "product_hunt", key, _text(n["name"]), _text(n["url"]),
        F.coalesce(n["dailyRank"], F.col("before") + F.col("pos") + 1), _text(n["tagline"]), meta
    )


# --- registries -----------------------------------------------------------------------------------------------------


def model_hub(landed: DataFrame) -> DataFrame:
    """Models, datasets and spaces, a source each. landed: resource, payload."""
    entry = "array<struct<id:string,description:string,likes:long,downloads:long,trendingScore:double,createdAt:string,lastModified:string,pipeline_tag:string,tags:array<string>>>"
    rows = landed.select("resource", _before(landed), F.posexplode(F.from_json("payload", entry)).alias("pos", "e")).filter("e.id != ''")
    meta = _meta(
        resource=F.col("resource"), window=F.lit("current"), likes=F.coalesce("e.likes", F.lit(0)),
        downloads=F.coalesce("e.downloads", F.lit(0)), trending_score=F.coalesce("e.trendingScore", F.lit(0.0)),
        created_at=F.col("e.createdAt"), last_modified=F.col("e.lastModified"), pipeline_tag=F.col("e.pipeline_tag"),
        tags=F.to_json("e.tags")
    )
    return _items(
        rows, F.concat(F.lit("huggingface_"), "resource"), F.col("e.id"), F.col("e.id"), F.concat(F.lit("https://huggingface.co/"), "e.id"),
        F.col("before") + F.col("pos") + 1, _text(F.col("e.description")), meta
    )


def with_card_links(items: DataFrame, cards: DataFrame, most: int) -> DataFrame:
    """The top ``most`` of each source by score get the first repository link of their card. cards: external_id, text."""
    score = F.coalesce(F.col("metadata")["trending_score"].try_cast("double"), F.lit(0.0))
    order = [score.desc(), F.col("source_rank").asc(), F.col("external_id").asc()]
    top = first_per(
        items.select("source", "external_id", "source_rank", "metadata"), ["source"], order, most
    ).select("source", "external_id")
    link = F.regexp_extract("text", X.GITHUB_LINK, 0)
    found = cards.select("external_id", F.regexp_replace(link, r"\.git$", "").alias("_link")).filter("_link != ''")
    out = items.join(top.join(found, "external_id"), ["source", "external_id"], "left")  # ``most`` rows a source
    meta = F.when(
        F.col("_link").isNotNull(), F.map_concat(F.col("metadata"), F.create_map(F.lit("repository"), F.col("_link")))
    ).otherwise(F.col("metadata"))
    return out.withColumn("metadata", meta).select(*ITEM)


def package_search(landed: DataFrame) -> DataFrame:
    """Package search. landed: query, query_label, payload."""
    obj = (
        "objects array<struct<package:struct<name:string,version:string,description:string,license:string,date:string,keywords:array<string>,publisher:struct<username:string>,maintainers:array<struct<username:string>>,links:struct<npm:string,homepage:string,repository:string,bugs:string>>,"
        "score:struct<final:double,detail:struct<quality:double,popularity:double,maintenance:double>>,searchScore:double,dependents:string,updated:string,downloads:struct<weekly:string,monthly:string>>>"
    )
    rows = landed.select(
        "query", "query_label", _before(landed), F.posexplode(F.from_json("payload", obj)["objects"]).alias("pos", "o")
    ).filter("o.package.name != ''")
    p, s = F.col("o.package"), F.col("o.score")
    meta = _meta(
        query=F.col("query"), query_label=F.col("query_label"), window=F.lit("current"), version=p["version"], keywords=F.to_json(p["keywords"]), license=p["license"], publisher=p["publisher"]["username"],
        maintainers_count=F.coalesce(F.size(p["maintainers"]), F.lit(0)), package_date=p["date"], updated=F.col("o.updated"), weekly_downloads=X.loose_number(F.col("o.downloads.weekly")), monthly_downloads=X.loose_number(F.col("o.downloads.monthly")),
        dependents=X.loose_number(F.col("o.dependents")), search_score=F.col("o.searchScore"), score_final=F.coalesce(s["final"], F.col("o.searchScore")), score_quality=s["detail"]["quality"], homepage=p["links"]["homepage"], repository=p["links"]["repository"],
    )
    return _items(
        rows, "npm_search", F.concat_ws(":", "query_label", p["name"]), p["name"],
        F.coalesce(p["links"]["npm"], F.concat(F.lit("https://www.npmjs.com/package/"), p["name"])), F.col("before") + F.col("pos") + 1,
        _text(p["description"]), meta
    )


def package_feeds(entries: DataFrame, packages: DataFrame, most: int, enriched: int) -> DataFrame:
    """Feed entries with their packages. entries: feed, pos (from 0), title, link, description, pubDate, author; packages: name, payload.

    Entries come from Spark's XML reader with rowTag ``item``. The package's name is in the title, else in the link.
    """
    e = entries.filter(F.col("pos") < most)
    newest, update = r"^(.+?)\s+added to PyPI$", r"^(.+?)\s+(\S+)$"
    link = r"/project/([^/]+)(?:/([^/]+))?/"
    got = lambda c, p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    name = F.coalesce(
        F.when(F.col("feed") == "newest", got("title", newest, 1)), F.when(F.col("feed") == "updates", got("title", update, 1)),
        got("link", link, 1), F.trim("title")
    )
    by_link = F.when(F.col("feed") == "newest", got("title", newest, 1).isNull()).otherwise(
        (F.col("feed") != "updates") | got("title", update, 1).isNull()
    )
    version = F.coalesce(F.when(F.col("feed") == "updates", got("title", update, 2)), F.when(by_link, got("link", link, 2)))
    e = e.withColumn("name", F.trim(name)).withColumn("version", version)
    body = F.from_json(
        "payload",
        "info struct<summary:string,version:string,license:string,requires_python:string,home_page:string>, urls array<struct<upload_time_iso_8601:string>>"
    )
    rows = e.join(
        packages.select("name", body.alias("b")), (e["name"] == packages["name"]) & (F.col("pos") < enriched), "left"
    ).drop(packages["name"])
    meta = _meta(
        feed=F.col("feed"), window=F.lit("current"), title=F.col("title"), version=F.col("version"), author=F.col("author"),
        pub_date=F.col("pubDate"), summary=F.col("b.info.summary"), latest_version=F.col("b.info.version"), license=F.col("b.info.license"),
        latest_upload_time=F.array_max(F.col("b.urls.upload_time_iso_8601"))
    )
    own = _plain(F.col("description"))
    return _items(
        rows, F.concat(F.lit("pypi_"), "feed"), F.concat_ws(":", "feed", "name", _text(F.col("version"))), F.col("name"),
        F.coalesce(F.nullif("link", F.lit("")), F.concat(F.lit("https://pypi.org/project/"), "name", F.lit("/"))), F.col("pos") + 1,
        F.coalesce(F.nullif(own, F.lit("")), _text(F.col("b.info.summary"))), meta
    )


# --- social exports -------------------------------------------------------------------------------------------------

#: What makes an account one of the topic, an organisation, a person.
TOPIC = (
    r"\bai\b", r"#ai\b", r"\bopenai\b", r"\banthropic\b", r"\bclaude\b", r"\bchatgpt\b", r"\bllm\b", "large language", "machine learning",
    "deep learning", r"\bdeepmind\b", r"hugging\s*face", r"\bhuggingface\b", r"\bagent\b", r"\bagents\b", r"\bagentic\b", r"\bcursor\b",
    "coding agent", r"\bneural\b", r"\brobot", r"\bagi\b"
)
ORGANISATION = (
    r"\bofficial account\b", r"^we\s", r"\bwe're\b", r"\bwe are\b", r"\bour mission\b", r"\bcompany\b", r"\bresearch lab\b",
    r"\blaboratory\b", r"\buniversity\b", r"\bcapital\b", r"\bventures?\b", r"\binvests?\b", r"\bcommunity\b", r"\bthe ai community\b"
)
PERSON = (
    r"\bfounder\b", r"\bco-?founder\b", r"\bceo\b", r"\bcto\b", r"\bprof\b", r"\bprofessor\b", r"\bresearcher\b", r"\bengineer\b",
    r"\bbuilding\b", r"\bi build\b", r"\bcreator\b", r"\bwriter\b", r"\binvestor\b", r"\bpartner\b", r"\bscientist\b", r"\bmy\b", r"\bi\b"
)


def seed_accounts(accounts: DataFrame, blocked: tuple[str, ...], configured: DataFrame, most: int) -> DataFrame:
    """Accounts of the topic held by persons, by followers; the configured list only if there is none.

    accounts: username, name, bio, followers_count; configured: username.
    """
    handle = F.regexp_replace(F.lower(F.trim(_text(F.col("username")))), "^@+", "")
    text = F.lower(F.concat_ws(" ", handle, F.trim(_text(F.col("name"))), F.trim(_text(F.col("bio")))))
    any_of = lambda patterns: text.rlike("|".join(f"(?:{p})" for p in patterns))
    found = accounts.filter(
        (F.col("followers_count") > 0) & any_of(TOPIC) & ~handle.isin(*blocked) & ~any_of(ORGANISATION) & any_of(PERSON)
    ).withColumn("_handle", handle).filter("_handle != ''")
    found = first_per(found, ["_handle"], [F.desc("followers_count"), F.col("username").asc()]).select("username", "followers_count")
    none = found.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(1).alias("_one"))  # a row if the list is empty
    fallback = configured.select(
        "username", F.lit(0).cast(found.schema["followers_count"].dataType).alias("followers_count")
    ).crossJoin(F.broadcast(none)).drop("_one")
    return found.unionByName(fallback).orderBy(F.desc("followers_count"), "username").limit(most)


def _first(c: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(c, f"$.{p}")), F.lit("")) for p in paths])


def followed_accounts(landed: DataFrame) -> DataFrame:
    """Account rows of several exporters. landed: ord, payload. The first non-empty of many paths; the first row of a name."""
    p = F.col("payload")
    url = _first(p, ("url", "twitterUrl", "profileUrl"))
    name = F.coalesce(
        F.regexp_replace(_first(p, ("username", "userName", "screenName", "screen_name", "handle", "legacy.screen_name")), "^@+", ""),
        F.nullif(F.regexp_extract(url, r"(?:x|twitter)\.com/([^/?#]+)", 1), F.lit(""))
    )
    count = lambda paths: F.coalesce(F.regexp_replace(_first(p, paths), "[^0-9]", "").try_cast("long"), F.lit(0))
    rows = landed.select(
        "ord", name.alias("username"), _text(_first(p, ("name", "displayName", "fullName", "legacy.name"))).alias("name"), count(("followersCount", "followerCount", "followers", "followers_count", "legacy.followers_count", "public_metrics.followers_count")).alias("followers_count"),
        count(("followingCount", "friendsCount", "following", "friends_count", "legacy.friends_count", "public_metrics.following_count")).alias("following_count"), _text(_first(p, ("description", "bio", "legacy.description"))).alias("bio"), F.coalesce(url, F.concat(F.lit("https://x.com/"), name)).alias("url"),
    ).filter("username is not null and username != ''").withColumn("_k", F.lower("username"))
    return first_per(rows, ["_k"], [F.col("ord").asc()]).drop("_k", "ord")


#: Where a post's fields may stand, the first non-empty one counts.
POST_FIELDS = {
    "post_id": ("id", "tweetId", "tweet_id"),
    "at": ("createdAt", "created_at"),
    "link": ("url", "twitterUrl"),
    "name": ("author.username", "author.userName", "author.screenName", "author.handle", "username", "authorUsername"),
    "body": ("text", "fullText"),
    "reply": ("isReply", "inReplyToId", "inReplyToUsername"),
    "repost": ("isRetweet", "retweeted_tweet"),
}
POST_COUNTS = ("likeCount", "replyCount", "retweetCount", "quoteCount", "viewCount")


def _fields(text: Column) -> Column:
    """An object's fields as texts, parsed once: a map, since names may differ in case alone; nested objects stay JSON text."""
    return F.from_json(text, T.MapType(T.StringType(), T.StringType()))


def posts(landed: DataFrame, replies: bool = True, reposts: bool = True) -> DataFrame:
    """Posts of an export. landed: ord, payload. The first row of an id, with a readable time; engagement leaves views out."""
    rows = landed.select("ord", _fields(F.col("payload")).alias("p"))
    rows = rows.select("ord", "p", _fields(F.try_element_at("p", F.lit("author"))).alias("author"))

    def at(path: str) -> Column:
        return F.try_element_at(*(("author", F.lit(path.removeprefix("author."))) if path.startswith("author.") else ("p", F.lit(path))))

    first = [F.coalesce(*[F.nullif(F.trim(at(path)), F.lit("")) for path in of]).alias(name) for name, of in POST_FIELDS.items()]
    count = [F.coalesce(F.regexp_replace(at(c), "[^0-9]", "").try_cast("long"), F.lit(0)).alias(c) for c in POST_COUNTS]
    rows = rows.select("ord", *first, *count).filter("post_id is not null")
    twitter = F.try_to_timestamp(F.regexp_replace("at", "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    of_link = F.nullif(F.regexp_extract("link", r"(?:x|twitter)\.com/([^/]+)/status/", 1), F.lit(""))
    author = F.coalesce(F.regexp_replace("name", "^@+", ""), of_link, F.lit(""))
    flag = lambda c: F.coalesce(F.col(c) != "false", F.lit(False))
    rows = rows.select(
        "ord", "post_id", author.alias("author"), unescaped(_text(F.col("body"))).alias("text"),
        F.coalesce(X.parsed_time(F.col("at")), X.feed_time(F.col("at")), twitter).alias("created_at"),
        F.coalesce("link", F.concat(F.lit("https://x.com/"), author, F.lit("/status/"), "post_id")).alias("url"),
        (F.col("likeCount") + F.col("replyCount") + F.col("retweetCount") + F.col("quoteCount")).alias("engagement"),
        F.col("viewCount").alias("views"), flag("reply").alias("is_reply"), flag("repost").alias("is_repost"),
    )
    rows = first_per(rows, ["post_id"], [F.col("ord").asc()]).filter("created_at is not null").drop("ord")
    return rows.filter((~F.col("is_reply") | F.lit(replies)) & (~F.col("is_repost") | F.lit(reposts)))


def projects_in(text: Column, author: Column, terms: tuple[str, ...]) -> Column:
    """Keys of what a post mentions: other accounts, tags, repositories or sites of links, known terms; each once, in that order."""
    handles = F.filter(F.regexp_extract_all(text, F.lit(r"@([A-Za-z0-9_]{1,15})"), F.lit(1)), lambda h: F.lower(h) != F.lower(author))
    tags = F.regexp_extract_all(text, F.lit(r"#([A-Za-z0-9_]+)"), F.lit(1))

    def of_link(u: Column) -> Column:
        repo = F.regexp_extract(u, r"(?i)github\.com/([^/\s]+)/([^/\s#?]+)", 0)
        host = X.bare_host(u)
        return F.when(
            repo != "", F.concat(F.lit("github:"), F.regexp_replace(F.regexp_replace(repo, r"(?i)^github\.com/", ""), r"\.git$", ""))
        ).when((host != "") & ~host.isin("x.com", "twitter.com", "t.co", "pic.twitter.com"), F.concat(F.lit("domain:"), host))

    links = F.transform(F.regexp_extract_all(text, F.lit(X.LINK), F.lit(0)), of_link)
    known = F.array_compact(
        F.array(*[F.when(F.lower(text).rlike(r"(?<![\w@#])" + t.lower() + r"(?![\w-])"), F.lit(f"term:{t.lower()}")) for t in terms])
    ) if terms else F.array().cast("array<string>")
    keys = F.concat(
        F.transform(handles, lambda h: F.concat(F.lit("@"), h)), F.transform(tags, lambda h: F.concat(F.lit("#"), h)),
        F.array_compact(links), known
    )
    return F.array_distinct(F.transform(keys, F.lower))


def stored_posts(store: DataFrame, archived: DataFrame, handles: DataFrame, now: Column, windows: tuple[str, ...], most: int) -> DataFrame:
    """Posts of allowed authors that no archived import brought, a row for each window they fit; one running rank, capped.

    store: post_id, author, text, url, created_at, import_run; archived: import_run; handles: author. The rank runs over the
    newest ``most`` posts only, since each has one row at least.
    """
    from lodestream.operators.windows import age_windows

    kept = store.withColumn("import_run", F.coalesce("import_run", F.lit(""))).join(
        archived.select("import_run").distinct(), "import_run", "left_anti"
    )
    kept = kept.withColumn("_a", F.lower(F.regexp_replace(F.trim("author"), "^@+", ""))).join(
        handles.select(F.lower("author").alias("_a")).distinct(), "_a", "left_semi"
    )
    kept = kept.withColumn("_w", F.filter(age_windows(F.col("created_at"), now), lambda w: w.isin(*windows))).filter(F.size("_w") > 0)
    newest = kept.orderBy(F.desc("created_at"), F.desc("post_id")).limit(most)
    rows = newest.select("*", F.posexplode("_w").alias("_p", "window"))
    rows = ranked(
        rows, "source_rank", [], [F.desc("created_at"), F.desc("post_id"), F.col("_p").asc()]
    ).filter(F.col("source_rank") <= most)
    name = F.when(
        F.col("author") != "", F.concat(F.lit("@"), F.regexp_replace("author", "^@+", ""), F.lit(": "), F.substring("text", 1, 96))
    ).otherwise(F.substring("text", 1, 110))
    return _items(
        rows, "x_tweets", F.concat_ws(":", "window", "post_id"), name, _text(F.col("url")), F.col("source_rank"), F.col("text"),
        _meta(window=F.col("window"), tweet_id=F.col("post_id"), author=F.col("author"), created_at=X.iso_time(F.col("created_at")))
    )

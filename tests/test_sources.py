import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import landed as S


def rows(df):
    return [r.asDict() for r in df.orderBy("source", "source_rank", "external_id").collect()]


def test_trending_page(spark):
    def block(name, stars, extra=""):
        return f'<article class="Box-row"><h2 class="h3 lh-condensed"><a data-x href="/{name}">x</a></h2><p class="col-9 color-fg-muted my-1">Fast &amp; <b>small</b></p>{extra}<a href="/{name}/stargazers"> 12,345</a> {stars} stars today</article>'

    page = block("Own/repo", "1,234", '<span itemprop="programmingLanguage">Rust</span>') + '<article class="Box-row">no head</article>' + block("b/c", "7")
    got = rows(S.trending_pages(spark.createDataFrame([("daily", "", page)], "period string, language string, payload string")))
    assert [(r["external_id"], r["source_rank"]) for r in got] == [("daily:Own/repo", 1), ("daily:b/c", 3)]
    m = got[0]["metadata"]
    assert (m["period_stars"], m["stars_total"], m["window"], m["language"], m["scope_language"]) == ("1234", "12345", "24h", "Rust", "all")
    assert got[0]["description"] == "Fast & small" and got[1]["metadata"]["language"] == "unknown"


def test_search_pages_rank_on_and_stop(spark):
    page = lambda names: json.dumps({"items": [{"full_name": n, "html_url": f"https://github.com/{n}", "stargazers_count": 5, "topics": ["a"]} for n in names]})
    df = spark.createDataFrame([("q", "l", 2, page(["c/3", "d/4"])), ("q", "l", 1, page(["a/1", "b/2"])), ("q", "other", 1, "broken")], "query string, query_label string, page int, payload string")
    got = rows(S.repository_search(df, 3))
    assert [(r["name"], r["source_rank"]) for r in got] == [("a/1", 1), ("b/2", 2), ("c/3", 3)]
    assert got[0]["metadata"]["stars"] == "5" and got[0]["description"] == ""


def test_mover_page_cuts_the_object_and_fills_sparklines(spark):
    data = {"daily": [{"fullName": "a/b", "rank": 1, "description": "has } and \" in it", "sparkline": [], "scoreComponents": {"starsVelocity": 200}}, {"fullName": ""}], "weekly": [{"fullName": "a/b", "sparkline": [1, 2, 5]}]}
    stream = 'x "initialRepositories":' + json.dumps(data) + ',"more":{'
    page = "".join(f"<script>self.__next_f.push({json.dumps([1, part])})</script>" for part in (stream[:40], stream[40:])) + "<script>self.__next_f.push(oops)</script>"
    got = rows(S.mover_pages(spark.createDataFrame([(page,), ("nothing",)], "payload string"), ("daily", "weekly"), 10))
    assert [r["external_id"] for r in got] == ["trending-repos:daily:a/b", "trending-repos:weekly:a/b"]
    assert json.loads(got[0]["metadata"]["sparkline"]) == [1, 2, 5] and got[0]["metadata"]["sparkline_source_period"] == "weekly"
    assert got[0]["metadata"]["stars_velocity"] == "200.0"


def test_balanced_object():
    assert json.loads(S.balanced_object('a "k": {"x":"}\\"{","y":{}} tail}', '"k"')) == {"x": '}"{', "y": {}}
    assert S.balanced_object("none", '"k"') is None and S.balanced_object('"k": {', '"k"') is None


def test_leaderboard_script(spark):
    text = 'const rows = [{"name":"a/b","7d_new":"1,200","30d_new":"3000","7d%":"12.5%"},{"name":"c/d","7d_new":"x"}];'
    got = rows(S.leaderboard_script(spark.createDataFrame([(text,)], "payload string"), 5))
    assert [r["external_id"] for r in got] == ["repofomo:a/b", "repofomo:c/d"]
    assert got[0]["metadata"]["stars_7d"] == "1200.0" and got[0]["metadata"]["growth_7d_percent"] == "12.5" and got[1]["metadata"]["stars_7d"] is None


def test_stories(spark):
    hits = json.dumps({"hits": [{"objectID": "9", "title": "T", "points": 3, "url": ""}, {"story_id": "8", "story_title": "S", "story_text": "<p>a &gt; b"}]})
    got = rows(S.story_hits(spark.createDataFrame([("24h", "q", "l", hits)], "window string, query string, query_label string, payload string")))
    assert [(r["external_id"], r["url"]) for r in got] == [("24h:l:9", "https://news.ycombinator.com/item?id=9"), ("24h:l:8", "https://news.ycombinator.com/item?id=8")]
    assert got[1]["description"] == "a > b" and got[1]["metadata"]["points"] == "0" and got[1]["name"] == "S"
    lists = spark.createDataFrame([("topstories", "[5,6,7]")], "list string, payload string")
    items = spark.createDataFrame([(5, '{"title":"five","score":10}'), (7, '{"title":"seven","url":"http://x"}')], "item_id long, payload string")
    got = rows(S.story_lists(lists, items, 3))
    assert [(r["external_id"], r["source_rank"], r["url"]) for r in got] == [("topstories:5", 1, "https://news.ycombinator.com/item?id=5"), ("topstories:7", 3, "http://x")]


def test_launches_and_hub(spark):
    p = json.dumps({"data": {"posts": {"edges": [{"node": {"id": "1", "name": "A", "dailyRank": 4, "votesCount": 9}}, {"node": {"slug": "b"}}, {"node": {"name": "no id"}}]}}})
    got = rows(S.launches(spark.createDataFrame([(p,)], "payload string")))
    assert [(r["external_id"], r["source_rank"]) for r in got] == [("b", 2), ("1", 4)]
    hub = json.dumps([{"id": "o/m", "likes": 2, "trendingScore": 5.0}, {"id": "o/n", "trendingScore": 9.0}])
    items = S.model_hub(spark.createDataFrame([("models", hub)], "resource string, payload string"))
    assert rows(items)[0]["metadata"]["downloads"] == "0" and rows(items)[0]["source"] == "huggingface_models"
    cards = spark.createDataFrame([("o/m", "see https://github.com/a/b.git"), ("o/n", "at https://github.com/c/d ok")], "external_id string, text string")
    linked = {r["name"]: r["metadata"].get("repository") for r in rows(S.with_card_links(items, cards, 1))}
    assert linked == {"o/m": None, "o/n": "https://github.com/c/d"}


def test_packages(spark):
    p = json.dumps({"objects": [{"package": {"name": "x", "maintainers": [{"username": "a"}, {"username": "b"}], "links": {"npm": "u"}}, "downloads": {"weekly": 1000}, "searchScore": 2.5}, {"package": {"name": "@s/y"}}]})
    got = rows(S.package_search(spark.createDataFrame([("q", "l", p)], "query string, query_label string, payload string")))
    assert got[0]["metadata"]["maintainers_count"] == "2" and got[0]["metadata"]["weekly_downloads"] == "1000.0" and got[0]["metadata"]["score_final"] == "2.5"
    assert got[1]["url"] == "https://www.npmjs.com/package/@s/y"


def test_package_feeds_from_xml(spark, tmp_path):
    xml = "<rss><channel><item><title>pkg added to PyPI</title><link>https://pypi.org/project/pkg/</link><description>a &amp;lt; b</description></item><item><title>odd</title><link>https://pypi.org/project/odd/1.0/</link></item></channel></rss>"
    (tmp_path / "f.xml").write_text(xml)
    e = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string, author string").load(str(tmp_path / "f.xml"))
    e = e.select("*", (F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("link")) - 1).alias("n")).select(F.lit("newest").alias("feed"), (1 - F.col("n")).alias("pos"), "title", "link", "description", "pubDate", "author")
    packages = spark.createDataFrame([("pkg", json.dumps({"info": {"summary": "S"}, "urls": [{"upload_time_iso_8601": "2024-01-01T00:00:00Z"}, {"upload_time_iso_8601": "2024-02-01T00:00:00Z"}]}))], "name string, payload string")
    got = {r["name"]: r for r in rows(S.package_feeds(e, packages, 10, 10))}
    assert got["pkg"]["metadata"]["latest_upload_time"] == "2024-02-01T00:00:00Z" and got["pkg"]["external_id"] == "newest:pkg:"
    assert got["odd"]["external_id"] == "newest:odd:1.0"


def test_seed_accounts(spark):
    schema = "username string, name string, bio string, followers_count long"
    rows_ = [("@Ann", "Ann", "I build AI agents", 50), ("ann", "Ann", "founder, AI", 70), ("lab", "Lab", "AI research lab, we are hiring engineers", 90), ("bob", "Bob", "gardener", 80), ("openai", "OpenAI", "my AI", 99), ("zero", "Z", "AI founder", 0)]
    configured = spark.createDataFrame([("fallback",)], "username string")
    got = S.seed_accounts(spark.createDataFrame(rows_, schema), ("openai",), configured, 5).collect()
    assert [(r.username, r.followers_count) for r in got] == [("ann", 70)]
    none = S.seed_accounts(spark.createDataFrame(rows_[3:4], schema), (), configured, 5).collect()
    assert [r.username for r in none] == ["fallback"]


def test_followed_accounts(spark):
    data = [{"userName": "@A", "followers": "1,200"}, {"legacy": {"screen_name": "b", "followers_count": 7}}, {"url": "https://x.com/c?x"}, {"username": "a"}, {"name": "nobody"}]
    got = S.followed_accounts(spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "ord int, payload string"))
    assert {r.username: r.followers_count for r in got.collect()} == {"A": 1200, "b": 7, "c": 0}


def test_posts(spark):
    data = [
        {"id": "1", "createdAt": "Tue Jan 30 10:00:00 +0000 2024", "text": "a &amp; b", "likeCount": 2, "retweetCount": "3", "viewCount": 100, "author": {"userName": "@Ann"}},
        {"id": "1", "createdAt": "2024-01-01T00:00:00Z", "text": "again"},
        {"tweetId": "2", "created_at": "2024-01-29T00:00:00Z", "isReply": True, "url": "https://x.com/bob/status/2"},
        {"id": "3", "createdAt": "no time"},
        {"id": "4", "createdAt": "Mon, 29 Jan 2024 01:00:00 +0100"},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "ord int, payload string")
    got = {r.post_id: r for r in S.posts(df).collect()}
    assert set(got) == {"1", "2", "4"}
    assert got["1"].text == "a & b" and got["1"].engagement == 5 and got["1"].author == "Ann" and got["1"].created_at.hour == 10
    assert got["2"].author == "bob" and got["2"].is_reply and got["4"].created_at.day == 29
    assert "2" not in {r.post_id for r in S.posts(df, replies=False).collect()}


def test_projects_in_posts(spark):
    text = "by @me and @You #Tag https://github.com/A/B.git https://www.site.io/x https://t.co/q uses Tool-X and toolx #tag"
    got = spark.createDataFrame([(text,)], "t string").select(S.projects_in(F.col("t"), F.lit("me"), ("Tool-X",))).first()[0]
    assert got == ["@you", "#tag", "github:a/b", "domain:site.io", "term:tool-x"]


def test_stored_posts(spark):
    store = spark.createDataFrame([("1", "@Ann", "new", None, "2024-01-30 12:00:00", None), ("2", "ann", "old", None, "2024-01-20 00:00:00", "r1"), ("3", "ann", "gone", None, "2024-01-30 00:00:00", "bad"), ("4", "eve", "no", None, "2024-01-30 00:00:00", None)], "post_id string, author string, text string, url string, t string, import_run string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    archived, handles = spark.createDataFrame([("bad",)], "import_run string"), spark.createDataFrame([("ANN",)], "author string")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    got = rows(S.stored_posts(store, archived, handles, now, ("24h", "7d", "30d"), 10))
    assert [(r["external_id"], r["source_rank"]) for r in got] == [("24h:1", 1), ("7d:1", 2), ("30d:1", 3), ("30d:2", 4)]
    assert len(rows(S.stored_posts(store, archived, handles, now, ("24h", "7d", "30d"), 2))) == 2


@pytest.mark.parametrize("reader", ["launches", "leaderboard_script"])
def test_broken_payloads_give_no_rows(spark, reader):
    f = getattr(S, reader)
    df = spark.createDataFrame([("{",), (None,)], "payload string")
    assert (f(df) if reader == "launches" else f(df, 3)).count() == 0


@pytest.mark.parametrize("name, reader", [("s5_story_hits", "story_hits"), ("s6_story_lists", "story_lists"), ("s7_launches", "launches"), ("s8_s9_model_hub", "model_hub"), ("s10_package_search", "package_search")])
def test_landed_rows_are_pages_of_bounded_size(spark, tmp_path, monkeypatch, name, reader):
    from lodestream.plans import source_queries as Q
    from lodestream.sources import landed as S

    one = ["1 as user_id", "timestamp_ntz'2024-01-02' as ts", "'view' as event_type", "1.0D as value", "'{\"k\":1}' as props"]
    spark.range(1, 2501).selectExpr("id as event_id", *one).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1, 2501).selectExpr("id as p_partkey", "1 as p_size", "'b' as p_brand", "'n' as p_name").write.parquet(f"{tmp_path}/part.parquet")
    seen, read = [], getattr(S, reader)
    monkeypatch.setattr(S, reader, lambda landed, *more: (seen.append(landed), read(landed, *more))[1])
    ranks = sorted(r.source_rank for r in getattr(Q, name)(spark, str(tmp_path)).collect())
    longest = seen[0].selectExpr("max(length(payload))").first()[0]
    if name == "s6_story_lists":
        assert ranks == [n for n in range(1, 31) if n % 6] and longest < 200
    else:
        assert ranks == list(range(1, 2501)) and seen[0].count() == 3

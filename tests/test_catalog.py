"""Every registered query against its SQL, and invariants that SQL does not state."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lodestream.plans import catalog


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    out = duck.execute(catalog.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(out.description)}
    assert sorted(at) == columns
    assert got == sorted((tuple(norm(r[at[c]]) for c in columns) for r in out.fetchall()), key=str)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_promotion_does_not_depend_on_order(spark):
    from lodestream.operators import rules as R

    rows = [("e", "github", "a", "watch", "m", 1.0, "2024-01-02"), ("e", "hn", "b", "high_potential", "m", 2.0, "2024-01-03"), ("e", "hn", "c", "potential", "m", 2.0, "2024-01-01")]
    schema = "entity_key string, family string, rule string, level string, metric_name string, metric double, event_at string"
    one, two = (R.promoted(spark.createDataFrame(x, schema)).first() for x in (rows, rows[::-1]))
    assert one == two and one.level == "high_potential" and one.families == ["github", "hn"] and one.first_trigger_at == "2024-01-01"


def test_rules_at_their_edges(spark):
    from lodestream.operators import rules as R

    stars = spark.createDataFrame([("a", 1, 299, "t"), ("b", 1, 300, "t"), ("c", 1, 1000, "t"), ("d", 1, 3000, "t")], "entity_key string, item_id int, stars int, at string")
    assert {r.entity_key: r.level for r in R.daily_stars(stars).collect()} == {"b": "watch", "c": "potential", "d": "high_potential"}
    accel = spark.createDataFrame([("flat", 70, 300, "t"), ("low", 69, 10, "t"), ("new", 70, 0, "t"), ("up", 210, 300, "t")], "entity_key string, stars_7d int, stars_30d int, at string")
    assert {r.entity_key: r.level for r in R.star_acceleration(accel).collect()} == {"new": "watch", "up": "high_potential"}
    rank = spark.createDataFrame([("a", 5, None, "t"), ("b", None, 10, "t"), ("c", 11, 12, "t")], "entity_key string, daily_rank int, weekly_rank int, at string")
    assert {r.entity_key: (r.level, r.metric_name) for r in R.launch_rank(rank).collect()} == {"a": ("potential", "daily_rank"), "b": ("watch", "weekly_rank")}


@pytest.mark.parametrize("many", [100_000, 50])
def test_components_of_long_paths_and_hubs(spark, monkeypatch, many):
    from lodestream.operators import components
    from lodestream.operators.components import connected_components

    monkeypatch.setattr(components, "MANY", many)  # so that the hub is hot
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    other = [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + hub + other, "a long, b long")).collect()}
    want = {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)} | {5000: 5000, 5001: 5000}
    assert got == want


def test_components_equal_union_find_on_random_graphs(spark):
    import random

    from lodestream.operators.components import connected_components

    for seed, (n, m) in enumerate(((200, 150), (400, 420), (60, 300))):
        rng = random.Random(seed)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
        assert {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_resolution_is_an_equivalence(spark):
    from lodestream.operators import entities as E

    rows = [(1, ["a", "b"], "Beta"), (2, ["b", "c"], "alpha"), (3, ["d"], " "), (4, ["d"], "dd"), (5, ["item:5"], None)]
    items = spark.createDataFrame(rows, "item_id int, keys array<string>, name string")
    roots = {r.item_id: r.root for r in E.resolve(items).collect()}
    assert roots == {1: "a", 2: "a", 3: "d", 4: "d", 5: "item:5"}
    names = {r.root: (r.canonical_entity, r.n_items) for r in E.entities(items, E.resolve(items)).collect()}
    assert names == {"a": ("Beta", 2), "d": ("dd", 2), "item:5": ("item:5", 1)}


def test_item_keys_prefer_repositories(spark):
    from lodestream.operators import entities as E

    rows = [(1, "https://github.com/A/B.git and https://x.io", "n"), (2, "see https://www.my-site.io/p", "n"), (3, "none", "My Project"), (4, "https://medium.github.io/", "app")]
    df = spark.createDataFrame(rows, "i int, t string, n string")
    got = {r.i: r.k for r in df.select("i", E.item_keys(F.array("t"), F.col("n"), F.col("i"), F.lit(False)).alias("k")).collect()}
    assert got == {1: ["github:a/b"], 2: ["domain:my-site.io"], 3: ["name:my-project"], 4: ["item:4"]}


def test_budget_passes_over_what_does_not_fit(spark):
    from lodestream.operators import windows as W

    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("size")) for i, n in enumerate((50, 60, 10, 30))])
    assert spark.range(1).select(W.fitted(rows, 100).alias("f")).first()["f"].kept == [0, 2, 3]


def test_backfill_jobs_of_all_producers(spark):
    from lodestream.operators import rules as R

    at = lambda s: F.lit(s).cast("timestamp_ntz")
    promoted = spark.createDataFrame([("github:p/1", "potential"), ("domain:x", "high_potential"), ("github:w/1", "watch")], "entity_key string, level string")
    rows = [("github:s/1", 1, 5, 600, "2024-01-21", "2024-01-30"), ("github:s/1", 2, None, 700, "2024-01-21", "2024-01-30"), ("github:board/1", 3, 1, 900, "2024-01-21", "2024-01-30"), ("github:slow/1", 4, 1, 490, "2024-01-21", "2024-01-30"),
            ("github:idle/1", 5, 1, 900, "2024-01-01", "2024-01-16"), ("github:old/1", 6, 1, 99999, "2023-08-03", "2024-01-30"), ("github:none/1", 7, 1, 900, None, "2024-01-30"), ("domain:y", 8, 1, 900, "2024-01-21", "2024-01-30")]
    search = spark.createDataFrame(rows, "entity_key string, item_id int, source_rank int, stars int, created string, pushed string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created", "pushed")})
    trending = spark.createDataFrame([("github:p/1", 500, 0, 1.0), ("github:fomo/1", 500, 0, 1.0), ("github:w/1", 200, 0, 0.5), ("github:w/1", 300, 0, 0.1), ("github:flat/1", 500, 0, 0.0), ("github:few/1", 149, 49, 1.0)], "entity_key string, stars_velocity int, forks_velocity int, slope double")
    packages = spark.createDataFrame([("e", 1, 1, " a ", 3000), ("e", 2, 2, "a", 4000), ("e", 3, 1, "b", 5000), ("e", 4, 1, "c", 2999), ("e", 5, 1, " ", 9000)], "entity_key string, item_id int, source_rank int, package string, weekly int")
    boards, fomo = (spark.createDataFrame([(x,)], "entity_key string") for x in ("github:board/1", "github:fomo/1"))
    producers = R.backfill_producers(promoted, search, trending, packages, boards, fomo, at("2024-01-31"))
    want = [("github:p/1", "potential_candidate", 1_000_002.0), ("e", "package_downloads:b", 505_000.0), ("e", "package_downloads:a", 504_000.0), ("github:w/1", "trending_repos_rising_watch", 100_300.0), ("github:s/1", "github_search_velocity_prefilter", 70.0)]
    assert [tuple(r) for r in R.backfill_jobs(producers).collect()] == want
    assert [tuple(r) for r in R.backfill_jobs(producers, 2).collect()] == want[:2]


def test_story_units_drop_rows_before_they_count(spark):
    from lodestream.operators import mentions as M

    rows = [("url:a", 1, 5, 9, "low", "u", 2, 5), ("url:a", 2, 50, 1, "old", "u", 2, 1), ("url:a", 3, 20, 2, "kept", "u", 0, 5), ("url:b", 4, 5, 0, "low", "u", 0, 5), ("url:c", 5, 90, 0, "undated", "u", 0, None)]
    df = spark.createDataFrame(rows, "unit_key string, item_id int, score int, comments int, title string, url string, impact int, at int")
    got = M.story_units(df, 10, 10, F.lit(3), F.lit(7)).collect()
    assert [(r.unit_key, r.item_id, r.title, r.best_score, r.best_comments, r.row_count, r.impact) for r in got] == [("url:a", 3, "kept", 20, 2, 1, 0)]


def test_newest_posts_link_split_and_uncached_keys(spark):
    from lodestream.operators import mentions as M

    posts = spark.createDataFrame([(1, 2), (2, 9), (3, 8), (4, 8), (5, 11), (6, None)], "post_id int, at int")
    assert [r.post_id for r in M.newest(posts, F.lit(3), F.lit(10), 2).collect()] == [2, 3]
    links = spark.createDataFrame([("e", "github:a/b", 0.8), ("e", "github:a/b", 0.9), ("e", "github:c/d", 0.79), ("e", "npm:x", None), ("e", "", 1.0), ("e", "domain:k", 1.0)], "entity_id string, key string, confidence double")
    aliases, proposals = M.split_links(links, spark.createDataFrame([("e", "domain:k")], "entity_id string, key string"))
    assert [tuple(r) for r in aliases.collect()] == [("e", "github:a/b")] and sorted(r.key for r in proposals.collect()) == ["github:c/d", "npm:x"]
    cached = spark.createDataFrame([("a", "ok"), ("b", "failed")], "key string, status string")
    assert sorted(r.key for r in M.uncached(spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "key string"), cached).collect()) == ["b", "c"]

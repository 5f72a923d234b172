"""Stores that prune, ids that last, canonical JSON, companies, stage events, votes and comparers at their edges."""

import glob
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import scalars as X
from lodestream.operators import entities, facts, identities, quality, rules, runs, snapshots, windows


def test_latest_from_store_opens_only_the_latest_runs(spark, tmp_path):
    """Files of other runs are overwritten with what is no Parquet: reading goes well, so none of them was opened."""
    path = f"{tmp_path}/store"
    rows = [(s, f"2024-0{r}", f"x{i % 5}", i) for s in ("a", "b") for r in range(1, 6) for i in range(10)]
    snapshots.append_snapshot(spark.createDataFrame(rows, "source string, run_id string, external_id string, ord int"), path)
    status = [(s, f"2024-0{r}", "partial" if (s, r) == ("b", 5) else "ok") for s in ("a", "b") for r in range(1, 6)]
    table = spark.createDataFrame(status, "source string, run_id string, status string")
    table.write.parquet(f"{tmp_path}/snapshots")
    broken = [f for f in glob.glob(f"{path}/source=*/run_id=*/*.parquet") if f.split("run_id=")[1][:7] not in ("2024-04", "2024-05")]
    assert len(broken) >= 6
    for f in broken:
        with open(f, "r+b") as out:
            out.seek(4)
            out.write(b"\0" * 64)
    for crc in glob.glob(f"{path}/source=*/run_id=*/.*.crc"):
        if crc.split("run_id=")[1][:7] not in ("2024-04", "2024-05"):
            open(crc, "wb").close()
    found = snapshots.latest_from_store(spark, path, spark.read.parquet(f"{tmp_path}/snapshots"))
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
    assert sorted((r.source, r.run_id, r.external_id, r.ord) for r in found.collect()) == sorted((s, r, f"x{i}", i) for s, r in (("a", "2024-05"), ("b", "2024-04")) for i in range(5))


def test_entities_keep_their_ids_day_by_day(spark):
    """After each of several random days the groups equal a full run's; a merge keeps the older root and tells the other."""
    rng = random.Random(4)
    items = [(i, sorted({f"k{rng.randrange(40)}" for _ in range(rng.choice([1, 1, 1, 2, 3]))}), f"d{i // 12}") for i in range(60)]
    labels = spark.createDataFrame([], "key string, root string, since string")
    before: dict[str, str] = {}
    for n in range(5):
        day = spark.createDataFrame([x for x in items if x[2] == f"d{n}"], "item_id int, keys array<string>, day string")
        so_far = spark.createDataFrame([x for x in items if x[2] <= f"d{n}"], "item_id int, keys array<string>, day string")
        changed, merges = entities.resolve_day(labels, day, f"d{n}")
        merged = {r.root: r.into for r in merges.collect()}
        rows = entities.relabelled(labels, changed).collect()
        labels = spark.createDataFrame(rows, "key string, root string, since string")
        now = {r.key: r.root for r in rows}
        since = {r.root: r.since for r in rows}
        full = {r.item_id: r.root for r in entities.resolve(so_far).collect()}
        got = {r.item_id: r.root for r in entities.labelled(so_far, labels).collect()}
        groups = lambda roots: {frozenset(i for i in roots if roots[i] == r) for r in roots.values()}
        assert groups(full) == groups(got)
        for key, root in before.items():  # a root changes only where it was merged, into one no younger
            assert now[key] == merged.get(root, root) and since[now[key]] <= f"d{n}"
        assert not set(merged) & set(now.values())
        before = now


def test_a_days_rounds_touch_only_the_days_keys(spark):
    labels = spark.createDataFrame([("a", "a", "d1"), ("b", "a", "d1"), ("c", "c", "d0"), ("x", "x", "d0")], "key string, root string, since string")
    day = spark.createDataFrame([(1, ["b", "c"]), (2, ["new", "other"])], "item_id int, keys array<string>")
    changed, merges = entities.resolve_day(labels, day, "d2")
    assert sorted(tuple(r) for r in changed.collect()) == [("a", "c", "d0"), ("b", "c", "d0"), ("new", "new", "d2"), ("other", "new", "d2")]
    assert [tuple(r) for r in merges.collect()] == [("a", "c", "d2")]


def test_canonical_json(spark):
    deep = {"b": [{"z": None, "y": {"x": {"w": [1, {"v": "é😀\n\"\\ 1.0, 2.0"}]}}}], "a": {"c": True, "": []}, "B": -3}
    shuffled = '{"B":-3.0, "a" : {"":[], "c":true},"b":[{"y":{"x":{"w":[1.00,{"v":"\\u00e9\\ud83d\\ude00\\n\\"\\\\ 1.0, 2.0"}]}},"z":null}]}'
    rows = [json.dumps(deep), json.dumps(deep, ensure_ascii=False, sort_keys=True), shuffled, '{"a":1.50,"b":[10.0,100,0.10,-7.0]}', "no json", None, "[]", '"x 1.0"']
    got = [r.c for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", X.canonical_json(F.col("t")).alias("c")).orderBy("i").collect()]
    want = json.dumps(deep, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == [want, want, want, '{"a":1.5,"b":[10,100,0.1,-7]}', None, None, "[]", '"x 1.0"']
    one = spark.range(1).select(X.content_hash(F.lit(shuffled))).first()[0]
    assert one == hashlib.sha256(want.encode()).hexdigest()


def test_nested_paths_and_entity_keys(spark):
    row = spark.createDataFrame([('{"a":{"b c":{"d-e":5}},"n":null}',)], "t string").select(*[X.nested(F.col("t"), p).alias(str(i)) for i, p in enumerate(("a.b c.d-e", "a.x.y", "n", "a"))]).first()
    assert tuple(row) == ("5", None, None, '{"b c":{"d-e":5}}')
    keys = ["Name: My Project", "term:Big  Tool!", "name:!", "TERM:", " github:A/b ", None]
    got = [r.k for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, t string").select("i", X.canonical_entity_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["name:my-project", "term:big-tool", "name:!", "TERM:", "github:A/b", ""]


def test_companies(spark):
    rows = [
        (1, "x", "github:NVlabs/tool", None, "NVIDIA"), (2, "@Anthropics", None, None, "Anthropic"), (3, None, "npm:@openai/sdk", "https://google.com", "OpenAI"),
        (4, "n", None, "https://u:p@Docs.Azure.Microsoft.com:8443/x", "Microsoft"), (5, "n", None, "https://www.ai.google/?q=openai.com", "Google"), (6, "n", None, "ftp://openai.com", ""),
        (7, "n", None, "https://github.com/googleapis/x", "Google"), (8, None, None, None, ""), (9, "a/b", "domain:openai.com", "https://notopenai.com", ""), (10, "n", None, "https://[::1]:80/", ""),
        (11, "n", None, "https://openai.com.evil.io", ""), (12, "Google/x", None, "https://anthropic.com", "Anthropic"),
    ]
    df = spark.createDataFrame(rows, "id int, canonical_name string, canonical_key string, canonical_link string, want string")
    got = {r.id: r.company for r in identities.company_of(df, identities.companies(spark), "id").collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_stages_leave_events_whether_they_end_well_or_not(spark, tmp_path):
    df, events = spark.range(10), f"{tmp_path}/events"
    got = runs.observed_stage(df, lambda d: d.write.parquet(f"{tmp_path}/out"), events, "r", "scoring", "t", {"z": 1, "a": {"c": 1, "b": 2}}, even=F.count_if(F.col("id") % 2 == 0))
    assert got == {"rows": 10, "even": 5} and spark.read.parquet(f"{tmp_path}/out").count() == 10
    with pytest.raises(RuntimeError):
        runs.observed_stage(df, lambda d: (_ for _ in ()).throw(RuntimeError("Bearer abc.def failed")), events, "r", "brief", "t")
    rows = {r.stage: r for r in spark.read.schema(runs.EVENT).parquet(events).collect()}
    assert rows["scoring"].status == "scoring_ok" and rows["scoring"].metadata_json == '{"a":{"b":2,"c":1},"even":5,"rows":10,"z":1}' and rows["scoring"].error is None
    assert rows["brief"].status == "brief_error" and rows["brief"].error_type == "RuntimeError" and "abc" not in rows["brief"].error and "failed" in rows["brief"].error
    status = quality.run_status(spark.read.schema(runs.EVENT).parquet(events), ["feed_run_id"]).first()
    assert (status.errors, status.successes, status.status) == (1, 1, "ok_with_errors")


def test_latest_runs_and_errors(spark):
    schema = "run_id string, status string, started_at int, completed_at int"
    of = lambda rows, **k: runs.latest_run(spark.createDataFrame(rows, schema), **k).first().run_id
    rows = [("a", "ok", 1, 9), ("b", "ok_with_errors", 8, None), ("c", "error", 20, 30), ("d", "running", 40, None), ("e", "ok", 3, 9)]
    assert of(rows) == of(rows, fall_back=True) == "e"
    assert of(rows[2:4]) is None and of(rows[2:4], fall_back=True) == "d" and of(rows[2:3], fall_back=True) is None
    s = spark.createDataFrame([(1, "r1", "ok", "t1", "hn", "old"), (2, "r2", "error", "t2", "hn", "boom"), (3, "r3", "error", "t3", "x_project_mentions", "gone"), (4, "r4", "partial", "t4", "npm", None)], "id int, run_id string, status string, fetched_at string, source string, error string")
    assert tuple(runs.latest_source_run(s).first()) == ("r1", "t1") and tuple(runs.latest_source_run(s.filter("id > 1")).first()) == ("", "")
    assert {r.source: r.error for r in runs.latest_errors(s).collect()} == {"hn": "boom", "npm": None}


def test_votes(spark):
    rows = [("r", "g", "up", 1), ("r", "g", "down", 2), ("r", "g", "maybe", 3), ("r", "h", "up", 1), ("r", "h", "clear", 2), ("s", "g", "up", 1), ("", "g", "up", 9), ("r", None, "up", 9), ("r", "g", None, 9)]
    got = runs.standing_votes(spark.createDataFrame(rows, "feed_run_id string, group_id string, vote string, ord int"))
    assert sorted(tuple(r) for r in got.collect()) == [("r", "g", "down"), ("s", "g", "up")]


def test_comparers(spark):
    def failures(f, expected, actual):
        row = spark.createDataFrame([(json.dumps(expected), json.dumps(actual))], "e string, a string")
        kinds = {"noise": "boolean", "requires_alias": "boolean", "has_alias": "boolean", "requires_citations": "boolean", "cited": "int", "closer_look": "int", "product_signals": "int"}
        of = lambda c: lambda name: X.nested(F.col(c), name).cast(kinds.get(name, "string"))
        return row.select(f(of("e"), of("a")).alias("f")).first().f

    assert failures(quality.story_failures, {"projectness": "project", "requires_alias": True, "deterministic_link_type": "github"}, {"projectness": "news", "noise": True, "has_alias": False, "deterministic_link_type": None}) == [
        "projectness expected project got news", "expected deterministic alias link", "deterministic_link_type expected github got None"]
    assert failures(quality.story_failures, {"projectness": "a"}, {"projectness": "a", "noise": True, "has_alias": False}) == []
    assert failures(quality.tier_failures, {"x_tier": "watch", "max_tier": "watch", "requires_citations": True, "noise": True}, {"accepted_x_tier": "high", "cited": 0}) == [
        "x_tier expected watch got high", "accepted tier high exceeds max_tier watch", "accepted non-none tier without citations", "noise expected none got high"]
    assert failures(quality.tier_failures, {"noise": False}, {"accepted_x_tier": "none", "cited": 0}) == ["expected non-noise x signal"]
    assert failures(quality.tier_failures, {"noise": False, "max_tier": "watch"}, {"accepted_x_tier": "none", "cited": 0}) == []
    assert failures(quality.triage_failures, {"noise": True}, {"closer_look": 1, "product_signals": 0}) == ["noise case should not request closer look"]
    assert failures(quality.triage_failures, {"noise": False}, {"closer_look": 0, "product_signals": 0}) == ["expected at least one product signal"]
    totals = quality.case_totals(spark.createDataFrame([("a", []), ("a", ["x"]), ("b", [])], "k string, failures array<string>"), ["k"])
    assert sorted(tuple(r) for r in totals.collect()) == [("a", 2, 1, 1), ("b", 1, 1, 0)]


def test_scaling_refs_evidence_and_pruning(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 10.0), (3, "a", None), (4, "b", 5.0), (5, "c", 0.0), (6, None, 1.0), (7, None, 3.0)], "i int, k string, v double")
    assert {r.i: r.s for r in windows.min_max_scaled(df, "v", "s", ["k"]).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 0.0, 6: 0.0, 7: 1.0}
    assert {r.i: r.s for r in windows.min_max_scaled(df, "v", "s", []).collect()}[4] == 0.5
    promoted = spark.createDataFrame([("a", "watch"), ("b", "potential")], "entity_key string, level string")
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", None)], "entity_key string, item_id int")
    assert sorted(r.ref for r in rules.edge_watch_refs(promoted, items).collect()) == ["item:1", "item:2"]
    jobs, stars = spark.createDataFrame([("e", "r"), ("f", "s")], "entity_key string, repo string"), spark.createDataFrame([("r", 0), ("r", 24), ("r", 168), ("r", 169), ("r", -1)], "repo string, h int")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(now) - F.col("h").cast("long") * 3_600_000_000)
    got = rules.backfill_evidence(jobs, stars.withColumn("at", at), spark.createDataFrame([("r", 7, True)], "repo string, forks int, lower_bound boolean"), now)
    assert {(r.entity_key, r.metric_name): (r.metric_value, r.note) for r in got.collect()} == {
        ("e", "github_stars_24h"): ("2", "lower_bound_due_to_page_cap"), ("e", "github_stars_7d"): ("3", "lower_bound_due_to_page_cap"), ("e", "github_forks_total"): ("7", "repo metadata snapshot"),
        ("f", "github_stars_24h"): ("0", "complete_recent_pages"), ("f", "github_stars_7d"): ("0", "complete_recent_pages"), ("f", "github_forks_total"): ("0", "repo metadata snapshot")}
    rows = spark.createDataFrame([(i, i % 2, 100 - i) for i in range(20)], "item_id int, g int, m int")
    kept = snapshots.pruned(rows, rows.filter("item_id in (1, 18)"), ["g"], [F.desc("m")], 3)
    assert sorted(r.item_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 18] and "WindowGroupLimit" in kept._jdf.queryExecution().toString()


def test_sketches_of_runs_merge(spark):
    calls = spark.range(40_000).select((F.col("id") % 7).alias("run"), F.lit("c").alias("component"), (F.col("id") * 7919 % 40_000).alias("latency_ms"))
    merged = quality.merged_quantiles(quality.latency_sketches(calls, ["run", "component"]), ["component"], {"p50": 0.5, "p95": 0.95}).first()
    assert merged.n == 40_000 and abs(merged.p50 / 40_000 - 0.5) < 0.03 and abs(merged.p95 / 40_000 - 0.95) < 0.03


def test_facts_and_compact_payloads(spark):
    rows = [
        ("github_trending", {"period": "daily", "stars_total": "12"}, ["窗口=daily", "窗口新增star=None", "总star=12.00"]),
        ("github_search", {"query": "q", "query_label": "", "topics": '["a","b","c","d","e"]'}, ["搜索词=q", "star=None", "fork=None", "最后push=None", "topics=a, b, c, d"]),
        ("github_movers_trending_repos", {"source_score": "1.5", "topics": "[]"}, ["来源=None", "窗口=None", "rank=/1.5", "source_score=1.50", "star速度=", "fork速度=", "最新sparkline=None"]),
        ("x_tweets", {"author": "me", "mentioned_projects": '[{"name":"","key":"k"},{"name":"N"}]'}, ["作者=@me", "发布时间=None", "提及=k, N"]),
        ("npm_search", {"weekly_downloads": "n/a"}, ["搜索词=None", "版本=None", "周下载=n/a", "月下载=", "dependents=", "score=", "quality=", "popularity=", "maintenance="]),
        ("unknown", {}, []),
    ]
    got = spark.createDataFrame(rows, "s string, m map<string,string>, want array<string>").select(facts.row_facts(F.col("s"), F.col("m")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    raw = [("github_search", "[1,2]"), ("x_tweets", '{"raw":{"a":1},"b":[1.0,{"d":2,"c":null}],"a":null}'), ("npm_search", '{"z":1,"a":2}'), ("x_tweets", "bad"), ("hn", None)]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(raw)], "i int, s string, r string").orderBy("i").select(facts.compact_raw(F.col("s"), F.col("r"))).collect()]
    assert got == ["[1,2]", '{"a":null,"b":[1,{"c":null,"d":2}]}', '{"a":2,"z":1}', None, None]
    kept = json.loads(spark.range(1).select(facts.compact_raw(F.lit("github_search"), F.lit('{"license":"MIT","owner":{"login":"a"},"size":5,"x":1}'))).first()[0])
    assert kept["license"] is None and kept["owner"] == "a" and kept["size"] == 5 and "x" not in kept and set(kept) == set(facts.KEPT["github_search"])


def test_slopes_in_their_last_digits(spark):
    """Parts 8280 and 12439 of sf0.1: their exact slope is 0, and what regr_slope leaves above it in DuckDB decides whether they rise."""
    counts = {
        8280: [3, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 3, 1],
        12439: [1, 2, 1, 1, 1, 1, 3, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 1, 1, 2, 1, 1, 2],
        1: [2, 4, 6], 2: [1, 5], 3: [6, 4, 2], 4: [0, 0, 0],
    }
    points = [(k, x, n) for k, own in counts.items() for x, n in enumerate(own)]
    points += [(5, 7, 1), (5, 7, 2), (5, 7, 3), (6, 0, 1), (6, 1, None), (6, 2, 5), (None, 0, 1), (None, 1, 3), (None, 2, 5), (7, 0, None), (7, 1, None), (7, 2, None)]
    random.Random(1).shuffle(points)
    found = windows.slope(spark.createDataFrame(points, "k int, x long, n long"), ["k"], "x", "n")
    got = {r.k: r.slope for r in found.collect()}
    assert got == {8280: 1.8015789446250004e-18, 12439: 2.754895842742324e-18, 1: 0.5, 3: -0.5, 4: 0.0, 5: None, 6: pytest.approx(2 / 3), None: pytest.approx(2 / 3), 7: None}

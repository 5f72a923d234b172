import datetime as dt

from pyspark.sql import functions as F

from lodestream.operators.mentions import entity_windows
from lodestream.operators.snapshots import upserted
from lodestream.streaming import live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "post_id string, entity_key string, author string, created_at timestamp, first_seen timestamp, last_seen timestamp"


def rows(n):
    return [(f"p{i % 7}", f"e{i % 3}", f"a{i % 2}", T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i), T0 + dt.timedelta(hours=i)) for i in range(n)]


def landed(spark, tmp_path, parts):
    path = f"{tmp_path}/in"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        del k
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_kept_stream_equals_the_batch_over_restarts(spark, tmp_path):
    data = rows(24)
    whole = spark.createDataFrame(data, SCHEMA)
    want = {(r.post_id, r.first_seen, r.last_seen) for r in upserted(whole.limit(0), whole, "post_id").collect()}
    path = f"{tmp_path}/in"
    for part in (data[16:], data[4:16], data[:8]):  # late and overlapping batches, a restart for each
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(SCHEMA).parquet(path)
        live.keep(stream, f"{tmp_path}/store", f"{tmp_path}/cp", available_now=True).awaitTermination(120)
    landed_ = spark.read.parquet(f"{tmp_path}/store")
    assert landed_.count() == 8 + 12 + 8  # each batch once
    got = live.latest(landed_, "post_id")
    assert got.columns == landed_.columns and {(r.post_id, r.first_seen, r.last_seen) for r in got.collect()} == want


def test_counts_as_of_now_equal_the_batch_at_each_trigger(spark, tmp_path):
    """Posts come late and in restarts, time passes without posts of an entity, and posts age out of both windows."""
    schema = "post_id string, entity_key string, author string, created_at timestamp, seen_at timestamp"
    hour = lambda h: T0 + dt.timedelta(hours=h)
    batches = [
        [(f"p{i}", f"e{i % 3}", f"A{i % 4}", hour(i), hour(i)) for i in range(30)],
        [("late", "e0", "a9", hour(2), hour(40)), ("old", "e1", "a1", hour(-200), hour(41)), ("p3", "e0", "a3", hour(3), hour(41)), ("q", "e2", None, hour(40), hour(41))],
        [("only", "e0", "a1", hour(60), hour(60))],
        [("later", "e2", "b", hour(150), hour(190))],
        [("end", "e2", "b", hour(399), hour(400))],
    ]
    with live.settings(spark):
        seen = []
        for batch in batches:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/posts")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/posts")
            live.keep(live.counts_as_of_now(stream, parts=2), f"{tmp_path}/told", f"{tmp_path}/cp2", available_now=True).awaitTermination(240)
            seen += batch
            now = max(b[4] for b in seen) - dt.timedelta(seconds=1)
            posts = spark.createDataFrame(seen, schema).dropDuplicates(["post_id"])
            want = {r.entity_key: tuple(r)[1:] for r in live.counted_as_of(posts, F.lit(now)).collect()}
            got = {r.entity_key: tuple(r)[1:] for r in live.standing(spark.read.schema(live.AGING).parquet(f"{tmp_path}/told")).collect()}
            assert {k: v for k, v in got.items() if any(v)} == want, now


def test_windows_of_a_bounded_replay_equal_the_batch(spark, tmp_path):
    data = rows(48)
    stream = landed(spark, tmp_path, [data[:24], data[24:], [("late", "e0", "a0", T0 + dt.timedelta(days=9), T0, T0)]])
    q = live.mention_counts(stream).writeStream.format("memory").queryName("mention_windows").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.entity_key): (r.mentions, r.authors) for r in spark.table("mention_windows").collect()}
    whole = spark.createDataFrame(data, SCHEMA)
    want = {(r.start, r.entity_key): (r.mentions, r.authors) for r in whole.groupBy(F.window("created_at", "24 hours", "6 hours"), "entity_key").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("author").alias("authors")).select("window.start", "entity_key", "mentions", "authors").collect()}
    assert got == want
    now = F.lit(str(T0 + dt.timedelta(hours=48))).cast("timestamp")
    day = entity_windows(whole.select("entity_key", "author", F.col("created_at").alias("at")), now, F.lit(False)).filter("window_name = '24h'").collect()
    assert {r.entity_key: r.mention_count for r in day} == {e: got[(T0 + dt.timedelta(hours=24), e)][0] for e in ("e0", "e1", "e2")}


def test_repeats_within_the_watermark_come_once(spark, tmp_path):
    data = rows(10)
    stream = landed(spark, tmp_path, [data, data])
    q = live.deduplicated(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 7


def test_counts_as_of_now_keep_one_timer_and_few_state_rows_a_key(spark, tmp_path):
    """State grows by slots, not by posts and their timers; a key of many posts splits its slots and counts each post once."""
    schema = "post_id string, entity_key string, author string, created_at timestamp, seen_at timestamp"
    at = lambda i: T0 + dt.timedelta(minutes=i)
    posts = [(f"p{i}", "hot" if i % 2 else f"e{i % 10}", f"a{i % 3}", at(i), at(i)) for i in range(10_000)]
    posts += [(f"p{i}", "hot", f"a{i % 3}", at(i), at(9_999)) for i in range(9_001, 9_201, 2)]  # seen again
    spark.createDataFrame(posts, schema).coalesce(1).write.parquet(f"{tmp_path}/posts")
    with live.settings(spark):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/posts")
        told = live.keep(live.counts_as_of_now(stream, parts=1), f"{tmp_path}/told", f"{tmp_path}/cp", available_now=True)
        told.awaitTermination(240)
    rows = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in map(dict, told.recentProgress)]
    assert max(rows) < 200
    got = {r.entity_key: tuple(r)[1:] for r in live.standing(spark.read.schema(live.AGING).parquet(f"{tmp_path}/told")).collect()}
    once = spark.createDataFrame(posts, schema).dropDuplicates(["post_id"])
    want = {r.entity_key: tuple(r)[1:] for r in live.counted_as_of(once, F.lit(at(9_999) - dt.timedelta(seconds=1))).collect()}
    assert got == want and want["hot"][0] == 721

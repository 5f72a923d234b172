"""Streaming forms: the latest row of each key, mention counts over sliding windows, and mention counts as of now."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestream.operators.mentions import entity_windows


#: State on the executors' disks, in bounded memory, let go after each task and saved in the checkpoint folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str] = STATE) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session's own are put back."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def deduplicated(posts: DataFrame, key: str = "post_id", at: str = "created_at", late: str = "3 days") -> DataFrame:
    """Posts of a stream once each, as long as repeats come within the watermark."""
    return posts.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def mention_counts(
    mentions: DataFrame, at: str = "created_at", late: str = "1 hour", length: str = "24 hours", slide: str = "6 hours"
) -> DataFrame:
    """Mentions and distinct authors per entity and sliding window, emitted once a window is complete.

    Authors are counted exactly: first one row for each author of a window, then the rows.
    """
    w = F.window(at, length, slide)
    authors = mentions.withWatermark(at, late).groupBy(w, "entity_key", "author").agg(F.count(F.lit(1)).alias("n"))
    counts = authors.groupBy("window", "entity_key").agg(F.sum("n").alias("mentions"), F.count("author").alias("authors"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "entity_key", "mentions", "authors")


# --- the latest row of each key -------------------------------------------------------------------------------------


def keep(posts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Land a stream under ``path`` by Spark's own file sink: readers see whole micro-batches, each once, whatever is replayed."""
    out = posts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def latest(landed: DataFrame, key: str, first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """Of each key the row last seen (then the greatest), with the earliest first sight of all its rows.

    One aggregate that combines before the shuffle, so late and overlapping batches need no order, and a key with any
    number of rows costs one a task.
    """
    rest = [c for c in landed.columns if c not in (key, first, last)]
    newest = F.max(F.struct(F.col(last), *[F.col(c) for c in sorted(rest)])).alias("_row")
    rows = landed.groupBy(key).agg(F.min(first).alias("_first"), newest)
    return rows.select(
        *[F.col("_first").alias(c) if c == first else F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in landed.columns]
    )


# --- counts as of now -----------------------------------------------------------------------------------------------

_DAY_MS = 86_400_000
AGING = "entity_key string, part int, seq long, now timestamp, mentions_24h long, authors_24h long, mentions_7d long, authors_7d long"


#: Posts of one slot, the unit in which state is read and written, at which a key's slots double.
SLOT = 4096


class Aging(StatefulProcessor):
    """Posts of an entity (one part of it) of the last seven days, counted anew whenever posts come or age out.

    Now is the stream's watermark. A post counts while it was made no earlier than 24 hours or 7 days before now, as in the
    batch form; one timer a key tells when the next post reaches either age. A key's posts lie in slots by the hash of their
    id, so a few calls read and write them all, and no more than a slot is held at once however many posts a key has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.posts = handle.getMapState("posts", "slot int", "posts string")
        self.told = handle.getValueState("told", "seq long, now long, held long, slots int, timer long")

    def _read(self, slot: int) -> dict:
        import json

        found = self.posts.getValue((slot,))
        return {post: (at, author) for post, at, author in json.loads(found[0])} if found else {}

    def _write(self, slot: int, posts: dict) -> None:
        import json

        if posts:
            self.posts.updateValue((slot,), (json.dumps([(post, *rest) for post, rest in posts.items()]),))
        else:
            self.posts.removeKey((slot,))

    def _added(self, new: list[Row], held: int, slots: int) -> tuple[int, int]:
        """Most posts that are held, and slots, once these have come; slots double before they grow full."""
        import zlib

        hashed = lambda post: zlib.crc32((post or "").encode())
        held += len(new)
        while held > SLOT * slots:
            for slot in range(slots):
                old = self._read(slot)
                stay = {p: v for p, v in old.items() if hashed(p) % (2 * slots) == slot}
                if len(stay) < len(old):
                    self._write(slot, stay)
                    self._write(slot + slots, {p: v for p, v in old.items() if p not in stay})
            slots *= 2
        dealt: dict[int, dict] = {}
        for r in new:
            dealt.setdefault(hashed(r.post_id) % slots, {})[r.post_id] = (r.at, r.author)
        for slot, posts in dealt.items():
            self._write(slot, self._read(slot) | posts)
        return held, slots

    def _counted(self, key: tuple, now: int, rows: Iterator[Row] = iter(())) -> Iterator[Row]:
        import datetime as dt
        from itertools import islice

        seq, _, held, slots, timer = self.told.get() if self.told.exists() else (-1, 0, 0, 1, 0)
        fresh = (r for r in rows if r.at >= now - 7 * _DAY_MS)
        while new := list(islice(fresh, SLOT)):
            held, slots = self._added(new, held, slots)
        n, authors, leaves, held = [0, 0], [set(), set()], [], 0
        for slot in range(slots):
            old = self._read(slot)
            posts = {p: v for p, v in old.items() if v[0] >= now - 7 * _DAY_MS}
            if len(posts) < len(old):
                self._write(slot, posts)
            held += len(posts)
            for i, days in enumerate((1, 7)):
                live = [v for v in posts.values() if v[0] >= now - days * _DAY_MS]
                n[i] += len(live)
                authors[i].update(author.lower() for _, author in live if author is not None)
                if live:
                    leaves.append(min(at for at, _ in live) + days * _DAY_MS + 1)
        if leaves and (timer <= now or min(leaves) < timer):
            if timer > now:
                self.handle.deleteTimer(timer)
            timer = min(leaves)
            self.handle.registerTimer(timer)
        seq += 1
        self.told.update((seq, now, held, slots, timer))
        when = dt.datetime.fromtimestamp(now / 1000)
        yield Row(
            entity_key=key[0], part=key[1], seq=seq, now=when, mentions_24h=n[0], authors_24h=len(authors[0]), mentions_7d=n[1],
            authors_7d=len(authors[1])
        )

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._counted(key, max(timerValues.getCurrentWatermarkInMs(), 0), rows)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        if self.told.get()[1] < now:
            yield from self._counted(key, now)

    def close(self) -> None:
        pass


def counts_as_of_now(posts: DataFrame, parts: int = 16, late: str = "1 second") -> DataFrame:
    """A stream of counts (``AGING``) of each entity and part whenever they change; ``standing`` adds the parts up.

    posts: post_id, entity_key, author, created_at, seen_at. Time goes by ``seen_at``, when a post was read, so a post made
    long ago counts as it should when it comes. An entity's posts are dealt to ``parts`` by author, so no task
    holds a hot one, and authors of different parts differ. Needs the RocksDB state store.
    """
    part = F.pmod(F.xxhash64(F.lower("author")), F.lit(parts)).cast("int")
    rows = posts.withWatermark("seen_at", late).select(
        "seen_at", "entity_key", part.alias("part"), "post_id", "author", F.unix_millis(F.col("created_at").cast("timestamp")).alias("at")
    )
    return rows.groupBy("entity_key", "part").transformWithState(
        statefulProcessor=Aging(), outputStructType=AGING, outputMode="Append", timeMode="eventtime"
    )


def standing(told: DataFrame) -> DataFrame:
    """entity_key and its counts now, out of all that ``counts_as_of_now`` has told: the last word of each part, added up."""
    counts = ["mentions_24h", "authors_24h", "mentions_7d", "authors_7d"]
    last = told.groupBy("entity_key", "part").agg(F.max_by(F.struct(*counts), "seq").alias("c"))
    return last.groupBy("entity_key").agg(*[F.sum(f"c.{c}").alias(c) for c in counts])


def counted_as_of(posts: DataFrame, now: Column) -> DataFrame:
    """The batch form of ``standing``: the same counts of landed posts as of a moment, by ``entity_windows``."""
    rows = entity_windows(posts.withColumn("at", F.col("created_at")), now, F.lit(True))
    pick = lambda w, c: F.coalesce(F.max(F.when(F.col("window_name") == w, F.col(c))), F.lit(0))
    return rows.groupBy("entity_key").agg(
        pick("24h", "mention_count").alias("mentions_24h"), pick("24h", "distinct_authors").alias("authors_24h"),
        pick("7d", "mention_count").alias("mentions_7d"), pick("7d", "distinct_authors").alias("authors_7d"),
    )

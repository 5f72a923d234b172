"""Runs and their stages: which run is the latest, what its stages counted as they wrote, and readers' votes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestream.functions.scalars import canonical_json, redacted

from .snapshots import RETIRED

#: Statuses of runs that have ended well, and votes.
ENDED = ("ok", "ok_with_errors")
VOTES = ("up", "down", "clear")


def latest_errors(snapshots: DataFrame) -> DataFrame:
    """source, error of each source's latest snapshot (null if that is sound), retired sources aside. snapshots: id, source, error."""
    rows = snapshots.filter(~F.col("source").isin(*RETIRED))
    return rows.groupBy("source").agg(F.max_by("error", "id").alias("error"))


def latest_run(runs: DataFrame, fall_back: bool = False) -> DataFrame:
    """One row, run_id: of the runs that ended well the one that ended (or else began) last, ties to the later beginning;
    with ``fall_back``, if there is none, of those still running the one that began last. Null if there is none at all.

    runs: run_id, status, started_at, completed_at. One aggregate: nothing is sorted.
    """
    ended = F.when(F.col("status").isin(*ENDED), F.struct(F.coalesce("completed_at", "started_at"), "started_at", "run_id"))
    running = F.when((F.col("status") == "running") & F.lit(fall_back), F.struct("started_at", "run_id"))
    found = runs.agg(F.max(ended).alias("e"), F.max(running).alias("r"))
    return found.select(F.coalesce("e.run_id", "r.run_id").alias("run_id"))


def latest_source_run(snapshots: DataFrame) -> DataFrame:
    """One row, run_id and fetched_at of the last sound snapshot; empty texts if there is none. snapshots: id, run_id, status, fetched_at."""
    last = snapshots.agg(F.max(F.when(F.col("status") == "ok", F.struct("id", "run_id", "fetched_at"))).alias("s"))
    return last.select(*[F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("")).alias(c) for c in ("run_id", "fetched_at")])


def standing_votes(votes: DataFrame) -> DataFrame:
    """feed_run_id, group_id, vote: the last valid vote of each run and group, cleared ones left out. votes: feed_run_id, group_id, vote, ord."""
    last = votes.filter(valid_vote()).groupBy("feed_run_id", "group_id").agg(F.max_by("vote", "ord").alias("vote"))
    return last.filter("vote != 'clear'")


def valid_vote() -> Column:
    """Whether a vote names a run and a group and is one of the three there are."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return text("feed_run_id") & text("group_id") & F.coalesce(F.col("vote").isin(*VOTES), F.lit(False))


EVENT = "feed_run_id string, group_id string, stage string, status string, error_type string, error string, metadata_json string, created_at string"


def append_event(
    df: DataFrame, path: str, run: str, stage: str, status: str, at: str, metadata: dict, group: str | None = None,
    error: BaseException | None = None
) -> None:
    """Add one row to the events under ``path``: secrets redacted from the error, metadata as canonical JSON."""
    row = [(run, group, stage, status, type(error).__name__ if error else None, str(error) if error else None, json.dumps(metadata), at)]
    event = df.sparkSession.createDataFrame(row, EVENT)
    event.withColumns(
        {"error": redacted(F.col("error")), "metadata_json": canonical_json(F.col("metadata_json"))}
    ).write.mode("append").parquet(path)


def observed_stage(
    df: DataFrame, write: Callable[[DataFrame], None], events: str, run: str, stage: str, at: str, metadata: dict | None = None,
    **counts: Column
) -> dict:
    """Write ``df`` and add the stage's event with what was counted in the very pass that wrote it: rows, and the named aggregates.

    Nothing is scanned again for the counts. A stage that fails leaves an event with its error, and the error goes on.
    """
    seen = Observation(f"{stage}-{uuid.uuid4().hex}")
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    try:
        write(watched)
    except Exception as error:
        append_event(df, events, run, stage, f"{stage}_error", at, metadata or {}, error=error)
        raise
    found = dict(seen.get)
    append_event(df, events, run, stage, f"{stage}_ok", at, {**(metadata or {}), **found})
    return found

"""Structured Streaming forms of the progress, counting, queueing, screening and billing jobs.

Jobs with state of their own keep a few numbers for each key, in order of event time within a trigger, and drop them by a
timer: each rule says what a pause means, so that a key whose state is gone reads as one that begins anew. A watermark
must be set where a stream comes in (``delay``); rows that are later than it are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.sources import results
from vellum.sources.corpus import shared_folder

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
PROGRESS = "type string, stage int, chunk int, total int"
DAY = 86_400_000_000


def event_stream(spark: SparkSession, folder: str, files_each: int | None = None, name: str = "events.parquet*") -> DataFrame:
    """The events table as a stream of files."""
    reader = spark.readStream.schema(EVENTS)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    return reader.parquet(f"{folder}/{name}")


def progress_events(events: DataFrame) -> DataFrame:
    """Events as job progress: job_id, ts, event_id and the fields of a JSON payload, read with one wide schema.

    A start tells the total; one progress line in three has a total of its own, the others rely on the start.
    """
    id_ = F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "signup", "start").when((F.col("event_type") == "purchase") & (id_ % 3 == 0), "complete")
        .when(F.col("event_type") == "purchase", "stage").when(F.col("event_type") == "error", "error").otherwise("progress")
    )
    total = F.when(kind == "start", 10 + id_ % 30).when((kind == "progress") & (id_ % 3 == 0), 20)
    payload = F.to_json(F.struct(kind.alias("type"), F.when(kind == "stage", id_ % 8).cast("int").alias("stage"), F.when(kind == "progress", id_ % 20).cast("int").alias("chunk"), total.cast("int").alias("total")))
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", F.from_json(payload, PROGRESS).alias("p")).select("job_id", "ts", "event_id", "p.*")


def _stage_percent(stage: int | None) -> int:
    return max(10, min(80, (stage or 1) * 12))


def _chunk_percent(chunk: int | None, total: int | None) -> int:
    return max(20, min(90, int((20 + ((chunk or 0) / total if total else 0.0) * 65) + 0.5)))


def _sorted_rows(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """A trigger's rows of one key by time, then event_id; nulls as None."""
    rows = pd.concat(list(frames))[["us", "event_id", *columns]].sort_values(["us", "event_id"], kind="stable")
    return zip(*[[None if pd.isna(v) else v for v in rows[c].tolist()] for c in ("us", *columns)], strict=True)


def job_progress(events: DataFrame, pause_days: int = 30, delay: str = "1 day") -> DataFrame:
    """job_id, percent, state of a stream of progress events, in update mode.

    A stage stands for 12 percent within 10 to 80, a start for 16, chunks for 20 to 90 of the payload's total, else of the
    total that the run's start has told; complete is 100. An error keeps the last percentage (null if there is none yet).
    complete and error end a run, and so does a pause of more than ``pause_days``: the next event begins a new run that knows
    nothing of the last. So an ended job needs no state, and the timer drops a paused one.
    """
    limit = pause_days * DAY

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, percent, last = state.get if state.exists else (0, None, None)
        status = "running"
        for us, kind, stage, chunk, own in _sorted_rows(frames, ["type", "stage", "chunk", "total"]):
            if status != "running" or (last is not None and us - last > limit):
                total, percent, status = 0, None, "running"
            last = us
            if kind == "stage":
                percent = _stage_percent(stage)
            elif kind == "start":
                total, percent = own or 0, 16
            elif kind == "progress":
                percent = _chunk_percent(chunk, own or total)
            elif kind == "complete":
                percent, status = 100, "completed"
            elif kind == "error":
                status = "failed"
        until = (last + limit) // 1000 + 1
        if status == "running" and until > state.getCurrentWatermarkMs():
            state.update((int(total), percent, int(last)))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "percent": pd.array([percent], "Int32"), "state": [status]})

    rows = events.filter("ts is not null").withWatermark("ts", delay).select("job_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "type", "stage", "chunk", "total")
    return rows.groupBy("job_id").applyInPandasWithState(fold, "job_id long, percent int, state string", "total int, percent int, last long", "update", GroupStateTimeout.EventTimeTimeout)


def job_progress_table(events: DataFrame, pause_days: int = 30) -> DataFrame:
    """The rules of ``job_progress`` over a whole table, by windows."""
    order = Window.partitionBy("job_id").orderBy("ts", "event_id")
    us = F.unix_micros("ts")
    ends = F.lag("type").over(order).isin("complete", "error") | (us - F.lag(us).over(order) > pause_days * DAY)
    rows = events.filter("ts is not null").withColumn("_ends", F.coalesce(ends, F.lit(False)).cast("int")).withColumn("_run", F.sum("_ends").over(order))
    run = Window.partitionBy("job_id", "_run").orderBy("ts", "event_id")
    started = F.last(F.when(F.col("type") == "start", F.coalesce("total", F.lit(0))), ignorenulls=True).over(run)
    total = F.coalesce(F.nullif("total", F.lit(0)), started, F.lit(0))
    share = F.coalesce(F.try_divide(F.coalesce("chunk", F.lit(0)), total), F.lit(0.0))
    percent = (
        F.when(F.col("type") == "stage", F.greatest(F.lit(10), F.least(F.lit(80), F.coalesce(F.nullif("stage", F.lit(0)), F.lit(1)) * 12)))
        .when(F.col("type") == "start", 16).when(F.col("type") == "progress", F.greatest(F.lit(20), F.least(F.lit(90), F.floor(20 + share * 65 + 0.5)))).when(F.col("type") == "complete", 100)
    )
    rows = rows.withColumn("percent", percent.cast("int"))
    at = F.struct("_run", "ts", "event_id")
    last = rows.groupBy("job_id").agg(F.max("_run").alias("r"), F.max_by("type", at).alias("t"), F.max_by(F.struct("_run", "percent"), F.when(F.col("percent").isNotNull(), at)).alias("p"))
    state = F.when(F.col("t") == "complete", "completed").when(F.col("t") == "error", "failed").otherwise("running")
    return last.select("job_id", F.when(F.col("p._run") == F.col("r"), F.col("p.percent")).alias("percent"), state.alias("state"))


def log_level_counts(logs: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """start, level, n in tumbling windows of event time; rows later than ``delay`` are dropped, so state is bounded."""
    counts = logs.withWatermark("created_at", delay).groupBy(F.window("created_at", window), "level").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), "level", "n")


def enqueue_once(jobs: DataFrame, delay: str = "1 day") -> DataFrame:
    """A job id that was queued within ``delay`` is ignored.

    An id is kept until the watermark (the latest time of the triggers before, less ``delay``) has passed its first time by
    ``delay``; from the trigger after on it counts as new.
    """
    return jobs.withWatermark("queued_at", delay).dropDuplicatesWithinWatermark(["job_id"])


def usage_counters(uploads: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """user_id, used, last_reset (microseconds): running counters that start again when an upload comes more than ``days`` after the last reset.

    ``uploads`` has (user_id, ts). Rows of one trigger are taken in order of time; the state is two numbers a user, and is
    dropped when the watermark is past the time at which any upload would start the counter again.
    """
    limit = days * DAY

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, reset = state.get if state.exists else (0, None)
        for t in sorted(t for f in frames for t in f["us"]):
            if reset is None or t - reset > limit:
                used, reset = 0, t
            used += 1
        until = (reset + limit) // 1000 + 1
        if until > state.getCurrentWatermarkMs():
            state.update((used, reset))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "used": [used], "last_reset": [reset]})

    rows = uploads.filter("ts is not null").withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, used long, last_reset long", "used long, reset long", "update", GroupStateTimeout.EventTimeTimeout)


def subscription_events(events: DataFrame) -> DataFrame:
    """Events as billing events: user_id, ts, event_id, type, subscription, status."""
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type").isin("click", "view"), "updated").when(F.col("event_type") == "error", "deleted").otherwise("other")
    return events.select("user_id", "ts", "event_id", kind.alias("type"), F.concat(F.lit("sub"), F.col("event_id") % 2).alias("subscription"), F.when(F.col("event_id") % 3 == 0, "past_due").otherwise("active").alias("status"))


def subscription_state(events: DataFrame, lapse_days: int = 400, delay: str = "1 day") -> DataFrame:
    """user_id, subscription, status, plan of a stream of billing events, in update mode.

    completed sets the user's subscription. updated and deleted count only for the subscription that the user has: updated sets
    the status, deleted clears the subscription, makes the status inactive and the plan free. Other types are ignored. A user
    without a billing event for more than ``lapse_days`` begins anew, so the timer may drop the state.
    """
    limit = lapse_days * DAY

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        mine, status, plan, last = state.get if state.exists else (None, None, "premium", None)
        for us, kind, subscription, new_status in _sorted_rows(frames, ["type", "subscription", "status"]):
            if last is not None and us - last > limit:
                mine, status, plan = None, None, "premium"
            last = us
            if kind == "completed":
                mine = subscription
            elif mine is not None and subscription == mine:
                mine, status, plan = (None, "inactive", "free") if kind == "deleted" else (mine, new_status, plan)
        until = (last + limit) // 1000 + 1
        if until > state.getCurrentWatermarkMs():
            state.update((mine, status, plan, int(last)))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "subscription": pd.array([mine], "string"), "status": pd.array([status], "string"), "plan": [plan]})

    rows = events.filter("type <> 'other' and ts is not null").withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "type", "subscription", "status")
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, subscription string, status string, plan string", "mine string, status string, plan string, last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_to_table(
    stream: DataFrame, keys: list[str], mode: str = "update", checkpoint: str | None = None, path: str | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None, progress: list | None = None,
) -> DataFrame:
    """Run a stream over what is there (availableNow) and return its last row for each key as a table.

    Every trigger's rows are written with its number, so a trigger that runs again after a failure overwrites itself. With a
    ``path`` the run can be taken up again with its ``checkpoint``: its end seals the last rows of all keys up to its last
    trigger, and later runs read that and newer triggers only. ``each`` is applied to each trigger's rows first;
    ``progress`` collects Spark's reports of the triggers.
    """
    spark = stream.sparkSession
    run = shared_folder(spark)
    lasting = path is not None
    path, checkpoint = path or f"{run}/out", checkpoint or f"{run}/checkpoint"
    schema = each(spark.createDataFrame([], stream.schema)).schema if each else stream.schema

    def write(rows: DataFrame, number: int) -> None:
        (each(rows) if each else rows).write.mode("overwrite").parquet(f"{path}/triggers/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    until = results.seals(spark, path).agg(F.max("step")).first()[0]
    rest = [c for c in schema.names if c not in keys]
    new = results.read_folder(spark, f"{path}/triggers", T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    if until is not None:
        new = new.filter(F.col("batch") > until).unionByName(results.read_results(spark, path, schema, last_step=True).withColumn("batch", F.lit(until)))
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(1), "batch").alias("r")).select(*keys, *[f"r.{c}" for c in rest])
    if not lasting:
        return last
    top = results.read_folder(spark, f"{path}/triggers", "batch long").agg(F.max("batch")).first()[0]
    if top is not None and (until is None or top > until):
        results.write_step(last, path, top)
    return results.read_results(spark, path, schema, last_step=True)

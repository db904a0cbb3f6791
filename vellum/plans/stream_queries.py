"""Registered streaming queries, run over the tables that are there, and their DuckDB SQL for the final state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import operations, similarity
from vellum.plans.text_queries import REPORT, bench, matches_sql
from vellum.sources import corpus
from vellum.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


PAUSE = 2
PROGRESS = f"""WITH e AS (SELECT user_id AS job_id, event_id AS id, epoch_us(ts) AS t, CASE WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'complete' WHEN event_type = 'purchase' THEN 'stage' WHEN event_type = 'error' THEN 'error' ELSE 'progress' END AS type FROM events),
g AS (SELECT *, lag(type) OVER w AS before, t - lag(t) OVER w AS gap FROM e WINDOW w AS (PARTITION BY job_id ORDER BY t, id)),
r AS (SELECT *, sum(CASE WHEN before IN ('complete', 'error') OR gap > {PAUSE} * 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY t, id) AS run FROM g),
k AS (SELECT *, last_value(CASE WHEN type = 'start' THEN 10 + id % 30 END IGNORE NULLS) OVER (PARTITION BY job_id, run ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS started FROM r),
p AS (SELECT *, CASE type WHEN 'stage' THEN greatest(10, least(80, CASE id % 8 WHEN 0 THEN 1 ELSE id % 8 END * 12)) WHEN 'start' THEN 16 WHEN 'complete' THEN 100
WHEN 'progress' THEN greatest(20, least(90, floor(20 + CASE WHEN id % 3 = 0 THEN (id % 20) / 20 WHEN started IS NULL THEN 0 ELSE (id % 20) / started END * 65 + 0.5))) END AS percent FROM k),
l AS (SELECT job_id, max(run) AS run, arg_max(type, (t, id)) AS type FROM p GROUP BY job_id)
SELECT l.job_id, CAST(arg_max(percent, (t, id)) FILTER (percent IS NOT NULL) AS INT) AS percent, CASE l.type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state
FROM l JOIN p ON p.job_id = l.job_id AND p.run = l.run GROUP BY l.job_id, l.type"""
query("stm1_job_progress", PROGRESS)(lambda s, d: jobs.run_to_table(jobs.job_progress(jobs.progress_events(jobs.event_stream(s, d)), PAUSE), ["job_id"]))
query("stm1_job_progress_table", PROGRESS)(lambda s, d: jobs.job_progress_table(jobs.progress_events(s.read.schema(jobs.EVENTS).parquet(f"{d}/events.parquet")), PAUSE))
query(
    "stm2_log_level_counts",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start_s, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level, count(*) AS n FROM events GROUP BY ALL",
)(
    lambda s, d: jobs.run_to_table(jobs.log_level_counts(jobs.event_stream(s, d).select(operations.log_level(F.col("event_type")).alias("level"), F.col("ts").alias("created_at"))), ["start", "level"]).select(F.unix_timestamp("start").alias("start_s"), "level", "n")
)
DAYS_EACH = 6
STRETCH = f"CAST(floor(epoch(ts) / {DAYS_EACH * 86400}) AS BIGINT)"


@query(
    "stm3_enqueue_once",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id * 100 + event_id % 10 AS job_id, {STRETCH} AS k FROM events), o AS (SELECT DISTINCT k FROM e),
r AS (SELECT job_id, min(k) AS k FROM e GROUP BY job_id
UNION ALL SELECT r.job_id, n.k FROM r, (SELECT e.job_id, e.k, (SELECT max(o.k) FROM o WHERE o.k < e.k) AS earlier FROM e) n
WHERE n.job_id = r.job_id AND n.k > r.k AND r.k * {DAYS_EACH} + 2 <= n.earlier * {DAYS_EACH} - 2
AND NOT EXISTS (SELECT 1 FROM e m WHERE m.job_id = r.job_id AND m.k > r.k AND m.k < n.k AND r.k * {DAYS_EACH} + 2 <= (SELECT max(o.k) FROM o WHERE o.k < m.k) * {DAYS_EACH} - 2))
SELECT job_id, k AS stretch FROM r""",
)
def enqueue(spark, folder):
    """Jobs come in stretches of six days, a trigger each, with a delay of two days: an id is new again once the watermark
    has passed its time by the delay."""
    events = spark.read.schema(jobs.EVENTS).parquet(f"{folder}/events.parquet")
    queued = events.select((F.col("user_id") * 100 + F.col("event_id") % 10).alias("job_id"), F.expr(f"cast(floor(unix_seconds(ts) / {DAYS_EACH * 86400}) as bigint)").alias("stretch"))
    queued = queued.withColumn("queued_at", F.timestamp_seconds(F.col("stretch") * DAYS_EACH * 86400))
    run = corpus.shared_folder(spark)
    out = None
    for (stretch,) in sorted(queued.select("stretch").distinct().collect()):  # a row for each six days
        queued.filter(F.col("stretch") == stretch).write.parquet(f"{run}/in/{stretch}")
        stream = jobs.enqueue_once(spark.readStream.schema(queued.schema).parquet(f"{run}/in/*"), "2 days")
        out = jobs.run_to_table(stream.select("job_id", "stretch"), ["job_id", "stretch"], "append", f"{run}/checkpoint", f"{run}/out")
    return out if out is not None else queued.select("job_id", "stretch")


query(
    "stm4_usage_counters",
    """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), r AS (SELECT user_id, min(t) AS reset FROM e GROUP BY user_id
UNION ALL SELECT r.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = r.user_id AND e.t - r.reset > 5 * 86400000000) FROM r WHERE (SELECT min(e.t) FROM e WHERE e.user_id = r.user_id AND e.t - r.reset > 5 * 86400000000) IS NOT NULL),
l AS (SELECT user_id, max(reset) AS last_reset FROM r GROUP BY user_id)
SELECT l.user_id, count(*) AS used, last_reset FROM l JOIN e ON e.user_id = l.user_id AND e.t >= last_reset GROUP BY l.user_id, last_reset""",
)(lambda s, d: jobs.run_to_table(jobs.usage_counters(jobs.event_stream(s, d).select("user_id", "ts"), 5), ["user_id"]))


# Weights fitted on the sources alone.
FITTED = matches_sql(2, 0.75).replace("x_i AS (SELECT token, ln((1.0 + (SELECT count(*) FROM x_u)) / (1.0 + count(*))) + 1 AS idf FROM x_c GROUP BY token)", "x_i AS (SELECT token, ln((1.0 + (SELECT count(*) FROM benchmark)) / (1.0 + count(*) FILTER (s IS NOT NULL))) + 1 AS idf FROM x_c GROUP BY token)")


@query("stm5_screen_new_documents", FITTED + REPORT.format(0.75))
def screen(spark, folder):
    """Each trigger's documents against the sources. Weights are fitted on the sources, so that a document's result doesn't
    depend on the trigger that it comes with."""
    stream = spark.readStream.schema(corpus.DOCUMENTS).parquet(f"{folder}/documents.parquet*")
    sources = bench(spark, folder)
    return jobs.run_to_table(stream, ["doc_id"], "append", each=lambda rows: similarity.batch_check(rows, sources, fitted=sources))


@query("stm6_restarted_stream", PROGRESS)
def restarted(spark, folder):
    """The progress of jobs in two runs over one checkpoint: files are added between them, and the second stops at its first
    trigger and is started again."""
    events = spark.read.schema(jobs.EVENTS).parquet(f"{folder}/events.parquet")
    run = corpus.shared_folder(spark)
    middle = events.agg(F.timestamp_micros(F.floor((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2)).alias("m")).first().m
    stops = []

    def each(rows: DataFrame) -> DataFrame:
        if stops and not rows.isEmpty():
            raise RuntimeError(stops.pop())
        return rows

    def go() -> DataFrame:
        stream = jobs.progress_events(jobs.event_stream(spark, f"{run}/in", name="*"))
        return jobs.run_to_table(jobs.job_progress(stream, PAUSE), ["job_id"], checkpoint=f"{run}/checkpoint", path=f"{run}/out", each=each)

    early = F.lit(True) if middle is None else F.col("ts") < F.lit(middle)
    events.filter(early).write.parquet(f"{run}/in/a")
    go()
    events.filter(~early).write.parquet(f"{run}/in/b")
    stops.append("a planned stop")
    try:
        go()
    except StreamingQueryException:
        pass
    return go()


LAPSE = 3
query(
    "stm7_subscription_state",
    f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id AS id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'deleted' ELSE 'updated' END AS type, event_id % 2 AS sub, CASE event_id % 3 WHEN 0 THEN 'past_due' ELSE 'active' END AS status FROM events WHERE event_type IN ('purchase', 'click', 'view', 'error')),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, id) AS gap FROM e),
r AS (SELECT *, sum(CASE WHEN gap > {LAPSE} * 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, id) AS run FROM g),
a AS (SELECT r.* FROM r JOIN (SELECT user_id, max(run) AS run FROM r GROUP BY user_id) m ON m.user_id = r.user_id AND m.run = r.run),
c AS (SELECT *, count(*) FILTER (type = 'completed') OVER (PARTITION BY user_id ORDER BY t, id) AS seg FROM a),
s AS (SELECT *, max(CASE WHEN type = 'completed' THEN sub END) OVER (PARTITION BY user_id, seg) AS mine FROM c),
n AS (SELECT *, seg > 0 AND type <> 'completed' AND sub = mine AND coalesce(count(*) FILTER (type = 'deleted' AND sub = mine) OVER (PARTITION BY user_id, seg ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS counts FROM s),
u AS (SELECT user_id, max(seg) AS seg, arg_max(CASE WHEN type = 'deleted' THEN 'inactive' ELSE status END, (t, id)) FILTER (counts) AS status, coalesce(bool_or(type = 'deleted') FILTER (counts), false) AS gone FROM n GROUP BY user_id)
SELECT u.user_id, (SELECT CASE WHEN u.seg = 0 OR bool_or(counts AND type = 'deleted') THEN NULL ELSE concat('sub', max(mine)) END FROM n WHERE n.user_id = u.user_id AND n.seg = u.seg) AS subscription, status, CASE WHEN gone THEN 'free' ELSE 'premium' END AS plan FROM u""",
)(lambda s, d: jobs.run_to_table(jobs.subscription_state(jobs.subscription_events(jobs.event_stream(s, d)), LAPSE), ["user_id"]))

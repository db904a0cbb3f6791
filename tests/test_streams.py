"""Streams with state over several triggers, restarts, and results that are taken up again after a stop."""

import datetime
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vellum.sources import results
from vellum.streaming import jobs

DAY = datetime.datetime(2024, 1, 1)
PROGRESS = "job_id long, ts timestamp, event_id long, type string, stage int, chunk int, total int"


def at(days):
    return DAY + datetime.timedelta(days=days)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Feed:
    """A folder of rows that a stream reads trigger by trigger."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n, self.progress = spark, f"file://{path}", schema, 0, []

    def add(self, values):
        self.spark.createDataFrame(values, self.schema).write.parquet(f"{self.path}/in/{self.n}")
        self.n += 1

    def run(self, job, keys, mode="update", **more):
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/*")
        return jobs.run_to_table(job(stream), keys, mode, f"{self.path}/checkpoint", f"{self.path}/out", progress=self.progress, **more)

    def kept(self):
        """Keys in the state after the last trigger."""
        return sum(o["numRowsTotal"] for o in self.progress[-1]["stateOperators"])


def test_progress_folds_with_carried_state(spark, tmp_path):
    feed = Feed(spark, tmp_path, PROGRESS)
    job = lambda s: jobs.job_progress(s, 10)
    feed.add([(1, at(0), 1, "start", None, None, 40), (2, at(0), 1, "stage", None, None, None), (3, at(0), 1, "progress", None, 5, None)])
    assert rows(feed.run(job, ["job_id"])) == [(1, 16, "running"), (2, 12, "running"), (3, 20, "running")]
    feed.add([(1, at(1), 2, "progress", None, 20, None), (2, at(1), 2, "error", None, None, None)])  # the total is the start's
    assert rows(feed.run(job, ["job_id"])) == [(1, 53, "running"), (2, 12, "failed"), (3, 20, "running")]
    feed.add([(1, at(2), 4, "complete", None, None, None), (1, at(2), 3, "progress", None, 20, 20), (2, at(2), 3, "progress", None, 5, None)])
    assert rows(feed.run(job, ["job_id"])) == [(1, 100, "completed"), (2, 20, "running"), (3, 20, "running")]
    assert feed.kept() == 2  # job 1 has ended
    feed.add([(1, at(3), 5, "error", None, None, None), (4, at(20), 1, "start", None, None, 3)])
    assert rows(feed.run(job, ["job_id"]))[0] == (1, None, "failed")  # a new run, without a percentage yet
    assert feed.kept() == 1  # jobs 2 and 3 have paused for more than ten days
    feed.add([(3, at(21), 9, "progress", None, 10, None)])
    assert rows(feed.run(job, ["job_id"]))[2] == (3, 20, "running")


def random_progress(n):
    rnd = random.Random(2)
    kinds = ["start", "stage", "progress", "progress", "complete", "error", "other"]
    out = []
    for i in range(n):
        kind = rnd.choice(kinds)
        out.append((rnd.randrange(9), at(rnd.random() * 40), i, kind, rnd.choice([None, 0, 3, 9]), rnd.choice([None, 0, 7, 60]), rnd.choice([None, None, 0, 30])))
    return out


@pytest.mark.parametrize("triggers", [1, 4])
def test_progress_in_triggers_equals_the_table(spark, tmp_path, triggers):
    events = random_progress(300)
    feed, out = Feed(spark, tmp_path, PROGRESS), None
    for k in range(triggers):
        feed.add([e for e in events if int((e[1] - DAY).total_seconds() / 86_400 / 40 * triggers) == k])
        out = feed.run(lambda s: jobs.job_progress(s, 3), ["job_id"])
    assert rows(out) == rows(jobs.job_progress_table(spark.createDataFrame(events, PROGRESS), 3))


def test_progress_table_of_odd_rows(spark):
    odd = [(None, at(0), 1, "progress", None, 1, 2), (1, None, 1, "start", None, None, 3), (2, at(0), None, None, None, None, None), (2, at(0), 2, "progress", None, None, 0), (2, at(0), 2, "progress", None, None, 0)]
    assert rows(jobs.job_progress_table(spark.createDataFrame(odd, PROGRESS))) == [(2, 20, "running"), (None, 53, "running")]
    assert rows(jobs.job_progress_table(spark.createDataFrame([], PROGRESS))) == []


def test_queue_forgets_ids_after_the_delay(spark, tmp_path):
    feed = Feed(spark, tmp_path, "job_id long, queued_at timestamp")
    job = lambda s: jobs.enqueue_once(s, "2 days").select("job_id", "queued_at")
    for day, ids in ((0, [1, 2, 1]), (1, [1]), (4, [3]), (5, [1]), (9, [2, 3])):
        feed.add([(i, at(day)) for i in ids])
        out = feed.run(job, ["job_id", "queued_at"], "append")
    assert rows(out) == [(1, at(0)), (1, at(5)), (2, at(0)), (2, at(9)), (3, at(4))]
    assert feed.kept() == 1  # 3 was still known on day 9, as the watermark then was day 3


def test_counters_forget_users_whose_period_is_over(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp")
    job = lambda s: jobs.usage_counters(s, 5)
    us = lambda d: int((at(d) - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)
    feed.add([(1, at(0)), (1, at(5)), (2, at(4))])
    assert rows(feed.run(job, ["user_id"])) == [(1, 2, us(0)), (2, 1, us(4))]
    feed.add([(3, at(8))])
    feed.run(job, ["user_id"])
    assert feed.kept() == 2  # user 1's next upload would start again
    feed.add([(1, at(9)), (2, at(9))])
    assert rows(feed.run(job, ["user_id"])) == [(1, 1, us(9)), (2, 2, us(4)), (3, 1, us(8))]


def test_subscriptions_count_their_own_events_and_lapse(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp, event_id long, type string, subscription string, status string")
    job = lambda s: jobs.subscription_state(s, 30)
    feed.add([(1, at(0), 1, "completed", "a", None), (1, at(1), 2, "updated", "b", "past_due"), (1, at(1), 3, "updated", "a", "active"), (2, at(0), 1, "deleted", "a", None), (3, at(0), 1, "other", "a", None)])
    assert rows(feed.run(job, ["user_id"])) == [(1, "a", "active", "premium"), (2, None, None, "premium")]
    feed.add([(1, at(2), 4, "deleted", "b", None), (1, at(3), 5, "deleted", "a", None), (1, at(4), 6, "updated", "a", "active")])
    assert rows(feed.run(job, ["user_id"]))[0] == (1, None, "inactive", "free")
    feed.add([(4, at(60), 1, "completed", "x", None)])
    feed.run(job, ["user_id"])
    assert feed.kept() == 1
    feed.add([(1, at(61), 7, "completed", "c", None)])
    assert rows(feed.run(job, ["user_id"]))[0] == (1, "c", None, "premium")


def test_failed_trigger_runs_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp")
    job = lambda s: jobs.usage_counters(s, 5)
    feed.add([(1, at(0))])
    feed.run(job, ["user_id"])
    feed.add([(1, at(1)), (2, at(1))])
    stops = ["once"]

    def each(df):
        if stops and not df.isEmpty():
            raise RuntimeError(stops.pop())
        return df

    with pytest.raises(StreamingQueryException):
        feed.run(job, ["user_id"], each=each)
    assert [(r[0], r[1]) for r in rows(feed.run(job, ["user_id"], each=each))] == [(1, 2), (2, 1)]
    assert results.seals(spark, f"{feed.path}/out").count() == 2


# Results taken up again

DOCS = "doc_id long, text string"


def squared(df):
    return df.select("doc_id", (F.col("doc_id") * F.col("doc_id")).alias("square"))


def test_results_are_taken_up_after_a_failure(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([*[(i, "x") for i in range(60)], (7, "x"), (None, "x"), (None, "y")], DOCS)
    assert results.resume_results(df, path, ["doc_id"], squared, steps=6, most_steps=2) == 2
    first = set(rows(results.read_results(spark, path, "doc_id long, square long")))
    assert 0 < len(first) < 60
    broken = lambda d: squared(d).withColumn("square", F.when(F.col("doc_id") % 5 == 0, F.raise_error(F.lit("no"))).otherwise(F.col("square")))
    with pytest.raises(Exception, match="no"):
        results.resume_results(df, path, ["doc_id"], broken, steps=6)
    assert first <= set(rows(results.read_results(spark, path, "doc_id long, square long")))
    seen = []

    def noted(d):
        seen.extend(r.doc_id for r in d.select("doc_id").collect())
        return squared(d)

    results.resume_results(df, path, ["doc_id"], noted, steps=3)
    assert not {r[0] for r in first} & set(seen)
    want = sorted([*[(i, i * i) for i in range(60)], (7, 49), (None, None), (None, None)], key=repr)
    assert rows(results.read_results(spark, path, "doc_id long, square long")) == want
    assert results.resume_results(df, path, ["doc_id"], squared) == 0
    more = df.union(spark.createDataFrame([(100, "new")], DOCS))
    assert results.resume_results(more, path, ["doc_id"], squared) == 1
    assert results.seals(spark, path).agg(F.sum("n_units")).first()[0] == 62


def test_rows_without_a_seal_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "x"), (2, "y")], DOCS)
    df.write.json(f"{path}/rows/attempt=lost/step=0")  # a run that stopped before its seal
    df.select("doc_id").write.parquet(f"{path}/units/attempt=lost/step=0")
    assert rows(results.read_results(spark, path, DOCS, "json")) == []
    results.resume_results(df, path, ["doc_id"], lambda d: d, "json", steps=1)
    assert rows(results.read_results(spark, path, DOCS, "json")) == [(1, "x"), (2, "y")]
    assert rows(results.read_results(spark, f"{path}/nothing", DOCS)) == []
    assert results.resume_results(df.limit(0), f"{path}/nothing", ["doc_id"], lambda d: d) == 0


def test_units_without_results_are_finished_and_content_can_be_a_unit(spark, tmp_path):
    path, calls = f"file://{tmp_path}", []
    make = lambda d: (calls.append(1), d.filter("false"))[1]
    df = spark.createDataFrame([(1, "x")], DOCS).withColumn("hash", F.md5("text"))
    assert [results.resume_results(df, path, ["doc_id", "hash"], make) for _ in range(2)] == [1, 0] and len(calls) == 1
    changed = df.withColumn("text", F.lit("z")).withColumn("hash", F.md5("text"))
    assert results.resume_results(changed, path, ["doc_id", "hash"], lambda d: d) == 1


def test_files_as_units_are_opened_once(spark, tmp_path):
    source, path = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(80).repartition(8).write.parquet(source)
    read = lambda: spark.read.parquet(source).withColumn("file", F.col("_metadata.file_path"))
    files = []

    def scanned(node):
        own = node.metrics().apply("numFiles").value() if node.nodeName().startswith("Scan parquet") else 0
        return own + sum(scanned(node.children().apply(i)) for i in range(node.children().size()))

    part = read().filter(F.pmod(F.xxhash64("file"), F.lit(4)) == 1)._jdf.queryExecution().executedPlan()
    part.execute().count()
    assert scanned(part) < 8

    def noted(d):
        files.extend(r.file for r in d.select("file").distinct().collect())
        return d.select("id")

    results.resume_results(read(), path, ["file"], noted, steps=4, most_steps=2)
    spark.range(80, 90).coalesce(1).write.mode("append").parquet(source)
    results.resume_results(read(), path, ["file"], noted, steps=4)
    assert sorted(r.id for r in results.read_results(spark, path, "id long").collect()) == list(range(90))
    assert len(files) == len(set(files)) == 9

"""Reports over users, documents, projects, jobs and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.lexicons import PLANS
from vellum.functions.text import ranked, words

LARGE_WORDS = 12_000
LARGE_BLOCKS = 250


def overview_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n for each table."""
    rows = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def recent_with_owner(df: DataFrame, users: DataFrame, newest: list[Column], owner: str, key: str, k: int = 10) -> DataFrame:
    """The k newest rows with their owners' columns; a missing owner stays null."""
    return df.orderBy(*newest).limit(k).join(users, F.col(owner) == F.col(key), "left")


def documents_per_user(users: DataFrame, docs: DataFrame, key: str, owner: str) -> DataFrame:
    """Users' columns and n_documents, 0 where there are none."""
    counts = docs.groupBy(F.col(owner).alias(key)).agg(F.count(F.lit(1)).alias("n_documents"))
    return users.join(counts, key, "left").na.fill(0, ["n_documents"])


def list_documents(df: DataFrame, where: Column, newest: list[Column], page: int, limit: int) -> DataFrame:
    """One page of the matching rows, newest first, with n_total and n_pages."""
    df = df.filter(where)
    total = df.count()
    return df.orderBy(*newest).offset((page - 1) * limit).limit(limit).select("*", F.lit(total).cast("long").alias("n_total"), F.lit(-(-total // limit)).cast("long").alias("n_pages"))


def status_counts(df: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """by, total and n_<value> for each status, from one scan."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values])


def log_level(event_type: Column) -> Column:
    return F.when(event_type == "error", "error").when(event_type == "signup", "warning").otherwise("info")


def log_page(logs: DataFrame, users: DataFrame, level: str | None = None, k: int = 200) -> DataFrame:
    """log_id, level, user_id, name of the newest logs, of one level or of all."""
    logs = logs if level is None else logs.filter(F.col("level") == level)
    return logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(k).join(users, "user_id", "left").select("log_id", "level", "user_id", "name")


def log_stats(logs: DataFrame) -> DataFrame:
    """Totals of each level over all logs, in one row."""
    return logs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("info", "warning", "error")])


def projects_with_documents(projects: DataFrame, docs: DataFrame, key: str, order: str, shown: Column) -> DataFrame:
    """Projects' columns with documents: their list, in order, as text."""
    lists = docs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("s")))).alias("l"))
    lists = lists.select(key, F.array_join(F.transform("l", lambda x: x["s"]), ";").alias("documents"))
    return projects.join(lists, key, "left").na.fill("", ["documents"])


def search(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows in which a column has the text, in any case; blank text keeps all."""
    wanted = text.strip().lower()
    return df if not wanted else df.filter(reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(wanted) for c in columns]))


def active_job_per_document(jobs: DataFrame) -> DataFrame:
    """The newest queued or running job of each user and document."""
    return ranked(jobs.filter(F.col("status").isin("queued", "running")), ["user_id", "doc_id"], [F.desc("queued_at"), F.desc("job_id")], "_place").filter("_place = 1").drop("_place")


def cache_key(**parts: Column) -> Column:
    """SHA-256 of a JSON object of the parts, sorted by name; a null is a value, so that it differs from a missing part."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def reusable_results(jobs: DataFrame) -> DataFrame:
    """job_id, reused_id: the latest other completed job of the same document, style and content, null where there is none.

    ``jobs`` has job_id, document, style, content, status and completed_at. The latest is by time of completion, then by
    job_id; jobs that are queued, running, failed or have no time of completion are never reused, but may reuse. Two
    aggregates give the latest and the one before it, so a key with a third of all jobs needs no list.
    """
    keyed = jobs.select("job_id", cache_key(document=F.col("document"), style=F.col("style"), content=F.col("content")).alias("key"), F.when(F.col("status") == "completed", F.col("completed_at")).alias("done"))
    rank = F.struct("done", "job_id")
    done = keyed.filter("done is not null")
    latest = done.groupBy("key").agg(F.max(rank).alias("latest"))
    before = done.join(latest, "key").filter(rank < F.col("latest")).groupBy("key").agg(F.max(rank).alias("before"))
    known = keyed.join(latest, "key", "left").join(before, "key", "left")
    return known.select("job_id", F.when(F.col("job_id") == F.col("latest.job_id"), F.col("before.job_id")).otherwise(F.col("latest.job_id")).alias("reused_id"))


def job_timings(jobs: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """stage, n, mean_ms, median_ms, retries of all jobs' stages and of the wait in the queue (stage ``queue``).

    ``jobs`` has queued_at, started_at, attempts and stage_timings, an array of structs (name, elapsed_ms). A job waits until it
    is started; one that isn't yet has no wait. retries are the attempts beyond the first, of all jobs, in the row of the
    queue. The median is a value whose rank is right within n / ``accuracy``, from sketches that merge, so no stage's values
    are gathered.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    wait = (micros("started_at") - micros("queued_at")) / 1000
    stages = jobs.select(F.explode("stage_timings").alias("t")).select(F.col("t.name").alias("stage"), F.col("t.elapsed_ms").cast("double").alias("ms"), F.lit(None).cast("long").alias("retries"))
    queue = jobs.select(F.lit("queue").alias("stage"), wait.alias("ms"), F.greatest(F.coalesce("attempts", F.lit(0)) - 1, F.lit(0)).cast("long").alias("retries"))
    return stages.unionByName(queue).groupBy("stage").agg(F.count("ms").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.percentile_approx("ms", 0.5, accuracy).alias("median_ms"), F.sum("retries").alias("retries"))


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, documents_per_month int, plagiarism_checks int, storage_limit long, features array<string>")


def usage_vs_limits(users: DataFrame, plans: DataFrame) -> DataFrame:
    """user_id, plan, used, documents_per_month, percent (of at least 1, at most 100); without a limit it is 100 once anything is used."""
    share = F.floor(F.col("used") / F.greatest(F.col("documents_per_month"), F.lit(1)) * 100 + 0.5)
    return users.join(plans.select("plan", "documents_per_month"), "plan").select("user_id", "plan", "used", "documents_per_month", F.least(F.lit(100).cast("long"), share).alias("percent"))


#: What each limit of a plan is about.
LIMITS = {"documents": "documents_per_month", "plagiarism_checks": "plagiarism_checks", "storage": "storage_limit"}


def usage_of_all_limits(users: DataFrame, plans: DataFrame) -> DataFrame:
    """user_id, plan, resource, used, allowed (-1: no limit), percent (of at least 1, at most 100), within: a row for each user
    and each of documents, plagiarism checks and storage. ``users`` has a column of each name; null is none."""
    of = lambda name: F.struct(F.lit(name).alias("resource"), F.coalesce(F.col(name).cast("long"), F.lit(0)).alias("used"), F.col(f"_{name}").cast("long").alias("allowed"))
    limits = plans.select("plan", *[F.col(c).alias(f"_{name}") for name, c in LIMITS.items()])
    rows = users.join(limits, "plan").select("user_id", "plan", F.explode(F.array(*map(of, LIMITS))).alias("r")).select("user_id", "plan", "r.*")
    share = F.floor(F.col("used") / F.greatest(F.col("allowed"), F.lit(1)) * 100 + 0.5)
    return rows.select("*", F.least(F.lit(100).cast("long"), share).alias("percent"), ((F.col("allowed") < 0) | (F.col("used") <= F.col("allowed"))).alias("within"))


def monthly_usage_reset(users: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """user_id, used, reset: the counter is zero if the last reset is more than ``days`` days ago."""
    due = F.unix_timestamp(now) - F.unix_timestamp("last_reset") > days * 86_400
    return users.select("user_id", F.when(due, 0).otherwise(F.col("used")).alias("used"), due.alias("reset"))


def feature_access(users: DataFrame, plans: DataFrame, feature: str) -> DataFrame:
    """Users whose plan has the feature."""
    return users.join(plans.filter(F.array_contains("features", feature)).select("plan"), "plan", "left_semi")


def cascade_delete(docs: DataFrame, children: DataFrame, deleted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents and their child rows without the deleted ones."""
    return docs.join(deleted, key, "left_anti"), children.join(deleted, key, "left_anti")


def detach_projects(docs: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Documents' columns after projects were deleted: every document stays, its reference ``key`` to a deleted project is null."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def storage_after_delete(users: DataFrame, removed: DataFrame) -> DataFrame:
    """user_id, storage less what was removed, at least 0."""
    sums = removed.groupBy("user_id").agg(F.sum("size").alias("gone"))
    return users.join(sums, "user_id", "left").select("user_id", F.greatest(F.lit(0).cast("long"), F.col("storage") - F.coalesce("gone", F.lit(0))).alias("storage"))


def route_large_documents(docs: DataFrame, forced: Column | None = None) -> DataFrame:
    """route (large, standard), n_docs, n_words: large from 12,000 words or 250 lines, or if forced."""
    n_words, n_blocks = F.size(words(F.col("text"))), F.size(F.split("text", "\n"))
    large = (n_words >= LARGE_WORDS) | (n_blocks >= LARGE_BLOCKS)
    large = large if forced is None else large | forced
    return docs.select(F.when(large, "large").otherwise("standard").alias("route"), n_words.alias("w")).groupBy("route").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"))


def storage_and_word_rollup(docs: DataFrame) -> DataFrame:
    """source, lang, n_docs, n_words, n_bytes with subtotals (nulls) by source and over all."""
    rows = docs.select("source", "lang", F.size(words(F.col("text"))).alias("w"), F.octet_length("text").alias("b"))
    return rows.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.sum("b").alias("n_bytes"))

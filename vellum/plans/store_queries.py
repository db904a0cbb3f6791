"""Registered queries of the operational reports and their DuckDB SQL.

Users are customers, documents are orders, child rows are line items, logs and jobs are events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import operations as ops
from vellum.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def owners(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_name")


LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END"
STATUS = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
PLAN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'premium' WHEN 'MACHINERY' THEN 'team' ELSE 'free' END"


def newest(*columns: str) -> list[Column]:
    return [F.desc(c) for c in columns]


def logs(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("log_id"), ops.log_level(F.col("event_type")).alias("level"), "user_id", F.col("ts").alias("created_at"))


def named(spark, folder) -> DataFrame:
    return owners(spark, folder).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


def jobs(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("job_id"), "user_id", (F.col("event_id") % 5).alias("doc_id"), F.expr(STATUS).alias("status"), F.col("ts").alias("queued_at"))


def users(spark, folder) -> DataFrame:
    """user_id, plan, used: orders of each customer."""
    counted = ops.documents_per_user(table(spark, folder, "customer"), table(spark, folder, "orders"), "c_custkey", "o_custkey")
    return counted.select(F.col("c_custkey").alias("user_id"), F.expr(PLAN).alias("plan"), F.col("n_documents").alias("used"))


USERS = f"SELECT c_custkey AS user_id, {PLAN} AS plan, count(o_orderkey) AS used FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment"
COUNTED = ("documents", "orders", "customer", "lineitem", "events")
query("ops1_overview_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in COUNTED))(lambda s, d: ops.overview_counts({t: table(s, d, t) for t in COUNTED}))
query("ops2_recent_with_owner", "SELECT o_orderkey, o_orderstatus, c_custkey, c_name FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10) LEFT JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: ops.recent_with_owner(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate"), owners(s, d), newest("o_orderdate", "o_orderkey"), "o_custkey", "c_custkey").select("o_orderkey", "o_orderstatus", "c_custkey", "c_name")
)
query("ops3_documents_per_user", "SELECT c_custkey, c_name, count(o_orderkey) AS n_documents FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")(
    lambda s, d: ops.documents_per_user(owners(s, d), table(s, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name", "n_documents")
)
query(
    "ops4_list_documents",
    "WITH m AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM m) AS n_total, CAST((SELECT ceil(count(*) / 20) FROM m) AS BIGINT) AS n_pages FROM m ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20",
)(lambda s, d: ops.list_documents(table(s, d, "orders"), F.expr("o_orderstatus = 'O'"), newest("o_orderdate", "o_orderkey"), 2, 20).select("o_orderkey", "o_custkey", "o_totalprice", "n_total", "n_pages"))
query("ops5_status_counts", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p FROM orders GROUP BY o_orderpriority")(
    lambda s, d: ops.status_counts(table(s, d, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])
)
query("ops6_log_page", f"SELECT event_id AS log_id, level, user_id, c_name AS name FROM (SELECT *, {LEVEL} AS level FROM events WHERE {LEVEL} = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200) LEFT JOIN customer ON user_id = c_custkey")(
    lambda s, d: ops.log_page(logs(s, d), named(s, d), "error")
)
query("ops6_log_stats", f"SELECT count(*) AS total, count(*) FILTER ({LEVEL} = 'info') AS n_info, count(*) FILTER ({LEVEL} = 'warning') AS n_warning, count(*) FILTER ({LEVEL} = 'error') AS n_error FROM events")(lambda s, d: ops.log_stats(logs(s, d)))
query("ops7_projects_with_documents", "SELECT o_orderkey, o_orderstatus, coalesce(documents, '') AS documents FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(concat(l_linenumber, ':', l_returnflag), ';' ORDER BY l_linenumber, concat(l_linenumber, ':', l_returnflag)) AS documents FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")(
    lambda s, d: ops.projects_with_documents(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), table(s, d, "lineitem"), "l_orderkey", "l_linenumber", F.concat_ws(":", "l_linenumber", "l_returnflag")).withColumnRenamed("l_orderkey", "o_orderkey")
)
query("ops8_search", "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(coalesce(p_name, '')), 'steel') OR contains(lower(coalesce(p_type, '')), 'steel')")(lambda s, d: ops.search(table(s, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], " Steel "))
query("ops9_active_job_per_document", f"SELECT job_id, user_id, doc_id, status FROM (SELECT event_id AS job_id, user_id, event_id % 5 AS doc_id, {STATUS} AS status, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE {STATUS} IN ('queued', 'running')) WHERE k = 1")(
    lambda s, d: ops.active_job_per_document(jobs(s, d)).select("job_id", "user_id", "doc_id", "status")
)
query(
    "ops10_reusable_results",
    f"""WITH j AS (SELECT event_id AS job_id, sha256(concat('{{"content":"', md5(props[1:7]), '","document":', user_id, ',"style":"', CASE event_id % 2 WHEN 0 THEN 'APA' ELSE 'IEEE' END, '"}}')) AS k, CASE WHEN {STATUS} = 'completed' THEN ts END AS done FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY done DESC, job_id DESC) AS n FROM j WHERE done IS NOT NULL)
SELECT j.job_id, CASE WHEN j.job_id = a.job_id THEN b.job_id ELSE a.job_id END AS reused_id FROM j LEFT JOIN d a ON a.k = j.k AND a.n = 1 LEFT JOIN d b ON b.k = j.k AND b.n = 2""",
)(
    lambda s, d: ops.reusable_results(
        table(s, d, "events").select(
            F.col("event_id").alias("job_id"), F.col("user_id").alias("document"), F.when(F.col("event_id") % 2 == 0, "APA").otherwise("IEEE").alias("style"),
            F.md5(F.substring("props", 1, 7)).alias("content"), F.expr(STATUS).alias("status"), F.col("ts").alias("completed_at"),
        )
    )
)


@query(
    "ops11_job_timings",
    """WITH l AS (SELECT l_orderkey, min(l_shipdate) AS started_at, count(*) AS attempts FROM lineitem GROUP BY l_orderkey),
t AS (SELECT l_returnflag AS stage, l_quantity * 1000 AS ms, NULL AS retries FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT 'queue', (epoch_us(started_at) - epoch_us(o_orderdate)) / 1000, greatest(coalesce(attempts, 0) - 1, 0) FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT stage, count(ms) AS n, round(avg(ms), 3) AS mean_ms, quantile_disc(ms, 0.5) AS median_ms, CAST(sum(retries) AS BIGINT) AS retries FROM t GROUP BY stage""",
)
def timings(spark, folder):
    """Orders are jobs, queued at their date and started with the first shipment; lines are their stages and attempts."""
    stage = F.struct(F.col("l_returnflag").alias("name"), (F.col("l_quantity") * 1000).alias("elapsed_ms"))
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("started_at"), F.count(F.lit(1)).alias("attempts"), F.collect_list(stage).alias("stage_timings"))
    return ops.job_timings(table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias("queued_at")).join(lines, "o_orderkey", "left"))


query("ops12_usage_vs_limits", f"WITH u AS ({USERS}), p AS (SELECT *, CASE plan WHEN 'free' THEN 5 ELSE -1 END AS documents_per_month FROM u) SELECT *, CAST(least(100, floor(used / greatest(documents_per_month, 1) * 100 + 0.5)) AS BIGINT) AS percent FROM p")(
    lambda s, d: ops.usage_vs_limits(users(s, d), ops.plans(s))
)


LIMITS = "SELECT * FROM (VALUES ('free', 5, 0, 104857600), ('premium', -1, 10, 10737418240), ('team', -1, -1, 107374182400)) p(plan, d, c, b)"
query(
    "ops12_all_limits",
    f"""WITH u AS (SELECT c_custkey AS user_id, {PLAN} AS plan, count(o_orderkey) AS d, count(*) FILTER (o_orderstatus = 'F') AS c, coalesce(sum(CAST(floor(o_totalprice) AS BIGINT) * 100), 0) AS b FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment), p AS ({LIMITS}),
r AS (SELECT user_id, u.plan, 'documents' AS resource, u.d AS used, p.d AS allowed FROM u JOIN p ON u.plan = p.plan UNION ALL SELECT user_id, u.plan, 'plagiarism_checks', u.c, p.c FROM u JOIN p ON u.plan = p.plan UNION ALL SELECT user_id, u.plan, 'storage', u.b, p.b FROM u JOIN p ON u.plan = p.plan)
SELECT user_id, plan, resource, CAST(used AS BIGINT) AS used, CAST(allowed AS BIGINT) AS allowed, CAST(least(100, floor(used / greatest(allowed, 1) * 100 + 0.5)) AS BIGINT) AS percent, allowed < 0 OR used <= allowed AS within FROM r""",
)(
    lambda s, d: ops.usage_of_all_limits(
        table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.expr(PLAN).alias("plan")).join(
            table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("o_orderstatus") == "F").alias("plagiarism_checks"), F.sum(F.floor("o_totalprice") * 100).alias("storage")), "user_id", "left"),
        ops.plans(s),
    )
)


@query(
    "ops13_monthly_usage_reset",
    """WITH n AS (SELECT max(ts) AS now FROM events), u AS (SELECT user_id, count(*) AS used, CASE WHEN user_id % 3 = 0 THEN max(ts) - INTERVAL 31 DAY WHEN user_id % 3 = 1 THEN (SELECT now FROM n) - INTERVAL 30 DAY ELSE max(ts) END AS last_reset FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN floor(epoch(now)) - floor(epoch(last_reset)) > 30 * 86400 THEN 0 ELSE used END AS used, floor(epoch(now)) - floor(epoch(last_reset)) > 30 * 86400 AS reset FROM u, n""",
)
def monthly_reset(spark, folder):
    events = table(spark, folder, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    last = F.when(F.col("user_id") % 3 == 0, F.max("ts") - F.expr("INTERVAL 31 DAY")).when(F.col("user_id") % 3 == 1, now - F.expr("INTERVAL 30 DAY")).otherwise(F.max("ts"))
    return ops.monthly_usage_reset(events.groupBy("user_id").agg(F.count(F.lit(1)).alias("used"), last.alias("last_reset")), now)


query("ops14_feature_access", f"SELECT user_id, plan FROM ({USERS}) WHERE plan IN ('premium', 'team')")(lambda s, d: ops.feature_access(users(s, d).select("user_id", "plan"), ops.plans(s), "plagiarism_check"))

GONE = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 0 AND o_orderstatus = 'F')"


def deletion(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    deleted = orders.filter("o_custkey % 10 = 0 AND o_orderstatus = 'F'").select("o_orderkey")
    return orders, lines.withColumnRenamed("l_orderkey", "o_orderkey"), deleted


query("ops15_cascade_delete", f"SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {GONE}) GROUP BY l_orderkey")(
    lambda s, d: ops.cascade_delete(*deletion(s, d), "o_orderkey")[1].groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
)
query("ops15_project_delete", f"SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, CASE WHEN l_orderkey IN (SELECT o_orderkey FROM {GONE}) THEN NULL ELSE l_orderkey END AS o_orderkey FROM lineitem")(
    lambda s, d: (lambda orders, lines, deleted: ops.detach_projects(lines.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "o_orderkey"), deleted, "o_orderkey"))(*deletion(s, d))
)
query(
    "ops15_storage_after_delete",
    f"WITH g AS (SELECT o_custkey, count(*) * 100 AS gone FROM {GONE} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_custkey AS user_id, greatest(0, CAST(floor(c_acctbal) AS BIGINT) - coalesce(gone, 0)) AS storage FROM customer LEFT JOIN g ON c_custkey = o_custkey",
)(
    lambda s, d: (lambda orders, lines, deleted: ops.storage_after_delete(
        table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.floor("c_acctbal").alias("storage")),
        lines.join(deleted, "o_orderkey", "left_semi").join(orders.select("o_orderkey", F.col("o_custkey").alias("user_id")), "o_orderkey").select("user_id", F.lit(100).cast("long").alias("size")),
    ))(*deletion(s, d))
)

WORD_COUNT = r"len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))"
query("ops16_route_large_documents", f"SELECT CASE WHEN {WORD_COUNT} >= 12000 OR len(string_split(text, chr(10))) >= 250 THEN 'large' ELSE 'standard' END AS route, count(*) AS n_docs, CAST(sum({WORD_COUNT}) AS BIGINT) AS n_words FROM documents WHERE trim(text) <> '' GROUP BY 1")(
    lambda s, d: ops.route_large_documents(corpus.load_corpus(s, d))
)
query("ops17_storage_and_word_rollup", f"SELECT source, lang, count(*) AS n_docs, CAST(sum({WORD_COUNT}) AS BIGINT) AS n_words, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents WHERE trim(text) <> '' GROUP BY ROLLUP (source, lang)")(
    lambda s, d: ops.storage_and_word_rollup(corpus.load_corpus(s, d))
)

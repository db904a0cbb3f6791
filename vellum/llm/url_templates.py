"""URL filters: host and path rules first, then path-template trees judged by labelled purity.

Variable segments of a path (numbers, hexadecimal, segments with digits, very long ones) become
wildcards. The templates of a host form a tree. From the root down, branches whose shares of good
labels don't differ significantly from those of their siblings merge into one wildcard (``*``), and so
do those that lie significantly above (``*+``); a branch that lies significantly below stays. The labels
that then fall on a template give its purity, smoothed towards the share over all labels, and templates
of low purity are rejected.

Pages are first counted by host and generalised path, so that a host with a third of all pages is a
few rows in the tree. Everything here is built-in column expressions.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise

SMOOTHING = 4.0
LEAST_PURITY = 0.5
DIFFERENT_Z = 2.5
#: (host, path prefix, verdict)
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of variable segments and their wildcards, the first that fits counts.
WILDCARDS = ((r"^[0-9]+$", "{number}"), (r"^[0-9]+(\.[A-Za-z0-9]+)$", "{number}$1"), (r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$", "{hex}"), (r"^(?=.*[0-9]).*$", "{mixed}"), (r"^.{40,}$", "{long}"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, f"{h}{p}").otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def generalise(path: Column) -> Column:
    """All segments, with variable ones as wildcards."""

    def one(segment: Column) -> Column:
        out = segment
        for pattern, wildcard in reversed(WILDCARDS):
            out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, wildcard)).otherwise(out)
        return out

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), one)


def template_purity(counted: DataFrame, smoothing: float = SMOOTHING, different: float = DIFFERENT_Z) -> DataFrame:
    """(host, segments, template, purity) from rows of (host, segments, labelled, good).

    The tree goes on as long as two labelled paths of one branch have a further segment. Below that no branch
    has a labelled sibling to differ from, so that all remaining segments are ``*``.
    """
    total = counted.agg(F.sum("labelled").alias("m"), F.sum("good").alias("g")).first()
    prior = (total.g or 0) / total.m if total.m else 1.0
    rows = counted.withColumn("prefix", F.lit(""))
    for level in count():
        further = rows.filter((F.size("segments") > level) & (F.col("labelled") > 0))
        if not further.groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("paths")).filter("paths > 1").head(1):
            break
        seg = F.get("segments", F.lit(level))
        rows = rows.withColumn("seg", seg)
        nodes = rows.filter("seg is not null").groupBy("host", "prefix", "seg").agg(F.sum("labelled").alias("m"), F.sum("good").alias("g"))
        parents = nodes.groupBy("host", "prefix").agg(F.sum("m").alias("pm"), F.sum("g").alias("pg"))
        p = (F.col("pg") - F.col("g") + smoothing * prior) / (F.col("pm") - F.col("m") + smoothing)
        z = (F.col("g") - F.col("m") * p) / F.sqrt(F.col("m") * p * (1 - p) + 1e-9)
        kept = nodes.join(parents, ["host", "prefix"]).filter((F.col("m") > 0) & (F.col("pm") > F.col("m")) & (F.abs(z) > different)).select("host", "prefix", "seg", F.when(z > 0, "*+").otherwise(F.col("seg")).alias("own"))
        rows = rows.join(kept, ["host", "prefix", "seg"], "left")
        step = F.when(F.col("seg").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.lit("/"), F.coalesce("own", F.lit("*"))))
        rows = materialise(rows.select("host", "segments", "labelled", "good", step.alias("prefix")), "templates")
    rows = rows.withColumn("prefix", F.concat("prefix", F.repeat(F.lit("/*"), F.size("segments") - level)))
    purity = rows.groupBy("host", "prefix").agg(((F.sum("good") + smoothing * prior) / (F.sum("labelled") + smoothing)).alias("purity"))
    return rows.join(purity, ["host", "prefix"]).select("host", "segments", F.concat("host", "prefix").alias("template"), "purity")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], least_purity: float = LEAST_PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row of ``pages``.

    ``labels`` has (page_id, good boolean); a page with several labels counts each, null labels and ids don't
    count. Without labels every template is as pure as the whole and is allowed. Rows repeat as in ``pages``.
    """
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("segments", generalise(F.col("path")))
    marks = labels.filter("page_id is not null and good is not null").groupBy("page_id").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("good").alias("good"))
    counted = pages.join(marks, "page_id", "left").groupBy("host", "segments").agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    known = template_purity(materialise(counted, "counted"))
    rule, ruled = apply_rules(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return pages.join(known, ["host", "segments"], "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "template", "purity")


#: The rules that the contract fixes.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def report(pages: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return judge(pages.select("page_id", "url"), marks, RULES)

"""URL filters by a sort-merge range join.

A host is written with its labels reversed (``www.example.com`` is
``com.example.www.``). A rule's key then is a prefix of the keys of all hosts it
covers, that is an interval of the sorted keys, and intervals of prefixes nest. The
sweep goes through keys and rule starts in order and keeps the stack of rules that
are open: the last rule that started, and those around it. A key takes from that
stack what has not ended before it.

Two sweeps give the verdict: over distinct hosts for the rule hosts around each, then
over distinct (rule host, path) for the rules whose path fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.scratch import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between the host and the path of a key. No host holds it.
_SLASH = "/"


def url_host(url: Column) -> Column:
    """Lower-cased host; empty without ``://``."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def prefix_sweep(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule keys that are prefixes of each distinct item key.

    ``items`` and ``rules`` have a column ``key``. Returns ``key`` and ``open``, the
    stack, shortest rule first and empty if none fits.

    Keys are distinct before they are dealt out by range, so no key makes a task
    large. Each task starts with the stack that the tasks before it leave, found from
    their last rules: one row for each task.
    """
    rule_keys = rules.select("key").where("key != ''").distinct()
    prefixes = rule_keys.select(
        "key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substr("key", F.lit(1), n)))
    ).toDF("key", "around")
    stacks = (
        prefixes.join(rule_keys.select(F.col("key").alias("around")), "around")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("around")).alias("stack"))
    )
    item_keys = items.select("key").distinct()
    events = item_keys.select("key", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack"))
    events = events.unionByName(stacks.select("key", F.lit(0).alias("kind"), "stack"))
    dealt = materialize(events.repartitionByRange("key").withColumn("task", F.spark_partition_id()), "sweep")
    left = dealt.groupBy("task").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carried = left.select("task", F.last("left", ignorenulls=True).over(earlier).alias("carried"))
    upto = Window.partitionBy("task").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("last", F.last("stack", ignorenulls=True).over(upto)).where("kind = 1")
    stack = F.coalesce("last", "carried", F.array().cast("array<string>"))
    return (
        swept.join(carried, "task")
        .select("key", stack.alias("stack"))
        .select("key", F.filter("stack", lambda r: F.startswith(F.col("key"), r)).alias("open"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains if the path starts with the rule's. The rule with most characters wins,
    of equal ones the one with the longer host, and between two verdicts on the same host and path
    ``block``. Without a rule ``rule`` is null and the verdict ``default``. A null url
    has an empty host and path; rules with a null host or path are left out. Repeated rows are
    judged each, an empty table gives no rows, and other columns are not read.
    """
    named = (
        rules.where("host is not null and path is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block sorts after allow
        .select(
            host_key(F.col("host")).alias("host_key"),
            "path",
            "verdict",
            F.concat("host", "path").alias("rule"),
            F.struct(F.length(F.concat("host", "path")).alias("chars"), F.length("host").alias("host_chars")).alias("rank"),
        )
    )
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = seen.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    urls = seen.select("host", "path").distinct().withColumn("host_key", host_key(F.col("host")))
    hosts = prefix_sweep(
        urls.select(F.col("host_key").alias("key")), named.select(F.col("host_key").alias("key"))
    ).where(F.size("open") > 0)
    below = urls.join(hosts.withColumnRenamed("key", "host_key"), "host_key").select(
        "host", "path", F.explode("open").alias("rule_host")
    )
    below = below.withColumn("key", F.concat("rule_host", F.lit(_SLASH), "path"))
    keyed = named.withColumn("rule_key", F.concat("host_key", F.lit(_SLASH), "path"))
    # Of the rules of one host the longest path is the last on the stack.
    tops = prefix_sweep(below, keyed.select(F.col("rule_key").alias("key"))).where(F.size("open") > 0)
    tops = tops.select("key", F.get("open", F.size("open") - 1).alias("rule_key"))
    best = (
        below.join(tops, "key")
        .join(keyed.select("rule_key", "rule", "verdict", "rank"), "rule_key")
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
    )
    return seen.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

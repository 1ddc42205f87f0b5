"""URL filters: a sort-merge range join of hosts with allow and block rules.

A host's canonical key is its labels in reverse order, so that a rule's host
covers one interval of keys: itself and all subdomains. Intervals of rules are
nested or apart. One sorted sweep over distinct hosts and rule starts keeps the
stack of active rules as one value per depth (number of labels): the last rule
that began at a depth is the only one that can still be open there.

The sweep runs in parts, one for each pair of topmost labels; rules of a
single label are copied into the parts under them. Only distinct hosts are
swept, so a host that holds many pages costs one row. Built-in functions only.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule; an empty rule table leaves every page to the default verdict;
repeated pages are judged each; repeated rules count once. Of two rules of equal
length, the one with the longer host wins, then block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels of a key that name the part of the sweep it is in.
PART_LABELS = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    """Labels from the topmost down, in hex: a key sorts by label, whatever
    characters a label holds ('.' sorts before every hex digit)."""
    return F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.concat(F.hex(F.encode(x, "UTF-8")), F.lit(".")))


def _part(labels: Column) -> Column:
    return F.array_join(F.slice(labels, 1, PART_LABELS), "")


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rule_host) for each distinct host and each rule host that covers it."""
    own = rules.select(F.col("host").alias("rule_host")).distinct().withColumn("labels", _labels(F.col("rule_host")))
    depths = sorted(r[0] for r in own.select(F.size("labels")).distinct().collect())  # at most the labels of a host
    swept = hosts.select("host").distinct().withColumn("labels", _labels(F.col("host")))
    points = swept.select(
        _part(F.col("labels")).alias("part"),
        F.array_join("labels", "").alias("key"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("depth"),
        "host",
        F.lit(None).cast("string").alias("end"),
    )
    key = F.array_join("labels", "")
    begins = own.select(
        _part(F.col("labels")).alias("part"),
        key.alias("key"),
        F.lit(0).alias("kind"),
        F.size("labels").alias("depth"),
        F.col("rule_host").alias("host"),
        F.concat(F.substring(key, 1, 2147483647).substr(F.lit(1), F.length(key) - 1), F.lit("/")).alias("end"),
    )
    deep = begins.where(F.col("depth") >= PART_LABELS)
    under = points.select("part", F.concat(F.substring_index("part", ".", 1), F.lit(".")).alias("top")).distinct()
    short = begins.where(F.col("depth") < PART_LABELS).drop("part").join(under, F.col("key") == F.col("top")).select(points.columns)
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = [F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("host", "end")), ignorenulls=True).over(sweep) for d in depths]
    opened = points.union(deep).union(short).select("*", F.array(*stack).alias("stack") if stack else F.array().cast("array<struct<host:string,end:string>>").alias("stack"))
    return (
        opened.where("kind = 1")
        .select("host", F.explode(F.filter("stack", lambda r: r["end"] > F.col("key"))).alias("rule"))
        .select("host", F.col("rule.host").alias("rule_host"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge each page: (id, host, path, rule, verdict).

    ``rules`` has host, path and verdict. A rule fits a url if its host is the
    url's host or a parent domain of it, and the url's path starts with its
    path. The longest rule (host and path together) wins.
    """
    rules = rules.select("host", "path", "verdict").distinct()
    host, path = host_and_path(F.col("url"))
    judged = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")).select("id", host.alias("host"), path.alias("path"))
    listed = rules.select(
        F.col("host").alias("rule_host"),
        F.struct(
            (-F.length(F.concat("host", "path"))).alias("order"),
            (-F.length("host")).alias("order_host"),
            (F.col("verdict") != "block").alias("order_verdict"),
            F.concat("host", "path").alias("rule"),
            "path",
            "verdict",
        ).alias("entry"),
    )
    covering = active_rules(judged, rules).join(listed, "rule_host").groupBy("host").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    best = F.try_element_at(F.filter("entries", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    return (
        judged.join(covering, "host", "left")
        .select("id", "host", "path", best.alias("best"))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )

"""URL filters by dated lists: entries become validity intervals, and captures are judged as of the time they were fetched.

A list is a log of (list, pattern, at, added): from `at` on the pattern is on the list, or no longer. A pattern is a host or
parent domain ("example.com" covers "www.example.com"), or a host with the first segments of a path ("example.com/a" covers
"example.com/a/b"). validity() turns the log into intervals, end exclusive; judge() is an as-of join: the patterns that a
URL falls under join the intervals by equality, and those that hold at its time of fetching count.

A capture joins a few patterns, never a list, and intervals of a pattern are few; a pattern that a third of all captures
falls under is split at run time by the skew handling of the join, whose other side has one row per pattern.

Defined results: a null or unparsable URL falls under no pattern; a null time is judged by no entry; log rows with a null in
list, pattern or at are ignored, and a null `added` counts as removed; of several rows for one list, pattern and time a
removal counts last; a repeated addition changes nothing; repeated captures each have a row; empty captures or logs give
an empty table or empty findings; schemes, ports, user names, queries and fragments do not matter; letter case only in paths;
extra columns are not looked at.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_parts(url: Column) -> Column:
    return F.array_remove(F.split(F.regexp_extract(url, PATH, 1), "/"), "")


def validity(log: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): disjoint intervals, null valid_to where a pattern is still on the list."""
    known = log.where("list is not null and pattern is not null and at is not null")
    states = known.groupBy("list", "pattern", "at").agg(F.min(F.coalesce("added", F.lit(False))).alias("added"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    changes = states.withColumn("before", F.coalesce(F.lag("added").over(order), F.lit(False))).where("added <> before")
    return changes.withColumn("valid_to", F.lead("at").over(order)).where("added").select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")


def patterns_of(url: Column, depth: Column) -> Column:
    """Every pattern that a URL falls under, with at most `depth` path segments."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    parts = path_parts(url)
    most = F.least(F.size(parts), depth)
    paths = F.when(most > 0, F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda n: F.concat(
        host_of(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host_of(url), F.lit("")) != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, intervals: DataFrame, allow: str = "allow") -> DataFrame:
    """capture_id, host, n_entries, lists, blocked for each row (capture_id, url, fetched_at).

    n_entries counts intervals that hold at fetched_at, lists names their lists in order, and blocked tells whether there are
    any and none of them is on the list `allow`. Finding the depth of patterns runs a job at once.
    """
    depth = intervals.agg(F.max(F.length("pattern") - F.length(F.replace("pattern", F.lit("/"), F.lit("")))).alias("depth")).first().depth or 0
    by_pattern = intervals.groupBy("pattern").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("entries"))
    rows = captures.select("capture_id", "url", "fetched_at")
    wanted = rows.where("url is not null and fetched_at is not null").distinct()
    under = wanted.select("url", "fetched_at", F.explode(F.array_distinct(patterns_of(F.col("url"), F.lit(depth)))).alias("pattern")).distinct()
    holds = lambda e: (e["valid_from"] <= F.col("fetched_at")) & (e["valid_to"].isNull() | (F.col("fetched_at") < e["valid_to"]))
    found = under.join(by_pattern, "pattern").select("url", "fetched_at", F.filter("entries", holds).alias("entries")).where(F.size("entries") > 0)
    found = found.groupBy("url", "fetched_at").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    names = F.array_sort(F.array_distinct(F.transform("entries", lambda e: e["list"])))
    found = found.select("url", "fetched_at", F.size("entries").cast("bigint").alias("n"), names.alias("names"))
    none = F.array().cast("array<string>")
    names = F.coalesce("names", none)
    return rows.join(found, ["url", "fetched_at"], "left").select(
        "capture_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_entries"),
        F.array_join(names, ",").alias("lists"), ((F.size(names) > 0) & ~F.array_contains(names, allow)).alias("blocked"))

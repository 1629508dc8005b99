"""URL rules by a sort-merge range join.

The canonical key of a host and path is the reversed host labels, ``/`` and the path, so that a rule is a prefix of the
keys it covers: an interval. Every url enters under each of its domains (``com``, ``com.example``, ...) that has as many
labels as some rule. Sampled splitters range-partition the keys, rules are cut to the ranges they overlap, and every
range is swept in key order: a running sum of opened less closed rules is the depth of the stack, and the latest rule
opened at that depth is its top, the innermost rule around the url. The longest of the tops over its domains wins.

Only DataFrame functions are used. Equal (host, path) pairs are judged once and the verdict is joined back.

Defined results: a null url, or one without ``://``, has an empty host and path; equal rules with different verdicts
block; of equally long rules the one with the longer host wins; rules with null host, path or verdict are ignored;
without rules or urls nothing matches; repeated rows are judged separately; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricebase.llm.common import prepared, range_of, sampled_splitters, shuffle_partitions

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, CLOSE, URL = 1, 0, 2
#: Characters of a key in a splitter.
SPLITTER_CHARS = 200


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow"
) -> DataFrame:
    """Per row: the id, host, path, rule (``host/path`` or null) and verdict; ``rules``: host, path, verdict."""
    spark = prepared(pages.sparkSession)
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))  # block before allow
        .withColumn("labels", reversed_labels(F.col("host")))
    )
    # a set of label counts: at most a few small integers
    depths = sorted(r[0] for r in known.select(F.size("labels")).distinct().collect())
    if not depths:
        return rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))

    def key(labels: Column) -> Column:
        return F.concat(F.array_join(labels, "."), F.lit("/"), F.col("path"))

    pairs = rows.where("host <> ''").select("host", "path").distinct().withColumn("labels", reversed_labels(F.col("host")))
    domains = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: d <= F.size("labels"))
    asked = pairs.select("host", "path", F.explode(domains).alias("n"), "labels").select(
        "host", "path", key(F.slice("labels", F.lit(1), F.col("n"))).alias("key")
    )
    splitters = sampled_splitters(asked.select(F.substring("key", 1, SPLITTER_CHARS).alias("key")), ["key"], shuffle_partitions(spark))

    def part(position: Column) -> Column:
        return range_of(splitters, [position])

    def bytes_of(position: Column) -> Column:
        return position.cast("binary")

    ruled = known.select(
        key(F.col("labels")).alias("key"),
        F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"),
                 F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
    )
    # a rule is present in every range its interval overlaps; U+10FFFF sorts after all that may follow the prefix
    last = part(F.concat("key", F.lit("\U0010ffff" * (SPLITTER_CHARS + 1))))
    present = ruled.withColumn("part", F.explode(F.sequence(part(F.col("key")), last)))
    nothing = F.lit(None).cast("string")
    opened = present.select("part", bytes_of(F.col("key")).alias("at"), F.lit(OPEN).alias("kind"), "rule", nothing.alias("host"), nothing.alias("path"))
    closed = present.select(
        "part", F.concat(bytes_of(F.col("key")), F.lit(b"\xff")).alias("at"), F.lit(CLOSE).alias("kind"), "rule", nothing.alias("host"), nothing.alias("path")
    )
    urls = asked.select(part(F.col("key")).alias("part"), bytes_of(F.col("key")).alias("at"), F.lit(URL).alias("kind"),
                        F.lit(None).cast(ruled.schema["rule"].dataType).alias("rule"), "host", "path")
    events = opened.unionByName(closed).unionByName(urls)

    sweep = Window.partitionBy("part").orderBy("at", "kind")
    change = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    depth = F.sum(change).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    slot = Window.partitionBy("part", "depth").orderBy("at", "kind")
    top = F.last(F.when(F.col("kind") == OPEN, F.col("rule")), ignorenulls=True).over(
        slot.rowsBetween(Window.unboundedPreceding, 0)
    )
    stacked = events.withColumn("depth", depth).where(f"kind <> {CLOSE} and depth > 0")
    tops = stacked.withColumn("top", top).where(f"kind = {URL}")
    best = tops.groupBy("host", "path").agg(F.max("top").alias("top"))
    return rows.join(best, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(otherwise)).alias("verdict")
    )

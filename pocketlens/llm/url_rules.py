"""URL filtering by a sort-merge range join of urls with host and path rules.

A host becomes the key of its labels in reverse, each ended by a dot
(``a.example.com`` -> ``com.example.a.``), so a host and all its subdomains are
one key interval, and the intervals of two rules are nested or apart.  Splitters
from a bounded sample of url keys cut the key space into ranges; a url goes to
one range and a rule to every range that its interval meets.  Each task reads
its ranges in key order and keeps the rules whose interval is open on a stack.
A key that holds many urls is cut by a hash of the url's id as well, so a hot
host spreads over as many ranges as it needs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, slices

#: Ranges for each shuffle partition, and sampled keys for each range.
RANGES_PER_PARTITION = 4
SAMPLE_PER_RANGE = 16
#: No matter how many partitions a session has, so many ranges at most: bounds the sample.
MAX_RANGES = 4096

OUT = "page_id bigint, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each ended by a dot; the empty host has the empty key."""
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(key)


def _splitters(urls: DataFrame, ranges: int) -> list[str]:
    """Upper ends of the ranges: quantiles of the urls with the smallest hashes (same on every run)."""
    want = ranges * SAMPLE_PER_RANGE
    sample = urls.select("at", "tie").orderBy("tie").limit(want).collect()
    keys = sorted(r["at"] for r in sample)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_range, stack = None, []  # of (host key, {path: (label, verdict)}, path lengths, longest first)
        for batch in slices(batches, 4096):
            out: list[list] = [[], [], [], [], []]
            cols = [batch.column(c).to_pylist() for c in ("range", "key", "is_url", "page_id", "host", "path", "verdict")]
            for rng, key, is_url, page_id, host, path, verdict in zip(*cols):
                if rng != open_range:
                    open_range, stack = rng, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not is_url:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, rules, lengths = stack[-1]
                    if path not in rules:
                        if len(path) not in lengths:
                            lengths.append(len(path))
                            lengths.sort(reverse=True)
                        rules[path] = (host + path, verdict)
                    continue
                found = None
                for _, rules, lengths in reversed(stack):
                    found = next((rules[path[:n]] for n in lengths if n <= len(path) and path[:n] in rules), None)
                    if found:
                        break
                for column, value in zip(out, (page_id, host, path, *(found or (None, default)))):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "host", "path", "rule", "verdict"]
            )

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The verdict of the most specific rule for each url.

    ``pages``: page_id, url.  ``rules``: host, path, verdict (``allow``/``block``).  A
    rule fits its host and all subdomains when the url's path starts with the rule's
    path.  The longest host wins, then the longest path.  Rules of the same host and
    path: the verdict that sorts first (``allow``) holds.  A rule host is lower-cased
    like a url's; null host or path count as empty; the empty host fits every url.

    Returns page_id, host, path, rule (host and path of the winner, else null) and
    verdict (``default`` without a rule), one row for each input row, repeated rows
    included.  A null url, or one without ``://``, has an empty host and path; a null
    page_id is kept.  Empty tables give empty results (no rules: all ``default``).

    Sent to the driver: at most MAX_RANGES * SAMPLE_PER_RANGE sampled keys.  A rule is
    repeated in each range that its interval meets; a range boundary lies within at
    most as many rule hosts as its own host has labels.  A task holds the rules of the
    hosts on its stack.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("tie", F.xxhash64("page_id", "path"))
    urls = urls.withColumn("at", F.concat("key", F.lit("\u0001"), F.lpad(F.hex("tie"), 16, "0")))

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _splitters(urls, min(MAX_RANGES, partitions * RANGES_PER_PARTITION))
    cut_bytes = [c.encode() for c in cuts]
    shared = spark.sparkContext.broadcast(cut_bytes)

    @F.udf("int", useArrow=True)
    def range_of(at):
        return bisect.bisect_right(shared.value, at.encode())

    @F.udf("int", useArrow=True)
    def last_range_of(key):  # no UTF-8 text that starts with the key sorts after this
        return bisect.bisect_right(shared.value, key.encode() + b"\xff")

    rules = rules.select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = rules.withColumn("key", host_key(F.col("host")))
    rules = rules.withColumn("range", F.explode(F.sequence(range_of("key"), last_range_of("key"))))

    both = urls.select(
        range_of("at").alias("range"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path",
        F.lit(None).cast("string").alias("verdict"),
    ).unionByName(
        rules.select(
            "range", "key", F.lit(False).alias("is_url"), F.lit(None).cast("bigint").alias("page_id"), "host", "path",
            "verdict",
        )
    )
    dealt = both.repartition(partitions, "range").sortWithinPartitions("range", "key", "is_url")
    return dealt.mapInArrow(_sweep(default), OUT)

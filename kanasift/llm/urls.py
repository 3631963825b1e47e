"""URL filters against a list that changes over time: dated entries become validity intervals, captures join as of their fetch.

An entry names a key, an action (block, allow or drop) and a date. A key is a host, which stands for its
subdomains too, a host and path prefix, or *.host and path prefix, which stands for the path on the host and its
subdomains. An entry holds until the next one of the same key; drop ends it without a successor. The most specific
key that is active when a capture was fetched decides it: more labels of the host first, then more of the path, the
host's own key before the starred one. Without any the capture is allowed.

How deep keys go is read from the list, so there is no bound on labels or path segments. The as-of join lays
entries and captures of a key on one time line and carries the latest entry forward, so its work is their sum.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import HOT_KEYS, written


def host_of(url: Column) -> Column:
    """The lower-case host of a URL, without port, user and trailing dots; empty if it has none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


class Depths(NamedTuple):
    """How many labels the hosts of a list's keys have, and segments the paths of plain and of starred keys."""

    labels: list[int]
    segments: list[int]
    starred: list[tuple[int, int]]


def _key_parts(key: Column) -> tuple[Column, Column, Column]:
    """Whether a key is starred, its host's labels, its path's segments."""
    host = F.regexp_replace(F.get(F.split(key, "/", 2), F.lit(0)), r"^\*\.", "")
    return key.startswith("*."), F.size(F.split(host, r"\.")), F.size(F.filter(F.split(key, "/"), lambda x: x != "")) - 1


def depths(entries: DataFrame) -> Depths:
    """The depths of the keys of intervals(): a row for each that occurs, of which there are few at any size of the list."""
    star, labels, segments = _key_parts(F.col("key"))
    rows = entries.where("key is not null").select(star.alias("star"), labels.alias("labels"), segments.alias("segments")).distinct().collect()
    hosts = sorted({r["labels"] for r in rows if not r["star"] and not r["segments"]})
    return Depths(hosts, sorted({r["segments"] for r in rows if not r["star"] and r["segments"]}), sorted({(r["labels"], r["segments"]) for r in rows if r["star"]}))


def keys_of(host: Column, url: Column, deep: Depths) -> Column:
    """The keys that can decide a URL as (labels, segments, plain, key), the most specific being the greatest.

    They are the host's suffixes of two labels or more, the host itself, the host with its path's beginnings, and
    starred suffixes with them, as far as the list has keys of that depth.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    suffix = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    front = lambda k: F.array_join(F.slice(parts, 1, k), "/")

    def one(wanted: Column, k, s, plain: int, key: Column) -> Column:
        row = F.struct(F.lit(k).cast("int").alias("labels") if isinstance(k, int) else k.alias("labels"), F.lit(s).alias("segments"), F.lit(plain).alias("plain"), key.alias("key"))
        return F.when(wanted, row)

    rows = [one(F.lit(True), n, 0, 1, host)]
    rows += [one((n > k) & F.lit(k >= 2), k, 0, 1, suffix(k)) for k in deep.labels]
    rows += [one(F.size(parts) >= s, n, s, 1, F.concat(host, F.lit("/"), front(s))) for s in deep.segments]
    rows += [one((n >= k) & (F.size(parts) >= s), k, s, 0, F.concat(F.lit("*."), suffix(k), F.lit("/" if s else ""), front(s))) for k, s in deep.starred]
    return F.array_compact(F.array(*rows))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until) of entries (key, action, at): each holds from its date to the key's next one.

    Of entries of one key and date, block comes before allow and allow before drop, and the first counts.
    Entries without key, action or date are left out. A key's host has no case, nor does a slash at its end count.
    A list's history of one key is sorted by one task, after entries of one date have become one.
    """
    slash = F.expr("instr(key, '/')")
    key = F.regexp_replace(F.when(slash > 0, F.concat(F.lower(F.expr("substring(key, 1, instr(key, '/') - 1)")), F.expr("substring(key, instr(key, '/'))"))).otherwise(F.lower("key")), "/+$", "")
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "drop", 2)
    rows = entries.select(key.alias("key"), "action", F.col("at").cast("timestamp").alias("since"), rank.alias("rank")).where("key is not null and since is not null and rank is not null")
    one = rows.groupBy("key", "since").agg(F.min(F.struct("rank", "action")).alias("x")).select("key", "since", F.col("x.action").alias("action"))
    until = F.lead("since").over(Window.partitionBy("key").orderBy("since"))
    return one.withColumn("until", until).where("action != 'drop'").select("key", "action", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures' row (capture_id, url, fetched_at), with host, matched_key, action and blocked boolean.

    Null or odd URLs have an empty host, and captures without a fetch time meet no entry; neither is blocked.
    Repeated captures are evaluated once each; of their columns only these three are read. Empty tables give no
    rows and no blocks; URLs of any length are taken whole. Of a key that many captures share, those are dealt to
    several time lines, and its intervals are repeated for each.
    """
    spans = written(intervals(entries), "intervals")
    deep = depths(spans)
    rows = captures.select(F.col("capture_id"), "url", F.col("fetched_at").cast("timestamp").alias("fetched_at")).withColumn("host", host_of(F.col("url")))
    asked = rows.where("host != '' and fetched_at is not null").select("capture_id", "url", "host", "fetched_at").distinct()
    asked = asked.select(F.xxhash64("capture_id", "url", "fetched_at").alias("r1"), F.xxhash64(F.lit(7), "capture_id", "url", "fetched_at").alias("r2"), F.col("fetched_at").alias("at"), F.explode(keys_of(F.col("host"), F.col("url"), deep)).alias("k"))
    asked = asked.select("r1", "r2", "at", "k.*").join(spans.select("key").distinct(), "key", "left_semi")
    counts = written(asked.groupBy("key").agg(F.count("*").alias("__n")), "keys")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    # Keys over a thousandth of the rows are fewer than a thousand, so they are small enough to broadcast at any size.
    share = max(1, max(total, 20 * HOT_KEYS) // HOT_KEYS)
    hot = F.broadcast(written(counts.where(F.col("__n") > share).select("key", F.ceil(F.col("__n") / share).cast("int").alias("__salts")), "hot"))
    salts = F.coalesce("__salts", F.lit(1))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    line = asked.join(hot, "key", "left").select("key", F.pmod(F.xxhash64(F.lit(3), "r1"), salts).cast("int").alias("salt"), "at", F.lit(1).alias("kind"), "r1", "r2", "labels", "segments", "plain", none("action", "string"), none("until", "timestamp"))
    marks = spans.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("since").alias("at"), F.lit(0).alias("kind"), none("r1", "long"), none("r2", "long"), none("labels", "int"), none("segments", "int"), none("plain", "int"), "action", "until")
    so_far = Window.partitionBy("key", "salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    now = F.last(F.when(F.col("kind") == 0, F.struct("action", "until")), ignorenulls=True).over(so_far)
    met = line.unionByName(marks).withColumn("now", now).where("kind = 1 and now is not null and (now.until is null or at < now.until)")
    won = met.groupBy("r1", "r2").agg(F.max(F.struct("labels", "segments", "plain", "key", "now.action")).alias("w"))
    rows = rows.withColumn("r1", F.xxhash64("capture_id", "url", "fetched_at")).withColumn("r2", F.xxhash64(F.lit(7), "capture_id", "url", "fetched_at"))
    out = rows.join(won, ["r1", "r2"], "left")
    return out.select("capture_id", "url", "fetched_at", "host", F.col("w.key").alias("matched_key"), F.coalesce(F.col("w.action"), F.lit("allow")).alias("action"), (F.coalesce(F.col("w.action"), F.lit("allow")) == "block").alias("blocked"))

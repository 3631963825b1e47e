"""Cross-site boilerplate lines: how many sites a line is on, by HyperLogLog sketches per line hash.

Each task sketches the sites of its lines, sketches of a line merge as they meet, and lines whose estimate is
near the threshold are counted exactly. Lines on enough sites go from all documents but the first that has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import HOT_KEYS, salted_join, written

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 5
#: log2 of the registers of a sketch; the standard error of an estimate is 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within this many standard errors of the threshold are counted exactly.
ERRORS = 5.0


def _hashes(x: Column) -> tuple[Column, Column]:
    return F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2")


def _lines(docs: DataFrame) -> DataFrame:
    """(r1, r2, site, pos, h1, h2) of each line with a word; r1 and r2 stand for doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64("doc_id", "text").alias("r1"),
        F.xxhash64(F.lit(7), "doc_id", "text").alias("r2"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", "r1", "r2", "site", "pos", *_hashes(F.trim(F.translate("line", "\t\x0b\f\r", "    "))))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first, n): lines on min_sites sites or more, the first (doc_id, pos) of each and its rows.

    Sketches decide where they are sure; lines near the threshold are counted by their distinct sites.
    """
    lines = _lines(docs)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min(F.struct("id", "pos", "r1", "r2")).alias("first"), F.count("*").alias("n"))
    error = ERRORS * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites / (1 + error), min_sites / max(1e-9, 1 - error)
    many = written(sketched.where(F.col("n") >= min_sites).where(F.col("sites") >= F.lit(int(low))), "lines")
    near = many.where(F.col("sites") <= F.lit(int(high) + 1))
    # Each task keeps one row of a line and site before rows are dealt out, so a frequent line is no hot key.
    pairs = lines.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return many.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h1", "h2", "first", "n")


def dedup(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, lg_k: int = LG_K) -> DataFrame:
    """docs with their columns, the text less its boilerplate lines, and n_lines and n_removed, both long.

    docs has doc_id, text and source, the site. A line is boilerplate if it is on min_sites sites or more, white
    space at its ends or of another kind aside; lines without a word are never boilerplate. With keep_first, the
    line of the smallest (doc_id, position) stays. A null text stays null and has no lines; a null source is a
    site of its own; repeated rows are treated alike; columns n_lines and n_removed of docs are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    bad = written(boilerplate(docs, min_sites, lg_k), "boilerplate")
    lines = _lines(docs)
    total = bad.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = salted_join(lines, bad.select("h1", "h2", "first"), ["h1", "h2"], bad.select("h1", "h2", F.col("n").alias("__n")), max(total, 20 * HOT_KEYS), "r1")
    if keep_first:
        met = met.where(~(F.struct("id", "pos", "r1", "r2").eqNullSafe(F.col("first"))))
    gone = met.select("r1", "r2", "pos").groupBy("r1", "r2").agg(F.collect_set("pos").alias("__gone"))
    cols = [F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(names)]
    rows = docs.select(F.struct(*cols).alias("__row"), F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("r2"))
    # Each text is dealt out once, inside its row.
    was = F.col(f"__row.__c{names.index('text')}")
    rows = rows.join(gone, ["r1", "r2"], "left").select("__row", was.alias("__text"), F.split(was, "\n").alias("__lines"), "__gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    rows = rows.select("__row", "__text", "__lines", "__gone", F.when(F.col("__gone").isNotNull(), kept).alias("__kept"))
    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform("__kept", lambda i: F.get(F.col("__lines"), i)), "\n"))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size("__lines"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"__row.__c{k}").alias(c) for k, c in enumerate(names)], n.cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))

"""Quality rules: repetition and symbol figures, and a hashed n-gram log-likelihood ratio.

The ratio follows data selection by hashed n-grams: each text's tokens (runs of letters and digits, or of
other signs) and pairs of neighbours are hashed into buckets; one multinomial is counted over all distinct
texts, one over those of which the labels name a copy good; a document's score is the mean over its n-grams of
log(trusted / raw), and it is kept if the score is no less than a fixed threshold.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import words_of, written

BUCKETS = 1 << 14
#: A document whose mean log ratio is below this goes. Text like the corpus at large scores about 0.
THRESHOLD = -0.35
#: Labelled good documents at most whose n-grams make the trusted multinomial.
TRUSTED_ROWS = 20_000
SYMBOLS = "#*$%&|<>"


def base_figures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ..) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long, put first.

    Arrays stay within their row, so nothing is shuffled. Null texts have no words and figures of 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    more = ["__row"] if "__row" in docs.columns else []
    made = docs.select("doc_id", "text", *more, words_of(F.col("text")).alias("__w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    def let(x: Column, f) -> Column:
        """f(x), with x computed once however often f reads it."""
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def later(x: Column, k: int) -> Column:
        return F.slice(x, 1 + k, F.greatest(F.size(x), F.lit(1)))

    def threes(x: Column, join) -> Column:
        """join(a, b, c) over the windows of an array of three or more."""
        n = F.greatest(F.size(x) - 2, F.lit(0))
        return F.zip_with(F.zip_with(F.slice(x, 1, n), F.slice(x, 2, n), lambda a, b: join(a, b)), later(x, 2), lambda a, c: join(a, c))

    # Hashes that all differ say that no window is repeated; only other texts' windows are spelt out and sorted.
    hashes = F.when(F.size("__w") < 3, F.array().cast("array<bigint>")).otherwise(let(F.transform("__w", lambda w: F.xxhash64(w)), lambda h: threes(h, F.xxhash64)))
    made = made.select("doc_id", "text", *more, "__w", "__lines", hashes.alias("__h"))

    def covered(windows: Column) -> Column:
        """Words that sorted (window, place) rows cover where the window has an equal neighbour."""
        pairs = F.transform(F.arrays_zip(windows.alias("x"), F.concat(F.array(F.lit(None).cast("struct<w:string,i:int>")), windows).alias("before"), later(windows, 1).alias("after")), lambda p: F.when((p["x"]["w"] == p["before"]["w"]) | (p["x"]["w"] == p["after"]["w"]), p["x"]["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(F.array_sort(F.array_compact(pairs)), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"].cast("long"))

    spelt = F.transform(threes(F.col("__w"), lambda a, b: F.concat_ws(" ", a, b)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    repeats = F.when(F.size(F.array_distinct("__h")) < F.size("__h"), let(F.sort_array(spelt), covered)).otherwise(F.lit(0).cast("long"))
    return made.select(
        "doc_id",
        "text",
        *more,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    )


def features(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of a text's tokens: runs of letters and digits, or of other signs, in lower case, repeats included."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _pairs(tokens: Column, buckets: int) -> Column:
    """Buckets of neighbour pairs, from the tokens' buckets (a column, read twice)."""
    n = F.size(tokens)
    return F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(1))), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))


def _ratios(made: DataFrame, labels: DataFrame, buckets: int, trusted_rows: int) -> list[float]:
    """log(trusted / raw) of each bucket, counts smoothed by one; all 0 without trusted documents."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__good")).distinct().orderBy(F.xxhash64("__good"), "__good").limit(trusted_rows)
    marked = made.select("doc_id", "__t1", "__t2", "__u").join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left")
    # Each text counts once, however many copies it has; each task drops its own copies before they are dealt out.
    one = marked.groupBy("__t1", "__t2").agg(F.first("__u").alias("__u"), F.max(F.col("__good").isNotNull().cast("long")).alias("__g"))
    # Each task sums its own counts by bucket before they are dealt out, so a frequent word is no hot key.
    grams = one.select("__g", F.explode(F.concat("__u", _pairs(F.col("__u"), buckets))).alias("bucket"))
    n = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("__g").alias("good")).collect()
    raw, trusted = buckets + sum(r["raw"] for r in n), buckets + sum(r["good"] for r in n)
    out = [log(1 / trusted) - log(1 / raw)] * buckets
    for r in n:
        out[r["bucket"]] = log((r["good"] + 1) / trusted) - log((r["raw"] + 1) / raw)
    return out if trusted > buckets else [0.0] * buckets


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """doc_id, the base figures, base_failed and kept booleans, n_grams long and llr double for each row of docs.

    base_failed: under 50 words, or over half of them in repeated windows. kept: not base_failed and llr at
    least threshold. A text without n-grams has llr 0. Empty tables give no rows, repeated rows are judged
    each, other columns are ignored; a text of any length is one row's work, in memory some tens of times its size. Raw counts cover each distinct text of docs once; trusted counts cover those
    of which labels (doc_id, quality) call a copy good, of which at most trusted_rows, the first by hash, are used.

    Texts are gone through once: figures and tokens' buckets are a table, which is counted and then scored.
    """
    judged = _judged(docs, labels, threshold, buckets, trusted_rows)
    last = ["n_grams", "llr"]
    return judged.select(*[c for c in judged.columns if c not in last], *last)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The rows of docs that score() keeps, with all their columns."""
    names = [f"__c{k}" for k in range(len(docs.columns))]
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("__row"))
    # The task's number is no constant, so the filter is not pushed below the figures, which would be made twice.
    kept = _judged(carried, labels, threshold, buckets, trusted_rows).select("__row", "kept", F.spark_partition_id().alias("__task")).where("kept and __task >= 0")
    return kept.select(*[F.col(f"__row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)])


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int, trusted_rows: int) -> DataFrame:
    figures = base_figures(docs)
    made = written(figures.select("*", F.xxhash64("text").alias("__t1"), F.xxhash64(F.lit(7), "text").alias("__t2"), features(F.col("text"), buckets).alias("__u")).drop("text"), "figures")
    # A row of `buckets` numbers at any size of the input, set into the plan as a constant.
    table = F.split(F.lit(",".join(f"{r:.6f}" for r in _ratios(made, labels, buckets, trusted_rows))), ",").cast("array<double>")
    ratio = lambda s, b: s + F.get(table, b)
    n = F.size("__u") + F.greatest(F.size("__u") - 1, F.lit(0))
    total = F.aggregate("__u", F.lit(0.0), ratio) + F.aggregate(_pairs(F.col("__u"), buckets), F.lit(0.0), ratio)
    out = made.select(*[c for c in made.columns if c not in ("__t1", "__t2", "__u")], n.cast("long").alias("n_grams"), F.when(n > 0, total / n).otherwise(0.0).alias("llr"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"))

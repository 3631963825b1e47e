"""SimHash near-duplicates by the generalised pigeonhole principle.

A link at distance t or less differs, in some partition i of the bits, in thresholds[i] bits or fewer, if
the thresholds add up to t - (number of partitions) + 1; a threshold of -1 leaves its partition out. Bits
that go together are put into one partition, and dynamic programming hands out the thresholds by estimated
candidate counts. Each fingerprint then probes the partition values near its own, and pairs are verified.

A bucket that many fingerprints probe would give all pairs of its group. There, each fingerprint instead
names itself and its one-bit changes, and those that name the same value are within two bits of each other:
65 rows a fingerprint however large the group, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import join_by_key, written
from .components import components

#: Fingerprints of which pair distances are estimated: a bound for the driver, not for the search.
SAMPLE = 4096
#: Probes of a bucket beyond which its fingerprints go by one-bit changes.
BUCKET = 256


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's lower-cased word shingles, as a signed integer; 0 without words."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        hashes = [h(b" ".join(words), 42)]
    else:
        whole, ends, at = b" ".join(words), [], 0
        for w in words:
            at += len(w) + 1
            ends.append(at - 1)
        starts = [0, *(e + 1 for e in ends[: len(words) - width])]
        hashes = [h(whole[s:e], 42) for s, e in zip(starts, ends[width - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[k : k + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row of docs (doc_id, text); null texts count as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), width) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _bits(values: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(values, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partition_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in groups of like size, each begun with the most correlated pair left and grown by correlation."""
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(sample.T.astype(float)))) if len(sample) > 1 else np.zeros((64, 64))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 * (k + 1)) // parts - (64 * k) // parts
        sub = corr[np.ix_(left, left)]
        i = int(sub.argmax()) // len(left)
        group = [left[i]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())])
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def match_rates(sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, .. most bits of the group.

    The larger of the sample's pairs and of bits taken one by one, as rates below the sample's reach matter.
    """
    if len(sample) < 2:
        return [1.0] * (most + 1)
    x = sample[:, group].astype(np.float32)
    n, hist = len(x), np.zeros(len(group) + 1)
    for k in range(0, n, 512):
        y = x[k : k + 512]
        d = y.sum(1)[:, None] + x.sum(1)[None, :] - 2 * y @ x.T
        hist += np.bincount(d.astype(np.int64).ravel(), minlength=len(group) + 1)
    hist[0] -= n
    p = x.mean(axis=0).astype(float)
    dist = np.zeros(len(group) + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return [float(max(hist[: t + 1].sum() / (n * (n - 1)), dist[: t + 1].sum())) for t in range(most + 1)]


def allocate(rates: list[list[float]], sizes: list[int], most: int, n: int) -> tuple[float, list[int]]:
    """Thresholds from -1 to most for each partition, most - parts + 1 in all, of the least estimated cost.

    The cost counts the probes that n fingerprints make and the candidate pairs that they get.
    """
    parts = len(rates)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for r, size in zip(rates, sizes, strict=True):
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, most + 1):
                c = cost + (n * sum(comb(size, j) for j in range(t + 1)) + n * (n - 1) / 2 * r[t] if t >= 0 else 0)
                k = used + t + 1
                if k <= most + 1 and (k not in after or c < after[k][0]):
                    after[k] = (c, [*chosen, t])
        best = after
    assert sum(best[most + 1][1]) == most - parts + 1
    return best[most + 1]


def plan(values: list[int], n: int, most: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and their thresholds for n distinct fingerprints, of which values are a sample."""
    sample, found = _bits(values) if values else np.zeros((0, 64), np.uint8), []
    for parts in (2, 3, 4):
        groups = partition_bits(sample, parts)
        found.append((*allocate([match_rates(sample, g, most) for g in groups], [len(g) for g in groups], most, n), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return groups, thresholds


def _probes(groups: list[list[int]], thresholds: list[int]) -> list[tuple[int, int, int]]:
    """(partition, mask, flip) of every value that a fingerprint probes."""
    out = []
    for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        mask = sum(1 << b for b in g)
        out += [(i, mask, sum(1 << b for b in flip)) for k in range(t + 1) for flip in combinations(g, k)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, most: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(u long, v long) so that fingerprints at most bits apart reach each other; distinct: (fp long), unique.

    bucket bounds a bucket's probes; beyond it, the way of one-bit changes finds the same links for most = 2.
    """
    if most != 2:
        raise ValueError("the way around large buckets holds for two bits")
    n = distinct.count()
    sample = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    groups, thresholds = plan(sample, n, most)
    probes = _probes(groups, thresholds)
    one = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(_signed(mask)).alias("mask"), F.lit(_signed(flip)).alias("flip")) for i, mask, flip in probes])
    asked = distinct.select("fp", F.explode(one).alias("p")).select("fp", F.col("p.part").alias("part"), F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("value"), (F.col("p.flip") == 0).alias("own"))
    asked = written(asked, "probes")
    large = written(asked.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("part", "value"), "large")
    cold, hot = asked, None
    if large.limit(1).count():
        cold = asked.join(large, ["part", "value"], "left_anti")
        hot = asked.join(large, ["part", "value"], "left_semi").select("fp").distinct()
    a = cold.select("part", "value", F.col("fp").alias("u"))
    b = cold.where("own").select("part", "value", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most
    # With a threshold of 0 both sides probe alike and one order is enough; else each side must ask.
    order = F.col("u") < F.col("v") if all(t <= 0 for t in thresholds) else F.col("u") != F.col("v")
    out = a.join(b, ["part", "value"]).where(order & near).select("u", "v")
    if hot is not None:
        named = hot.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(64)])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name"))
        named = written(named, "names")
        least = named.groupBy("name").agg(F.min("fp").alias("u"))
        out = out.unionByName(named.join(least, "name").where("fp != u").select("u", F.col("fp").alias("v")))
    return out.distinct()


def near_duplicates(docs: DataFrame, most: int = 2, width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs (doc_id, text): component_id is the smallest doc_id
    reachable by links of at most `most` differing bits, the row's own included.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows stay rows of their own; a
    null doc_id is never a component's smallest unless all are null; no rows give no rows; other columns are ignored.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    each = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("__n")), "distinct")
    roots = components(links(each.select("fp"), most, bucket)).select(F.col("u").alias("fp"), "root")
    roots = written(each.select("fp", "first", "__n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    # Single fingerprints need no grouping; the rest are grouped by root, summed before the shuffle.
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("__n"))
    ids = join_by_key(roots.select("fp", "root"), least.select("root", "component_id"), "root", least.select("root", "__n"), roots.count())
    return join_by_key(rows, ids.select("fp", "component_id"), "fp", each.select("fp", "__n"), rows.count()).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, most: int = 2) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, once if its doc_id is repeated."""
    return keep_smallest(docs, near_duplicates(docs, most))


def keep_smallest(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is its own component_id in ids, once if the doc_id is repeated."""
    first = written(ids.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("__first")).agg(F.count("*").alias("__n")), "first")
    # The kept ids grow with the documents, so they are never broadcast, small tables included.
    kept = docs.join(first.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__first")), "left_semi")
    if first.where("__n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept


def hex_of(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

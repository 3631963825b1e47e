"""Near copies by SimHash and the Jaccard similarity of word shingles, every link verified.

SimHash comes first: texts whose fingerprints are within two bits are candidates (simhash.links), are compared by
their shingles, and make components. No number of bits gives all texts of a similarity of 0.8, so what is farther
apart comes after, among texts of different components only: texts that share one of BANDS MinHash keys, each of
ROWS minima, are compared as well; two texts of similarity 0.8 miss all keys with a probability of 5e-8. A key that
many different texts share would give all pairs of its group. Such texts are instead joined by the prefix filter,
which is exact: shingles are ordered from rare to frequent, as counted in a table of bounded size, and similar texts have a shingle in common
near the start of that order, whatever the order. In a large bucket of the prefix filter, all are compared with
one leader, the one of the most frequent shingles, and only those that are not similar to it with the others: what
is linked to the leader is in its component already.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._shared import HOT_KEYS, drop_written, join_by_key, salted_join, written
from .components import components

SIMILARITY, WIDTH = 0.8, 5
BANDS, ROWS = 32, 4
#: Different texts of a key beyond which they go by the prefix filter, and of a prefix bucket with a leader.
BUCKET = 32
#: log2 of the slots at most by which the frequency of shingles is told.
SLOT_BITS = 22
#: Parts into which the members of a prefix bucket are dealt.
SALTS = 16
#: Bytes of sets that are sent to all tasks at most.
MOST_SENT = 64 << 20

_RNG = np.random.default_rng(42)
_MULTIPLY = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's lower-cased word shingles; all words as one if there are fewer."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each, width = np.array([h(w, 42) for w in words], np.uint64), min(width, len(words))
    n = len(each) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += each[k : k + n] * _PLACE[k]
    return np.unique(_mixed(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a text with these shingles, as signed integers; none without shingles."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[k : k + 2048] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1), out=least)
    rows = _mixed(least).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS]
    for k in range(ROWS):
        out += rows[:, k] * _PLACE[k]
    return _mixed(out).view(np.int64)


def _node() -> Column:
    """A text's hash, 0 for all texts without words."""
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")


def _arrays(texts: DataFrame, f, name: str) -> DataFrame:
    """(node long, name array<long>) of texts (node, text): f of each text."""

    def run(batches):
        for b in batches:
            out = [f(t.as_py()) for t in b.column(1)]
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["node", name])

    return texts.mapInArrow(run, f"node long, {name} array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """pairs with the sets (u, nu, su) of their u. Hot ones' sets are sent to all tasks if they are small together, as
    a few of very long texts may not be; else they are repeated for several salts."""
    hot = counts.where(F.col("__n") > max(1, total // HOT_KEYS)).select("u")
    size = 8 * (sets.join(F.broadcast(hot), "u", "left_semi").agg(F.sum("nu")).first()[0] or 0) if total > 20 * HOT_KEYS else 0
    return join_by_key(pairs, sets, "u", counts, total) if size <= MOST_SENT else salted_join(pairs, sets, ["u"], counts, max(total, 20 * HOT_KEYS), "v")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (node, n, s) are similar; u may be in many pairs."""
    pairs = written(pairs, "pairs")
    counts = pairs.groupBy("u").agg(F.count("*").alias("__n"))
    out = pairs.join(sets.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("s").alias("sv")), "v")
    out = _with_sets(out, sets.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("s").alias("su")), counts, pairs.count())
    out = out.where(F.least("nu", "nv") >= similarity * F.greatest("nu", "nv") - 1e-9)
    return out.where(F.size(F.array_intersect("su", "sv")) * (1 + similarity) >= similarity * (F.col("nu") + F.col("nv")) - 1e-9).select("u", "v")


def _slots(s: pa.ListScalar, bits: int) -> np.ndarray:
    return (s.values.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _levels(sets: DataFrame) -> tuple[np.ndarray, int]:
    """How frequent elements are, in quarter powers of two, by the first bits of their hashes; and how many bits these are.

    Tasks count into slots, of which there are about as many as elements, 2 ** SLOT_BITS at most: one byte each.
    """
    bits = min(SLOT_BITS, max(10, int(sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).bit_length()))

    def run(batches):
        for b in batches:
            slots, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(_slots(s, bits) for s in b.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    n = sets.select("s").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    rows = n.select("slot", (F.floor(4 * F.log2("n")) + 1).cast("int").alias("level")).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[rows.column("slot").to_numpy()] = rows.column("level").to_numpy()
    return out, bits


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(x, node, root, n, at, centre): the elements of each set that come first, rare ones before frequent ones, as many
    as similar sets must share one of; those that no other set can have are left out. centre is the set's mean level.

    Any one order of all elements gives all links. That of their levels, then their hashes, is made in each task.
    """
    levels, bits = _levels(sets)
    sent = sets.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 6]
            for node, root, n, s in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                x = s.values.to_numpy(zero_copy_only=False)
                level = sent.value[_slots(s, bits)]
                first = np.lexsort((x, level))[: n - ceil(similarity * n - 1e-9) + 1]
                at = np.flatnonzero(level[first])
                out.append((x[first[at]], np.full(len(at), node), np.full(len(at), root), np.full(len(at), n), at, np.full(len(at), int(1000 * level.mean()))))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["x", "node", "root", "n", "at", "centre"])

    return sets.select("node", "root", "n", "s").mapInArrow(run, "x long, node long, root long, n long, at long, centre long")


def prefix_links(sets: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """(u, v) by which all similar sets (node, root, n, s) reach each other, by the prefix filter; those of one root
    are linked already and are not compared."""
    first = written(_prefixes(sets, similarity), "prefixes")
    size = first.groupBy("x").agg(F.count("*").alias("m"), F.max(F.struct("centre", "node", "root")).alias("leader")).where("m > 1")
    size = written(size.select("x", "m", F.col("leader.node").alias("leader"), F.col("leader.root").alias("of")), "prefix_sizes")
    u = lambda d: d.select("x", *[c for c in d.columns if c == "salt"], F.col("node").alias("u"), F.col("root").alias("ru"), F.col("n").alias("nu"), F.col("at").alias("iu"))
    v = lambda d: d.select("x", *[c for c in d.columns if c == "salt"], F.col("node").alias("v"), F.col("root").alias("rv"), F.col("n").alias("nv"), F.col("at").alias("iv"))
    # At the first element in common, what is left of both sets bounds their overlap.
    near = F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) * (1 + similarity) >= similarity * (F.col("nu") + F.col("nv")) - 1e-9
    near = near & (F.col("ru") != F.col("rv"))
    few = first.join(size.where(F.col("m") <= bucket).select("x"), "x", "left_semi")
    pairs = u(few).join(v(few), "x").where(near & (F.col("u") < F.col("v"))).select("u", "v").distinct()
    links = _verified(pairs, sets, similarity)
    large = written(size.where(F.col("m") > bucket).select("x", "leader", "of"), "large")
    if large.limit(1).count():
        many = written(first.join(F.broadcast(large) if large.count() <= 10_000 else large, "x"), "members")
        stars = _verified(many.where("root != of").select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct(), sets, similarity)
        stars = written(stars, "stars")
        # u and v as columns of the members: the leader and the member that it is similar to.
        linked = stars.select(F.col("u").alias("leader"), F.col("v").alias("node"))
        strays = written(many.where("root != of").join(linked, ["leader", "node"], "left_anti"), "strays")
        salted = many.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
        each = strays.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rest = u(each).join(v(salted), ["x", "salt"]).where(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = links.unionByName(stars).unionByName(_verified(rest, sets, similarity))
    return links


def simhash_pairs(fps: DataFrame) -> DataFrame:
    """(u, v): texts (node, fp) to be compared, for all whose fingerprints are equal or within simhash.links' two bits.

    The smallest node of a fingerprint stands for it. Pairs grow with the texts: u may be in many of them, v in few.
    """
    each = written(fps.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("__n")), "fingerprints")
    total = fps.count()
    equal = join_by_key(fps.withColumnRenamed("node", "v"), each.select("fp", F.col("node").alias("u")), "fp", each.select("fp", "__n"), total).where("u != v")
    near = simhash.links(each.select("fp")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    near = written(near, "near")
    counts = near.groupBy("a").agg(F.count("*").alias("__n"))
    near = join_by_key(near, each.select(F.col("fp").alias("a"), F.col("node").alias("u")), "a", counts, near.count())
    return equal.select("u", "v").unionByName(near.join(each.select(F.col("fp").alias("b"), F.col("node").alias("v")), "b").select("u", "v"))


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (node, ..) with the root of each node; nodes without links are their own."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def links(texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """(u long, v long) so that similar texts reach each other; texts: (node long, text), equal rows alike."""
    # A text's fingerprint stands before its keys, so texts are read once for both.
    keys = _arrays(texts, lambda t: np.r_[np.array([simhash.fingerprint(t)], np.int64), band_keys(shingles(t, width))], "keys")
    asked = written(keys.select("node", F.posexplode("keys").alias("at", "key")).select("node", (F.col("at") == 0).alias("fp"), "key").distinct(), "bands")
    near = written(simhash_pairs(written(asked.where("fp and node != 0").select("node", F.col("key").alias("fp")), "fps")), "near")
    asked_keys = asked.where("not fp").select("node", "key")
    size = written(asked_keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "band_sizes")
    cold = written(asked_keys.join(size.where(F.col("m") <= bucket).select("key"), "key", "left_semi"), "cold")
    hot = written(asked_keys.join(size.where(F.col("m") > bucket).select("key"), "key", "left_semi").select("node").distinct(), "hot")
    drop_written(asked)
    met = cold.select("node").unionByName(hot).unionByName(near.select(F.col("u").alias("node"))).unionByName(near.select(F.col("v").alias("node"))).distinct()
    # One text of each hash is dealt out, so a text with many copies is no hot key.
    one = texts.groupBy("node").agg(F.first("text").alias("text")).join(met.hint("merge"), "node", "left_semi")
    sets = _arrays(one, lambda t: shingles(t, width), "s").select("node", F.size("s").alias("n"), "s")
    sets = written(sets, "sets")
    out = written(_verified(near, sets, similarity), "simhash_links")
    roots = written(components(out).select(F.col("u").alias("node"), "root"), "simhash_roots")
    side = _rooted(cold, roots)
    a, b = (side.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "uv")
    pairs = a.join(b, "key").where("u < v and ru != rv").select("u", "v").distinct()
    out = out.unionByName(_verified(pairs, sets, similarity))
    if hot.limit(1).count():
        out = out.unionByName(prefix_links(written(_rooted(sets.join(hot, "node", "left_semi"), roots), "hot_sets"), similarity, bucket))
    return out.distinct()


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text): component_id is the smallest doc_id reachable by
    links of at least this Jaccard similarity, the row's own included.

    Texts without words link to each other; repeated rows stay rows of their own; a null doc_id is never a
    component's smallest unless all are null; other columns are ignored. Texts and shingles are told apart by
    64-bit hashes.
    """
    texts = docs.select(_node().alias("node"), F.col("text").cast("string").alias("text"))
    rows = written(docs.select(F.col("doc_id").cast("long"), _node().alias("node")), "rows")
    each = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("__n")), "distinct")
    roots = components(links(texts, similarity, width, bucket)).select(F.col("u").alias("node"), "root")
    roots = written(each.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("__n"))
    ids = join_by_key(roots.select("node", "root"), least.select("root", "component_id"), "root", least.select("root", "__n"), roots.count())
    return join_by_key(rows, ids.select("node", "component_id"), "node", each.select("node", "__n"), rows.count()).select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, once if its doc_id is repeated."""
    return simhash.keep_smallest(docs, near_copies(docs, similarity))

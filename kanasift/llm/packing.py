"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so their histogram, of at most `capacity` rows at any size of
the input, decides the packing: large pieces (over a third of the capacity, so at most two fit in a sequence)
are paired greedily, the longest with the longest that still fits; small pieces, longest first, go to the
fullest sequence that still takes them. The plan says which ranks of each length go to which sequences, and
each piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from .tokens import batches_of_texts, encoder

END = (0).to_bytes(4, "little")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset), ranks from 0 per length.

    Pieces of rank r in a row stand in sequence first + (r - first rank) // pieces, at
    offset + ((r - first rank) % pieces) * length. Every rank of every length is in exactly one row.
    """
    rows, used = [], defaultdict(int)  # used: ranks given so far
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges of sequences [lo, hi)
    order: list[int] = []  # the keys of gaps, ascending
    made = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n

    def room(gap: int, lo: int, hi: int) -> None:
        if gap and hi > lo:
            if gap not in gaps:
                insort(order, gap)
            gaps[gap].append((lo, hi))

    left = {k: n for k, n in histogram.items() if n}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b is None:
            n = left[a]
            put(a, n, made, 1, 0)
        elif b == a:
            n = left[a] // 2
            if n:
                put(a, 2 * n, made, 2, 0)
            else:  # one piece of this length is left: the next shorter one joins it
                n, c = 1, large[k - 1] if k else None
                put(a, 1, made, 1, 0)
                if c is not None:
                    put(c, 1, made, 1, a)
                    left[c] -= 1
                b = c
        else:
            n = min(left[a], left[b])
            put(a, n, made, 1, 0)
            put(b, n, made, 1, a)
            left[b] -= n
        left[a] -= 2 * n if b == a else n
        room(capacity - a - (b or 0), made, made + n)
        made += n
        large = [x for x in large if left[x]]

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[length]
        while n:
            k = bisect_left(order, length)
            if k == len(order):
                each = capacity // length
                lo, hi, gap, offset = made, made + -(-n // each), capacity, 0
                made = hi
            else:
                gap = order[k]
                lo, hi = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(k)
                each, offset = gap // length, capacity - gap
            full = min(hi - lo, n // each)
            if full:
                put(length, full * each, lo, each, offset)
                room(gap - each * length, lo, lo + full)
                n -= full * each
                lo += full
            if n and lo < hi:
                put(length, n, lo, each, offset)
                room(gap - n * length, lo, lo + 1)
                n, lo = 0, lo + 1
            room(gap, lo, hi)
    return rows


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """The pieces of docs (doc_id, text), with part and k: the task that made a piece, and its place among that
    task's pieces of its length. A document has its ids and id 0; only one over capacity is cut, its first
    piece being the remainder. Null texts count as empty (one piece of one id).
    """

    def run(batches):
        from pyspark import TaskContext

        code, part, seen = encoder(path), TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, some in batches_of_texts(texts):
                out = []
                for doc_id, x in zip(ids[at : at + len(some)], code.encode(some), strict=True):
                    x += END
                    n = len(x) // 4
                    start, end, piece = 0, (n - 1) % capacity + 1, 0
                    while start < n:
                        out.append((doc_id, piece, start, end - start, zlib.crc32(memoryview(x)[4 * start : 4 * end]), part, seen[end - start]))
                        seen[end - start] += 1
                        start, end, piece = end, end + capacity, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def place(made: DataFrame, capacity: int) -> DataFrame:
    """made, a written table with (length, part, k), with sequence_id long and offset long instead of part and k.

    A piece's rank among those of its length is the number of such pieces in earlier parts plus k, so no
    length, however common, is gathered in one task. The plan has a bounded number of rows and is broadcast.
    """
    spark = made.sparkSession
    # One row a length and task grows with the tasks, so it is never broadcast; a key has one task's pieces at most.
    each = written(made.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    before = each.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    histogram = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is empty or longer than the capacity")
    rows = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, first long, each long, base long")
    ranked = made.join(before.hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("k")).drop("before", "part", "k")
    found = ranked.join(F.broadcast(rows), (ranked["length"] == rows["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).drop(rows["length"])
    nth = F.col("rank") - F.col("lo")
    return found.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each"))).withColumn("offset", F.col("base") + nth % F.col("each") * F.col("length")).drop("rank", "lo", "hi", "first", "each", "base")


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """One row a piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Empty and null texts are pieces of one id, repeated rows are packed each, ties of length are told apart by
    task and order, no rows give no rows, other columns are ignored. Sequences are numbered from 0.
    """
    made = written(pieces(docs, capacity, path), "pieces")
    return place(made, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long"), F.col("offset").cast("long"))

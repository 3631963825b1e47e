"""Benchmark decontamination: every training passage is a BM25 query on an inverted index of the test items.

Postings are lists of (item, impact) by term, in blocks of items with each block's largest impact. Impacts are
divided by the item's score for its own text, so the threshold is a share of a full match. Of each item, the rarest
terms are pivots, as many as are needed for the others together to stay below REST: without some of them no item
reaches the threshold. So only the pivots of a passage are looked up; the sum of their block maxima and the block's
rest bounds the scores there, and where that bound and then the one over all terms reach the threshold, the block's
postings are scored (block-max WAND, all passages of a batch at once). All items at or above the threshold are then
verified by the overlap of their question and answer with the passage.

Passages overlap by half, so any run of up to half a passage stands whole in one. How long they are goes by the
item's own length, in powers of two, and document frequencies and the mean length are the whole benchmark's, so what
is found of an item does not depend on how items are grouped. Indexes are bounded by items and characters; a
larger benchmark means more of them, several of which go through the documents at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Items and characters of one index, unless one item has more; items of one block in it; indexes sent at once.
GROUP, CHARACTERS, BLOCK, AT_ONCE = 20_000, 4_000_000, 8, 4
#: Words by which passages advance at least; a passage has twice as many.
STRIDE = 64
#: Share of an item's own score from which it is retrieved, and of its shingles from which it is found.
RETRIEVE, OVERLAP = 0.5, 0.8
#: Share of an item's own score that its terms other than pivots have together at most.
REST = 0.3
SHINGLE = 5
#: Entries of lists that are summed up at once; items whose shingles are remembered.
ENTRIES, REMEMBERED = 4_000_000, 5000
#: Characters beyond which a text's words are not held all at once.
LONG = 1_000_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words, cut before its last sentence or line; with one sentence only, before its last quarter."""
    parts = [w for w in (words(x) for x in re.split(r"[.?!\n]+", text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    ws = words(text)
    n = max(1, len(ws) // 4)
    return ws[:-n] or ws, ws[-n:]


def shingles(ws: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of n words; all the words as one run if there are fewer."""
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


class Statistics(dict):
    """Of the whole benchmark: in how many items each word is, how many items have words, and their mean length."""

    def __init__(self, texts: Iterable[str | None]):
        super().__init__()
        self.items = total = 0
        for t in texts:
            ws = words(t)
            self.items += bool(ws)
            total += len(ws)
            for w in set(ws):
                self[w] = self.get(w, 0) + 1
        self.mean = total / max(1, self.items)


@dataclass
class Lists:
    """Postings of the items whose passages advance by one stride, sorted by term and item; numbers are within these items."""

    stride: int
    places: np.ndarray  # of each item: its place in the index
    blocks: int
    item: np.ndarray
    impact: np.ndarray
    keys: np.ndarray  # term * blocks + block of each list block, ascending
    begin: np.ndarray  # of each list block: its first posting, and the end
    highest: np.ndarray  # of each list block: the largest impact
    pivot: np.ndarray  # of each term, and False for none: whether it is an item's pivot
    pivot_begin: np.ndarray  # of each term: its first pivot block, and the end
    pivot_block: np.ndarray
    pivot_highest: np.ndarray
    rest: np.ndarray  # of each block: the largest share that an item has in terms other than its pivots


@dataclass
class Index:
    ids: list
    vocabulary: dict[str, int]
    texts: np.ndarray  # the items' words by number, one item after another
    begin: np.ndarray  # of each item: its first word, and the end
    answer: np.ndarray  # of each item: its answer's first word
    lists: list[Lists]
    known: dict = field(default_factory=dict)

    @property
    def stride(self) -> int:
        """The shortest stride of any item."""
        return self.lists[0].stride

    def shingles(self, place: int) -> tuple[set, set, set]:
        """Runs of the question, of the answer and of the whole of an item."""
        if place not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            lo, cut, hi = int(self.begin[place]), int(self.answer[place]), int(self.begin[place + 1])
            # An item of one word is its own question.
            self.known[place] = tuple(shingles(self.texts[x:y].tolist()) for x, y in ((lo, cut if cut > lo else hi), (cut, hi), (lo, hi)))
        return self.known[place]


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .., of size[0] numbers, then those of begin[1], .."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _lists(stride: int, places: list[int], counts: list[dict[int, int]], frequency: np.ndarray, n: int, mean: float) -> Lists:
    blocks, terms = -(-len(places) // BLOCK), len(frequency)
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
    term, item, impact, pivots = [], [], [], []
    rest = np.zeros(blocks)
    for k, c in enumerate(counts):
        t, tf = np.fromiter(c.keys(), np.int64, len(c)), np.fromiter(c.values(), np.float64, len(c))
        share = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean))
        share /= share.sum()
        order = np.lexsort((t, frequency[t]))
        left = share.sum() - np.cumsum(share[order])
        last = int(np.argmax(left <= REST))
        some = np.zeros(len(t), bool)
        some[order[: last + 1]] = True
        rest[k // BLOCK] = max(rest[k // BLOCK], left[last])
        for out, x in ((term, t), (item, np.full(len(t), k)), (impact, share), (pivots, some)):
            out.append(x)
    term, item, impact, pivots = (np.concatenate(x) for x in (term, item, impact, pivots))
    order = np.lexsort((item, term))
    term, item, impact, pivots = term[order], item[order], impact[order], pivots[order]

    def maxima(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = term[some] * blocks + item[some] // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.r_[first, len(key)], np.maximum.reduceat(impact[some], first)

    keys, begin, highest = maxima(np.ones(len(term), bool))
    pivot_keys, _, pivot_highest = maxima(pivots)
    pivot = np.zeros(terms + 1, bool)
    pivot[term[pivots]] = True
    return Lists(stride, np.array(places), blocks, item.astype(np.int32), impact, keys, begin, highest, pivot, np.searchsorted(pivot_keys // blocks, np.arange(terms + 1)), pivot_keys % blocks, pivot_highest, rest)


def build(items: list[tuple[int, str]], stride: int = STRIDE, statistics: Statistics | None = None) -> Index | None:
    """The index of items (item_id, text); items without words are left out, None without any.

    Without statistics these items are the whole benchmark. An item's passages advance by its length and a quarter at least.
    """
    statistics = Statistics(t for _, t in items) if statistics is None else statistics
    kept = [(i, ws, len(question_and_answer(t)[1])) for i, t in items if (ws := words(t))]
    if not kept:
        return None
    vocabulary: dict[str, int] = {}
    texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in ws] for _, ws, _ in kept]
    begin = np.cumsum([0, *map(len, texts)])
    frequency = np.array([statistics[w] for w in vocabulary], np.float64)
    classes: dict[int, list[int]] = {}
    for k, x in enumerate(texts):
        own = stride
        while own < len(x) + len(x) // 4:
            own *= 2
        classes.setdefault(own, []).append(k)
    lists = [_lists(own, some, [Counter(texts[k]) for k in some], frequency, statistics.items, statistics.mean) for own, some in sorted(classes.items())]
    answer = begin[1:] - [n for *_, n in kept]
    return Index([i for i, *_ in kept], vocabulary, np.array([w for x in texts for w in x], np.int32), begin, answer, lists)


def numbered(index: Index, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all texts' words, -1 for words of no item; where each text begins, and the end); a text may be its words."""
    get, out = index.vocabulary.get, []
    for t in texts:
        if isinstance(t, str) and len(t) > LONG:
            out.append(np.fromiter((get(m[0], -1) for m in _WORD.finditer(t.lower())), np.int32))
        else:
            ws = words(t) if t is None or isinstance(t, str) else t
            out.append(np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws)))
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum([0, *map(len, out)])


def _candidates(lists: Lists, ids: np.ndarray, begin: np.ndarray, base: np.ndarray, retrieve: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, first word in ids, blocks) of passages whose pivots let some blocks reach `retrieve`."""
    at = np.flatnonzero(lists.pivot[ids])
    text = np.searchsorted(begin, at, side="right") - 1
    chunk, term = (at - begin[text]) // lists.stride, ids[at].astype(np.int64)
    one, two = base[text] + chunk < base[text + 1], chunk > 0
    terms = len(lists.pivot)
    keys = np.unique(np.concatenate([(base[text] + chunk)[one] * terms + term[one], (base[text] + chunk - 1)[two] * terms + term[two]]))
    passage, term = keys // terms, keys % terms
    size = lists.pivot_begin[term + 1] - lists.pivot_begin[term]
    so_far, lo = np.cumsum(size), 0
    while lo < len(keys):
        # Whole passages only: a cut goes to the first key of its passage, or behind it if there is no other.
        hi = int(np.searchsorted(so_far, (so_far[lo - 1] if lo else 0) + ENTRIES, side="right"))
        if hi < len(keys):
            cut = int(np.searchsorted(passage, passage[hi]))
            hi = cut if cut > lo else int(np.searchsorted(passage, passage[hi], side="right"))
        rows = _ranges(lists.pivot_begin[term[lo:hi]], size[lo:hi])
        pair = np.repeat(passage[lo:hi], size[lo:hi]) * lists.blocks + lists.pivot_block[rows]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
        bound = np.add.reduceat(lists.pivot_highest[rows][order], first) if len(first) else np.zeros(0)
        pair = pair[first]
        pair = pair[bound + lists.rest[pair % lists.blocks] >= retrieve - 1e-6]
        places, starts = np.unique(pair // lists.blocks, return_index=True)
        for p, x, y in zip(places.tolist(), starts.tolist(), np.append(starts, len(pair))[1:].tolist(), strict=True):
            t = int(np.searchsorted(base, p, side="right")) - 1
            yield t, int(begin[t]) + (p - int(base[t])) * lists.stride, pair[x:y] % lists.blocks
        lo = hi


def _scored(lists: Lists, terms: np.ndarray, blocks: np.ndarray, retrieve: float) -> Iterator[tuple[int, float]]:
    """(place, score) of the items in some blocks that score at least `retrieve` with these terms."""
    asked = (terms[:, None] * lists.blocks + blocks[None, :]).ravel()
    at = np.minimum(np.searchsorted(lists.keys, asked), len(lists.keys) - 1)
    which = np.flatnonzero(lists.keys[at] == asked)
    at, which = at[which], which % len(blocks)
    enough = np.bincount(which, lists.highest[at], len(blocks)) >= retrieve - 1e-6
    at, which = at[enough[which]], which[enough[which]]
    size = lists.begin[at + 1] - lists.begin[at]
    rows = _ranges(lists.begin[at], size)
    scores = np.bincount(np.repeat(which, size) * BLOCK + lists.item[rows] % BLOCK, lists.impact[rows], len(blocks) * BLOCK)
    for k in np.flatnonzero(scores >= retrieve).tolist():
        yield int(lists.places[int(blocks[k // BLOCK]) * BLOCK + k % BLOCK]), float(scores[k])


def _search(index: Index, ids: np.ndarray, begin: np.ndarray, retrieve: float) -> Iterator[tuple[int, int, int, float, int]]:
    for lists in index.lists:
        base = np.r_[0, np.cumsum(np.maximum(1, -(-np.diff(begin) // lists.stride) - 1))]
        for t, at, blocks in _candidates(lists, ids, begin, base, retrieve):
            terms = np.unique(ids[at : min(at + 2 * lists.stride, int(begin[t + 1]))]).astype(np.int64)
            for place, score in _scored(lists, terms[terms >= 0], blocks, retrieve):
                yield t, at - int(begin[t]), place, score, lists.stride


def search(index: Index, texts: list, retrieve: float = RETRIEVE) -> list[tuple[int, int, int, float]]:
    """(text, first word of the passage, item's place, score) of all items that score at least `retrieve`."""
    return [x[:4] for x in _search(index, *numbered(index, texts), retrieve)]


def matches(index: Index, texts: list, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> list[tuple[int, object, float, float, float, int, float]]:
    """(text, item_id, score, question's, answer's overlap, first word of the passage, whole item's overlap), the best passage of each.

    An item is found if `overlap` of the shingles of its question and of its answer stand in the passage, or of its whole.
    """
    ids, begin = numbered(index, texts)
    best: dict[tuple[int, int], tuple] = {}
    seen: dict[tuple[int, int, int, int], set] = {}
    for text, first, item, score, stride in _search(index, ids, begin, retrieve):
        found = []
        for part in index.shingles(item):
            n = len(next(iter(part)))
            key = (text, first, stride, n)
            if key not in seen:
                lo = int(begin[text]) + first
                ws = ids[lo : min(lo + 2 * stride, int(begin[text + 1]))].tolist()
                seen[key] = set(zip(*(ws[k:] for k in range(n)), strict=False))
            found.append(len(part & seen[key]) / len(part))
        share = max(min(found[:2]), found[2])
        if share >= overlap and (share, score) > best.get((text, item), (-1, -1))[:2]:
            best[text, item] = (share, score, *found, first)
    return [(text, index.ids[item], score, q, a, first, whole) for (text, item), (_, score, q, a, whole, first) in sorted(best.items())]


def indexes(benchmark: DataFrame, group: int = GROUP, characters: int = CHARACTERS, stride: int = STRIDE):
    """One broadcast index after another, of at most `group` items of benchmark (item_id, text) and so many characters each.

    The driver goes through the benchmark twice, a partition at a time, and holds its words' frequencies and one index.
    """
    statistics = Statistics(r[0] for r in benchmark.select("text").toLocalIterator())
    some, size = [], 0

    def made():
        x = build(some, stride, statistics)
        return [benchmark.sparkSession.sparkContext.broadcast(x)] if x else []

    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if some and (len(some) == group or size + len(r[1] or "") > characters):
            yield from made()
            some, size = [], 0
        some.append((r[0], r[1]))
        size += len(r[1] or "")
    yield from made()


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """The indexes, AT_ONCE at a time."""
    all_of_them = indexes(benchmark)
    while some := list(islice(all_of_them, AT_ONCE)):
        yield some


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long, overlap double"
#: Texts searched at once: rows, and characters.
ROWS, CHARS = 500, 2_000_000


def _runs(texts):
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if k + 1 - at == ROWS or size >= CHARS:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def leaks(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """One row for each row of docs (doc_id, text) and benchmark item that it holds, with its best passage.

    Null and empty texts hold nothing, nor is an item without words held by any; texts and items of any length are
    taken whole; repeated rows are searched each, as are repeated items; ties of passages go to the first; empty
    tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "overlap"]
    for some in _passes(benchmark):

        def run(batches, some=some):
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lo, hi in _runs(texts):
                    found = [(ids[lo + k], item, *rest) for index in some for k, item, *rest in matches(index.value, texts[lo:hi], retrieve, overlap)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        out = out.unionByName(rows.mapInArrow(run, FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; odd input as in leaks()."""
    at = docs.columns.index("text")
    for some in _passes(benchmark):

        def run(batches, some=some):
            for b in batches:
                texts, keep = b.column(at).to_pylist(), np.ones(b.num_rows, bool)
                for lo, hi in _runs(texts):
                    for index in some:
                        for k, *_ in matches(index.value, texts[lo:hi], retrieve, overlap):
                            keep[lo + k] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

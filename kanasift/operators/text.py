"""Texts with offsets: normalization that remembers where each character came from, categories, word starts."""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache, reduce
from io import StringIO
from itertools import accumulate
from operator import and_

import numpy as np

#: Character categories as bits.
CATEGORIES = {
    "DEFAULT": 1, "SPACE": 2, "KANJI": 4, "SYMBOL": 8, "NUMERIC": 16, "ALPHA": 32, "HIRAGANA": 64, "KATAKANA": 128,
    "KANJINUMERIC": 256, "GREEK": 512, "CYRILLIC": 1024, "USER1": 2048, "USER2": 4096, "USER3": 8192, "USER4": 16384, "NOOOVBOW": 32768,
}
NOOOVBOW, KANJI, HIRAGANA, KATAKANA = (CATEGORIES[c] for c in ("NOOOVBOW", "KANJI", "HIRAGANA", "KATAKANA"))
NUMBERS = CATEGORIES["NUMERIC"] | CATEGORIES["KANJINUMERIC"]
#: Scripts whose letters begin a word only where the category changes.
SPACED = CATEGORIES["ALPHA"] | CATEGORIES["GREEK"] | CATEGORIES["CYRILLIC"]


class Categories(dict):
    """Category bits by character, of those that were asked for."""

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, ch: str) -> int:
        got = self[ch] = int(self.bits[ord(ch)])
        return got


class CharTable:
    """Code point -> category bits: the union of all ranges that hold it, DEFAULT if none does."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.ranges = ranges

    @cached_property
    def bits(self) -> np.ndarray:
        """The category bits of every code point, made when first asked for and never sent along."""
        out = np.zeros(0x110000, np.int32)
        for lo, hi, cats in self.ranges:
            out[lo : hi + 1] |= cats
        out[out == 0] = 1
        return out

    @cached_property
    def known(self) -> dict[str, int]:
        return Categories(self.bits)

    def __getstate__(self):
        return {"ranges": self.ranges}

    def of(self, ch: str) -> int:
        return self.known[ch]

    def letters(self, cats: int) -> str:
        """All characters of some categories, as what stands in the brackets of a regular expression."""
        edges = np.flatnonzero(np.diff(self.bits & cats != 0, prepend=False, append=False))
        return "".join(f"{re.escape(chr(lo))}-{re.escape(chr(hi - 1))}" for lo, hi in edges.reshape(-1, 2).tolist())


class Draft:
    """A text being rewritten: its present characters and, for each and for the end, the original index (places)."""

    def __init__(self, original: str):
        self.original = self.text = original
        self.places: range | array = range(len(original) + 1)

    @classmethod
    def of(cls, original: str) -> Draft:
        return cls(original)

    @classmethod
    def by(cls, original: str, rewriters: list, table: CharTable) -> Draft:
        out = cls(original)
        for r in rewriters:
            if hasattr(r, "rewrite_all"):
                r.rewrite_all(out)
            else:
                out.apply(r.edits(out.text, table))
        return out

    @property
    def source(self) -> list[int]:
        return list(self.places)

    @property
    def offsets(self) -> np.ndarray:
        """source as an array."""
        return np.arange(len(self.places), dtype=np.int32) if isinstance(self.places, range) else np.array(self.places, np.int32)

    def apply(self, edits: Iterable[tuple[int, int, str]]) -> None:
        """Replaces [begin, end) by a string for each of edits, which are in order and apart.

        The first new character comes from begin, all others from end, so that they have no width.
        """
        text, places, at = None, None, 0
        for begin, end, new in edits:
            if not at <= begin < end:
                raise ValueError("an edit is empty or out of order")
            if text is None:
                text, places = StringIO(), array("i")
            end = min(end, len(self.text))
            text.write(self.text[at:begin])
            text.write(new)
            places.extend(self.places[at:begin])
            if new:
                places.append(self.places[begin])
                places.extend([self.places[end]] * (len(new) - 1))
            at = end
        if text is not None:
            text.write(self.text[at:])
            places.extend(self.places[at:])
            self.text, self.places = text.getvalue(), places

    def original_end(self, at: int) -> int:
        """The last index that stands at the same original place as `at`."""
        while at < len(self.text) and self.places[at + 1] == self.places[at]:
            at += 1
        return at

    def slice(self, begin: int, end: int, table: CharTable) -> Text:
        """A sentence, with offsets of its own into its part of the original."""
        first, places = self.places[begin], self.places[begin : end + 1]
        own = list(range(len(places))) if isinstance(places, range) else [p - first for p in places]
        return Text(self.original[first : self.places[end]], self.text[begin:end], own, table)


@lru_cache(maxsize=1 << 17)
def _lower(ch: str) -> str:
    """The simple lower case of one character."""
    low = ch.lower()
    return low if len(low) == 1 else low[0]


class Normalize:
    """Lower case and compatibility forms, character by character; pairs of a table are replaced first, longest first.

    Characters of `ignore` keep their form (but for case).
    """

    def __init__(self, replace: dict[str, str] | None = None, ignore: set[str] | None = None):
        self.replace, self.ignore, self.known = dict(replace or {}), set(ignore or ()), {}
        self.same: set[str] = set()  # characters met that keep their form
        self.first, self.met, self.patterns = {k[0] for k in self.replace}, set(), {}

    def one(self, ch: str) -> str:
        got = self.known.get(ch)
        if got is None:
            low = _lower(ch)
            got = self.known[ch] = low if low in self.ignore else unicodedata.normalize("NFKC", low)
        return got

    def _changes(self, text: str) -> tuple[dict[str, str], bool]:
        """The text's characters that get another form, and whether any pair of the table may begin in it."""
        changes = {}
        for ch in set(text).difference(self.same):
            if (new := self.one(ch)) != ch:
                changes[ch] = new
            else:
                self.same.add(ch)
        return changes, not self.first.isdisjoint(text)

    def _pattern(self, changes: dict[str, str], pairs: bool) -> re.Pattern | None:
        # Characters that were met once stay in the pattern, so it is compiled a few times only.
        if not changes.keys() <= self.met:
            self.met |= changes.keys()
            self.patterns.clear()
        if pairs not in self.patterns:
            some = sorted(self.replace, key=len, reverse=True) if pairs else []
            parts = [re.escape(k) for k in some] + ([f"[{re.escape(''.join(sorted(self.met)))}]"] if self.met else [])
            self.patterns[pairs] = re.compile("|".join(parts)) if parts else None
        return self.patterns[pairs]

    def edits(self, text: str, table: CharTable) -> Iterator[tuple[int, int, str]]:
        changes, pairs = self._changes(text)
        if (changes or pairs) and (pattern := self._pattern(changes, pairs)):
            for m in pattern.finditer(text):
                new = self.replace.get(m[0]) if pairs else None
                new = self.one(m[0]) if new is None else new
                if new != m[0] or m.end() - m.start() > 1:
                    yield m.start(), m.end(), new

    def rewrite_all(self, draft: Draft) -> None:
        """edits() applied; where each character stays one character, places do not change."""
        changes, pairs = self._changes(draft.text)
        if pairs or any(len(new) != 1 for new in changes.values()):
            draft.apply(self.edits(draft.text, None))
        elif changes:
            draft.text = draft.text.translate({ord(ch): new for ch, new in changes.items()})


class Prolonged:
    """Runs of two or more prolonged sound marks become one symbol."""

    def __init__(self, marks: list[str], symbol: str):
        self.runs = re.compile(f"[{re.escape(''.join(marks))}]{{2,}}") if marks else None
        self.symbol = symbol

    def edits(self, text: str, table: CharTable) -> Iterator[tuple[int, int, str]]:
        for m in self.runs.finditer(text) if self.runs else ():
            yield m.start(), m.end(), self.symbol


class Yomigana:
    """Kanji, bracket, one to `longest` kana, bracket: the bracketed reading goes, the kanji stays."""

    def __init__(self, left: list[str], right: list[str], longest: int = 4):
        self.left, self.right, self.longest, self.pattern = "".join(left), "".join(right), longest, (None, None)

    def __getstate__(self):
        return {**self.__dict__, "pattern": (None, None)}

    def edits(self, text: str, table: CharTable) -> Iterator[tuple[int, int, str]]:
        if not self.right or self.longest < 1 or not any([ch in text for ch in self.left]):
            return
        if self.pattern[0] is not table:
            inside = lambda x: f"[{re.escape(x)}]"
            self.pattern = table, re.compile(f"([{table.letters(KANJI)}]){inside(self.left)}[{table.letters(HIRAGANA | KATAKANA)}]{{1,{self.longest}}}{inside(self.right)}")
        for m in self.pattern[1].finditer(text):
            yield m.start(), m.end(), m[1]


def _cuts(cats: list[int], first: int = 0) -> list[int]:
    """Where runs of characters that all share a category begin, one character after another."""
    out, shared = [], 0
    for at, c in enumerate(cats, first):
        shared &= c
        if not shared:
            out.append(at)
            shared = c
    return out


def _runs(cats: np.ndarray) -> np.ndarray:
    """_cuts() of an array."""
    starts = np.flatnonzero(_first(cats[1:] & cats[:-1] == 0))
    torn = np.flatnonzero(np.bitwise_and.reduceat(cats, starts) == 0)
    if not len(torn):
        return starts
    # Neighbours share one each, but not all of them the same: such a stretch is gone through by itself.
    ends = np.append(starts[1:], len(cats))
    more = [x for k in torn.tolist() for x in _cuts(cats[starts[k] : ends[k]].tolist(), int(starts[k]))]
    return np.union1d(starts, more).astype(starts.dtype)


def _first(rest: np.ndarray) -> np.ndarray:
    """True, then the rest."""
    out = np.empty(len(rest) + 1, bool)
    out[0] = True
    out[1:] = rest
    return out


#: Characters from which a sentence's figures are made by array operations; below, a loop is faster.
LONG = 150


class Text:
    """A normalized sentence: per character its category bits, the end of its category run, whether a word may begin.

    byte[k] is the UTF-8 offset of character k; source[k] its place in the original. Indices are code points. All
    are made when first asked for.
    """

    def __init__(self, original: str, text: str, source: list[int], table: CharTable):
        self.original, self.text, self.source, self.table = original, text, source, table
        self.long = len(text) >= LONG

    @classmethod
    def of(cls, original: str, rewriters: list, table: CharTable) -> Text:
        draft = Draft.by(original, rewriters, table)
        return cls(original, draft.text, draft.source, table)

    # As arrays

    @cached_property
    def codes(self) -> np.ndarray:
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)

    @cached_property
    def categories(self) -> np.ndarray:
        return self.table.bits[self.codes]

    @cached_property
    def begins(self) -> np.ndarray:
        c = self.categories
        return _first((c[1:] & SPACED == 0) | (c[1:] & c[:-1] == 0)) if len(c) else np.zeros(0, bool)

    @property
    def n_runs(self) -> int:
        """Runs of characters that each share a category with the one before, but maybe none with all others."""
        c = self.categories
        return int(np.count_nonzero(c[1:] & c[:-1] == 0)) + 1 if len(c) else 0

    @cached_property
    def runs(self) -> np.ndarray:
        return _runs(self.categories) if self.text else np.zeros(0, np.int64)

    # As lists

    @cached_property
    def cats(self) -> list[int]:
        return self.categories.tolist() if self.long else list(map(self.table.known.__getitem__, self.text))

    @cached_property
    def bow(self) -> list[bool]:
        if self.long:
            return self.begins.tolist()
        cats = self.cats
        return [True, *(not c & SPACED or not c & b for b, c in zip(cats, cats[1:], strict=False))][: len(cats)]

    @cached_property
    def run_start(self) -> list[bool]:
        out = [False] * len(self.text)
        for at in self.runs.tolist() if self.long else _cuts(self.cats):
            out[at] = True
        return out

    def _next(self, marked: list[bool]) -> list[int]:
        """Of each character, the next marked place behind it, or the end."""
        out, stop = [0] * len(marked), len(marked)
        for at in range(len(marked) - 1, -1, -1):
            out[at] = stop
            if marked[at]:
                stop = at
        return out

    def _next_of(self, marked: np.ndarray) -> list[int]:
        return np.append(np.flatnonzero(marked), len(marked))[np.cumsum(marked)].tolist()

    @cached_property
    def run_end(self) -> list[int]:
        if not self.long:
            return self._next(self.run_start)
        marked = np.zeros(len(self.text), bool)
        marked[self.runs] = True
        return self._next_of(marked)

    @cached_property
    def following(self) -> list[int]:
        """Of each character, the next place behind it where a word may begin, or the end."""
        return self._next_of(self.begins) if self.long else self._next(self.bow)

    @cached_property
    def byte(self) -> list[int]:
        if self.text.isascii():
            return list(range(len(self.text) + 1))
        if self.long:
            c = self.codes
            return np.append(0, np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))).tolist()
        return [0, *accumulate(1 if ch < "\x80" else 2 if ch < "\u0800" else 3 if ch < "\U00010000" else 4 for ch in self.text)]

    def span_cats(self, begin: int, end: int) -> int:
        """Categories that all characters of a span share; none if it goes over the end of a category run."""
        if self.run_end[begin] < end:
            return 0
        return reduce(and_, self.cats[begin:end])

    def next_bow(self, at: int) -> int:
        return self.following[at]

    def at_byte(self, byte: int) -> int:
        """The character that holds a UTF-8 offset, or the length."""
        return bisect_right(self.byte, byte) - 1


def utf16_offsets(text: str) -> list[int]:
    """UTF-16 index of each code point of a text and of its end."""
    if not text or max(text) <= "\uffff":
        return list(range(len(text) + 1))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.r_[0, np.cumsum(1 + (codes > 0xFFFF))].tolist()

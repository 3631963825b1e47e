"""Dictionaries as plain values on the driver: words, parts of speech, connection costs; and their lookup form for tasks."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np

POS = tuple[str, str, str, str, str, str]
#: A connection of this cost is inhibited.
INHIBITED = 32767
#: A word of this cost gets one by analysis when its dictionary is added.
UNKNOWN_COST = -32768
#: Dictionaries of one engine: one system dictionary and user dictionaries.
MOST_DICTIONARIES = 15
WORD_BITS = 28


def word_id(dict_id: int, number: int) -> int:
    """Dictionary (4 bits) and word number (28 bits) as one number."""
    if not 0 <= number < 1 << WORD_BITS or not 0 <= dict_id < 16:
        raise ValueError(f"no word id: {dict_id}, {number}")
    return dict_id << WORD_BITS | number


def dict_of(wid: int) -> int:
    return wid >> WORD_BITS


def number_of(wid: int) -> int:
    return wid & (1 << WORD_BITS) - 1


@dataclass(frozen=True)
class Word:
    """headword is None where the word is only used in splits; dictionary_form is a word number of the same dictionary or -1."""

    headword: str | None
    left: int
    right: int
    cost: int
    surface: str
    pos_id: int
    reading: str
    normalized: str
    dictionary_form: int = -1
    a_split: tuple[int, ...] = ()
    b_split: tuple[int, ...] = ()
    structure: tuple[int, ...] = ()
    synonyms: tuple[int, ...] = ()


@dataclass
class Matrix:
    """cost(left, right) of a node whose right id is `left` before a node whose left id is `right`."""

    left_size: int
    right_size: int
    costs: array

    @classmethod
    def zero(cls, left_size: int, right_size: int) -> Matrix:
        return cls(left_size, right_size, array("h", bytes(2 * left_size * right_size)))

    def cost(self, left: int, right: int) -> int:
        return self.costs[left * self.right_size + right]

    def with_inhibited(self, pairs: Iterable[tuple[int, int]]) -> Matrix:
        costs = array("h", self.costs)
        for left, right in pairs:
            costs[left * self.right_size + right] = INHIBITED
        return Matrix(self.left_size, self.right_size, costs)


@dataclass
class Dictionary:
    """One dictionary as built: a user dictionary's parts of speech are the system's followed by its own."""

    words: list[Word]
    pos: list[POS]
    matrix: Matrix | None = None
    user: bool = False
    description: str = ""


@dataclass
class Lookup:
    """All dictionaries of an engine in one form that is sent to tasks. A word's place is its index in words."""

    pos: list[POS]
    matrix: Matrix
    words: list[Word] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)  # of each dictionary: its first word's place
    keys: list[dict[str, list[int]]] = field(default_factory=list)
    #: By first character: (headwords, their lengths) of each dictionary that has some, later dictionaries first.
    starts: dict[str, list[tuple[dict[str, list[int]], list[int]]]] = field(default_factory=dict)
    #: By first character, and of all: the length of the longest headword.
    reach: dict[str, int] = field(default_factory=dict)
    longest: int = 0
    _begins: tuple[int, np.ndarray] | None = field(default=None, compare=False, repr=False)

    @classmethod
    def of(cls, system: Dictionary) -> Lookup:
        out = cls(list(system.pos), system.matrix)
        out._append(system, lambda w, i: w)
        return out

    def _append(self, d: Dictionary, fitted: Callable[[Word, int], Word]) -> None:
        dict_id, start = len(self.first), len(self.words)
        self.first.append(start)
        keys: dict[str, list[int]] = {}
        for number, w in enumerate(d.words):
            w = fitted(w, number)
            self.words.append(w)
            self.ids.append(word_id(dict_id, number))
            if w.headword is not None and w.left >= 0:
                keys.setdefault(w.headword, []).append(start + number)
        lengths: dict[str, set[int]] = {}
        for k in keys:
            lengths.setdefault(k[0], set()).add(len(k))
        self.keys.append(keys)
        for k, v in lengths.items():
            self.reach[k] = max(self.reach.get(k, 0), max(v))
            self.longest = max(self.longest, max(v))
            self.starts.setdefault(k, []).insert(0, (keys, sorted(v)))

    @property
    def begins(self) -> np.ndarray:
        """Of each code point, whether a headword begins with it; made when first asked for and never sent along."""
        if self._begins is None or self._begins[0] != len(self.keys):
            out = np.zeros(0x110000, bool)
            out[[ord(ch) for ch in self.starts]] = True
            self._begins = len(self.keys), out
        return self._begins[1]

    def __getstate__(self):
        return {**self.__dict__, "_begins": None}

    def pos_id(self, pos: Iterable[str]) -> int:
        """The number of a part of speech, or -1."""
        try:
            return self.pos.index(tuple(pos))
        except ValueError:
            return -1

    def register_pos(self, pos: Iterable[str]) -> int:
        pos = tuple(pos)
        if len(pos) != 6 or any(x is None or len(x) > 127 for x in pos):
            raise ValueError(f"a part of speech has six parts of 127 characters at most: {pos}")
        if (k := self.pos_id(pos)) >= 0:
            return k
        self.pos.append(pos)
        return len(self.pos) - 1

    def add_user(self, d: Dictionary, system_pos: int, estimate: Callable[[Lookup, str], tuple[int, int]]) -> None:
        """Adds a user dictionary: its own parts of speech go behind those known, its split ids name its place here.

        estimate gives (cost by analysis, morphemes) of a surface with what has been added so far.
        """
        if len(self.first) >= MOST_DICTIONARIES:
            raise ValueError(f"more than {MOST_DICTIONARIES} dictionaries")
        dict_id, offset = len(self.first), len(self.pos) - system_pos
        own = lambda ids: tuple(word_id(dict_id, number_of(i)) if dict_of(i) else i for i in ids)

        def fitted(w: Word, number: int) -> Word:
            cost = w.cost
            if cost == UNKNOWN_COST:
                by, n = estimate(self, w.surface)
                cost = max(-32768, min(32767, by - 20 * n))
            pos = w.pos_id + offset if w.pos_id >= system_pos else w.pos_id
            return replace(w, cost=cost, pos_id=pos, a_split=own(w.a_split), b_split=own(w.b_split), structure=own(w.structure))

        # All costs are estimated before any of the dictionary's words can be found.
        words = [fitted(w, k) for k, w in enumerate(d.words)]
        self.pos += d.pos[system_pos:]
        self._append(replace(d, words=words), lambda w, i: w)

    def place(self, wid: int) -> int:
        return self.first[dict_of(wid)] + number_of(wid)

    def word(self, wid: int) -> Word:
        return self.words[self.place(wid)]

    def dictionary_form(self, place: int) -> str:
        """The surface of the word's dictionary form: a word of the same dictionary, or its own."""
        w = self.words[place]
        if w.dictionary_form < 0:
            return w.surface
        return self.words[self.first[dict_of(self.ids[place])] + w.dictionary_form].surface

    def prefixes(self, text: str, at: int):
        """(end, places) of all headwords that begin at `at`: later dictionaries first, in each the shortest first."""
        for keys, sizes in self.starts.get(text[at], ()):
            for size in sizes:
                if at + size <= len(text) and (found := keys.get(text[at : at + size])):
                    yield at + size, found

    def find(self, headword: str, pos_id: int, reading: str) -> int:
        """The id of a word by headword, part of speech and reading: user dictionaries in order, then the system's; -1."""
        order = [*range(1, len(self.first)), 0]
        for d in order:
            for p in self.keys[d].get(headword, ()):
                if self.words[p].pos_id == pos_id and self.words[p].reading == reading:
                    return self.ids[p]
        return -1

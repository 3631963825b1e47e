"""Candidates for words that no dictionary has. A provider's candidates() gives (end, left, right, cost, pos_id).

A provider may have only() as well: where a text falls into stretches of which each is the sole candidate at its
begin, as long as no dictionary word begins there.
"""

from __future__ import annotations

import re

import numpy as np

from .lattice import MOST, Lattice, Only, length_bit
from .text import CATEGORIES, Text


class Templates:
    """By character category: the whole run of like characters and its first few prefixes, one candidate a template.

    properties: category -> (always, group, length); templates: category -> [(left, right, cost, pos_id)].
    """

    def __init__(self, properties: dict[int, tuple[bool, bool, int]], templates: dict[int, list[tuple[int, int, int, int]]]):
        if unknown := set(templates) - set(properties):
            raise ValueError(f"templates of undefined categories: {sorted(unknown)}")
        self.kinds = [(bit, *properties[bit], templates[bit]) for bit in sorted(CATEGORIES.values()) if bit in properties and bit in templates]

        #: The one template of a set of categories where a whole run is the only candidate, by its number.
        self.templates, self.alone = [], {}

    def only(self, text: Text) -> Only:
        """The runs of a text, and the template where nothing else than the whole run is offered."""
        cuts = text.runs
        kinds, numbers = text.categories[cuts], []
        values, inverse = np.unique(kinds, return_inverse=True)
        for cats in values.tolist():
            if cats not in self.alone:
                found = [x for x in self.kinds if cats & x[0]]
                single = len(found) == 1 and found[0][2] and not found[0][3] and len(found[0][4]) == 1
                self.alone[cats] = len(self.templates) if single else -1
                self.templates += found[0][4] if single else []
            numbers.append(self.alone[cats])
        # A run's end counts if a word may begin there.
        return Only(cuts, np.where(text.begins[cuts], np.array(numbers, np.int64)[inverse], -1), self.templates)

    def candidates(self, lattice: Lattice, at: int, mask: int):
        text = lattice.text
        cats, end, out = text.cats[at], text.run_end[at], []
        for bit, always, group, length, templates in self.kinds:
            if cats & bit and (always or not mask):
                if group:
                    out += [(end, *t) for t in templates]
                for stop in range(at + 1, min(at + length, end - group) + 1):
                    out += [(stop, *t) for t in templates]
        return out


class Simple:
    """Only where nothing else is found: up to the next place where a word can begin."""

    def __init__(self, left: int, right: int, cost: int, pos_id: int):
        self.template = (left, right, cost, pos_id)

    def only(self, text: Text) -> Only:
        """All places where a word may begin."""
        cuts = np.flatnonzero(text.begins)
        return Only(cuts, np.zeros(len(cuts), np.int64), [self.template])

    def candidates(self, lattice: Lattice, at: int, mask: int):
        return () if mask else [(lattice.text.following[at], *self.template)]


class Pattern:
    """A match at the place, of max_length bytes at most; strict: only where a run of like characters begins."""

    def __init__(self, regex: str, left: int, right: int, cost: int, pos_id: int, max_length: int = 32, boundaries: str = "strict"):
        if boundaries.lower() not in ("strict", "relaxed"):
            raise ValueError(f"boundaries are strict or relaxed, not {boundaries}")
        for name, x in (("leftId", left), ("rightId", right), ("cost", cost)):
            if x > 32767:
                raise ValueError(f"{name} is over 32767")
        self.pattern = re.compile(regex.removeprefix("^"), re.ASCII)
        self.template, self.longest, self.strict = (left, right, cost, pos_id), max_length, boundaries.lower() == "strict"

    def candidates(self, lattice: Lattice, at: int, mask: int):
        text = lattice.text
        if self.strict and not text.run_start[at]:
            return
        m = self.pattern.match(text.text, at, text.at_byte(min(text.byte[at] + self.longest, text.byte[-1])))
        if not m or m.end() == at:
            return
        end, n = m.end(), text.byte[m.end()] - text.byte[at]
        if mask & length_bit(n) and (n <= MOST or lattice.ends[end]):
            return
        yield (end, *self.template)

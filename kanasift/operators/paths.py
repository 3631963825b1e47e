"""Rewriting of the cheapest path: joined numerals and katakana words. A rewriter takes and returns a list of nodes."""

from __future__ import annotations

from .lattice import Lattice, Node
from .numeral import read
from .text import KATAKANA, NOOOVBOW, NUMBERS


def joined(lattice: Lattice, nodes: list[Node], normalized: str | None = None) -> Node:
    """Nodes as one word with the first one's part of speech; not marked as out of vocabulary."""
    every = lambda f: "".join(map(f, nodes))
    info = (every(lattice.surface), lattice.pos_id(nodes[0]), every(lattice.normalized) if normalized is None else normalized, every(lattice.dictionary_form), every(lattice.reading))
    return Node(nodes[0].begin, nodes[-1].end, 0, 0, 0, -1, info)


class JoinNumbers:
    """Runs of numeric nodes that read as one numeral become one node with its plain decimal form.

    A run is as many nodes in a row as are digits, units, points and commas. A point or comma that breaks the
    numeral is punctuation from there to the next word, and the run ends before it; a digit or unit that does not
    fit ends it too, and what came before stays apart.
    """

    def __init__(self, pos_id: int, normalize: bool = True):
        self.pos_id, self.normalize = pos_id, normalize

    def _one(self, lattice: Lattice, run: list[Node], value: str) -> list[Node] | None:
        """The run as one node, or None if it stays as it is."""
        first = run[0]
        if lattice.pos_id(first) != self.pos_id or len(run) == 1 and (not self.normalize or value == lattice.normalized(first)):
            return None
        return [joined(lattice, run, value if self.normalize else None)]

    def rewrite(self, lattice: Lattice, path: list[Node]) -> list[Node]:
        forms = [lattice.normalized(x) for x in path]
        numeric = [bool(lattice.text.span_cats(x.begin, x.end) & NUMBERS) for x in path]
        if not any(numeric) and not {",", "."} & set(forms):
            return path
        out: list[Node] = []
        at, n, punctuation = 0, len(path), set()

        def keep(until: int) -> int:
            out.extend(path[at:until])
            return until

        while at < n:
            end = at
            while end < n and (numeric[end] or forms[end] in (",", ".") and forms[end] not in punctuation):
                end += 1
            if end == at:
                punctuation &= {forms[at]}
                at = keep(at + 1)
                continue
            found = read("".join(forms[at:end]))
            bad, chars = at, found.at
            while found.value is None and bad < end and chars >= len(forms[bad]):
                chars -= len(forms[bad])
                bad += 1
            if found.value is None and bad < end:
                if found.fault:
                    punctuation.add("," if found.fault == "comma" else ".")
                else:
                    at = keep(bad + 1)
                continue
            # The run is whole, or only its end is wrong: then a mark that hangs there is left out.
            last = end if found.value is not None else end - 1
            if found.value is None and (found.fault, forms[last]) not in (("comma", ","), ("point", ".")):
                last = at
            following = end + 1
            if last > at:
                if one := self._one(lattice, path[at:last], found.before if found.value is None else found.value):
                    out += one
                    at = last
                elif last - at > 1:
                    # The first word is no numeral: reading goes on behind the second, or the mark behind that.
                    following = at + 2 + (last < end)
            if end < n:
                punctuation &= {forms[end]}
            at = keep(min(following, n) if end < n else n)
        return out


class JoinKatakana:
    """Katakana around an unknown or short katakana node becomes one word: the cheapest known one of that span, or a new one."""

    def __init__(self, pos_id: int, min_length: int = 1):
        if min_length < 0:
            raise ValueError("minLength is negative")
        self.pos_id, self.min_length = pos_id, min_length

    def rewrite(self, lattice: Lattice, path: list[Node]) -> list[Node]:
        text, path, k = lattice.text, list(path), 0
        kana = lambda x: x.end > x.begin and text.span_cats(x.begin, x.end) & KATAKANA
        while k < len(path):
            x = path[k]
            if (x.oov or x.end - x.begin < self.min_length) and kana(x):
                begin, end = k, k + 1
                while begin and kana(path[begin - 1]):
                    begin -= 1
                while end < len(path) and kana(path[end]):
                    end += 1
                while begin < end and text.cats[path[begin].begin] & NOOOVBOW:
                    begin += 1
                if end - begin > 1:
                    s = "".join(map(lattice.surface, path[begin:end]))
                    one = lattice.cheapest(path[begin].begin, path[end - 1].end) or Node(path[begin].begin, path[end - 1].end, 0, 0, 0, -1, (s, self.pos_id, s, s, ""), True)
                    path[begin:end] = [one]
                    k = begin + 1
            k += 1
        return path

"""The lattice of candidate words and its cheapest path, found while it is built."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from ..plans.dictionary import INHIBITED, Lookup
from .text import NOOOVBOW, Text

#: Bit of a word length in a mask; longer words share the last.
MOST = 63


def length_bit(n: int) -> int:
    return 1 << min(n, MOST + 1) - 1 if n > 0 else 0


class Node:
    """A candidate: place names a dictionary word (or -1), info a made-up one: (surface, pos_id, normalized, dictionary form, reading)."""

    __slots__ = ("begin", "end", "left", "right", "cost", "place", "info", "oov", "total", "prev", "seq")

    def __init__(self, begin, end, left, right, cost, place=-1, info=None, oov=False):
        self.begin, self.end, self.left, self.right, self.cost = begin, end, left, right, cost
        self.place, self.info, self.oov = place, info, oov
        self.total, self.prev, self.seq = None, None, -1


class Only(NamedTuple):
    """Stretches of a text, each from one cut to the next: the template (left, right, cost, pos_id) of each by number,
    or below 0 where there are other candidates or none."""

    cuts: np.ndarray
    kinds: np.ndarray
    templates: list[tuple[int, int, int, int]]


class Chain(Node):
    """Sole candidates one behind the other, from stretch lo to stretch hi, as one node until they are asked for."""

    __slots__ = ("hi", "lo", "only")

    def bounds(self) -> list[int]:
        """Where each stretch begins, and the end."""
        return [*self.only.cuts[self.lo : self.hi].tolist(), self.end]

    def templates(self) -> list[tuple[int, int, int, int]]:
        """The template of each stretch."""
        return list(map(self.only.templates.__getitem__, self.only.kinds[self.lo : self.hi].tolist()))


class NoPath(ValueError):
    """A text has no candidate at a place, or no path to its end."""


class Lattice:
    """All candidates of a text, connected as they come: ends[k] has the nodes that end at k, in order."""

    def __init__(self, text: Text, lookup: Lookup, providers: list):
        self.text, self.lookup = text, lookup
        n = len(text.text)
        self.ends: list = [()] * (n + 1)
        bos = Node(0, 0, 0, 0, 0)
        bos.total, bos.seq = 0, 0
        self.bos, self.ends[0], self.count, self.chains = bos, [bos], 1, []
        self._build(providers)
        self.eos = Node(n, n, 0, 0, 0)
        self._connect(self.eos, self._cheapest(n, 0))

    def _cheapest(self, at: int, left: int) -> tuple[int | None, Node | None]:
        """(cost up to a node with this left id, its predecessor): the least total, of equal ones the first that came."""
        m, size = self.lookup.matrix.costs, self.lookup.matrix.right_size
        best, prev = None, None
        for p in self.ends[at]:
            if p.total is not None:
                c = m[p.right * size + left]
                if c != INHIBITED and (best is None or p.total + c < best):
                    best, prev = p.total + c, p
        return best, prev

    @staticmethod
    def _connect(node: Node, found: tuple[int | None, Node | None]) -> None:
        if found[1] is not None:
            node.total, node.prev = found[0] + node.cost, found[1]

    def _stretches(self, providers: list):
        """Places where chains may begin, as far as they go: (only, number of each cut, first stop from each cut on, costs up to each)."""
        text, lookup = self.text, self.lookup
        if len(providers) != 1 or not text.long or not hasattr(providers[0], "only"):
            return None
        only = providers[0].only(text)
        cuts, kinds, templates = only
        m, size = lookup.matrix.costs, lookup.matrix.right_size
        if not templates:
            return None
        between = np.array([[m[a[1] * size + b[0]] for b in templates] for a in templates], np.int64)
        steps = between[kinds[:-1], kinds[1:]]
        stops = lookup.begins[text.codes[cuts]] | (kinds < 0)
        stops[1:] |= steps == INHIBITED
        at = np.append(np.flatnonzero(stops), len(cuts))
        until = at[np.cumsum(stops) - stops]
        costs = np.append(0, np.cumsum(steps + np.array([t[2] for t in templates], np.int64)[kinds[1:]]))
        numbers = np.full(len(text.text), -1)
        numbers[cuts] = np.arange(len(cuts))
        return only, numbers.tolist(), until.tolist(), costs.tolist(), np.append(cuts, len(text.text)).tolist()

    def _build(self, providers: list) -> None:
        """Goes through the places where a word may begin and one has ended.

        Where no dictionary word begins and nothing found before reaches farther, all sole candidates up to the next
        such word are one chain.
        """
        text, words, starts = self.text, self.lookup.words, self.lookup.starts
        s, ends, bow, cats, n = text.text, self.ends, text.bow, text.cats, len(text.text)
        byte, cheapest, connect = text.byte, self._cheapest, self._connect
        stretches = self._stretches(providers)
        seq, at, far = self.count, 0, 0
        while at < n:
            if not bow[at] or not ends[at]:
                at += 1
                continue
            if stretches and far <= at:
                only, numbers, until, costs, cuts = stretches
                lo = numbers[at]
                if lo >= 0 and until[lo] > lo + 1:
                    hi = until[lo]
                    left, _, cost, _ = only.templates[only.kinds[lo]]
                    node = Chain(at, cuts[hi], left, only.templates[only.kinds[hi - 1]][1], cost + costs[hi - 1] - costs[lo])
                    node.only, node.lo, node.hi, node.seq = only, lo, hi, seq
                    connect(node, cheapest(at, left))
                    self.chains.append(node)
                    seq += hi - lo
                    at = far = node.end
                    ends[at] = [node]
                    continue
            mask, known = 0, {}
            for keys, sizes in starts.get(s[at], ()):
                for size in sizes:
                    end = at + size
                    if end > n:
                        break
                    places = keys.get(s[at:end])
                    if places and (end == n or bow[end]):
                        for p in places:
                            w = words[p]
                            node = Node(at, end, w.left, w.right, w.cost, p)
                            node.seq = seq
                            seq += 1
                            if (found := known.get(w.left)) is None:
                                found = known[w.left] = cheapest(at, w.left)
                            connect(node, found)
                            if ends[end]:
                                ends[end].append(node)
                            else:
                                ends[end] = [node]
                        far = max(far, end)
                        mask |= length_bit(byte[end] - byte[at])
            asked = () if cats[at] & NOOOVBOW else providers
            last = providers[-1:]
            while True:
                for provider in asked:
                    for end, left, right, cost, pos_id in provider.candidates(self, at, mask):
                        form = s[at:end]
                        node = Node(at, end, left, right, cost, -1, (form, pos_id, form, form, ""), True)
                        node.seq = seq
                        seq += 1
                        if (found := known.get(left)) is None:
                            found = known[left] = cheapest(at, left)
                        connect(node, found)
                        if ends[end]:
                            ends[end].append(node)
                        else:
                            ends[end] = [node]
                        far = max(far, end)
                        mask |= length_bit(byte[end] - byte[at])
                if mask or not last:
                    break
                asked, last = last, []
            if not mask:
                raise NoPath(f"no candidate at {at}")
            at += 1
        self.count = seq

    def _links(self, chain: Chain) -> list[Node]:
        """A chain's nodes."""
        s, out, bounds = self.text.text, [], chain.bounds()
        for k, (begin, end, (left, right, cost, pos_id)) in enumerate(zip(bounds, bounds[1:], chain.templates(), strict=False), chain.seq):
            form = s[begin:end]
            node = Node(begin, end, left, right, cost, -1, (form, pos_id, form, form, ""), True)
            node.seq = k
            out.append(node)
        return out

    def pieces(self) -> list[Node]:
        """The cheapest path, chains as they are."""
        if self.eos.prev is None:
            raise NoPath("the end is not reached")
        out, node = [], self.eos.prev
        while node is not self.bos:
            out.append(node)
            node = node.prev
        return out[::-1]

    def best(self) -> list[Node]:
        """The cheapest path."""
        return [y for x in self.pieces() for y in (self._links(x) if isinstance(x, Chain) else (x,))]

    def _spell(self) -> None:
        """Chains become the nodes that they stand for, connected like all others."""
        last = {}
        for chain in self.chains:
            prev, total = chain.prev, chain.total
            for node in self._links(chain):
                if prev is not None:
                    c = self.lookup.matrix.cost(prev.right, node.left)
                    node.prev, node.total = prev, prev.total + c + node.cost
                self.ends[node.end] = [node]
                prev = None if prev is None else node
            last[chain] = node
            assert node.total == total
        self.chains = []
        for x in self.nodes() if last else ():
            x.prev = last.get(x.prev, x.prev)

    def insert(self, node: Node) -> None:
        """A further candidate, connected to what has ended at its begin so far."""
        self._spell()
        node.seq = self.count
        self.count += 1
        self._connect(node, self._cheapest(node.begin, node.left))
        self.ends[node.end] = [*self.ends[node.end], node]

    def remove(self, node: Node) -> None:
        """Takes a candidate out; paths that were found through it stay."""
        self._spell()
        self.ends[node.end] = [x for x in self.ends[node.end] if x is not node]

    def ending(self, end: int) -> list[Node]:
        """The candidates that end at a place."""
        self._spell()
        return [x for x in self.ends[end] if x is not self.bos]

    def spanning(self, begin: int, end: int) -> list[Node]:
        """The candidates of a span."""
        return [x for x in self.ending(end) if x.begin == begin]

    def cheapest(self, begin: int, end: int) -> Node | None:
        """The node of a span with the least cost of its own."""
        return min(self.spanning(begin, end), key=lambda x: x.cost, default=None)

    def nodes(self) -> Iterable[Node]:
        self._spell()
        for some in self.ends:
            yield from some
        yield self.eos

    def size(self) -> int:
        """How many nodes() there are, chains counted by their candidates."""
        return sum(map(len, self.ends)) + 1 + sum([x.hi - x.lo - 1 for x in self.chains])

    def length(self) -> int:
        """How many nodes best() has."""
        return sum([x.hi - x.lo if isinstance(x, Chain) else 1 for x in self.pieces()])

    # What a node says, whether of a dictionary or made up.

    def surface(self, x: Node) -> str:
        return x.info[0] if x.info else self.lookup.words[x.place].surface

    def pos_id(self, x: Node) -> int:
        return x.info[1] if x.info else self.lookup.words[x.place].pos_id

    def normalized(self, x: Node) -> str:
        return x.info[2] if x.info else self.lookup.words[x.place].normalized

    def dictionary_form(self, x: Node) -> str:
        return x.info[3] if x.info else self.lookup.dictionary_form(x.place)

    def reading(self, x: Node) -> str:
        return x.info[4] if x.info else self.lookup.words[x.place].reading

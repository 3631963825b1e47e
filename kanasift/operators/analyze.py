"""Analysis of a text: sentences, each as a list of tokens. Plain Python on one text; engine.py runs it over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

from ..plans.dictionary import dict_of
from .lattice import Chain, Lattice, Node
from .sentence import LIMIT, first_end
from .text import Draft, Text, utf16_offsets

MODES = ("A", "B", "C")


@dataclass(slots=True)
class Token:
    """begin and end are UTF-16 indices into the sentence, begin_cp and end_cp code points of it."""

    begin: int
    end: int
    begin_cp: int
    end_cp: int
    surface: str
    pos_id: int
    pos: tuple[str, ...]
    normalized_form: str
    dictionary_form: str
    reading_form: str
    is_oov: bool
    dict_id: int
    word_id: int
    synonym_group_ids: tuple[int, ...]
    cost: int


@dataclass
class Sentence:
    """A sentence's text, its lattice and rewritten path in mode C, and where it begins (code points) in its document."""

    parts: object
    text: Text
    begin: int = 0

    def __post_init__(self):
        self.lattice = Lattice(self.text, self.parts.lookup, self.parts.providers)
        self.pieces = self.path if self.parts.rewriters else self.lattice.pieces()

    @cached_property
    def best(self) -> list[Node]:
        return self.lattice.best()

    @cached_property
    def path(self) -> list[Node]:
        path = self.best
        for r in self.parts.rewriters:
            path = r.rewrite(self.lattice, path)
        return path

    def split(self, nodes: list[Node], mode: str) -> list[Node]:
        """The nodes as their units of a mode; the words of a unit take their spelt lengths from the unit's begin."""
        if mode not in MODES:
            raise ValueError(f"no mode {mode}")
        if mode == "C":
            return nodes
        lookup, out = self.parts.lookup, []
        for x in nodes:
            w = lookup.words[x.place] if x.place >= 0 else None
            ids = () if w is None else w.a_split if mode == "A" else w.b_split
            if not ids or len(ids) == 1 and lookup.place(ids[0]) == x.place:
                out.append(x)
            elif len(ids) == 1:
                out.append(Node(x.begin, x.end, 0, 0, 0, lookup.place(ids[0])))
            else:
                at = x.begin
                for wid in ids:
                    unit = lookup.word(wid)
                    end = at + len(unit.headword if unit.headword is not None else unit.surface)
                    out.append(Node(at, end, 0, 0, 0, lookup.place(wid)))
                    at = end
        return out

    def columns(self, mode: str, names: Sequence[str]) -> list[list]:
        """The tokens of a mode as columns of these names (of COLUMNS); nothing else is made."""
        view = View(self, mode)
        return [COLUMNS[c](view) for c in names]

    def tokens(self, mode: str = "C") -> list[Token]:
        return [Token(*x) for x in zip(*self.columns(mode, Token.__slots__), strict=True)]

    def path_cost(self) -> int:
        """The whole cost of the cheapest path, its ends included."""
        return self.lattice.eos.total


class View:
    """A sentence's tokens in one mode, and what several columns of them are made from, each made once."""

    def __init__(self, sentence: Sentence, mode: str):
        self.sentence, self.mode, self.lattice = sentence, mode, sentence.lattice
        self.pieces = sentence.split(sentence.pieces, mode)
        self.chained = bool(sentence.lattice.chains)

    def each(self, node: Callable[[Node], object], chain: Callable[[Chain], list]) -> list:
        """A value for each token, from its node or as part of a chain."""
        if not self.chained:
            return list(map(node, self.pieces))
        out = []
        for x in self.pieces:
            if isinstance(x, Chain):
                out += chain(x)
            else:
                out.append(node(x))
        return out

    @cached_property
    def sizes(self) -> list[int]:
        return [x.hi - x.lo if isinstance(x, Chain) else 1 for x in self.pieces]

    @cached_property
    def bounds(self) -> list[tuple[int, int]]:
        """(begin, end) of each token in the normalized text."""
        return self.each(lambda x: (x.begin, x.end), lambda x: list(pairwise(x.bounds())))

    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        """(begin, end) in the original; unless empty ones are allowed, one without width has those of the one before."""
        source, n, out = self.sentence.text.source, len(self.sentence.text.text), []
        same = self.sentence.parts.allow_empty
        for b, e in self.bounds:
            b, e = source[b], source[min(e, n)]
            out.append(out[-1] if b == e and not same and out else (b, e))
        return out

    @cached_property
    def units(self) -> list[int]:
        return utf16_offsets(self.sentence.text.original)

    @cached_property
    def ids(self) -> list[int]:
        ids = self.sentence.parts.lookup.ids
        return self.each(lambda x: ids[x.place] if x.place >= 0 else -1, lambda x: [-1] * (x.hi - x.lo))

    @cached_property
    def pos_ids(self) -> list[int]:
        return self.each(self.lattice.pos_id, lambda x: [t[3] for t in x.templates()])

    def forms(self, node: Callable[[Node], str]) -> list[str]:
        text = self.sentence.text.text
        return self.each(node, lambda x: [text[b:e] for b, e in pairwise(x.bounds())])

    def same(self, node: Callable[[Node], object], value) -> list:
        """A value for each token that is one and the same in chains."""
        return self.each(node, lambda x: [value] * (x.hi - x.lo))


def _offsets(v: View) -> list[list[int]]:
    source = v.sentence.text.source
    return [[p - source[b] for p in source[b : e + 1]] for b, e in v.bounds]


#: How each column of tokens is made from a View.
COLUMNS: dict[str, Callable[[View], list]] = {
    "begin": lambda v: [v.units[b] for b, _ in v.spans],
    "end": lambda v: [v.units[e] for _, e in v.spans],
    "begin_cp": lambda v: [b for b, _ in v.spans],
    "end_cp": lambda v: [e for _, e in v.spans],
    "surface": lambda v: [v.sentence.text.original[b:e] for b, e in v.spans],
    "pos_id": lambda v: v.pos_ids,
    "pos": lambda v: list(map(v.sentence.parts.lookup.pos.__getitem__, v.pos_ids)),
    "normalized_form": lambda v: v.forms(v.lattice.normalized),
    "dictionary_form": lambda v: v.forms(v.lattice.dictionary_form),
    "reading_form": lambda v: v.same(v.lattice.reading, ""),
    "is_oov": lambda v: v.same(lambda x: x.oov, True),
    "dict_id": lambda v: [dict_of(i) if i >= 0 else -1 for i in v.ids],
    "word_id": lambda v: v.ids,
    "synonym_group_ids": lambda v: v.same(lambda x: v.sentence.parts.lookup.words[x.place].synonyms if x.place >= 0 else (), ()),
    "cost": lambda v: v.each(lambda x: x.cost, lambda x: [t[2] for t in x.templates()]),
    "mod2orig": _offsets,
    "mode": lambda v: [v.mode] * sum(v.sizes),
    "tok_id": lambda v: list(range(sum(v.sizes))),
    "sent_begin": lambda v: [v.sentence.begin] * sum(v.sizes),
}


def _crossing(parts, text: str, begin: int):
    """Whether a dictionary word that begins in the last 64 bytes before an end crosses it, or ends there with two characters or more."""
    lookup, n = parts.lookup, len(text)
    starts, reach, longest = lookup.starts, lookup.reach, lookup.longest

    def crossed(length: int) -> bool:
        end = begin + length
        room = 64
        # No headword that begins farther off reaches the end.
        for k in range(end - 1, max(end - longest, 0) - 1, -1):
            ch = text[k]
            room -= 1 if ch < "\x80" else 2 if ch < "\u0800" else 3 if ch < "\U00010000" else 4
            if room < 0:
                break
            least = end - k if end - k > 1 else 2
            if reach.get(ch, 0) >= least:
                for keys, sizes in starts[ch]:
                    if any([size >= least and k + size <= n and text[k : k + size] in keys for size in sizes]):
                        return True
        return False

    return crossed


def spans(parts, text: Draft, limit: int = LIMIT) -> Iterator[tuple[int, int]]:
    """[begin, end) of the sentences of a normalized text; what has no end in it is the last one."""
    begin, n = 0, len(text.text)
    while begin < n:
        # One character more than are searched says that the text goes on.
        length = first_end(text.text[begin : begin + limit + 1], limit, _crossing(parts, text.text, begin))
        end = text.original_end(begin + length) if 0 < length < n - begin else n
        yield begin, end
        begin = end


def prepare(parts, text: str) -> Draft:
    """The normalized text and where its characters come from."""
    return Draft.by(text, parts.inputs, parts.table)


def one_sentence(parts, text: str) -> Sentence | None:
    """A whole text as one sentence; None if it is empty."""
    return Sentence(parts, Text.of(text, parts.inputs, parts.table)) if text else None


def sentences(parts, text: str, limit: int = LIMIT) -> Iterator[Sentence]:
    """A text's sentences, each analysed by itself when it is asked for, so that one lattice is held at a time."""
    if text:
        whole = prepare(parts, text)
        for b, e in spans(parts, whole, limit):
            yield Sentence(parts, whole.slice(b, e, parts.table), whole.places[b])


def resplit(parts, place: int, begin: int, mode: str) -> list[tuple[int, int, int]]:
    """(place, begin, end) of a dictionary word's units of a finer mode, in characters of the normalized text."""
    lookup = parts.lookup
    w = lookup.words[place]
    ids = w.a_split if mode == "A" else w.b_split if mode == "B" else ()
    if len(ids) < 2:
        return [(lookup.place(ids[0]) if ids else place, begin, begin + len(w.headword or w.surface))]
    out = []
    for wid in ids:
        unit = lookup.word(wid)
        end = begin + len(unit.headword or unit.surface)
        out.append((lookup.place(wid), begin, end))
        begin = end
    return out


def internal_cost(tokens: list[Token]) -> int:
    """The last token's own cost less the first one's."""
    return tokens[-1].cost - tokens[0].cost if tokens else 0


def estimate_cost(parts, surface: str) -> tuple[int, int]:
    """(internal cost, tokens) of a surface without path rewriting, for a user word without a cost."""
    from dataclasses import replace

    s = one_sentence(replace(parts, rewriters=[]), surface)
    tokens = s.tokens("C") if s else []
    return internal_cost(tokens), len(tokens)


def lattice_json(parts, text: str, s: Sentence | None = None) -> dict:
    """All that analysis made of a text (of s, if it is analysed already): its normalized form, the lattice's nodes, the
    cheapest and the rewritten path."""
    s = s or one_sentence(parts, text)
    if s is None:
        return {"inputText": {"originalText": text, "modifiedText": ""}, "lattice": [], "bestPath": [], "rewrittenPath": []}
    lattice, byte = s.lattice, s.text.byte

    def row(x: Node) -> dict:
        edge = x is lattice.bos or x is lattice.eos
        costs = [lattice.lookup.matrix.cost(p.right, x.left) for p in lattice.ends[x.begin]] if x is not lattice.bos else []
        info = {} if edge else {"headword": lattice.surface(x), "wordId": lattice.lookup.ids[x.place] if x.place >= 0 else -1, "posId": lattice.pos_id(x), "isOOV": x.oov}
        return {"nodeId": x.seq, "begin": None if x is lattice.bos else byte[x.begin], "end": None if x is lattice.eos else byte[x.end], "leftId": x.left, "rightId": x.right, "cost": x.cost, "connectCosts": costs, **info}

    return {"inputText": {"originalText": s.text.original, "modifiedText": s.text.text}, "lattice": [row(x) for x in lattice.nodes()], "bestPath": [row(x) for x in s.best], "rewrittenPath": [row(x) for x in s.path]}


def lattice_text(parts, text: str) -> list[str]:
    """The lattice as lines, its end first: place of the node, its word and the costs to all nodes before it."""
    out = []
    for k, r in enumerate(reversed(lattice_json(parts, text)["lattice"])):
        word = r.get("headword", "(null)")
        out.append(f"{k}: {r['begin']} {r['end']} {word}({r.get('wordId', 0)}) {r.get('posId', 'BOS/EOS')} {r['leftId']} {r['rightId']} {r['cost']}: {' '.join(map(str, r['connectCosts']))}")
    return out

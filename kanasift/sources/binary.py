"""Compiled binary dictionaries: reading those that users already have, and writing them.

Little-endian, one part after another: header (version, time, 256 bytes of description), parts of speech,
connection costs, double-array trie, word id table, word parameters, word records. Strings are UTF-16 with a
length of one or two bytes; an empty normalized form or reading is the surface.
"""

from __future__ import annotations

import struct
import time
from array import array
from collections import defaultdict

import numpy as np

from ..plans.dictionary import Dictionary, Matrix, Word

# Versions of the format, and whether each is a user dictionary, has a grammar, has synonyms.
VERSIONS = {
    0x7366D3F18BD111E7: (False, True, False),
    0xCE9F011A92394434: (False, True, True),
    0xA50F31188BD211E7: (True, False, False),
    0x9FDEB5A90168D868: (True, True, False),
    0xCA9811756FF64FB0: (True, True, True),
}
NEWEST = {False: 0xCE9F011A92394434, True: 0xCA9811756FF64FB0}
_DESCRIPTION = 256


class _In:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out[0] if len(out) == 1 else out

    def array(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def length(self) -> int:
        n = self.take("B")
        return n if n < 128 else (n & 127) << 8 | self.take("B")

    def string(self) -> str:
        n = self.length()
        self.at += 2 * n
        return self.data[self.at - 2 * n : self.at].decode("utf-16-le", "surrogatepass")

    def ints(self) -> tuple[int, ...]:
        return tuple(self.array("<u4", self.take("B")).tolist())


def header(data: bytes) -> dict:
    """is_user, version, created (seconds) and description of a binary dictionary; ValueError for other data."""
    if len(data) < 16 + _DESCRIPTION:
        raise ValueError("no dictionary: too short")
    version, created = struct.unpack_from("<Qq", data)
    if version not in VERSIONS:
        raise ValueError("no dictionary: unknown version")
    return {"is_user": VERSIONS[version][0], "version": version, "created": created, "description": data[16 : 16 + _DESCRIPTION].split(b"\0")[0].decode()}


#: Units of a double array that share all but the last 8 bits of their place; a node's letters are in one block.
_BLOCK = 256
#: Blocks in which new nodes may still be placed.
_OPEN = 4
#: Distances from a node to its letters that are written as they are; greater ones without their last 8 bits.
_NEAR = 1 << 21


def _offsets(units: np.ndarray) -> np.ndarray:
    return ((units >> 10) << ((units & 1 << 9) >> 6)).astype(np.int64)


def trie_keys(units: np.ndarray) -> list[tuple[bytes, int]]:
    """(key, value) of all keys of a double array, from its root down, all nodes of one depth at a time."""
    if not len(units):
        return []
    units = np.asarray(units, np.uint32)
    letters, names = np.arange(1, 256), [bytes([c]) for c in range(256)]
    marks = (units & np.uint32(0x800000FF)).astype(np.int64)
    keys, bases, out = [b""], _offsets(units[:1]), []
    while keys:
        longer, below = [], []
        for k in range(0, len(keys), 4096):
            slots = bases[k : k + 4096, None] ^ letters
            found = (slots < len(units)) & (marks[np.minimum(slots, len(units) - 1)] == letters)
            node, letter = np.nonzero(found)
            at = slots[node, letter]
            some = [keys[k + i] + names[c] for i, c in zip(node.tolist(), letters[letter].tolist(), strict=True)]
            base = at ^ _offsets(units[at])
            ends = np.flatnonzero(units[at] >> 8 & 1)
            out += zip(map(some.__getitem__, ends.tolist()), (units[base[ends]] & np.uint32(0x7FFFFFFF)).tolist(), strict=True)
            longer += some
            below.append(base)
        keys, bases = longer, np.concatenate(below)
    return sorted(out)


class _Block:
    """Free units of a block, and which bases its nodes have."""

    def __init__(self, start: int):
        self.start, self.taken, self.bases = start, bytearray(_BLOCK), bytearray(_BLOCK)
        self.free = list(range(_BLOCK))
        if not start:
            # The root's own unit, and the base that would say that there is none.
            self.taken[0] = self.bases[0] = 1
            self.free.remove(0)

    def place(self, letters: list[int], at: int, near: int) -> int | None:
        """A base for the letters of the node at a place, now taken; None if they do not fit."""
        far = self.start ^ (at & -_BLOCK)
        tried = (x ^ letters[0] for x in self.free) if far < near else (at & _BLOCK - 1,)
        for low in tried:
            if not self.bases[low] and not any(self.taken[low ^ c] for c in letters):
                self.bases[low] = 1
                for c in letters:
                    self.taken[low ^ c] = 1
                self.free = [x for x in self.free if not self.taken[x]]
                return self.start | low
        return None


def trie_units(values: dict[bytes, int], near: int = _NEAR) -> np.ndarray:
    """A double array of keys and values.

    A node's letters go to the first of the last _OPEN blocks in which they fit, else to a new one, so the work grows
    with the keys alone. Where they are `near` or farther away, their base has the node's place in its block.
    """
    keys = sorted(values)
    units, blocks = array("I", bytes(4 * _BLOCK)), [_Block(0)]
    todo = [(0, len(keys), 0, 0)] if keys else []
    while todo:
        lo, hi, depth, place = todo.pop()
        leaf = len(keys[lo]) == depth
        below, k = [], lo + leaf
        while k < hi:
            # Keys are sorted: those that go on with one letter stand together.
            c, begin = keys[k][depth], k
            while k < hi and keys[k][depth] == c:
                k += 1
            below.append((c, begin, k))
        letters = [c for c, _, _ in below] + [0] * leaf
        base = next((b for x in blocks if (b := x.place(letters, place, near)) is not None), None)
        if base is None:
            blocks = [x for x in blocks if x.free][1 - _OPEN :] + [_Block(len(units))]
            units.frombytes(bytes(4 * _BLOCK))
            base = blocks[-1].place(letters, place, near)
        jump = base ^ place
        if jump >= 1 << 29:
            raise ValueError("the trie is larger than the format can hold")
        units[place] |= (jump << 10 if jump < near else jump << 2 | 1 << 9) | leaf << 8
        if leaf:
            units[base] = 1 << 31 | values[keys[lo]]
        for c, begin, end in below:
            units[base ^ c] = c
            todo.append((begin, end, depth + 1, base ^ c))
    return np.array(units, "<u4")


def read(data: bytes, system: Dictionary | None = None) -> Dictionary:
    """A dictionary from its binary form; a user dictionary needs its system dictionary for the parts of speech."""
    head = header(data)
    user, grammar, synonyms = VERSIONS[head["version"]]
    if user and system is None:
        raise ValueError("a user dictionary is read over its system dictionary")
    f = _In(data)
    f.at = 16 + _DESCRIPTION
    pos, matrix = list(system.pos) if user else [], None
    if grammar:
        pos += [tuple(f.string() for _ in range(6)) for _ in range(f.take("h"))]
        left, right = f.take("hh")
        costs = f.array("<i2", left * right)
        if not user:
            matrix = Matrix(left, right, array("h", costs.reshape(right, left).T.astype("i2").tobytes()))
    keys = trie_keys(f.array("<u4", f.take("i")))
    table = _In(f.array("u1", f.take("i")).tobytes())
    heads: dict[int, str] = {}
    for key, at in keys:
        table.at = at
        for number in table.ints():
            heads[number] = key.decode()
    n = f.take("i")
    numbers = f.array("<i2", 3 * n).reshape(n, 3).tolist()
    places = f.array("<i4", n).tolist()
    words = []
    for k, (left, right, cost) in enumerate(numbers):
        f.at = places[k]
        surface = f.string()
        f.length()
        pos_id, normalized, form, reading = f.take("h"), f.string(), f.take("i"), f.string()
        a, b, s = f.ints(), f.ints(), f.ints()
        words.append(Word(heads.get(k), left, right, cost, surface, pos_id, reading or surface, normalized or surface, form, a, b, s, f.ints() if synonyms else ()))
    return Dictionary(words, pos, matrix, user, head["description"])


def write(d: Dictionary, system_pos: int = 0, created: int | None = None) -> bytes:
    """The binary form of a dictionary; of a user dictionary's parts of speech those from system_pos on are its own."""

    def length(n: int) -> bytes:
        return bytes([n]) if n < 128 else bytes([n >> 8 | 128, n & 255])

    def string(s: str) -> bytes:
        x = s.encode("utf-16-le", "surrogatepass")
        return length(len(x) // 2) + x

    ints = lambda x: bytes([len(x)]) + struct.pack(f"<{len(x)}I", *x)
    description = d.description.encode()[: _DESCRIPTION - 1]
    out = [struct.pack("<Qq", NEWEST[d.user], int(time.time()) if created is None else created), description.ljust(_DESCRIPTION, b"\0")]
    own = d.pos[system_pos:] if d.user else d.pos
    out += [struct.pack("<h", len(own)), *(string(x) for p in own for x in p)]
    m = d.matrix
    out.append(struct.pack("<hh", m.left_size, m.right_size) + np.frombuffer(m.costs, "i2").reshape(m.left_size, m.right_size).T.astype("<i2").tobytes() if m else struct.pack("<hh", 0, 0))
    ids: dict[bytes, list[int]] = defaultdict(list)
    for k, w in enumerate(d.words):
        if w.headword is not None and w.left >= 0:
            ids[w.headword.encode()].append(k)
    table, values = bytearray(), {}
    for key in sorted(ids):
        values[key] = len(table)
        table += ints(ids[key])
    units = trie_units(values)
    out += [struct.pack("<i", len(units)), units.tobytes(), struct.pack("<i", len(table)), table]
    out += [struct.pack("<i", len(d.words)), *(struct.pack("<hhh", w.left, w.right, w.cost) for w in d.words)]
    at = sum(map(len, out)) + 4 * len(d.words)
    records, places = [], []
    for w in d.words:
        same = lambda x, w=w: "" if x == w.surface else x
        r = string(w.surface) + length(len((w.headword if w.headword is not None else w.surface).encode())) + struct.pack("<h", w.pos_id) + string(same(w.normalized)) + struct.pack("<i", w.dictionary_form) + string(same(w.reading)) + ints(w.a_split) + ints(w.b_split) + ints(w.structure) + ints(w.synonyms)
        places.append(at)
        at += len(r)
        records.append(r)
    return b"".join([*out, struct.pack(f"<{len(places)}i", *places), *records])

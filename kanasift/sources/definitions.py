"""Readers of the definition files: character categories, out-of-vocabulary templates, normalization rules, connection costs.

Each takes the text of a file and raises ValueError with the line's number for what it cannot read.
"""

from __future__ import annotations

import unicodedata

from ..operators.text import CATEGORIES
from ..plans.dictionary import Matrix


def _lines(text: str):
    for n, line in enumerate(text.split("\n"), 1):
        yield n, line.rstrip("\r")


def _fail(n: int, why: str):
    raise ValueError(f"line {n}: {why}")


def _category(name: str, n: int) -> int:
    if name not in CATEGORIES:
        _fail(n, f"no category {name}")
    return CATEGORIES[name]


def read_categories(text: str) -> list[tuple[int, int, int]]:
    """Lines `0xLO[..0xHI] CATEGORY...`, the rest after # being a comment; other lines are properties."""
    out = []
    for n, line in _lines(text):
        parts = line.split("#")[0].split()
        if not parts or not line.startswith("0x"):
            continue
        if len(parts) < 2:
            _fail(n, "a range without a category")
        bounds = parts[0].split("..")
        try:
            lo, hi = int(bounds[0], 16), int(bounds[-1], 16)
        except ValueError:
            _fail(n, f"no range: {parts[0]}")
        if lo > hi or len(bounds) > 2:
            _fail(n, f"no range: {parts[0]}")
        bits = 0
        for c in parts[1:]:
            bits |= _category(c, n)
        out.append((lo, hi, bits))
    return out


def read_properties(text: str) -> dict[int, tuple[bool, bool, int]]:
    """Lines `CATEGORY ALWAYS GROUP LENGTH`: whether candidates are always made, whole runs grouped, prefixes to a length."""
    out: dict[int, tuple[bool, bool, int]] = {}
    for n, line in _lines(text):
        parts = line.split("#")[0].split()
        if not parts or line.startswith("0x"):
            continue
        if len(parts) < 4:
            _fail(n, "a category has three properties")
        bit = _category(parts[0], n)
        if bit in out:
            _fail(n, f"{parts[0]} is defined already")
        out[bit] = (parts[1] != "0", parts[2] != "0", int(parts[3]))
    return out


def read_templates(text: str, properties: dict, pos_id) -> dict[int, list[tuple[int, int, int, int]]]:
    """Lines `CATEGORY,left,right,cost,pos x 6`; pos_id turns a part of speech into its number or raises."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for n, line in _lines(text):
        if not line.strip() or line.startswith("#"):
            continue
        parts = line.split(",")
        if len(parts) < 10:
            _fail(n, "a template has ten columns")
        bit = _category(parts[0], n)
        if bit not in properties:
            _fail(n, f"{parts[0]} is not defined")
        left, right, cost = map(int, parts[1:4])
        out.setdefault(bit, []).append((left, right, cost, pos_id(parts[4:10])))
    return out


def read_rewrites(text: str) -> tuple[dict[str, str], set[str]]:
    """One column: a character that keeps its form; two columns: what is replaced and by what."""
    replaced: dict[str, str] = {}
    kept: set[str] = set()
    for n, line in _lines(text):
        parts = line.split()
        if not parts or line.startswith("#"):
            continue
        if len(parts) == 1:
            if len(parts[0]) != 1:
                _fail(n, f"{parts[0]} is more than one character")
            kept.add(parts[0])
        elif len(parts) == 2:
            if parts[0] in replaced:
                _fail(n, f"{parts[0]} is replaced already")
            replaced[parts[0]] = parts[1]
        else:
            _fail(n, "more than two columns")
    return replaced, kept


def read_matrix(text: str) -> Matrix:
    """A header `left_size right_size`, then lines `left right cost`; pairs without a line cost 0, blank lines are skipped."""
    matrix = None
    for n, line in _lines(text):
        parts = line.split()
        if not parts:
            continue
        try:
            numbers = [int(x) for x in parts[: 2 if matrix is None else 3]]
            if matrix is None:
                matrix = Matrix.zero(*numbers)
            else:
                left, right, cost = numbers
                if not (0 <= left < matrix.left_size and 0 <= right < matrix.right_size):
                    raise ValueError("outside the matrix")
                matrix.costs[left * matrix.right_size + right] = cost
        except (ValueError, TypeError, OverflowError) as e:
            raise ValueError(f"line {n}: {e}") from e
    if matrix is None:
        raise ValueError("no header")
    return matrix


def default_rewrites() -> tuple[dict[str, str], set[str]]:
    """The rules of normalization by default.

    A kana and a sound mark after it, in each form that is in use, become the one character that Unicode
    composes of them. Number letters, radicals, sound marks and compatibility ideographs keep their form.
    """
    replaced = {}
    for mark, forms in (("゙", "ﾞ゛゙"), ("゚", "ﾟ゜゚")):
        for base in [*map(chr, range(0x3041, 0x3097)), *map(chr, range(0x30A1, 0x30FB)), *map(chr, range(0xFF66, 0xFF9E))]:
            one = unicodedata.normalize("NFKC", base + mark)
            if len(one) == 1 and not (base in "ワヰヱヲﾜｦ"):
                half = "｡" < base
                replaced |= {base + f: one for f in (forms[:1] if half else forms)}
    # The ranges whose characters keep their form.
    ranges = [(0x2160, 0x217F), (0x2E80, 0x2E99), (0x2E9B, 0x2EF3), (0x2F00, 0x2FD5), (0x309B, 0x309C), (0xF900, 0xFA6D), (0xFA70, 0xFAD9)]
    return replaced, {chr(c) for lo, hi in ranges for c in range(lo, hi + 1)}


# The character categories and their properties by default.
CATEGORIES_BY_DEFAULT = """
DEFAULT 0 1 0
SPACE 0 1 0
KANJI 0 0 2
SYMBOL 1 1 0
NUMERIC 1 1 0
ALPHA 1 1 0
HIRAGANA 0 1 2
KATAKANA 1 1 2
KANJINUMERIC 0 1 0
GREEK 1 1 0
CYRILLIC 1 1 0
0x0009..0x000B SPACE
0x000D SPACE
0x0020 SPACE
0x0021..0x002F SYMBOL
0x0030..0x0039 NUMERIC
0x003A..0x0040 SYMBOL
0x0041..0x005A ALPHA
0x005B..0x0060 SYMBOL
0x0061..0x007A ALPHA
0x007B..0x007E SYMBOL
0x00A1..0x00BF SYMBOL
0x00C0..0x00D6 ALPHA
0x00D7 SYMBOL
0x00D8..0x00F6 ALPHA
0x00F7 SYMBOL
0x00F8..0x0236 ALPHA
0x0374..0x03FB GREEK
0x0400..0x04F9 CYRILLIC
0x0500..0x050F CYRILLIC
0x1E00..0x1EF9 ALPHA
0x2000..0x206F SYMBOL
0x2070..0x209F NUMERIC
0x20A0..0x214F SYMBOL
0x2150..0x218F NUMERIC
0x2190..0x23FF SYMBOL
0x2460..0x24FF SYMBOL
0x2501..0x26FE SYMBOL
0x2700..0x297F SYMBOL
0x2A00..0x2BFF SYMBOL
0x2E80..0x2EF3 KANJI
0x2F00..0x2FD5 KANJI
0x3000..0x303F SYMBOL
0x3005 KANJI NOOOVBOW
0x3007 KANJI SYMBOL KANJINUMERIC
0x3041..0x309F HIRAGANA
0x309B..0x309C HIRAGANA KATAKANA
0x30A1..0x30FA KATAKANA
0x30A1 NOOOVBOW
0x30A3 NOOOVBOW
0x30A5 NOOOVBOW
0x30A7 NOOOVBOW
0x30A9 NOOOVBOW
0x30E3 NOOOVBOW
0x30E5 NOOOVBOW
0x30E7 NOOOVBOW
0x30EE NOOOVBOW
0x30FB..0x30FE NOOOVBOW
0x30FC..0x30FF KATAKANA
0x31F0..0x31FF KATAKANA
0x3200..0x32FE SYMBOL
0x3300..0x33FF SYMBOL
0x3400..0x4DB5 KANJI
0x4E00..0x9FFF KANJI
0x4E00 KANJINUMERIC
0x4E03 KANJINUMERIC
0x4E07 KANJINUMERIC
0x4E09 KANJINUMERIC
0x4E5D KANJINUMERIC
0x4E8C KANJINUMERIC
0x4E94 KANJINUMERIC
0x5104 KANJINUMERIC
0x5146 KANJINUMERIC
0x516B KANJINUMERIC
0x516D KANJINUMERIC
0x5341 KANJINUMERIC
0x5343 KANJINUMERIC
0x56DB KANJINUMERIC
0x767E KANJINUMERIC
0xF900..0xFA2D KANJI
0xFA30..0xFA6A KANJI
0xFE30..0xFE4F SYMBOL
0xFE50..0xFE6B SYMBOL
0xFF01..0xFF0F SYMBOL
0xFF10..0xFF19 NUMERIC
0xFF1A..0xFF20 SYMBOL
0xFF21..0xFF3A ALPHA
0xFF3B..0xFF40 SYMBOL
0xFF41..0xFF5A ALPHA
0xFF5B..0xFF65 SYMBOL
0xFF66..0xFF9F KATAKANA
0xFFE0..0xFFEF SYMBOL
"""

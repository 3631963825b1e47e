"""Numerals in Arabic and kanji digits, with units, points and commas, as plain decimal strings of any length.

A numeral is a row of terms, each a literal in digits and the unit behind it: 2千, 千, 1.5百, 30. A large unit (万)
raises all terms since the large unit before it. Each term fills decimal places, and a numeral is sound if every
term stands wholly below the one before it; its plain form is read off the places, those between being zero.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Digits, and the powers of ten of units.
DIGITS = dict(zip("0123456789〇一二三四五六七八九", [*range(10), *range(10)], strict=True))
SMALL = {"十": 1, "百": 2, "千": 3}
LARGE = {"万": 4, "億": 8, "兆": 12}

_TO_ASCII = str.maketrans({ch: str(n) for ch, n in DIGITS.items()})
_LITERAL = re.compile(r"[0-9.,]*")
_MARK = re.compile(r"[.,]")


class Term(NamedTuple):
    """Digits, of which the last stands at a power of ten."""

    digits: str
    low: int

    def raised(self, power: int) -> Term:
        return Term(self.digits, self.low + power)

    @property
    def high(self) -> int:
        return self.low + len(self.digits) - 1


class Reading(NamedTuple):
    """What a text reads as: value if it is a numeral; else the fault's kind ("point", "comma" or ""), the character
    that it shows at (the length: only at the end), and the value without the mark that hangs at the end."""

    value: str | None
    fault: str = ""
    at: int = 0
    before: str = "0"


def plain(terms: list[Term]) -> str:
    """The decimal form of terms that stand below one another; what is behind the point without zeros at its end."""
    if not terms:
        return "0"
    low = min(0, terms[-1].low)
    places = ["0"] * (terms[0].high - low + 1)
    for t in terms:
        at = terms[0].high - t.high
        places[at : at + len(t.digits)] = t.digits
    text = "".join(places)
    if not low:
        return text
    return f"{text[:low] or '0'}.{text[low:]}".rstrip("0").rstrip(".")


def _fault(literal: str, last: bool) -> tuple[str, int] | None:
    """The first mark of a literal that cannot stand where it does, or its length if that shows at its end only.

    A point needs digits before it and is the only one. A comma stands behind one to three digits that are not all
    zero, and behind a comma every mark and the end need three digits more; a point ends such grouping.
    """
    groups, grouped, pointed = 0, False, False
    for m in _MARK.finditer(literal):
        digits = literal[:m.start()].replace(",", "").replace(".", "")
        size = len(digits) - groups
        if m[0] == "." and not digits:
            return "point", m.start()
        if grouped and size != 3 or m[0] == "," and not grouped and not (size <= 3 and digits.strip("0")):
            return "comma", m.start()
        if m[0] == "." and pointed:
            return "point", m.start()
        grouped = m[0] == ","
        pointed = pointed or not grouped
        groups = len(digits) if grouped else groups
    if not last:
        return None
    if _hangs(literal):
        return "point", len(literal)
    return ("comma", len(literal)) if grouped and sum(map(str.isdigit, literal)) - groups != 3 else None


def _hangs(literal: str) -> bool:
    """Whether no digit stands behind the literal's point."""
    _, point, rest = literal.rpartition(".")
    return bool(point) and not rest.strip(",")


def _term(literal: str) -> Term:
    whole, _, part = literal.replace(",", "").partition(".")
    return Term(whole + part, -len(part))


def _below(terms: list[Term], term: Term) -> bool:
    return not terms or term.high < terms[-1].low


def read(text: str) -> Reading:
    """A text as one numeral, or where and why it is none."""
    ascii_digits, n = text.translate(_TO_ASCII), len(text)
    total: list[Term] = []
    group: list[Term] = []  # since the last large unit
    at, hanging = 0, False
    while at < n:
        literal = _LITERAL.match(ascii_digits, at)[0]
        stop = at + len(literal)
        fault = _fault(literal, stop == n) if literal else None
        if fault and at + fault[1] < n:
            return Reading(None, fault[0], at + fault[1])
        term = _term(literal) if literal else None
        hanging = _hangs(literal) if literal else hanging
        if stop == n:
            more = [*group, term]
            whole = [*total, *more] if _below(group, term) and _below(total, more[0]) else None
            if fault:
                return Reading(None, fault[0], n, plain(whole or total))
            return Reading(plain(whole)) if whole else Reading(None, "", n)
        unit = text[stop]
        if unit in SMALL:
            term = (term or Term("1", 0)).raised(SMALL[unit])
            if not _below(group, term):
                return Reading(None, "", stop)
            group.append(term)
        elif unit in LARGE:
            if term and not _below(group, term):
                return Reading(None, "", stop)
            raised = [t.raised(LARGE[unit]) for t in [*group, *([term] if term else [])]]
            if not raised or not _below(total, raised[0]):
                return Reading(None, "", stop)
            total, group = total + raised, []
        else:
            return Reading(None, "", stop)
        at = stop + 1
    whole = [*total, *group] if not group or _below(total, group[0]) else None
    if hanging:
        return Reading(None, "point", n, plain(whole or total))
    return Reading(plain(whole)) if whole is not None else Reading(None, "", n)


class Parser:
    """read() for a text that comes character by character; error is "", "point" or "comma" after a fault of that kind."""

    def __init__(self):
        self.text, self.error = "", ""

    def add(self, ch: str) -> bool:
        self.text += ch
        found = read(self.text)
        wrong = found.value is None and found.at < len(self.text)
        self.error = found.fault if wrong else ""
        return not wrong

    def end(self) -> bool:
        found = read(self.text)
        self.error = found.fault
        return found.value is not None

    def value(self) -> str:
        found = read(self.text)
        return found.before if found.value is None else found.value


def normalize_numeral(text: str | None) -> str | None:
    """The plain decimal form of a whole numeral, or None if it is none."""
    return read(text).value if text else None

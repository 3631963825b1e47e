"""Sentence detection: where the first sentence of a text ends."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Characters of a text that are searched for a break.
LIMIT = 4096

#: Characters that end, join, open and close sentences.
PERIODS, DOTS, MIDDLE, COMMAS = "。？！♪…?!", ".．", "・", ",，、"
LETTERS = "a-zA-Z0-9ａ-ｚＡ-Ｚ０-９〇一二三四五六七八九十百千万億兆"
OPENING, CLOSING = "({｛[（「【『［≪〔“", ")}]）」｝】』］〕≫”"

_close = re.escape(CLOSING)
#: All that a search for an end stops at: a break, or a bracket that opens or closes.
_STOP = re.compile(rf"(?P<opens>[{re.escape(OPENING)}])|(?P<closes>[{_close}])|(?P<ends>(?:[{PERIODS}]|{MIDDLE}{{3,}}|(?<![{LETTERS}])[{DOTS}](?![{LETTERS}{COMMAS}]))[{DOTS}{PERIODS}]*|(?:<br>|<BR>){{2,}})")
#: What belongs to the sentence that ends before it.
_TAIL = re.compile(rf"[{_close}{COMMAS}{PERIODS}]*")
_ITEM = re.compile(rf"[{LETTERS}][{DOTS}]")
#: An end that the text goes on from: a quotation or exclamation with a particle, an item's mark with one.
_GOES_ON = re.compile(rf"(?<=[！？!?{_close}])(?:と|っ|です)|(?<=[{LETTERS}][{DOTS}])[とやの]")
_FIRST_LINE = re.compile(r"[^\n\r\u0085\u2028\u2029]+[ \t\n\x0b\f\r]+")


def ends(text: str, limit: int = LIMIT) -> Iterator[int]:
    """The ends of sentences in a text that begins one, taken alone: outside brackets, not behind an item's mark only,
    not where the text goes on."""
    text = text[:limit]
    level = 0
    for stop in _STOP.finditer(text):
        if stop["opens"]:
            level += 1
        elif stop["closes"]:
            level = max(0, level - 1)
        elif not level:
            end = _TAIL.match(text, stop.end()).end()
            if not _ITEM.fullmatch(text, 0, end) and not _GOES_ON.match(text, end):
                yield end


def first_end(text: str, limit: int = LIMIT, crossed: Callable[[int], bool] | None = None) -> int:
    """The end of the first sentence; 0 for no text; below 0 if there is none, the magnitude being a usable prefix.

    crossed says whether a dictionary word stands across an end, which then is none.
    """
    found = next((end for end in ends(text, limit) if not (crossed and crossed(end))), None)
    if found is not None:
        return found
    line = _FIRST_LINE.search(text[:limit]) if len(text) > limit else None
    return -(line.end() if line else min(len(text), limit))

"""Formats of analysed sentences: a formatter takes a sentence's tokens and gives its text, without a line end.

A format is named in FORMATS, or by "module:function" of one's own.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from .analyze import Token

Formatter = Callable[[list[Token]], str]


def _row(t: Token) -> list[str]:
    return [t.surface, ",".join(t.pos), t.normalized_form]


def tabular(tokens: list[Token]) -> str:
    """A line for each token: surface, part of speech, normalized form; then EOS."""
    return "\n".join([*("\t".join(_row(t)) for t in tokens), "EOS"])


def detailed(tokens: list[Token]) -> str:
    """As tabular(), with dictionary form, reading, dictionary, synonyms and (OOV)."""

    def line(t: Token) -> str:
        more = [t.dictionary_form, t.reading_form, str(t.dict_id), "[" + ", ".join(map(str, t.synonym_group_ids)) + "]"]
        return "\t".join([*_row(t), *more, *(["(OOV)"] if t.is_oov else [])])

    return "\n".join([*map(line, tokens), "EOS"])


def wakati(tokens: list[Token]) -> str:
    """The surfaces with a space between, empty ones and spaces left out."""
    return " ".join(t.surface for t in tokens if t.surface not in ("", " "))


FORMATS: dict[str, Formatter] = {"tabular": tabular, "detailed": detailed, "wakati": wakati}


def formatter(name: str | Formatter) -> Formatter:
    """A formatter by its name, or by module:function."""
    if callable(name):
        return name
    if name in FORMATS:
        return FORMATS[name]
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"no format {name}")
    return getattr(import_module(module), attribute)

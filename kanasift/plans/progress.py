"""How a dictionary's build goes on, and what came out of it."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from typing import TypeVar

from .dictionary import Dictionary

Made = TypeVar("Made")


class Progress:
    """Runs steps one after another and tells a listener of each: its name, what it made and the seconds it took."""

    def __init__(self, listener: Callable[[str, int, float], None] | None = None):
        self.listener, self.steps = listener, []

    def step(self, name: str, work: Callable[[], Made], size: Callable[[Made], int] = lambda x: 1) -> Made:
        began = time.monotonic()
        made = work()
        self.steps.append((name, size(made), time.monotonic() - began))
        if self.listener:
            self.listener(*self.steps[-1])
        return made


def statistics(d: Dictionary) -> dict[str, int]:
    """A dictionary in figures."""
    found = Counter(w.headword for w in d.words if w.headword is not None and w.left >= 0)
    return {
        "words": len(d.words),
        "indexed words": sum(found.values()),
        "headwords": len(found),
        "most homographs": max(found.values(), default=0),
        "words with splits": sum(bool(w.a_split or w.b_split) for w in d.words),
        "parts of speech": len(d.pos),
        "connections": len(d.matrix.costs) if d.matrix and not d.user else 0,
    }

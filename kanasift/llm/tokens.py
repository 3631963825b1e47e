"""Token ids by the tokenizers library, with the ids of frequent words remembered per worker."""

from __future__ import annotations

import os
import re
from array import array

#: Words whose ids a worker remembers; forgotten all at once when full.
KNOWN_WORDS = 300_000
SPECIAL = "<|endoftext|>"
#: The byte-level pre-tokenizer's words, for texts of the letters that all Unicode versions agree on; letters come first, as most words are such.
_WORD = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters outside that range: control characters, numbers that are no digits, other scripts.
_OTHER = re.compile("[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u0482\u048a-\u052f\u2010-\u2027\u20ac]")
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> str:
    """The letter of each byte in a byte-level vocabulary: itself where it prints, else the next one from 256 on."""
    out, more = [], 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b if prints else more))
        more += not prints
    return "".join(out)


_LETTERS = _byte_letters()


class _Known(dict):
    """Ids of words; a new word is given to the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        out = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        if len(word) < 64:
            self[word] = out
        return out


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, equal to encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Known(self.tokenizer.model)

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        get = known.__getitem__
        for t in texts:
            if len(known) > KNOWN_WORDS:
                known.clear()
            if SPECIAL in t or _OTHER.search(t):
                out.append(array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(map(get, _WORD.findall(t))))
        return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str | None) -> Encoder:
    """One encoder a worker and vocabulary file."""
    path = path or default_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def batches_of_texts(texts: list[str | None], chars: int = 4_000_000):
    """Runs of consecutive rows with bounded text: (first row, texts with null as empty)."""
    first, size, some = 0, 0, []
    for k, t in enumerate(texts):
        some.append(t or "")
        size += len(some[-1])
        if size >= chars:
            yield first, some
            first, size, some = k + 1, 0, []
    if some:
        yield first, some

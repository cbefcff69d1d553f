"""White-space chunks of a text and their token ids under a public word tokenizer.

The tokenizer normalises, splits and merges inside white-space chunks only, so a text's ids are its chunks' ids in
order. A chunk is therefore the "word" that is encoded once and looked up afterwards.
"""

from __future__ import annotations

import functools
import re
import struct
import unicodedata

from tideline.llm.common import _SPACES

_ODD = re.compile("[\\x1c-\\x1f]")
_SPLIT = re.compile(_SPACES)


def chunks(text: str) -> list[str]:
    """Maximal runs without Unicode white space."""
    return [x for x in _SPLIT.split(text) if x] if _ODD.search(text) else text.split()


def _class(kind: str) -> str:
    """Characters below U+0180 of a Unicode category, for a regular expression."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: Below U+0180 the tokenizer's normal form is lower case alone (but for U+0130), and its pre-tokenizer's pattern is this.
_LATIN = re.compile("[\x00-\u012f\u0131-\u017f]+").fullmatch
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: its own, or one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


@functools.cache
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one for each Python worker."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Bounded(dict):
    """A cache that a Python worker keeps between tasks; ``limit`` bounds its entries and so its memory.

    Entries have two generations: when the new one holds half of the limit it becomes the old one, and what is asked for
    again moves back. So frequent words stay, and only rare ones are encoded anew.
    """

    limit = 600_000

    def __init__(self, path: str):
        super().__init__()
        self.path, self.old = path, {}

    def __missing__(self, x: str) -> bytes:
        found = self.old.get(x)
        if found is None:
            found = self.make(x)
        if 2 * len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[x] = found
        return found


class _Parts(_Bounded):
    """Ids of what the pre-tokenizer splits a chunk into."""

    def make(self, part: str) -> bytes:
        spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(_LETTERS)
        return _packed([t.id for t in tokenizer(self.path).model.tokenize(spelt)])


class Ids(_Bounded):
    """Id bytes (little-endian unsigned 32-bit integers) of chunks."""

    def __init__(self, path: str):
        super().__init__(path)
        self.parts = _Parts(path)

    def make(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # its own only part
            return self.parts.make(chunk.lower())
        if _LATIN(chunk) and "<|" not in chunk:
            return b"".join(map(self.parts.__getitem__, _PARTS(chunk.lower())))
        return _packed(tokenizer(self.path).encode(chunk, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        """The id bytes of a whole text."""
        return b"".join(map(self.__getitem__, chunks(text)))


@functools.cache
def ids_of(path: str) -> Ids:
    return Ids(path)

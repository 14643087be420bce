"""Token ids of whole texts, with each distinct word encoded once a worker.

``LibraryEncoder`` gives what the tokenizers library gives for a whole text.
The tokenizer drops white space and merges inside words only, so a text's ids
are those of its words one after the other; workers keep the ids of words in
a table of bounded size and hand only words that are not in it to the library.
Texts of plain characters are cut into words at once, all others first at
white space.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

from tokenizers import Tokenizer

#: Distinct words a worker remembers before it begins anew.
REMEMBERED = 600_000

_LETTERS = "a-zß-öø-ſ"
#: Texts of these characters only are the same in NFC, in lower case their
#: letters are ``_LETTERS``, and the white space among them is ASCII.
_OTHER = re.compile("[^\t-\r -~«»À-ÖØ-öø-įı-ſ–—‘-”…]")
_BETWEEN_SPACE = re.compile("[^\t-\r ]+").findall
#: What str.split takes for white space, but ASCII's own.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile(f"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies name each byte:
    printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordTable(dict):
    """Packed ids of words, found when first asked for. Its size is bounded:
    what one generation did not meet is forgotten when the next is full."""

    def __init__(self, encode: Callable[[str], bytes], size: int = REMEMBERED) -> None:
        super().__init__()
        self.encode, self.size, self.old = encode, size, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.encode(word)
        self[word] = found
        return found

    def trim(self) -> None:
        if len(self) > self.size // 2:
            self.old = dict(self)
            self.clear()


class LibraryEncoder:
    """Ids by the tokenizers library for a byte-level tokenizer that
    lower-cases, drops white space and cuts words at classes of characters.

    Words of plain texts are in the form that the library's own steps before
    the merges would give them, so they go to the library's model directly. In
    other texts nothing reaches across ASCII white space: normal forms, words
    and special strings all end there, so each chunk between it is encoded
    alone, by its words if it is plain and else by the whole library.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.controls = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.words, self.chunks = WordTable(self._word), WordTable(self._chunk)
        self._names = dict(enumerate(byte_characters()))

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() else word.encode().decode("latin-1").translate(self._names)
        return array("I", [t.id for t in self.library.model.tokenize(named)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if self._plain(chunk):
            return self._by_words(chunk)
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(c in text for c in self.controls)

    def _by_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORD.findall(text.lower())))

    def _text(self, text: str) -> bytes:
        if self._plain(text):
            return self._by_words(text)
        chunks = _BETWEEN_SPACE(text) if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        self.words.trim()
        self.chunks.trim()
        return [self._text(x) for x in texts]


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each worker process and file."""
    return LibraryEncoder(path)


def in_blocks(texts: list[str | None], chars: int = 1 << 20) -> Iterable[list[str]]:
    """``texts`` (null: empty) in runs of about ``chars`` characters."""
    block, held = [], 0
    for text in texts:
        block.append(text or "")
        held += len(block[-1])
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block

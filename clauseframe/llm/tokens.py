"""Tokenization helpers that encode each distinct word once in a task."""

from __future__ import annotations

import re
from array import array
from unicodedata import normalize

#: White space as the tokenizers' regular expressions see it (the Unicode property); a fixed value.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: ASCII punctuation but for the apostrophe, which may begin an ending; a fixed value.
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def vocabulary(name: str) -> str:
    """The path of a vocabulary file; the package is found where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):  # noqa: ANN201
    """The tokenizer, without truncation and padding; ``name`` is a vocabulary's name or a path."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(name if "/" in name else vocabulary(name))
    t.no_truncation()
    t.no_padding()
    return t


def units(text: str) -> list[str]:
    """The text cut before each run of white space that follows something else.

    Byte-level BPE looks forward only and joins nothing across such a cut, so the ids of the units, one after another, are
    the ids of the text.
    """
    return UNIT.findall(text)


#: Words held in a generation; two generations take about 330 MB.
HELD_WORDS = 750_000


class WordIds(dict):
    """Word (bytes, without white space) -> its ids as little-endian unsigned 32-bit, encoded once while it is held.

    For tokenizers that lower-case and drop white space: the ids of a text are those of its words, one after another. Two
    generations of at most ``most`` words are held; a word that is met again moves to the younger one, so that frequent
    words stay.
    """

    def __init__(self, name: str, special: bool = True, most: int = HELD_WORDS):
        super().__init__()
        self.tokenizer, self.most, self.old = load(name), most, {}
        self.tokenizer.encode_special_tokens = not special

    def __missing__(self, word: bytes) -> bytes:
        value = self.old.get(word)
        if value is None:
            value = self.parted(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value

    def parted(self, word: bytes) -> bytes:
        """The ids of a new word. Punctuation behind a letter or digit is a word of its own to the tokenizer, so it is cut off
        here, and one encoding serves a word however its sentence goes on."""
        core = word.rstrip(PUNCTUATION)
        if core and len(core) < len(word) and b"<|" not in word:
            last = core[-1:].decode() if core[-1] < 128 else normalize("NFC", core.decode()).lower()[-1]  # as the tokenizer sees it
            if last.isalpha() or last in "0123456789":
                return self[core] + self[word[len(core) :]]
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" not in data:  # else lower-casing could spell a special token
            data = data.lower()
        return b"".join(map(self.__getitem__, data.split()))


_held: dict[tuple, WordIds] = {}


def word_ids(name: str, special: bool = True, most: int = HELD_WORDS) -> WordIds:
    """The process's own ``WordIds`` of this kind: the tasks that one Python worker runs one after another share its bounded store, so
    that frequent words are not encoded anew in each. Only one kind is held; asking for another lets the first go."""
    if (name, special, most) not in _held:
        _held.clear()
        _held[name, special, most] = WordIds(name, special, most)
    return _held[name, special, most]

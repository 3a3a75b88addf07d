"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit numbers.

The tokenizer drops white space and works on each pre-token alone, and a corpus repeats its words. So
a text is cut at white space, and each process keeps the ids of the words and pre-tokens it met last
(two generations of at most ``KEPT``). A word within Latin-1 is lower-cased and cut into pre-tokens
here, by the rule in the tokenizer's file; any other word goes through the tokenizer, as does a
text that holds the string of a special token.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

KEPT = 500_000
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: The pre-token pattern of the tokenizer's file, for lower-case Latin-1.
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")


class Recent(dict):
    """The value of each string, found when first asked for; values not asked for lately go."""

    def __init__(self, find: Callable[[str], bytes], kept: int = KEPT):
        super().__init__()
        self.find, self.kept, self.old = find, kept, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.find(word)
        self[word] = out
        return out


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(0x100) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class TextTokens:
    """``ids(text)``: what the tokenizer returns for the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, [*special, *map(chr, range(0x1C, 0x20))])))
        self.words, self.pretokens = Recent(self._word), Recent(self._pretoken)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _pretoken(self, text: str) -> bytes:
        letters = text.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(word)
        return b"".join([self.pretokens[p] for p in _PRETOKEN.findall(word.lower())])

    def ids(self, text: str) -> bytes:
        if self.special.search(text):  # Python also splits at the characters 28 to 31
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@cache
def tokens(path: str) -> TextTokens:
    """One per process and file."""
    return TextTokens(path)

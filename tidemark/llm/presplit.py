"""Pre-splitting of texts for byte-level vocabularies."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import islice

import regex

#: The pre-splitting pattern of byte-level BPE, with Unicode's white space spelled out. Letters and digits
#: come first, which changes no match. The standard library has no class for numbers: texts with numbers that are no
#: decimal digits take the slower pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
PATTERN = rf" ?\p{{L}}+| ?\p{{N}}+|{ENDINGS}| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
QUICK = rf" ?[^\W\d_]+| ?\d+|{ENDINGS}| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@cache
def odd_numbers() -> frozenset[str]:
    """Characters on which the two patterns may differ: numbers that are no decimal digits, and what only one library knows."""
    letter, number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
    points = (chr(k) for k in range(128, sys.maxunicode + 1) if not 0xD800 <= k < 0xE000)
    return frozenset(c for c in points if unicodedata.category(c) in ("Nl", "No") or bool(letter(c)) != bool(c.isalpha()) or bool(number(c)) != bool(c.isdecimal()))


class Splitter:
    """split(text): the pre-tokens, which together are the text. Made on the driver; workers only compile the patterns."""

    def __init__(self) -> None:
        self.odd_numbers = odd_numbers()
        self._compile()

    def _compile(self) -> None:
        self.quick, self.slow = re.compile(QUICK), regex.compile(PATTERN)

    def __getstate__(self) -> dict:
        return {"odd_numbers": self.odd_numbers}

    def __setstate__(self, state: dict) -> None:
        self.odd_numbers = state["odd_numbers"]
        self._compile()

    def split(self, text: str) -> list[str]:
        return self._pattern(text).findall(text)

    def _pattern(self, text: str) -> re.Pattern | regex.Pattern:
        return self.quick if text.isascii() or self.odd_numbers.isdisjoint(set(text)) else self.slow

    def parts(self, text: str, size: int = 1 << 16) -> Iterator[list[str]]:
        """The pre-tokens in lists of so many, so that a long text does not become one list."""
        if len(text) <= size:
            yield self.split(text)
            return
        found = (m[0] for m in self._pattern(text).finditer(text))
        while some := list(islice(found, size)):
            yield some

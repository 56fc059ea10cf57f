"""The split that precedes byte-level merges: the same matches as public_tokenizers.PATTERN, by Python's re.

Letter and number classes are the code points of Unicode categories L and N; white space is Unicode's White_Space.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Code points with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def _ranges(major: str) -> str:
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(1)
def splitter() -> re.Pattern:
    letters, numbers, space = _ranges("L"), _ranges("N"), re.escape(WHITE_SPACE)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Cache(dict):
    """Results by piece, of bounded size: when full, the entries become the old half, of which those asked for again stay.

    Long pieces are never kept.
    """

    def __init__(self, make, most: int = 400_000, longest: int = 48) -> None:
        super().__init__()
        self.make, self.half, self.longest = make, most // 2, longest
        self.old: dict = {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > self.longest:
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value

"""Pre-tokens of a byte-level BPE vocabulary file, as its library cuts them.

The file names the special strings (cut out first, each one token) and the
vocabulary; the rest of a text is cut by ``PATTERN``. Python's regex module
and the library know different Unicode versions: a text with a character
outside ``KNOWN`` is given to the library itself (``exact`` says which).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex

#: Fixed value: the public pattern that cuts a text before the merges.
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Code points that both Unicode versions put in the same class.
KNOWN = ((0x0, 0x557), (0x58D, 0x88E), (0x890, 0xC5B), (0xCDD, 0x208E), (0x20A0, 0xA7CD),
         (0xAC00, 0xD7FF), (0xE000, 0x103FF), (0x1F000, 0x1FAFF))
_OTHER = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in KNOWN) + "]")


def exact(text: str) -> bool:
    """Whether ``PATTERN`` cuts this text as the library does."""
    return text.isascii() or _OTHER.search(text) is None


class Cutter:
    """Cuts texts into pre-tokens (str) and special tokens (int ids)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                       for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        self._cut = regex.compile(PATTERN).findall

    def pieces(self, text: str):
        """(pre-tokens, special ids met): lists of str, in order of the text;
        a special token appears as its int id."""
        if self._special is None or self._special.search(text) is None:
            return self._cut(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += self._cut(text[at:m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._cut(text[at:])


@lru_cache(maxsize=4)
def cutter(path: str) -> Cutter:
    return Cutter(path)


@lru_cache(maxsize=4)
def library(path: str):
    """The vocabulary in its own library, one thread, no truncation or padding."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t

"""Cutting a text into the pieces inside which a byte-level BPE merges."""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Blocks whose letters, digits and spaces the `regex` module and the tokenizers library class alike
#: (tests/llm/test_operators.py goes through every code point). Texts with others are cut by the library.
AGREED = "\\u0000-\\u052F\\u1E00-\\u208E\\u2100-\\u218B\\u2190-\\u23FF\\u2500-\\u27BF\\u3000-\\u303F\\u3041-\\u3096\\u30A0-\\u30FF\\u4E00-\\u9FEF\\uAC00-\\uD7A3\\uFF01-\\uFF5E\\U0001F300-\\U0001F64F"
_FOREIGN = re.compile(f"[^{AGREED}]")

#: Letters, digits and white space of the Latin blocks; texts of these and ASCII punctuation alone are cut by `re`, which is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \xa0"
_ODD = re.compile("[^\\t-\\r -~\xa0-ɏ]")
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes are themselves, the rest follow from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Cutter:
    """Special strings and pre-tokens of a tokenizer file, as the tokenizers library finds them."""

    def __init__(self, path: str):
        self.path = path
        self.specials = {t["content"]: t["id"] for t in self.read()["added_tokens"]}
        self._split = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.specials, key=len, reverse=True)))
        self._find = regex.compile(public_tokenizers.PATTERN).findall
        self._bytes = {c: b for b, c in byte_chars().items()}

    def read(self) -> dict:
        """The tokenizer file; what is needed of it is kept by those who ask."""
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, made where it is first asked for."""
        out = Tokenizer.from_file(self.path)
        out.no_padding()
        out.no_truncation()
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        if not _ODD.search(text):
            return _LATIN.findall(text)
        if not _FOREIGN.search(text):
            return self._find(text)
        return [bytes(self._bytes[c] for c in w).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is special, string) in order; empty strings are left out."""
        if not any(s in text for s in self.specials):
            return [(False, text)] if text else []
        return [(x in self.specials, x) for x in self._split.split(text) if x]


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    return Cutter(path)

"""Exact, memoised use of the public word-level BPE vocabulary.

White space never joins two pre-tokens of this vocabulary, so a text's ids are
the ids of its white-space tokens, one after the other. `WordPieces` keeps
one bounded memo of white-space tokens and pre-tokens; only pre-tokens that it
lacks reach the encoder behind it, which is the library's merging alone: they
are in normal form, lower case and split already. Texts with characters outside a plain
Latin set, or with a special-token marker, take `fallback` whole: Unicode
normal forms and special strings are then the library's business.
"""

from __future__ import annotations

import json
import re
import struct

import regex

# The pre-token pattern of the public vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Letters here have one-to-one lower case, are stable under NFC, and split()
# and the vocabulary agree on which of these characters are white space.
_NOT_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~À-įı-ɏ]")
_SPECIAL = "<|"
MEMO_ENTRIES = 400_000  # about 170 bytes each, in every Python worker


def is_plain(text: str) -> bool:
    return _SPECIAL not in text and _NOT_PLAIN.search(text) is None


class _Memo(dict):
    """A bounded dict that computes what it lacks; beyond its bound new
    entries are computed each time and not stored."""

    def __init__(self, compute, bound: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.bound:
            self[key] = value
        return value


class WordPieces:
    """`encode(pre-token) -> value` lifted to texts; `join` merges values."""

    def __init__(self, encode, join, fallback):
        self._encode, self._join, self._fallback = encode, join, fallback
        self._split = regex.compile(PRETOKEN).findall
        self._tokens = _Memo(self._of_token)

    def _of_token(self, token: str):
        # a pre-token splits into itself, so both kinds share one memo
        if token.isalpha():
            return self._encode(token)
        parts = self._split(token)
        if len(parts) == 1:
            return self._encode(token)
        return self._join([self._tokens[p] for p in parts])

    def __call__(self, text: str):
        if not is_plain(text):
            return self._fallback(text)
        return self._join(list(map(self._tokens.__getitem__, text.lower().split())))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies:
    printable Latin-1 bytes stand for themselves, the others are numbered
    from code point 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_id_encoders: dict[str, WordPieces] = {}


def id_encoder(path: str) -> WordPieces:
    """Text -> its ids as little-endian unsigned 32-bit bytes; one per worker."""
    if path not in _id_encoders:
        import numpy as np
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        merged, symbols = tokenizer.model.tokenize, dict(enumerate(byte_symbols()))

        def encode(word: str) -> bytes:
            if not word.isascii():  # printable ASCII stands for itself
                word = word.encode("utf-8").decode("latin-1").translate(symbols)
            ids = [t.id for t in merged(word)]
            return struct.pack(f"<{len(ids)}I", *ids)

        def whole(text: str) -> bytes:
            return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

        _id_encoders[path] = WordPieces(encode, b"".join, whole)
    return _id_encoders[path]


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def merge_ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(merges)}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

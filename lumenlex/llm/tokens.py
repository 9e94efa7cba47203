"""Byte-level BPE with a cache of words, exact for whole texts.

A token never reaches over the gap before a space that follows a character other than white space, so the ids of a
text are those of its words, each with the space before it, joined. Words repeat, their ids are cached. A text in
which two or more white space characters surround a space, or that holds a special token, is encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
assert sys.byteorder == "little" and array("I").itemsize == 4

#: A space whose neighbours on both sides are white space (or the end): word by word would cut such a run wrongly.
RUN = re.compile(r"\s (?:\s|\Z)")
#: Characters of which both encoders' character classes surely agree.
PLAIN = re.compile(r"[\x00-ɏ‐-‧]*\Z")
STOPS = ".,"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Bpe:
    """encode(text) gives the ids as packed little-endian unsigned 32-bit numbers."""

    def __init__(self, json_path: str, ranks_path: str, cached_words: int = 100_000):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.cached_words = cached_words
        self.stops = {c: self.raw(c) for c in STOPS}
        self.cache = _Cache(self)

    def raw(self, text: str) -> bytes:
        if (text.isascii() or PLAIN.match(text)) and not any(s in text for s in self.special):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or RUN.search(text):
            return self.raw(text)
        first, *rest = text.split(" ")
        return (self.raw(first) if first else b"") + b"".join(map(self.cache.__getitem__, rest))

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        out = [b""] * self.full.get_vocab_size()
        for token, rank in self.ranks.items():
            out[rank] = token
        for i, token in self.full.get_added_tokens_decoder().items():
            out[i] = token.content.encode()
        return out


class _Cache(dict):
    """Ids of a word with a space before it. The first cached_words words stay; others are encoded each time."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in STOPS and word[-2:-1].isalpha():  # a letter and a full stop never share a token
            ids = self[word[:-1]] + self.bpe.stops[word[-1]]
        else:
            ids = self.bpe.raw(" " + word)
        if len(self) < self.bpe.cached_words and len(word) < 64:
            self[word] = ids
        return ids


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(files: tuple[str, str]) -> Bpe:
    """One encoder for each Python worker."""
    if files not in _LOADED:
        _LOADED[files] = Bpe(*files)
    return _LOADED[files]

"""Tokenizers from vocabulary files, with words encoded once."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from seriesloom.llm.common import KEPT

CACHED_WORDS = 300_000

_PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ſ]|İ")
_SPLIT = {  # the tokenizers' own word patterns, for texts of plain characters only
    "byte": re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+"),
    "word": re.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\[-`{-~]+"),
}
# Byte-level vocabularies write a byte as one letter: printable ones as themselves, the others from U+0100 on in order.
_OWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {byte: 0x100 + rank for rank, byte in enumerate(b for b in range(0x100) if b not in _OWN)}
_encoders: dict[tuple[str, str, bool], Encoder] = {}
KEPT["tokens"] = _encoders.clear


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers, exactly as the tokenizer gives them.

    Both vocabularies merge inside words only. So a text of plain Latin characters is split by the
    tokenizer's pattern and each distinct word is encoded once, as long as it is remembered: words that
    were not met since the memory last filled up are forgotten. Any other text goes to the tokenizer whole,
    and so does one that holds the string of an added token, which gives that token's id; with ``plain`` such
    strings are ordinary text.
    """

    def __init__(self, path: str, kind: str, plain: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if plain:
            self.tokenizer.encode_special_tokens = True
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        self.lower, self.words = kind == "word", _SPLIT[kind].findall
        self.model = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text) or self.added and self.added(text):
            return self._encode(text).tobytes()
        if len(self.known) > CACHED_WORDS:
            self.before, self.known = self.known, {}
        words = self.words(text.lower() if self.lower else text)
        new = set(words).difference(self.known)
        if new:
            self._learn(new)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, words: set[str]) -> None:
        """New words go to the library's merge model itself: the split and the byte letters are known already, so the
        rest of its pipeline would only repeat them."""
        for w in words:
            found = self.before.get(w)
            if found is None:
                ids = [t.id for t in self.model(w.encode().decode("latin-1").translate(BYTE_LETTERS))]
                found = struct.pack(f"<{len(ids)}I", *ids)
            self.known[w] = found


def vocabulary(file: str, folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, or where the public tokenizers are installed."""
    if folder is not None:
        return f"{folder}/{file}"
    import public_tokenizers
    return public_tokenizers.path(file)


def encoder(file: str, kind: str, folder: str | None = None, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; ``kind`` is ``byte`` (byte-level BPE, spaces kept) or
    ``word`` (lower-cased words, white space dropped)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = vocabulary(file, folder), kind, plain
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]

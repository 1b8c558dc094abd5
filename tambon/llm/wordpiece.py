"""Whole-text tokenization with the public word BPE, a cache of words in front of the library.

The tokenizer's patterns never match across white space, and neither NFC nor lower-casing
does anything across it, so the ids of a text are those of its white-space-separated chunks
one after another. A text of Latin-1 characters is lower-cased and split into the tokenizer's pieces at once. Chunks
and pieces repeat (Zipf), hence each worker keeps bounded caches from them to
their ids as little-endian unsigned 32-bit bytes. Texts where the chunking could differ from the
library's (controls 1C-1F, which Python counts as white space, and the strings of special
tokens) go to the library whole.
"""

from __future__ import annotations

import os
import re
from struct import pack as pack_ids

import numpy as np
import regex

from .shared import worker_cache

CACHED = 200_000
_LONG_CHUNK = 64
_odd = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Chunks of these characters alone are split here: below U+0250 nothing composes under NFC, lower-casing
#: has no context, and letters and numbers have long been settled. All others go to the library.
_plain = re.compile(r"[\x21-\x7e\xa1-\u024f]+\Z").match
#: Fixed value: the tokenizer's own pattern.
_pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
#: The same for lower-cased Latin-1, whose letters and numbers can be named.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_latin_pieces = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself if it is one in Latin-1, else one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_characters = _byte_characters()


class _Cache(dict):
    """From string to ids; what is missing is encoded, and kept unless it is long. A full cache is set aside once, so that what is frequent survives."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= _LONG_CHUNK:
            self[key] = ids
        return ids

    def bound(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks, self.pieces = _Cache(self._chunk), _Cache(self._piece)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        # Printable ASCII is written as itself.
        tokens = self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_characters))
        return pack_ids(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        if len(chunk) > _LONG_CHUNK or not _plain(chunk):
            return self._library([chunk])[0]
        return b"".join(map(self.pieces.__getitem__, _pieces(chunk.lower())))

    def _text(self, text: str) -> bytes:
        if any(map(text.__contains__, _odd)):
            return self._library([text])[0]
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return b"".join(map(self.pieces.__getitem__, _latin_pieces(text.lower())))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; a null text is an empty one."""
        self.chunks.bound()
        self.pieces.bound()
        return [self._text(text) if text else b"" for text in texts]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> Encoder:
    """One per worker process."""
    return worker_cache(path, lambda: Encoder(path))

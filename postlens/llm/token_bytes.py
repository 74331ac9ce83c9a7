"""Whole-text encoding with a public ``tokenizers`` file, word by word through a cache.

The vocabulary file drops white space and its pattern never matches across a space or a line feed,
and canonical composition never reaches over either, so the ids of a text are the ids of its
space-separated words laid end to end.  The file's added tokens (``<|startoftext|>``,
``<|endoftext|>``) hold no space either: where a word contains one, the library itself cuts it out, as
the untouched file does.  Ids travel as little-endian unsigned 32-bit bytes: joining
cached byte strings is far cheaper than encoding the same words again.
"""

from __future__ import annotations

import re
import struct

import numpy as np

END_ID = 2
#: Entries kept per Python worker; beyond it the cache starts afresh (nothing is lost, only time).
CACHE_WORDS = 800_000
#: Longest word that is worth caching (characters).
CACHE_WORD_CHARS = 64

_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """word → ids as bytes; unknown words are encoded by the library."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self[""] = b""
        # the byte-level spelling of accented letters, as the library's own pre-tokenizer gives it
        from tokenizers.pre_tokenizers import ByteLevel
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def _letters(self, word: str) -> bytes:
        """Ids of lower-case letters: normalising and splitting leave them as they are, so the
        library's model is asked directly."""
        ids = [t.id for t in self.library.model.tokenize(word if word.isascii() else word.translate(self.spelling))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        # letters followed by marks are two pre-tokens, the letters in lower case
        m = _PLAIN.fullmatch(word)
        if m and (m[2] or m[1] != m[1].lower()):
            ids = self[m[1].lower()] + (self[m[2]] if m[2] else b"")
        elif m:
            ids = self._letters(word)
        else:
            ids = self._ids(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
                self[""] = b""
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""

    def sentence_ends(self) -> np.ndarray:
        """For each id: does a token with it close a sentence (a run of marks with . ! or ? in it)?"""
        vocab = self.library.get_vocab()
        ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            body = piece.removesuffix("</w>")
            ends[i] = piece.endswith("</w>") and any(c in ".!?" for c in body) and not any(c.isalnum() for c in body)
        return ends


def encoder(path: str) -> WordEncoder:
    """One encoder per vocabulary file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]

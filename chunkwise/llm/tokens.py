"""Tokenisation of whole texts, shared by the token files and the packer.

``TextEncoder.encode`` gives the ids that the tokenizers library gives for the
whole text.  A text whose only white space is single blanks and newlines is cut
before every blank and around every newline, where the tokenizer's own
pre-tokenisation always cuts; each distinct piece is encoded by the library
once per worker.  Any other text is encoded in one go, and so is one that spells
an added token of the vocabulary, which then is that token, as in the library.  Plain Latin words need
no normaliser or pre-tokeniser beyond lower case and the byte alphabet, so
they go straight to the library's model.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from chunkwise.llm.worker_cache import per_worker

CACHE_PIECES = 400_000  # per generation and Python worker; two generations are kept
# Latin letters that are their own normal form and lower-case to one letter; a full stop or comma may follow.
_WORD = re.compile("( ?[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,]?)")
_OTHER_SPACE = [
    "  ", " \n", "\n\n",
    *(chr(c) for c in (9, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)),
]


class _Pieces(dict):
    """piece -> ids as little-endian unsigned 32-bit bytes; the least recently made half is dropped when full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class TextEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes, by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]  # a text that spells one goes through the library whole
        self.added_any_case = any(t.normalized for t in added)
        self.model = self.tokenizer.model
        shape = json.loads(self.tokenizer.to_str())
        self.lower = "Lowercase" in json.dumps(shape["normalizer"])
        self.blank = shape["pre_tokenizer"]["type"] == "ByteLevel"  # else white space is dropped
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        chars = [" ", *(chr(c) for c in range(0x41, 0x250) if _WORD.fullmatch(chr(c)))]
        self.alphabet = {ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in chars}
        self.first = _Pieces(self._piece)  # at the start of a line
        self.later = _Pieces(lambda piece: self._piece(" " + piece)) if self.blank else self.first
        self.newline = self._library("\n")

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        plain = _WORD.fullmatch(piece)
        if not plain:
            return self._library(piece)
        word = plain[1].lower() if self.lower else plain[1]
        ids = array("I", [t.id for t in self.model.tokenize(word.translate(self.alphabet))]).tobytes()
        return ids + self.first[plain[2]] if plain[2] else ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in _OTHER_SPACE) or any(t in text for t in self.added):
            return self._library(text)
        if self.added_any_case and any(t.lower() in text.lower() for t in self.added):
            return self._library(text)
        lines = text.split("\n")
        if not self.blank:
            lines = [" ".join(lines)]
        out = []
        for line in lines:
            pieces = line.split(" ")
            out.append(self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:])))
        return self.newline.join(out)


def encoder(path: str) -> TextEncoder:
    """One encoder per worker and file."""
    return per_worker(("encoder", path), lambda: TextEncoder(path), large=True)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

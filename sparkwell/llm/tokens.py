"""Whole-text encoding with the tokenizers library, fast on text that repeats its words."""

from __future__ import annotations

import os
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLANK = str.maketrans("\t\n\r", "   ")
#: Words that one worker remembers, in two generations; at about 250 bytes each.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte, by their published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Token ids of texts as little-endian unsigned integers, of 2 bytes for vocabularies of up to 65,536 ids and of 4 otherwise.

    The vocabulary's own rules cut at every white space, so the ids of a text are the ids of its
    blank-separated words in order. Each word goes through the library once and is then looked
    up; plain lower-case words go to the library's model directly, all others through its
    whole chain. ``tests/llm`` compares it with the library on whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind, self.letter = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        # The direct way holds for a vocabulary of this kind only; others take the whole chain per text.
        self.by_word = self._is_word_vocabulary()
        self[""] = b""

    def _is_word_vocabulary(self) -> bool:
        import json

        kinds = json.loads(self.tokenizer.to_str())
        chain = [x["type"] for x in (kinds["normalizer"] or {}).get("normalizers", [])]
        before = [x["type"] for x in (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])]
        return chain == ["NFC", "Replace", "Lowercase"] and before == ["Split", "ByteLevel"]

    def _library(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array(self.letter, ids).tobytes()
        return np.array(ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            if word[-1] in ".," and word[:-1].isalpha():
                found = self[word[:-1]] + self[word[-1]]
            else:
                low = word.lower() if word.isascii() else unicodedata.normalize("NFC", word).lower()
                if low.isalpha() and "σ" not in low and "ς" not in low:
                    spelled = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                    found = self.packed([t.id for t in self.model.tokenize(spelled)])
                else:
                    found = self._library(word)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
            self[""] = b""
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._library(text)
        return b"".join(map(self.__getitem__, text.translate(BLANK).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process."""
    return WordEncoder(path)


def texts_of(batch: pa.RecordBatch, column: str):
    """The column's strings one by one, without a list of the whole batch."""
    return (x.as_py() for x in batch.column(column))

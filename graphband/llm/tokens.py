"""Whole texts to token ids with the tokenizers library, each distinct word once.

Under a vocabulary that drops white space and never merges across it, a text's
ids are those of its words in turn.  A worker therefore keeps the ids of the
words that it has met, in a table of bounded size, and asks the library only
for new ones.
"""

from __future__ import annotations

import os
import struct

import numpy as np

MAX_BYTES = 192 << 20  # of a worker's table, by estimate; it starts anew when full
ENTRY = 150  # bytes of an entry besides its word and ids
LONG = 256  # bytes of a word that is not kept
_END_MARKS = b".,;:!?"


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as the character of its number if that is printed, else as the next one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {b: 256 + k for k, b in enumerate(others)}


_CHARACTERS = _byte_characters()


def letters(word: bytes) -> str | None:
    """A word of lower-case Latin letters as the vocabulary spells it; None of any other.

    The normaliser leaves such a word alone, and it is one pre-token.
    """
    if word.isascii():
        return word.decode("ascii") if word.isalpha() and word.islower() else None  # texts with special strings come in their own case
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return None
    if max(text) < "\u0180" and text.isalpha() and text == text.lower():
        return word.decode("latin-1").translate(_CHARACTERS)
    return None


class WordEncoder:
    """Ids of texts under a word-separating vocabulary of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ids: dict[bytes, bytes] = {}
        self.held, self.most = 0, MAX_BYTES

    def _model(self, spelled: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[bytes]) -> None:
        """Words of letters, with one mark at most after them, by the model itself; all others by the library."""
        hard = []
        for w in words:
            # Only letters end a pre-token before a mark; other marks before it would join it.
            stem, mark = (w[:-1], w[-1:]) if w[-1] in _END_MARKS else (w, b"")
            spelled = letters(stem)
            if spelled is None:
                hard.append(w)
                continue
            if mark and mark not in self.ids:
                self.ids[mark] = self._library([mark])[0]
            self.ids[w] = (self.ids.get(stem) or self._model(spelled)) + (self.ids[mark] if mark else b"")
        for i in range(0, len(hard), 4096):
            part = hard[i : i + 4096]
            self.ids.update(zip(part, self._library(part), strict=True))

    def _library(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        for i in range(0, len(texts), 256):
            split = []
            for t in texts[i : i + 256]:
                low = t.lower()  # A-Z only; the normaliser lower-cases everything, except in special strings
                split.append((t if b"<|" in low else low).split())
            needed = set().union(*split)
            new = needed.difference(self.ids)
            if new and self.held > min(self.most, MAX_BYTES):
                self.ids.clear()
                self.held, new = 0, needed
            self._learn(new)
            get = self.ids.__getitem__
            out += [b"".join(map(get, words)) for words in split]
            for w in new:
                if len(w) > LONG:
                    del self.ids[w]
                else:
                    self.held += ENTRY + len(w) + len(self.ids[w])
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, most: int = MAX_BYTES) -> WordEncoder:
    """This worker's encoder, kept from task to task, with a table of ``most`` bytes."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]

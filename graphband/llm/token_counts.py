"""Token counts by byte-pair merging on a heap and a linked list.

A count needs no identifiers: a word starts as one symbol a byte and loses one
with each merge.  The adjacent pair of lowest rank, leftmost first, is popped
again and again until no pair has a rank.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from graphband.llm.text import encoded
from graphband.llm.tokens import ENTRY, LONG, MAX_BYTES, letters
from graphband.session import ship_package


def merged_count(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank."""
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or rank.get((symbols[i], symbols[j])) != r:
            continue  # a neighbour has changed since this pair was pushed
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (x := rank.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (x, i))
        if (h := before[i]) >= 0 and (x := rank.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (x, h))
    return n - merges


class TokenCounter:
    """Counts under a vocabulary file with ranked merges and an end-of-word suffix.

    Normalising and cutting into pre-tokens follow the file; special strings
    inside a text count one each, as the library treats them by default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = Tokenizer.from_file(path)
        self.normalise, self.cut = parts.normalizer.normalize_str, parts.pre_tokenizer.pre_tokenize_str
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.counts: dict[bytes, int] = {}
        self.held = 0

    def _piece(self, piece: str) -> int:
        return merged_count([*piece[:-1], piece[-1] + self.end], self.rank)

    def _word(self, word: bytes) -> int:
        spelled = letters(word)
        if spelled is not None:
            return self._piece(spelled)
        text, total = word.decode("utf-8", "replace"), 0
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            total += 1 if i % 2 else sum(self._piece(p) for p, _ in self.cut(self.normalise(part))) if part else 0
        return total

    def count(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(texts), 256):
            split = []
            for t in texts[i : i + 256]:
                low = t.lower()
                split.append((t if b"<|" in low else low).split())
            needed = set().union(*split)
            new = needed.difference(self.counts)
            if new and self.held > MAX_BYTES:
                self.counts.clear()
                self.held, new = 0, needed
            self.counts.update((w, self._word(w)) for w in new)
            get = self.counts.__getitem__
            out += [sum(map(get, words)) for words in split]
            for w in new:
                if len(w) > LONG:
                    del self.counts[w]
                else:
                    self.held += ENTRY + len(w)
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """This worker's counter, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    One pass without a shuffle.  A null text counts as empty: 0 bytes, 0
    tokens.  Repeated rows and null ids give a row each; other columns are not
    read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = counter(tokenizer)
        for b in batches:
            texts = encoded(b["text"])
            n = pd.Series(tool.count(texts), dtype="int64")
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": pd.Series(map(len, texts), dtype="int64"), "n_tokens": n, "over_limit": n > limit})

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

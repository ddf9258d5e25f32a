"""Unigram encoding and decoding with the pieces of a SentencePiece model file.

Pieces and their log scores stand in a double-array trie over UTF-8 bytes.  A
file of merges has ranks in place of log scores: these become log probabilities
by Zipf's law, so that a rare piece costs as much as a few common ones and not
thousands of them.  Nothing is trained.
Viterbi's algorithm finds the segmentation of highest total score; a character
that no piece covers costs the least score less ten and becomes its bytes.
Spaces are written as a marker, with one before the text, and decoding turns
markers back.  No piece has a marker after another character, so a text's best
segmentation is that of its marker-led chunks in turn; a worker keeps those of
the chunks it has met in a table of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from graphband.session import ship_package

MARK = "▁"
MAX_BYTES = 128 << 20  # of a worker's table, by estimate; it starts anew when full
ENTRY = 200  # bytes of an entry besides its text and ids
LONG = 256  # characters of a chunk that is not kept
ZIPF_OFFSET = 2.7
UNKNOWN_PENALTY = 10.0


class DoubleArrayTrie:
    """Byte strings to numbers: the child of node s by byte b is base[s] + b + 1 where check agrees; a value is the child by 0."""

    def __init__(self, keys: list[tuple[bytes, int]]) -> None:
        children: list[dict[int, int]] = [{}]
        value: list[int] = [-1]
        for key, number in keys:
            s = 0
            for b in key:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][b]
            value[s] = number
        size = len(children) * 2 + 512
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        place = {0: 0}
        used = bytearray(size)
        used[0] = 1
        free, recent = 257, 0  # low slots are out of reach of most bytes; where a single child is tried first, and several ones
        todo = [0]
        while todo:
            s = todo.pop()
            at, kids = place[s], sorted(children[s])
            self.value[at] = value[s]
            if not kids:
                continue
            while used[free]:
                free += 1
            base = max(free - kids[0] - 1, recent - 64 if len(kids) > 1 else 0, 0)
            while any(used[base + b + 1] for b in kids):
                base += 1
                if base + 258 >= len(used):
                    more = len(used)
                    used.extend(bytes(more))
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
            self.base[at] = base
            recent = max(recent, base)
            for b in kids:
                t = base + b + 1
                used[t] = 1
                self.check[t] = at
                place[children[s][b]] = t
                todo.append(children[s][b])


class _Words(dict):
    """Ids of words with a marker before them, found when they are first asked for."""

    def __init__(self, codec: UnigramCodec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        found = self.codec._chunk(MARK + word)
        if len(word) <= LONG:
            self[word] = found
            self.codec.held += ENTRY + len(word) + len(found)
        return found


def log_scores(scores: dict[int, float]) -> dict[int, float]:
    """Scores as they are; of ranks (whole numbers), log probabilities by Zipf's law, best first, that sum to one."""
    values = list(scores.values())
    if any(x != int(x) for x in values):
        return scores
    order = sorted(scores, key=scores.__getitem__, reverse=True)
    weight = 1.0 / (np.arange(len(order)) + ZIPF_OFFSET)
    return dict(zip(order, np.log(weight / weight.sum()).tolist(), strict=True))


class UnigramCodec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has a marker after another character")
        self.score = log_scores({i: float(model.get_score(i)) for i in plain})
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArrayTrie([(pieces[i].encode(), i) for i in plain])
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = pieces[i].replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.joined = {x[k : k + 2] for x in (pieces[i] for i in plain) for k in range(len(x) - 1)}
        self.chunks: dict[str, bytes] = {}
        self.held = 0
        self.words = _Words(self)

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equally good ones, the one whose last piece starts first."""
        data = text.encode("utf-8", "replace")
        n = len(data)
        best: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        best[0] = 0.0
        at = 0
        while at < n:
            first = data[at]
            char = at + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            so_far, single, s = best[at], False, 0
            for end in range(at + 1, n + 1):  # along the trie
                t = base[s] + data[end - 1] + 1
                if check[t] != s:
                    break
                s = t
                if (i := value[s]) >= 0:
                    total = so_far + score[i]
                    if best[end] is None or total > best[end]:
                        best[end], back[end] = total, (at, i)
                    single |= end == char
            if not single:
                total = so_far + self.least
                if best[char] is None or total > best[char]:
                    best[char], back[char] = total, (at, -1)
            at = char
        out: list[int] = []
        while n:
            start, i = back[n]
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(data[start:n])]
            else:
                out.append(self.unknown)
            n = start
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; it is cut where no piece has these two characters side by side, as no piece can cross there."""
        found = self.chunks.get(chunk)
        if found is None:
            joined = self.joined
            cuts = [k for k in range(1, len(chunk)) if chunk[k - 1 : k + 1] not in joined]
            if cuts:
                return b"".join([self._chunk(chunk[a:b]) for a, b in zip([0, *cuts], [*cuts, len(chunk)], strict=True)])
            found = np.array(self.viterbi(chunk), "<i4").tobytes()
            if len(chunk) <= LONG:
                self.chunks[chunk] = found
                self.held += ENTRY + len(chunk) + len(found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; none of an empty one."""
        if not text:
            return np.empty(0, "<i4")
        if self.held > MAX_BYTES:
            self.words.clear()
            self.chunks.clear()
            self.held = 0
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<i4")
        chunks = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return np.frombuffer(b"".join(map(self._chunk, chunks)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text, with each marker as a space and without the one that encoding put first."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_CODECS: dict[str, UnigramCodec] = {}


def codec(path: str) -> UnigramCodec:
    """This worker's codec, kept from task to task."""
    if path not in _CODECS:
        _CODECS[path] = UnigramCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, n_bytes_fallback, ids_crc32, decoded (whether decoding gives the text back) of each row.

    A null or empty text has no ids.  Null ids and repeated rows give a row
    each; other columns are not read; an empty table gives no rows.  A marker
    that stands in the text itself comes back as a space.  No shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = codec(model)
        fallback = np.zeros(len(tool.raw), bool)
        fallback[list(tool.byte_ids.values())] = True
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.iloc[i : i + 512]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                ids = [tool.encode(t) for t in texts]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").array,
                    "ids": ids,
                    "n_tokens": [len(x) for x in ids],
                    "n_bytes_fallback": [int(fallback[x].sum()) for x in ids],
                    "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids],
                    "decoded": [tool.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)],
                })

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, "doc_id long, ids array<int>, n_tokens long, n_bytes_fallback long, ids_crc32 long, decoded boolean")

"""Hierarchical packing of documents into windows of several context sizes.

A document is cut into full windows of the largest size; what is left of it is
routed to the smallest context size that holds it.  Windows are filled in turn,
longest tier first: a gap takes the longest whole piece that fits, mostly one of
a shorter tier, and only where none fits a longer piece is cut.  So windows are
full; the last one of a task is cut at powers of two.  Each task packs its own
documents, whatever their number, with one batch in memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphband.llm.text import encoded
from graphband.llm.tokens import MAX_BYTES, encoder
from graphband.session import ship_package

TIERS = (256, 512, 1024, 2048)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_id long"


class Shelf:
    """Pieces by length; finds the longest at most, or the shortest above, a length."""

    def __init__(self, top: int) -> None:
        self.by: list[list] = [[] for _ in range(top + 1)]
        self.has = np.zeros(top + 1, bool)
        self.n = 0

    def put(self, length: int, piece: tuple) -> None:
        self.by[length].append(piece)
        self.has[length] = True
        self.n += 1

    def take(self, length: int) -> tuple:
        piece = self.by[length].pop()
        self.has[length] = bool(self.by[length])
        self.n -= 1
        return piece

    def at_most(self, length: int) -> int:
        """The longest length on the shelf up to this one, 0 if none."""
        back = self.has[length:0:-1]
        i = int(back.argmax())
        return length - i if len(back) and back[i] else 0

    def above(self, length: int) -> int:
        """The shortest length on the shelf beyond this one, 0 if none."""
        on = self.has[length + 1 :]
        i = int(on.argmax()) if len(on) else 0
        return length + 1 + i if len(on) and on[i] else 0


class Packer:
    """Packs (document, start, length) pieces; ``add`` and ``finish`` return closed windows as (tier, pieces)."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers, self.top = tuple(sorted(tiers)), max(tiers)
        self.shelf = Shelf(self.top)
        self.open: list[tuple] = []
        self.open_tier = self.open_used = 0

    def add(self, docs: list[tuple[int, int]]) -> list[tuple[int, list[tuple]]]:
        """docs: (document, tokens).  All but one open window are closed before it returns."""
        out = []
        for doc, n in docs:
            full = n // self.top
            out += [(self.top, [(doc, i * self.top, self.top)]) for i in range(full)]
            if n % self.top:
                self.shelf.put(n % self.top, (doc, full * self.top))
        while self.shelf.n:
            if not self.open:
                longest = self.shelf.at_most(self.top)
                self.open_tier = next(t for t in self.tiers if t >= longest)
                self._place(longest, longest)
            elif fits := self.shelf.at_most(self.open_tier - self.open_used):
                self._place(fits, fits)
            else:
                gap = self.open_tier - self.open_used
                self._place(self.shelf.above(gap), gap)
            if self.open_used == self.open_tier:
                out.append((self.open_tier, self.open))
                self.open, self.open_used = [], 0
        return out

    def _place(self, length: int, used: int) -> None:
        doc, start = self.shelf.take(length)
        self.open.append((doc, start, used))
        self.open_used += used
        if length > used:
            self.shelf.put(length - used, (doc, start + used))

    def finish(self) -> list[tuple[int, list[tuple]]]:
        """The open window, cut at the powers of two in its length: none of its parts needs padding."""
        out, pieces = [], list(self.open)
        left = self.open_used
        while left:
            size = 1 << (left.bit_length() - 1)
            part, need = [], size
            while need:
                doc, start, n = pieces.pop(0)
                part.append((doc, start, min(n, need)))
                if n > need:
                    pieces.insert(0, (doc, start + need, n - need))
                need -= part[-1][2]
            out.append((size, part))
            left -= size
        self.open, self.open_used = [], 0
        return out


def steps(windows: list[tuple[int, list[tuple]]], size: int) -> list[int]:
    """A step for each window: about ``size`` windows each, dealt back and forth by attention cost, so that steps cost alike."""
    n = max(1, -(-len(windows) // size))
    cost = [sum(p[2] ** 2 for p in pieces) for _, pieces in windows]
    out = [0] * len(windows)
    for rank, i in enumerate(sorted(range(len(windows)), key=cost.__getitem__, reverse=True)):
        lap, at = divmod(rank, n)
        out[i] = at if lap % 2 == 0 else n - 1 - at
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_windows: int = 16, id_col: str = "doc_id", text_col: str = "text", table: int = MAX_BYTES) -> DataFrame:
    """One row for each piece: its document, place and checksum, and its window, tier and training step.

    A null or empty text is its end token alone.  Null ids and repeated rows
    are documents of their own; other columns are not read; an empty table
    gives no rows.  Numbers of windows and steps are unique over all tasks.
    No shuffle: memory is one batch of token ids, the open window and a table of
    words' ids of about ``table`` bytes, which a worker keeps between tasks.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, packer = encoder(tokenizer, table), Packer(tiers)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        kept: dict[int, tuple] = {}  # documents with tokens in the open window
        number = windows_out = steps_out = 0

        def rows(windows: list[tuple[int, list[tuple]]]) -> pd.DataFrame:
            nonlocal windows_out, steps_out
            out = []
            for (tier, pieces), step in zip(windows, steps(windows, step_windows), strict=True):
                offset = 0
                for doc, start, n in pieces:
                    name, ids = kept[doc]
                    out.append((name, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + windows_out, offset, tier, base + steps_out + step))
                    offset += n
                windows_out += 1
            steps_out += -(-len(windows) // step_windows)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            return frame.astype({"doc_id": "Int64"})

        for b in batches:
            names = b["doc_id"].astype("Int64").tolist()
            texts = encoded(b["text"])
            for i in range(0, len(texts), 2048):
                new = []
                for name, ids in zip(names[i : i + 2048], tool.encode(texts[i : i + 2048]), strict=True):
                    kept[number] = (None if name is pd.NA else name, ids + end)
                    new.append((number, len(ids) // 4 + 1))
                    number += 1
                yield rows(packer.add(new))
                still = {p[0] for p in packer.open}
                kept = {k: v for k, v in kept.items() if k in still}
        if last := packer.finish():
            yield rows(last)

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, PIECES)

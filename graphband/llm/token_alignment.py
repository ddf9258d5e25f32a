"""Alignment of two tokenisations of the same texts by merge-path partitioning.

The ends of A's and B's tokens are two sorted lists of byte offsets.  Merged,
with A's first of equal ones, each end closes a link between the two tokens that
lie over it; offsets in both lists close a group.  A diagonal of the merge grid
holds all ways to take so many ends, and a binary search finds where the merge
crosses it.  Diagonals at equal distances so cut the merge into pieces of equal
work that know nothing of each other, whatever the lengths of texts are: a piece
emits its links and the groups that it closes, and groups that go on over a
piece's end are stitched.

Both tokenisers cut before a space that follows other than white space, so a
text is a row of units (a space and what follows) that are tokenised alike
wherever they stand.  A worker keeps the links and groups of units in a table of
bounded size; the new units of a batch are tokenised and merged together.

A task's documents form chunks.  A chunk has a list of its distinct id pairs with
the number of its documents that hold each, and its documents name pairs by
their place in that list.  Counts of all chunks are summed, each chunk's list
is joined with them, and the answers meet the chunk's documents by the chunk's
own number, which is written with it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.llm import lookup
from graphband.llm.tokens import _byte_characters
from graphband.session import materialise, ship_package

PIECE = 1 << 16  # ends in a piece of the merge
NEW = 1 << 15  # characters of new units that are tokenised at once
MAX_BYTES = 160 << 20  # of a worker's table, by estimate; it starts anew when full
ENTRY = 400  # bytes of an entry besides its contents
LONG = 256  # bytes of a unit that is not kept
CHUNK = 1 << 20  # distinct pairs of its documents, added up, that fill a chunk
SLICE = 1 << 22  # characters of a long text that are looked up at once

MARK = "▁"
#: Before a space that follows other than white space and has something after it.
_CUT = re.compile(r"(?<=\S)(?= [\s\S])")
#: Where a space does not begin a unit.
_JOINED = re.compile(r"[^\S ] ")


def crossings(a: np.ndarray, b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """How many of the first ``diagonal`` ends of the merge of a and b are a's; of equal ends a's comes first."""
    low, high = np.maximum(diagonal - len(b), 0), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        i, j = np.minimum(middle, len(a) - 1), np.clip(diagonal - middle - 1, 0, max(len(b) - 1, 0))
        more = open_ & (a[i] <= b[j])
        low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
    return low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, i_end: int, j: int, j_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token), and the (A token, B token) that close a group, of one piece of the merge."""
    over_a, over_b = np.arange(i, i_end), np.arange(j, j_end)
    b_of = j + np.searchsorted(b[j:j_end], a[i:i_end], side="left")
    a_of = i + np.searchsorted(a[i:i_end], b[j:j_end], side="right")
    last = np.maximum(a_of - 1, 0)
    both = (a_of > 0) & (a[last] == b[over_b])  # A's end has made this link
    return np.concatenate([over_a, a_of[~both]]), np.concatenate([b_of, over_b[~both]]), last[both], over_b[both]


def merge_path(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two sorted lists of token ends with the same last one: links by A token then B token, and the last tokens of groups in order."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, size), total)
    i = crossings(a, b, diagonal)
    j = diagonal - i
    pieces = [merge_piece(a, b, *x) for x in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True)]
    x, y, ga, gb = (np.concatenate(c) if pieces else np.empty(0, np.int64) for c in zip(*pieces, strict=True)) if pieces else [np.empty(0, np.int64)] * 4
    by = np.lexsort((y, x))
    return x[by], y[by], ga, gb


class Pair:
    """Two tokenisers and what their tokens are in bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        spelled = _byte_characters()  # of bytes that are not printed; others stand for themselves
        number = {chr(spelled.get(b, b)): b for b in range(256)}
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes([number[c] for c in vocabulary.get(i, "") if c in number]) for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.b.get_piece_size()
        piece = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(piece)]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(piece) if not self.b.is_control(i)):
            raise ValueError("a piece has a marker after another character")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), n))]
        #: unit without its space -> (clean, n_a, n_b, n_groups, n_links, groups, pairs)
        self.units: dict[str, tuple] = {}
        self.held = 0

    def tokens(self, rest: str) -> tuple[list[int], list[int], bytes, bytes]:
        """A's ids of space and text, B's of the text, and what they are in bytes."""
        a = self.a.encode_batch_fast([" " + rest], add_special_tokens=False)[0].ids
        b = self.b.encode(rest, num_threads=1)
        return a, b, b"".join([self.bytes_a[i] for i in a]), b"".join([self.bytes_b[i] for i in b])

    def _aligned(self, units: list[str], a: list[int], b: list[int]) -> list[tuple]:
        """Entries of units whose tokens stand one unit after another."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        x, y, ga, gb = merge_path(end_a, end_b)
        pairs = a[x] * len(self.bytes_b) + b[y]
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) + 1 for u in units])
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = np.searchsorted(x, last_a, side="right").tolist()
        groups = (np.searchsorted(ga, last_a) + 1).tolist()
        names = self.names
        spelled_a, spelled_b = [names[i] for i in a.tolist()], [names[i] for i in b.tolist()]
        written, i, j = [], 0, 0
        for ia, ib in zip((ga + 1).tolist(), (gb + 1).tolist(), strict=True):
            written.append(f"{spelled_a[i]}|{spelled_b[j]}" if ia == i + 1 and ib == j + 1 else f"{','.join(spelled_a[i:ia])}|{','.join(spelled_b[j:ib])}")
            i, j = ia, ib
        out, fa, fb, fg, fl = [], 0, 0, 0, 0
        for na, nb, ng, nl in zip((last_a + 1).tolist(), (last_b + 1).tolist(), groups, links, strict=True):
            out.append((True, na - fa, nb - fb, ng - fg, nl - fl, ";".join(written[fg:ng]).encode(), pairs[fl:nl].tobytes()))
            fa, fb, fg, fl = na, nb, ng, nl
        return out

    def _learn(self, units: list[str]) -> dict[str, tuple]:
        """Entries of new units; those that end in white space by themselves, others one after another as one text."""
        found: dict[str, tuple] = {}
        at = 0
        plain = []
        for u in units:
            if u[-1:].isspace() or not u:
                self._single(u, found)
            else:
                plain.append(u)
        while at < len(plain):
            size, end = 0, at
            while end < len(plain) and size < NEW:
                size += len(plain[end]) + 1
                end += 1
            part = plain[at:end]
            a, b, bytes_a, bytes_b = self.tokens(" ".join(part))
            whole = " ".join(["", *part]).encode("utf-8", "surrogatepass")
            if bytes_a == whole and bytes_b == whole:
                found.update(zip(part, self._aligned(part, a, b), strict=True))
            else:
                for u in part:
                    self._single(u, found)
            at = end
        return found

    def _single(self, unit: str, found: dict[str, tuple]) -> None:
        a, b, bytes_a, bytes_b = self.tokens(unit)
        whole = (" " + unit).encode("utf-8", "surrogatepass")
        found[unit] = self._aligned([unit], a, b)[0] if bytes_a == whole and bytes_b == whole else (False, 0, 0, 0, 0, b"", b"")

    def entries(self, texts: list[list[str]]) -> list[list[tuple]]:
        """Entries of the units of some texts."""
        needed = dict.fromkeys(chain.from_iterable(texts))
        new = [u for u in needed if u not in self.units]
        if new and self.held > MAX_BYTES:
            self.units.clear()
            self.held, new = 0, list(needed)
        self.units.update(self._learn(new))
        get = self.units.__getitem__
        out = [list(map(get, units)) for units in texts]
        for u in new:
            if len(u) > LONG:
                del self.units[u]
            else:
                e = self.units[u]
                self.held += ENTRY + len(u) + len(e[5]) + len(e[6])
        return out


def units_of(text: str) -> list[str]:
    """The units of space and text, each without its space; none of an empty text."""
    if not text:
        return []
    words = text.split(" ")
    if "" in words or _JOINED.search(text):
        return [u[1:] for u in _CUT.split(" " + text)]
    return words


def slices_of(text: str, size: int = SLICE) -> Iterator[str]:
    """Parts of a long text that end where a unit does; without the space that a part starts with."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start() + 1
    yield text[at:]


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """This worker's tokenisers and table, kept from task to task."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return _PAIRS[path_a, path_b]


class Aligned:
    """What one text comes to: counts, the groups' digest (and the groups, if asked for), distinct pairs and how often each is there."""

    def __init__(self, with_groups: bool = False) -> None:
        self.n = np.zeros(4, np.int64)
        self.sha, self.first, self.clean = hashlib.sha256(), True, True
        self.groups: list[bytes] | None = [] if with_groups else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, entries: list[tuple]) -> None:
        clean, na, nb, ng, nl, written, pairs = zip(*entries, strict=True)
        self.clean &= all(clean)
        if not self.clean:
            return
        self.n += (sum(na), sum(nb), sum(ng), sum(nl))
        text = b";".join(written)
        self.sha.update(text if self.first else b";" + text)
        if self.groups is not None:
            self.groups.append(text)
        self.first = False
        self.parts.append(np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True))

    def result(self) -> tuple[list[int], str, str | None, np.ndarray, np.ndarray]:
        nothing = np.empty(0, np.int64)
        if not self.clean or self.first:
            return [0, 0, 0, 0], "", None if self.groups is None else "", nothing, nothing
        key, n = self.parts[0]
        if len(self.parts) > 1:
            key, at = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in self.parts])).astype(np.int64)
        return self.n.tolist(), self.sha.hexdigest(), None if self.groups is None else b";".join(self.groups).decode(), key, n


def _texts(column: list) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def aligned(tool: Pair, texts: list[str], with_groups: bool = False) -> Iterator[tuple]:
    """The result of each text, some at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < SLICE and len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        if end == at:  # a long text, part by part
            one = Aligned(with_groups)
            for part in slices_of(texts[at]):
                one.add(tool.entries([units_of(part) or [""]])[0])
            yield one.result()
            at += 1
            continue
        for entries in tool.entries([units_of(t) for t in texts[at:end]]):
            one = Aligned(with_groups)
            if entries:
                one.add(entries)
            yield one.result()
        at = end


DOCS = "chunk long, doc_id array<long>, n array<long>, sha array<string>, held array<long>, place binary, times binary, pair array<long>, holders array<long>"


def chunks(docs: DataFrame, path_a: str, path_b: str, size: int = CHUNK) -> DataFrame:
    """A row for each chunk: its documents (doc_id, four counts each, digest, number of distinct pairs; the pairs' places and how often each is there, joined), and its distinct pairs with the number of documents that hold each."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(DOCS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, rows, held, made = pair(path_a, path_b), [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, held, made
            key, place, holders = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True, return_counts=True)
            times = np.concatenate([r[3] for r in rows])
            columns = [
                [(lookup.chunk() << 32) + made], [[r[0] for r in rows]], [[x for r in rows for x in r[1][0]]], [[r[1][1] for r in rows]], [[len(r[2]) for r in rows]],
                [place.astype("<u4").tobytes()], [times.astype("<u4").tobytes()], [key], [holders.astype(np.int64)],
            ]
            rows, held, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            names = b.column(0).to_pylist()
            for name, (n, sha, _, key, times) in zip(names, aligned(tool, _texts(b.column(1).to_pylist())), strict=True):
                rows.append((name, (n, sha), key, times))
                held += len(key) + 16
                if held >= size:
                    yield flush()
        if rows:
            yield flush()

    return docs.mapInArrow(run, DOCS)


def pair_counts(parts: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it), best (whether no pair of its A id has more)."""
    counts = materialise(parts.select(F.inline(F.arrays_zip("pair", "holders"))).groupBy("pair").agg(F.sum("holders").alias("n")))
    a = F.expr(f"pair div {n_b}")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    Links are the pairs of an A and a B token that share bytes; an id pair's
    count is how many rows hold it linked; n_best are the links whose count is
    the highest of their A id, ties included; count_sum adds up the links' counts.
    Texts that are null or empty, or that the tokens do not give back byte by
    byte, have no tokens: zeros and ''.  Rows with equal or null ids are
    documents of their own; other columns are not read; an empty table gives no
    rows.  The texts are scanned once; a very long text is taken in parts, and a
    unit is merged in pieces.  A task holds one chunk, at most ``chunk``
    distinct pairs beside those of one text.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(docs.sparkSession)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    parts = materialise(chunks(source, path_a, path_b, chunk))
    n_b = len(pair(path_a, path_b).bytes_b)
    counts = materialise(pair_counts(parts, n_b))
    asked = parts.select(F.col("chunk").alias("asked_by"), F.posexplode("pair").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("asked_by", "place", "n", "best")
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def told(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        value = lambda c: docs.column(c).combine_chunks()[0]
        at, n, best = (answers.column(c).to_numpy() for c in ("place", "n", "best"))
        told_n, told_best = np.zeros((2, len(at)), np.int64)
        told_n[at], told_best[at] = n, best
        place, times = (np.frombuffer(value(c).as_py(), "<u4") for c in ("place", "times"))
        if len(place) and int(place.max()) >= len(at):
            raise RuntimeError("a chunk's pairs were not all answered")
        edge = np.append(0, np.cumsum(value("held").values.to_numpy()))
        added = lambda x: np.diff(np.append(0, np.cumsum(x[place] * times.astype(np.int64)))[edge])
        four = value("n").values.to_numpy().reshape(-1, 4)
        columns = [value("doc_id").values, *four.T, added(told_best), added(told_n), value("sha").values]
        return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    held = parts.drop("pair", "holders").groupBy("chunk")
    return held.cogroup(answers.groupBy("asked_by")).applyInArrow(told, RESULT)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups of each row: ``a1,a2|b1;a3|b2,b3``, ids in order, '' where there are no tokens."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = pair(path_a, path_b)
        for b in batches:
            found = aligned(tool, _texts(b["text"].tolist()), True)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "groups": [x[2] for x in found]})

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, "doc_id long, groups string")

"""Removal of passages that stand anywhere else, by relative Lempel-Ziv parsing over blocks.

The reference is the whole corpus, cut into blocks where its content says so:
of each ``window``-word window one word position is chosen, the one whose
``SEED``-word hash is least, and the windows that chose the same position form a
block.  Equal windows choose equal positions, so equal passages have equal
blocks wherever they stand, and the index needs a row for about every fourteenth
word: how often a block stands in the corpus, and its first and last place.

Each document is parsed greedily against the index: a factor starts at a block
that stands elsewhere too, takes the source among its places from which it goes
on longest, and ends where the next block does not follow there.  A factor is at
least a window long and becomes a duplicate span.  At its ends, blocks that
stand nowhere else but share their seed with others are checked window by
window, which moves the span's end to the word.

Chunks of documents are told what the index has of their blocks and windows, so
no text is shuffled.  Hashes: a block is known by two independent 64-bit hashes,
a window by the hash of its seed and its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.llm import lookup
from graphband.llm.text import U64, Words, encoded, mix64, pieces, slices
from graphband.session import ship_package

WINDOW = 35
SEED = 10
FLUSH = 1_000_000  # rows that a task sums up before it hands them on
_PLACE_BITS = 24  # of a place's number: the word; the others tell documents apart


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of h[i : i + span], the first of equal ones."""
    at, best, have = np.arange(len(h)), h, 1
    while have < span:
        step = min(have, span - have)
        a, b = best[:-step], best[step:]
        later = b < a
        best, at = np.where(later, b, a), np.where(later, at[step:], at[:-step])
        have += step
    return at


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(U64).view(np.int64)


class Blocks:
    """Blocks of a batch of texts: for each its text, first and last window start, seed hash and block hash."""

    def __init__(self, words: Words, window: int, seed: int) -> None:
        first = words.first
        n = len(words.codes)
        empty = np.empty(0, np.int64)
        self.words, self.window = words, window
        self.text = self.low = self.high = self.seed = self.block = empty
        if n < window:
            return
        seeds = words.runs(slice(0, n - seed + 1), seed)
        choice = _least(seeds, window - seed + 1)  # for a window start, the seed's place
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        start = np.arange(len(choice))
        whole = text[start] == text[start + window - 1]
        start, choice = start[whole], choice[whole]
        if not len(start):
            return
        text = text[start]
        new = np.flatnonzero((np.diff(choice, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        self.low, self.high = start[new], start[np.append(new[1:], len(start)) - 1]
        seed_at = choice[new]
        self.text, self.seed = text[new], _signed(seeds[seed_at])
        place = ((seed_at - self.low) * (1 << 20) + (self.high - seed_at + (1 << 19))).astype(U64)
        self.block = _signed(mix64(words.spans(self.low, self.high + window) ^ mix64(place)))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these blocks the windows' starts, one block after another, and their hashes."""
        sizes = self.high[which] - self.low[which] + 1
        start = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.low[which], sizes)
        return start, _signed(self.words.runs(start, self.window))


def _blocks(texts: list[bytes], doc: np.ndarray, t: np.ndarray, window: int, seed: int) -> Iterator[tuple[Blocks, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts slice by slice; for each block its text's number, the first window's word number there, and its place in the corpus."""
    parts = [(i, before, part) for i, text in enumerate(texts) for part, before in pieces(text, window - 1)]
    own = mix64(doc.view(U64) ^ mix64(t.view(U64))) >> U64(_PLACE_BITS + 1)
    for a, b in slices([p[2] for p in parts], 1 << 21):
        blocks = Blocks(Words([p[2] for p in parts[a:b]]), window, seed)
        row = np.array([p[0] for p in parts[a:b]], np.int64)[blocks.text]
        low = blocks.low - blocks.words.first[blocks.text] + np.array([p[1] for p in parts[a:b]], np.int64)[blocks.text]
        place = (own[row].astype(np.int64) << _PLACE_BITS) + np.minimum(low, (1 << _PLACE_BITS) - 1)
        yield blocks, row, low, place


def _numbers(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return b["doc_id"].fillna(-1).to_numpy(np.int64), b["t"].to_numpy(np.int64)


class Known:
    """What the index has of this chunk's blocks."""

    def __init__(self, folder: str) -> None:
        columns = lookup.mine(folder, "block", "seed", "n", "first", "last", "mixed")
        by = np.argsort(columns[0])
        self.block, self.seed, self.n, self.first, self.last, self.mixed = (c[by] for c in columns)
        self.mixed = self.mixed.astype(bool)
        self.met = np.zeros(len(by), bool)

    def find(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of blocks that are known, and of their entries."""
        if not len(self.block) or not len(blocks.block):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.block, blocks.block), len(self.block) - 1)
        hit = np.flatnonzero((self.block[at] == blocks.block) & (self.seed[at] == blocks.seed))
        self.met[at[hit]] = True
        return hit, at[hit]

    def check(self) -> None:
        lookup.check(bool(self.met.all()))


def reference_index(docs: DataFrame, roll: lookup.Roll, window: int, seed: int) -> DataFrame:
    """chunk, block, seed, n, first, last, mixed: for each chunk its blocks whose seed stands in several places.

    n places hold the block, first and last among them; ``mixed`` says that
    other blocks have that seed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        here = roll.here()

        def flush() -> pd.DataFrame:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            last = np.append(new[1:], len(rows)) - 1
            return pd.DataFrame({"seed": rows[new, 0], "block": rows[new, 1], "n": last - new + 1, "first": rows[new, 2], "last": rows[last, 2], "chunk": lookup.chunk()})

        for b in batches:
            here.see(b["mark"].to_numpy())
            for blocks, _, _, place in _blocks(encoded(b["text"]), *_numbers(b), window, seed):
                if len(place):
                    held.append(np.stack([blocks.seed, blocks.block, place], axis=1))
                    if sum(map(len, held)) >= FLUSH:
                        yield flush()
        here.leave()
        if held:
            yield flush()

    rows = docs.mapInPandas(run, "seed long, block long, n long, first long, last long, chunk int")
    index = rows.groupBy("seed", "block").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("chunk").alias("chunks"))
    seeds = index.groupBy("seed").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("blocks")).where("places > 1")
    several = index.join(seeds.select("seed", (F.col("blocks") > 1).alias("mixed")), "seed")
    return several.select(F.explode("chunks").alias("chunk"), "block", "seed", "n", "first", "last", "mixed")


def end_windows(docs: DataFrame, roll: lookup.Roll, known: str, window: int, seed: int) -> DataFrame:
    """chunk, seed, w: windows that stand elsewhere, for the chunks with blocks that stand nowhere else but hold such a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, here = Known(known), roll.here()
        held: list[np.ndarray] = []

        def flush() -> pd.DataFrame:
            rows = np.concatenate(held)
            held.clear()
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.flatnonzero(np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            single = np.maximum.reduceat(rows[:, 2], new)
            return pd.DataFrame({"seed": rows[new, 0], "w": rows[new, 1], "n": np.diff(np.append(new, len(rows))), "chunk": pd.Series(np.full(len(new), lookup.chunk()), dtype="Int32").mask(single == 0)})

        for b in batches:
            here.see(b["mark"].to_numpy())
            if not index.mixed.any():
                continue
            for blocks, _, _, place in _blocks(encoded(b["text"]), *_numbers(b), window, seed):
                hit, at = index.find(blocks)
                # Blocks that stand nowhere else, and one of each that does.
                end = index.mixed[at] & ((index.n[at] == 1) | (place[hit] == index.first[at]))
                hit, at = hit[end], at[end]
                if len(hit):
                    _, w = blocks.windows(hit)
                    sizes = blocks.high[hit] - blocks.low[hit] + 1
                    held.append(np.stack([np.repeat(blocks.seed[hit], sizes), w, np.repeat((index.n[at] == 1).astype(np.int64), sizes)], axis=1))
                    if sum(map(len, held)) >= FLUSH:
                        yield flush()
        here.leave()
        if held:
            yield flush()

    rows = docs.mapInPandas(run, "seed long, w long, n long, chunk int")
    found = rows.groupBy("seed", "w").agg(F.sum("n").alias("n"), F.collect_set("chunk").alias("chunks"))
    return found.where("n > 1").select(F.explode("chunks").alias("chunk"), "seed", "w")


def factors(low: list[int], high: list[int], own: list[int], first: list[int], last: list[int]) -> list[tuple[int, int, int]]:
    """Greedy parse of one document's repeated blocks, in order: (first window start, last one, source place) of each factor.

    A block that stands at no other place (a row that is there twice) is its own source.
    """
    out, i = [], 0
    while i < len(low):
        end, place = i, own[i]
        for source in dict.fromkeys(s for s in (first[i], last[i]) if s != own[i]) or (own[i],):
            j = i + 1
            while j < len(low) and low[j] == high[j - 1] + 1 and source + low[j] - low[i] in (first[j], last[j]):
                j += 1
            if j > end:
                end, place = j, source
        out.append((low[i], high[end - 1], place))
        i = end
    return out


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, kept_text string"


def dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors and kept_text of each row, and before them the columns in ``carry``.

    A word goes when a run of ``window`` words over it also starts anywhere
    else, in the same document or another, judged on the input.  kept_text has
    the kept words with one space between, or the text as it is where nothing
    goes.  n_factors counts the factors of the parse and the runs of single
    windows at their ends.  Null and shorter texts lose nothing.  Rows with equal
    or null ids are documents of their own, also when they are equal
    altogether; columns not in ``carry`` are not read; an empty table gives no
    rows.  The documents are scanned three times; long texts are taken in
    pieces, and a task holds what the index has of its chunk.
    """
    import pyarrow as pa

    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    roll = lookup.roll_call(docs, id_col)
    text_and_id = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"), lookup.mark(docs[id_col])]
    source = docs.select(*text_and_id)
    known = lookup.publish(reference_index(source, roll, window, seed))
    twice = lookup.publish(end_windows(source, roll, known, window, seed))

    def spans(texts: list[bytes], doc: np.ndarray, t: np.ndarray, index: Known, ends: np.ndarray) -> list[list[tuple[int, int]]]:
        """Of each text, first and last window starts of its factors."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for blocks, row, low, place in _blocks(texts, doc, t, window, seed):
            hit, at = index.find(blocks)
            whole = index.n[at] > 1
            h, a = hit[whole], at[whole]
            columns = [x.tolist() for x in (low[h], low[h] + blocks.high[h] - blocks.low[h], place[h], index.first[a], index.last[a])]
            edge = np.flatnonzero(np.append(True, np.diff(row[h]) != 0)) if len(h) else []
            for i, j in zip(edge, np.append(edge[1:], len(h)) if len(h) else [], strict=True):
                out[int(row[h[i]])] += [f[:2] for f in factors(*(c[i:j] for c in columns))]
            single = hit[~whole & index.mixed[at]]
            if len(single) and len(ends):
                start, w = blocks.windows(single)
                of = np.repeat(single, blocks.high[single] - blocks.low[single] + 1)
                own = _ends_key(blocks.seed[of], w)
                found = np.flatnonzero(ends[np.minimum(np.searchsorted(ends, own), len(ends) - 1)] == own)
                at_word = low[of[found]] + start[found] - blocks.low[of[found]]
                run = np.flatnonzero(np.append(True, (np.diff(at_word) != 1) | (np.diff(row[of[found]]) != 0))) if len(found) else np.empty(0, np.int64)
                for i, j in zip(run, np.append(run[1:], len(found))[: len(run)], strict=True):
                    out[int(row[of[found[i]]])].append((int(at_word[i]), int(at_word[j - 1])))
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, here = Known(known), roll.here()
        ends = np.sort(_ends_key(*lookup.mine(twice, "seed", "w")))
        for b in batches:
            here.see(b.column("mark").to_numpy())
            n_words, n_removed, shas, n_factors, kept_texts = [], [], [], [], []
            plain = b.column("text").to_pylist()
            texts = encoded(plain)
            doc = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for whole, text, runs in zip(plain, texts, spans(texts, doc, b.column("t").to_numpy(), index, ends), strict=True):
                words = text.split()
                kept = words
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r[0] for r in runs], 1)
                    np.add.at(edge, [r[1] + window for r in runs], -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                shas.append(hashlib.sha256(joined).hexdigest())
                n_factors.append(len(runs))
                kept_texts.append(joined.decode("utf-8", "replace") if len(kept) < len(words) else whole)
            own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(n_factors, pa.int64()), pa.array(kept_texts, pa.string())]
            carried = [b.column(f"c{i}") for i in range(len(carry))]
            names = [f"c{i}" for i in range(len(carry))] + [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*carried, b.column("doc_id"), *own], names)
        here.leave()
        index.check()

    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], *text_and_id)
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    out = rows.mapInArrow(cut, ", ".join([*fields, RESULT]))
    return out.withColumnsRenamed({f"c{i}": f"carried_{c}" for i, c in enumerate(carry)})


def _ends_key(seed: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number of a seed's and a window's hash."""
    return _signed(mix64(seed.astype(np.int64).view(U64) ^ mix64(w.astype(np.int64).view(U64))))


def without_passages(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of its texts and their lengths set anew; rows and columns stay."""
    docs = lookup.steady(docs)
    carry = tuple(c for c in docs.columns if c not in (text_col, length_col))
    out = dedup(docs, window, seed, id_col, text_col, carry)
    fresh = {text_col: F.col("kept_text"), length_col: F.length("kept_text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"carried_{c}").alias(c) for c in docs.columns])

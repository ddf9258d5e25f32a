"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers.  Both give a
character's probability after the two before it, each order interpolated with
the next lower one, and are trained from labelled samples: strings with a mark
that says whether they are random.  Tasks add up transitions, so a model is a
table whose size is bounded by the alphabet alone.  Strings fall into two halves,
and one half's are judged by the models of the other's, so that no string vouches
for itself.  A string is a secret where its log-likelihood ratio outweighs the
odds against it.

Samples can be given; ``samples`` takes them from the documents themselves: what
a fixed pattern finds is labelled random, other strings of the same characters
are labelled ordinary.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.session import ship_package

#: Fixed patterns of the contract, with the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

MODEL = "model"  # the kind of spans that the models add, after the others
LEAST = 16  # characters of a string that the models judge
TRAIN_LEAST = 8  # characters of a string that they are trained on
ODDS = 20.0  # log-likelihood ratio from which on a string is a secret
HELD = 100_000  # different samples that a task holds at once

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % min(ASSIGN_LEAST, TRAIN_LEAST))
#: Strings of the models: as runs, cut at full stops and at the signs that give values to names.
_STRING = re.compile(r"[A-Za-z0-9+/_-]+")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE)
_ALPHABET = "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
SIZE = len(_ALPHABET) + 2  # and others, and what stands before the first
_CODE = np.full(256, SIZE - 2, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions (two characters before, character) of all texts as one number each, and where each text's first one stands."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    c = _CODE[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
    before = np.concatenate([[SIZE - 1], c[:-1]]) if len(c) else c
    full = first[sizes > 0]
    before[full] = SIZE - 1
    second = np.concatenate([[SIZE - 1], before[:-1]]) if len(c) else c
    second[full] = SIZE - 1
    return (second * SIZE + before) * SIZE + c, first


def halves(texts: list[str]) -> np.ndarray:
    """0 or 1 for each string, the same wherever it stands."""
    return np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) & 1 for t in texts), np.int64, len(texts))


@dataclass
class Models:
    """Log-likelihood ratio of each transition, random over ordinary, for strings of each half: by the models of the other half's samples."""

    ratio: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        code, first = codes(texts)
        last = np.append(first[1:], len(code))
        total = np.append(0.0, np.cumsum(self.ratio[np.repeat(halves(texts), last - first), code]))
        return total[last] - total[first]


def log_probabilities(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """log P(c | two before) of transition counts, each order interpolated with the next lower one.

    A lower order weighs as ``strength`` observations.  Half of the lowest are
    equal shares: strings of other characters than the samples' stay likely
    where few samples lead to them.
    """
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    one = three.sum(axis=(0, 1))
    p = (one + strength / SIZE) / (one.sum() + strength) / 2 + 0.5 / SIZE
    for n in (three.sum(axis=0), three):
        p = (n + strength * p) / (n.sum(axis=-1, keepdims=True) + strength)
    return np.log(p).ravel()


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of what the fixed patterns find, in code points."""
    found = []
    if not _RUN.search(text):
        return found
    if _KEYWORD.search(text):
        found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    for run in _RUN.finditer(text):  # a match of the others lies within one
        if run.end() - run.start() >= HEX_LEAST:
            at, to = run.span()
            for k, pattern, least in ((1, ACCESS, ACCESS_LEAST), (2, HEX, HEX_LEAST)):
                found += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text, at, to) if m.end() - m.start() >= least]
    return sorted(found)


def other_strings(text: str, base: list[tuple[int, int, int, str]], least: int) -> list[tuple[int, int, str]]:
    """(start, end, string) of the strings of ``least`` characters or more that no span of ``base`` (sorted) touches."""
    found, edge, k = [], 0, 0
    for run in _RUN.finditer(text):
        if run.end() - run.start() < least:
            continue
        for m in _STRING.finditer(text, *run.span()):
            if m.end() - m.start() < least:
                continue
            while k < len(base) and base[k][0] < m.end():
                edge = max(edge, base[k][2])
                k += 1
            if edge <= m.start():
                found.append((m.start(), m.end(), m[0]))
    return found


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, random, n: the different labelled strings of all documents and how often each is there.

    What a fixed pattern finds is random (of an assignment, its value), other
    strings of TRAIN_LEAST characters or more are not.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[tuple[str, bool]] = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(t, r, n) for (t, r), n in held.items()], columns=["text", "random", "n"])
            held.clear()
            return out

        for b in batches:
            for text in b["text"]:
                if isinstance(text, str):
                    base = base_spans(text)
                    held.update((value, True) for _, _, _, value in base)
                    held.update((s, False) for _, _, s in other_strings(text, base, TRAIN_LEAST))
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(docs[text_col].alias("text")).mapInPandas(run, "text string, random boolean, n long")
    return rows.groupBy("text", "random").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame) -> Models:
    """Both models of labelled samples (text, random), for each half of the strings; a null counts for nothing.

    A string has each of its transitions once, so that neither a very long
    string nor, where samples are distinct, many copies make a model.  Each task adds up transitions; at most 4 * SIZE ** 3 sums, whatever the
    samples are, go to the driver.
    """
    ship_package(labelled.sparkSession)
    cells = SIZE**3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(4 * cells, np.int64)
        for b in batches:
            b = b.dropna()
            texts = b["text"].tolist()
            code, first = codes(texts)
            own = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(code))))
            own, code = np.divmod(np.unique(own * cells + code), cells)
            at, n = np.unique((2 * halves(texts) + b["random"].to_numpy(bool))[own] * cells + code, return_counts=True)
            total[at] += n
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    sums = labelled.select("text", "random").mapInPandas(run, "at long, n long")
    rows = sums.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, 2, cells))
    counts.ravel()[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return Models(np.stack([log_probabilities(random) - log_probabilities(ordinary) for ordinary, random in counts[::-1]]))


RESULT = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"


def scan(docs: DataFrame, models: Models, odds: float = ODDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row: kind, start and end (exclusive) in code points, and the models' log-likelihood ratio of what they add.

    Spans of the fixed patterns stay whatever the models say; the models add
    strings of ``least`` characters or more that touch none of them and whose
    ratio is ``odds`` or more.  By start, then by kind.  Null and empty texts
    have none.  Repeated rows and null ids give a row each; other columns are
    not read; an empty table gives no rows.  One pass without a shuffle; the
    models are 2 * SIZE ** 3 numbers.  A very long text is held whole by its task,
    and nothing longer than its spans beside it.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(models.ratio)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = Models(shared.value)
        for b in batches:
            out, strings = [], []
            for row, text in enumerate(b["text"]):
                spans = base_spans(text) if isinstance(text, str) else []
                out.append([(start, k, end, None) for start, k, end, _ in spans])
                if isinstance(text, str):
                    strings += [(row, *x) for x in other_strings(text, spans, least)]
            for (row, start, end, _), score in zip(strings, models.score([x[3] for x in strings]).tolist(), strict=True):
                if score >= odds:
                    out[row].append((start, len(KINDS), end, score))
            names = (*KINDS, MODEL)
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64").array,
                "spans": [[{"kind": names[k], "start": start, "end": end, "score": score} for start, k, end, score in sorted(x, key=lambda s: s[:2])] for x in out],
            })

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, RESULT)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model of what ``scan`` found; spans are written kind:start:end, joined by commas."""
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != MODEL)
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(MODEL).alias("n_model"))


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    """The digest of written spans."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()

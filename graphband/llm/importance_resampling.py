"""Importance resampling towards a target distribution, with feature counts of segments computed once.

Features are runs of one to ``order`` words, hashed into buckets.  A bucket's
gain is the logarithm of its smoothed share in the target over that in the
corpus; a document's weight is the sum of its features' gains, and the highest
of weight plus Gumbel noise are a draw without replacement.

Texts are cut at newlines into lines, which the corpus repeats: boilerplate,
menus, copies.  A task keeps a table of the lines it has met: a line's words are
cut out and hashed when it is first met, and its counts are multiplied by how
often it occurs; so are its gains in the second pass.  Features that reach over a
newline are added separately, from the words at lines' ends.  Counts of tasks are
sums over buckets, so no text is shuffled, and the table is bounded: a full one
hands on its sums and starts anew.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.llm.text import encoded
from graphband.operators.graph import ranked
from graphband.session import materialise, ship_package

ORDER = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
TABLE = 96 << 20  # bytes of a table of lines, and of one of words, by estimate
ENTRY = 200  # bytes of an entry besides its line

#: A-Z in lower case; digits, letters and bytes from 128 on are of words, others part them.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """Buckets of features, found when they are first asked for."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.held = size, 0

    def __missing__(self, feature: bytes) -> int:
        if self.held > TABLE:
            self.clear()
            self.held = 0
        found = self[feature] = zlib.crc32(feature) % self.size
        self.held += ENTRY + len(feature)
        return found


class Lines:
    """A table of lines: each with the buckets of its features, the words at its ends and how often it was met."""

    def __init__(self, order: int, buckets: Buckets) -> None:
        self.order, self.buckets = order, buckets
        self.place: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.place.clear()
        self.found: list[np.ndarray] = []
        self.words: list[int] = []
        self.ends: list[tuple[list[bytes], bool]] = []
        self.times: list[int] = []
        self.held = 0

    def _new(self, line: bytes) -> int:
        words, n = line.translate(_WORDS).split(), self.order
        features = list(words)
        for size in range(2, n + 1):
            features += [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
        self.place[line] = at = len(self.found)
        self.found.append(np.fromiter(map(self.buckets.__getitem__, features), np.int64, len(features)))
        self.words.append(len(words))
        self.held += ENTRY + len(line) + 8 * len(features)
        if n > 1:  # words at the ends, and whether some lie between
            long = len(words) > 2 * (n - 1)
            self.ends.append((words[: n - 1] + words[-(n - 1) :] if long else words, long))
        self.times.append(0)
        return at

    def of(self, text: bytes) -> list[int]:
        """Places of the text's lines."""
        get, new = self.place.get, self._new
        return [new(line) if (at := get(line)) is None else at for line in text.split(b"\n")]

    def across(self, lines: list[int]) -> list[int]:
        """Buckets of the features that reach over a newline."""
        n, out = self.order, []
        if n < 2 or len(lines) < 2:
            return out
        words: list[bytes] = []
        line: list[int] = []  # of each word
        gap: list[int] = []  # of each word, how many gaps lie before it
        gaps = 0
        for k, at in enumerate(lines):
            ends, long = self.ends[at]
            for i, w in enumerate(ends):
                gaps += long and i == n - 1
                words.append(w)
                line.append(k)
                gap.append(gaps)
        for size in range(2, n + 1):
            for i in range(len(words) - size + 1):
                j = i + size - 1
                if line[i] != line[j] and gap[i] == gap[j]:
                    out.append(self.buckets[b" ".join(words[i : j + 1])])
        return out

    def sums(self) -> np.ndarray:
        """Counts of each bucket: each line's, times how often it was met."""
        total = np.zeros(self.buckets.size, np.int64)
        for i in range(0, len(self.found), 4096):
            sizes = [len(f) for f in self.found[i : i + 4096]]
            times = np.repeat(np.array(self.times[i : i + 4096], np.int64), sizes)
            total += np.bincount(np.concatenate(self.found[i : i + 4096]), times, self.buckets.size).astype(np.int64)
        return total


def feature_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has some."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, total = Lines(order, Buckets(buckets)), np.zeros(buckets, np.int64)
        for b in batches:
            for text in encoded(b["text"]):
                at = lines.of(text)
                for i in at:
                    lines.times[i] += 1
                for bucket in lines.across(at):
                    total[bucket] += 1
                if lines.held > TABLE:
                    total += lines.sums()
                    lines.clear()
        total += lines.sums()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.select(texts[text_col].alias("text")).mapInPandas(run, "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 * ln of its share in the target over that in the corpus), each count one more; at most 2 * buckets rows are read."""
    counts = np.zeros((2, buckets), np.int64)
    both = corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    for bucket, n, side in both.toPandas()[["bucket", "n", "side"]].itertuples(index=False):
        counts[side, bucket] = n
    (s, t), (all_s, all_t) = counts.astype(float), counts.sum(axis=1).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the sum of its features' gains."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gain = shared.value
        lines = Lines(order, Buckets(len(gain)))
        features: list[int] = []  # of each line in the table
        weight: list[int] = []
        for b in batches:
            out = []
            for text in encoded(b["text"]):
                at = lines.of(text)
                for found in lines.found[len(weight) :]:
                    features.append(len(found))
                    weight.append(int(gain[found].sum()))
                over = lines.across(at)
                out.append((sum([lines.words[i] for i in at]), sum([features[i] for i in at]) + len(over), sum([weight[i] for i in at]) + int(gain[over].sum())))
                if lines.held > TABLE:
                    lines.clear()
                    features.clear()
                    weight.clear()
            frame = pd.DataFrame(out, columns=["n_words", "n_features", "weight"], dtype="int64")
            frame.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield frame

    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row.

    ``target`` has texts in ``text_col``.  score is the weight plus Gumbel noise
    that sha256 of ``seed:doc_id`` draws; of the rows with ``least_words`` words
    or more, ``percent`` in a hundred (rounded down) are drawn, highest scores
    first, ties to the smaller id; rank is a row's place among them, null where
    it is not drawn.  Null and empty texts have no features and weight 0.  Rows
    with equal ids have equal noise and are ranked one after another, by weight
    and number of features; a null id draws as 'null' and comes before others of its score.
    Other columns are not read; an empty table gives no rows.  The texts are scanned
    twice and none is shuffled; only scores are sorted.  A very long text is
    held whole by its task, and its lines until the table is full.
    """
    gain = gains(feature_counts(docs, order, buckets, text_col), feature_counts(target, order, buckets, text_col), buckets)
    found = weights(docs, gain, order, id_col, text_col)
    draw = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(draw, 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")
    rows = materialise(found.withColumn("score", F.col("weight") + noise))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order_by = able.select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("key"))
    placed = ranked(order_by, ["key", "doc_id", "weight", "n_features"], "place")
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn_rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    return placed.select(*columns, drawn_rank).unionByName(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))

"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

N-grams of UTF-8 bytes, up to order 4, upper and lower case apart, packed into
one integer: its last bytes are the suffix, its first ones the context.  Tasks
sum up the n-grams of trusted texts and name, once each, the n-grams that the
texts of their chunk hold.  Counts, discounted probabilities and back-off
weights stay in sharded tables that grow with the texts.  What is asked for is
resolved by joins, order by order: an n-gram's own probability, or its context's
back-off weight and what its suffix has.  A join with the chunks' questions
hands each chunk the values of its n-grams, and a second scan adds them up to a
perplexity of a byte for each document.  Documents fall into two halves by their
identifiers, and the trusted ones of one half make the model that scores all of
the other: no text vouches for itself, and trusted and other documents are
judged alike.  A document is kept up to a high quantile of the trusted
documents' perplexities in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphband.llm import lookup
from graphband.llm.text import encoded, slices
from graphband.session import discard, materialise, ship_package

ORDER = 4
QUANTILE = 0.999
START, END = b"\xfe", b"\xff"  # bytes that no UTF-8 text holds
HELD = 1_000_000  # n-grams that a task sums up before it hands them on


def plain(text: bytes) -> bytes:
    """Words with one space between."""
    return b" ".join(text.split())


def mask(size: int) -> int:
    return (1 << 8 * size) - 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of order ORDER up to each byte of the plain texts and to each text's end, and where a text's first one stands."""
    pad = START * (ORDER - 1)
    data = np.frombuffer(b"".join([pad + t + END for t in texts]) + pad, np.uint8)
    code = np.zeros(len(data) - ORDER + 1, np.int64)
    for i in range(ORDER):
        code = (code << 8) | data[i : i + len(code)]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    keep = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(texts)), sizes) * (ORDER - 1)
    return code[keep], first


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams and their summed numbers."""
    by = np.argsort(g, kind="stable")
    g = g[by]
    new = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    return g[new], np.add.reduceat(n[by], new) if len(g) else n


def gather(docs: DataFrame, trusted: str) -> DataFrame:
    """k, m, g, n, chunk: partial counts of trusted texts' n-grams by order k for the model m, and as k = 0 what each chunk's texts hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, good = lookup.mine(trusted, "doc_id", "trusted")
        ids = np.sort(ids[good.astype(bool)])
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def frame(k: int, m: int, g: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"k": k, "m": m, "g": g, "n": n, "chunk": lookup.chunk()})

        def put(k: int, m: int, g: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
            parts = held.setdefault((k, m), [])
            parts.append((g, n))
            if len(parts) >= 8:
                g, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
                held[k, m] = [(g, n)]
                if len(g) > HELD:
                    del held[k, m]
                    yield frame(k, m, g, n)

        for b in batches:
            texts = [plain(t) for t in encoded(b["text"])]
            known = np.isin(b["doc_id"].fillna(0).to_numpy(np.int64), ids) & b["doc_id"].notna().to_numpy()
            model = np.where(known, 1 - b["fold"].to_numpy(np.int64), -1)
            for i, j in slices(texts, 1 << 20):
                code, first = grams(texts[i:j])
                which = np.repeat(model[i:j], np.diff(np.append(first, len(code))))
                asked = np.unique(code)
                yield from put(0, 0, asked, np.ones_like(asked))
                for m in (0, 1):
                    g, n = np.unique(code[which == m], return_counts=True)
                    for k in range(ORDER, 0, -1):
                        g, n = _summed(g & mask(k), n)
                        if len(g):
                            yield from put(k, m, g, n)
        for (k, m), parts in held.items():
            yield frame(k, m, *_summed(*map(np.concatenate, zip(*parts, strict=True))))

    return docs.mapInPandas(run, "k int, m int, g long, n long, chunk int")


def _discount(counts: DataFrame) -> str:
    """Chen and Goodman's discounts as SQL, for each model from the numbers of n-grams that occur once to four times."""
    seen = {(r["m"], r["n"]): r["c"] for r in counts.where("n <= 4").groupBy("m", "n").agg(F.count(F.lit(1)).alias("c")).collect()}
    cases = []
    for m in (0, 1):
        t = {i: seen.get((m, i), 0) for i in range(1, 5)}
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0.5
        d = [min(max(i - (i + 1) * y * t[i + 1] / t[i] if t[i] else y, 0.05), i - 0.05) for i in (1, 2, 3)]
        cases += [f"WHEN m = {m} AND least(n, 3) = {i} THEN {x!r}D" for i, x in enumerate(d, 1)]
    return f"CASE {' '.join(cases)} END"


def train(counts: DataFrame) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """Of summed counts (k, m, g, n), by order the n-grams (m, g, p) and the contexts (m, c, gamma); order 0 is an empty context.

    p is interpolated with all lower orders; at the bottom stand uniform bytes.
    """
    rows, contexts = {}, {}
    by_order = {k: counts.where(F.col("k") == k).select("m", "g", "n") for k in range(1, ORDER + 1)}
    below = counts.sparkSession.createDataFrame([(m, 0, 1 / 256) for m in (0, 1)], "m int, s long, below double")
    for k in range(1, ORDER + 1):
        found = by_order[k]
        if k < ORDER:  # continuation counts: how many bytes stand before
            found = by_order[k + 1].groupBy("m", F.col("g").bitwiseAND(mask(k)).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        found = materialise(found.select("m", "g", "n", F.shiftright("g", 8).alias("c"), F.col("g").bitwiseAND(mask(k - 1)).alias("s")))
        discount = F.expr(_discount(found))
        own = found.groupBy("m", "c").agg(F.sum("n").alias("total"), F.sum(discount).alias("held"))
        own = materialise(own.select("m", "c", "total", (F.col("held") / F.col("total")).alias("gamma")))
        contexts[k - 1] = own.select("m", "c", "gamma")
        p = (F.col("n") - discount) / F.col("total") + F.col("gamma") * F.col("below")
        rows[k] = materialise(found.join(own, ["m", "c"]).join(below, ["m", "s"]).select("m", "g", p.alias("p")))
        below = rows[k].select("m", F.col("g").alias("s"), F.col("p").alias("below"))
    return rows, contexts


def resolve(asked: DataFrame, model: tuple[dict[int, DataFrame], dict[int, DataFrame]]) -> DataFrame:
    """m, g, bits (log2 of its probability) of each n-gram asked for (m, g): its own, or its context's weight and its suffix's."""
    rows, contexts = model
    wanted = {ORDER: asked.select("m", "g")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select("m", F.col("g").bitwiseAND(mask(k)).alias("g")).distinct()
    lower = asked.sparkSession.createDataFrame([(m, 0, -8.0) for m in (0, 1)], "m int, s long, lower double")
    for k in range(1, ORDER + 1):
        x = wanted[k].select("m", "g", F.shiftright("g", 8).alias("c"), F.col("g").bitwiseAND(mask(k - 1)).alias("s"))
        x = x.join(rows[k], ["m", "g"], "left").join(contexts[k - 1], ["m", "c"], "left").join(lower, ["m", "s"])
        bits = F.coalesce(F.log2("p"), F.coalesce(F.log2("gamma"), F.lit(0.0)) + F.col("lower"))
        found = x.select("m", "g", bits.alias("bits"))
        lower = found.toDF("m", "s", "lower")
    return found


def perplexity(docs: DataFrame, trusted: str, values: str) -> DataFrame:
    """doc_id, lang, trusted, perplexity of each row, from its chunk's answers; null for a text without a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, good = lookup.mine(trusted, "doc_id", "trusted")
        by = np.argsort(ids)
        ids, good = ids[by], good[by].astype(bool)
        g, zero, one = lookup.mine(values, "g", "bits0", "bits1")
        by = np.argsort(g)
        g, bits = g[by], np.stack([zero[by], one[by]]).astype(np.float32)
        for b in batches:
            texts, there = [plain(t) for t in encoded(b["text"])], b["doc_id"].notna().to_numpy()
            name = b["doc_id"].fillna(0).to_numpy(np.int64)[there]
            known, fold = np.zeros(len(b), bool), b["fold"].to_numpy(np.int64)
            if len(name):
                at = np.minimum(np.searchsorted(ids, name), len(ids) - 1)
                lookup.check(len(ids) and (ids[at] == name).all())
                known[there] = good[at]
            out = np.full(len(b), np.nan)
            for i, j in slices(texts, 1 << 20):
                code, first = grams(texts[i:j])
                at = np.minimum(np.searchsorted(g, code), len(g) - 1)
                lookup.check(len(g) and (g[at] == code).all())
                sizes = np.diff(np.append(first, len(code)))
                total = np.add.reduceat(bits[np.repeat(fold[i:j], sizes), at].astype(float), first)
                out[i:j] = np.where(sizes > 1, 2.0 ** (-total / sizes), np.nan)
            score = pd.Series(out).astype("Float64").mask(np.isnan(out))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64").array, "lang": b["lang"].array, "trusted": known, "perplexity": score.array})

    return docs.mapInPandas(run, "doc_id long, lang string, trusted boolean, perplexity double")


def _ids(docs: DataFrame) -> DataFrame:
    """chunk, doc_id: the different ids of each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["doc_id"].dropna().unique().astype(np.int64)
            yield pd.DataFrame({"chunk": np.full(len(ids), lookup.chunk()), "doc_id": ids})

    return docs.mapInPandas(run, "chunk int, doc_id long").distinct()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept of every row.

    Trusted are documents with a label of quality 1.  The limit is their
    quantile by language, and a document at the limit is kept; a language
    without trusted documents (null included) takes that of all.  A null or
    empty text has no perplexity and is not kept; without any trusted document
    no limit exists and every text is kept.  Null ids are never trusted;
    repeated rows are judged alike; other columns are not read; an empty table
    gives no rows.  The documents are scanned three times.
    """
    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    docs = docs.withColumn("fold", F.xxhash64("doc_id").bitwiseAND(1).cast("int"))
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted")).distinct()
    # A merge join at every size: labels grow with the documents, so a broadcast would not last.
    trusted = lookup.publish(_ids(docs).join(good.hint("merge"), "doc_id", "left").select("chunk", "doc_id", F.coalesce("trusted", F.lit(False)).alias("trusted")))
    seen = materialise(gather(docs, trusted))
    counts = materialise(seen.where("k > 0").groupBy("k", "m", "g").agg(F.sum("n").alias("n")))
    asked = seen.where("k = 0").select("g", "chunk")
    both = asked.select("g").distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("m"), "g")
    bits = resolve(both, train(counts)).groupBy("g").agg(*[F.max(F.when(F.col("m") == m, F.col("bits"))).cast("float").alias(f"bits{m}") for m in (0, 1)])
    answers = asked.join(bits.hint("merge"), "g").select("chunk", "g", "bits0", "bits1")
    found = lookup.publish(answers)
    scores = materialise(perplexity(docs, trusted, found))
    discard(trusted, seen, counts, found)
    known = scores.where("trusted AND perplexity is not null")
    limit = lambda rows: rows.agg(F.percentile_approx("perplexity", quantile, 100_000).alias("limit"))
    by_lang = materialise(limit(known.groupBy("lang")))  # a table of known size, which Spark may broadcast
    all_ = limit(known).first()["limit"]
    out = scores.join(by_lang.where("lang is not null"), "lang", "left")
    threshold = F.coalesce("limit", F.lit(all_).cast("double"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), kept.alias("kept"))

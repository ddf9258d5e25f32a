"""Exact dedup by a log-structured merge index over text digests.

Each task is a memtable: it gathers one entry a digest (best row, number of
rows) and, when full, flushes a run that is sorted by digest.  Runs are Parquet
files with Parquet's filters on the digest, so that a lookup skips runs without
it.  Compaction merges the runs by digest, keeping one row, into a sorted table.
Each chunk of documents is told which of its digests compaction found more than
once.  Rows with such a digest are hits: copies within a task are compared byte
by byte in place, and one of them is sent to be compared with the text that
stays; a text that differs in spite of an equal digest is grouped by its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphband.llm import lookup
from graphband.llm.text import encoded
from graphband.session import discard, materialise, shared_dir, ship_package

MEMTABLE = 100_000  # entries
BODIES = 64 << 20  # bytes of hits' texts that a task keeps to compare copies with

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def flush_runs(source: DataFrame, largest: bool, memtable: int, digest_bytes: int, roll: lookup.Roll | None = None) -> DataFrame:
    """Entries (digest, best, n, chunk) of sorted runs, one for each digest of a memtable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        better = max if largest else min
        table: dict[bytes, tuple[int | None, int]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(d, *table[d]) for d in sorted(table)], columns=["digest", "best", "n"])
            table.clear()
            return out.astype({"best": "Int64"}).assign(chunk=lookup.chunk())

        here = roll.here() if roll else None
        for b in batches:
            if here:
                here.see(b["mark"].to_numpy())
            for name, text in zip(b["doc_id"].astype("Int64").tolist(), encoded(b["text"]), strict=True):
                name = None if name is pd.NA else name
                key = hashlib.sha256(text.lower()).digest()[:digest_bytes]
                best, n = table.get(key, (None, 0))
                table[key] = (name if best is None else best if name is None else better(best, name), n + 1)
                if len(table) >= memtable:
                    yield flush()
        if here:
            here.leave()
        if table:
            yield flush()

    return source.mapInPandas(run, "digest binary, best long, n long, chunk int")


def _filed(entries: DataFrame) -> DataFrame:
    """Entries in files with filters on the digest, read back."""
    spark, path = entries.sparkSession, shared_dir(entries.sparkSession)
    entries.write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
    out = spark.read.schema(entries.schema).parquet(path)
    out._scratch = path
    return out


def compact(runs: DataFrame, largest: bool = True) -> DataFrame:
    """One entry (digest, best, n, chunks) for each digest of all runs, in files sorted by digest; chunks are those that hold it."""
    pick = F.max if largest else F.min
    merged = runs.groupBy("digest").agg(pick("best").alias("best"), F.sum("n").alias("n"), F.collect_set("chunk").alias("chunks"))
    return _filed(merged.sortWithinPartitions("digest"))


def find(spark: SparkSession, index: DataFrame, texts: list[str]) -> DataFrame:
    """The entries of some texts: a lookup that the files' filters and order serve."""
    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass").lower()).digest() for t in texts]
    return index.where(F.col("digest").isin(*[F.lit(d) for d in digests]))


def _probe(source: DataFrame, roll: lookup.Roll, hits: str, digest_bytes: int, odd: str | None = None) -> DataFrame:
    """doc_id, t, text_sha256, chunk, digest, keep_id, group_size, and the normalised text (body) of rows to compare elsewhere.

    A row without a hit is its own group.  Of hits, the row that stays has its
    body, and so has the first of other copies in a task; later copies equal
    that one's bytes, else they have theirs too.  Digests in ``odd`` have a body
    in every row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, best, none, group = (x.tolist() for x in lookup.mine(hits, "digest", "best", "none", "n"))
        table = {d: (None if z else b, n) for d, b, z, n in zip(keys, best, none, group, strict=True)}
        every = set(lookup.mine(odd, "digest")[0].tolist()) if odd else set()
        first: dict[bytes, bytes] = {}
        size, here = 0, roll.here()
        for b in batches:
            here.see(b["mark"].to_numpy())
            out = []
            for name, t, text in zip(b["doc_id"].astype("Int64").tolist(), b["t"].tolist(), encoded(b["text"]), strict=True):
                name, body = None if name is pd.NA else name, text.lower()
                sha = hashlib.sha256(body)
                digest = sha.digest()[:digest_bytes]
                hit = table.get(digest)
                if hit is None:
                    out.append((name, t, sha.hexdigest(), digest, name, 1, None))
                    continue
                send = body
                if digest not in every and name != hit[0]:
                    if digest not in first:
                        if size > BODIES:
                            first.clear()
                            size = 0
                        first[digest] = body
                        size += len(body)
                    elif first[digest] == body:
                        send = None
                out.append((name, t, sha.hexdigest(), digest, *hit, send))
            frame = pd.DataFrame(out, columns=["doc_id", "t", "text_sha256", "digest", "keep_id", "group_size", "body"])
            yield frame.astype({"doc_id": "Int64", "keep_id": "Int64"}).assign(chunk=lookup.chunk())
        here.leave()

    return source.mapInPandas(run, "doc_id long, t long, text_sha256 string, chunk int, digest binary, keep_id long, group_size long, body binary")


def _grouped(docs: DataFrame, roll: lookup.Roll, largest: bool, memtable: int, digest_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, chunk, keep_id, group_size, text_sha256 of every row of a steady frame."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"), lookup.mark(docs[id_col]))
    pick = F.max if largest else F.min
    runs = _filed(flush_runs(source, largest, memtable, digest_bytes, roll))
    index = compact(runs, largest)
    discard(runs)
    several = index.where("n > 1")
    hits = lookup.publish(several.select(F.explode("chunks").alias("chunk"), "digest", F.coalesce("best", F.lit(0)).alias("best"), F.col("best").isNull().alias("none"), "n"))
    rows = materialise(_probe(source, roll, hits, digest_bytes))
    columns = ["doc_id", "t", "chunk", "keep_id", "group_size", "text_sha256"]

    bodies = rows.where("body is not null").select("digest", "doc_id", "keep_id", "body")
    stays = materialise(bodies.where("doc_id <=> keep_id").groupBy("digest").agg(F.first("body").alias("stays")))
    # Tasks have summed up copies, so a digest has a row for each task and each text that differs.
    odd = bodies.join(stays, "digest", "left").where("not (body <=> stays)").select("digest").distinct()
    odd = materialise(odd)
    if odd.isEmpty():
        return rows.select(columns)
    # Digests that clash: by their bytes.
    every = lookup.publish(several.join(odd, "digest").select(F.explode("chunks").alias("chunk"), "digest"))
    mixed = materialise(_probe(source, roll, hits, digest_bytes, every).join(odd, "digest", "left_semi"))
    groups = mixed.groupBy("digest", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    mixed = mixed.drop("keep_id", "group_size").join(groups, ["digest", "body"])
    return rows.join(odd, "digest", "left_anti").select(columns).unionByName(mixed.select(columns))


def dedup(docs: DataFrame, largest: bool = True, memtable: int = MEMTABLE, digest_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts that are the same bytes after lower-casing A-Z; a null
    text counts as empty.  Of equal texts the largest id stays (the smallest
    if ``largest`` is false).  A null id stays only where a group has no other;
    rows that repeat the staying id all stay.  Other columns are not read; an
    empty table gives no rows.  ``digest_bytes`` below 32 makes digests clash
    and is meant for tests.  The documents are scanned twice; a task holds
    ``memtable`` entries, its chunk's hits and at most BODIES of texts.
    """
    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    found = _grouped(docs, lookup.roll_call(docs, id_col), largest, memtable, digest_bytes, id_col, text_col)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, largest: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; no text that is not a copy is shuffled."""
    ship_package(docs.sparkSession)
    docs = lookup.steady(docs)
    roll = lookup.roll_call(docs, id_col)
    found = _grouped(docs, roll, largest, MEMTABLE, 32, id_col, text_col)
    kept = found.where("doc_id <=> keep_id").select("chunk", F.xxhash64("doc_id").alias("a"), F.col("t").alias("b")).distinct()
    return lookup.keep(docs, roll, kept, id_col, text_col)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

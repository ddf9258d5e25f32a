"""Token ids in files of fixed bit width, with block offsets for random access.

A file: the magic ``GBIDS001``; unsigned 64-bit counts of bits an id, ids,
documents, ids a block and blocks; the documents' ids, null flags and first
ids; the blocks' byte offsets from the payload's start; the payload.  Ids stand
most significant bit first and each block starts on a byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphband.llm.lookup import filesystem
from graphband.llm.text import encoded
from graphband.llm.tokens import encoder
from graphband.session import materialise, shared_dir, ship_package

MAGIC = b"GBIDS001"
BLOCK = 1 << 16
FILE_IDS = 1 << 22
FILES_A_TASK = 8
_WHOLE = (8, 16, 32)  # widths of whole bytes, which need no single bits


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, the last byte filled with zeros."""
    if bits in _WHOLE:
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :]).tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids."""
    if bits in _WHOLE:
        return np.frombuffer(data, f">u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


def dump(names: list[int | None], parts: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """A file's bytes: documents' names and ids in order."""
    ids = np.concatenate([np.empty(0, "<u4"), *parts])
    first = np.cumsum([0, *map(len, parts)])[:-1].astype("<u8")
    payload = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, payload)])[:-1].astype("<u8") if payload else np.empty(0, "<u8")
    head = np.array([bits, len(ids), len(names), block, len(payload)], "<u8")
    known = np.array([0 if n is None else n for n in names], "<i8")
    null = np.array([n is None for n in names], np.uint8)
    return b"".join([MAGIC, head.tobytes(), known.tobytes(), null.tobytes(), first.tobytes(), offsets.tobytes(), *payload])


class IdFile:
    """Reads ids from anything with ``seek`` and ``read``; only the blocks asked for."""

    def __init__(self, file) -> None:
        self.file = file
        if file.read(8) != MAGIC:
            raise ValueError("not a file of token ids")
        self.bits, self.n_ids, self.n_docs, self.block, blocks = (int(x) for x in np.frombuffer(file.read(40), "<u8"))
        known = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        null = np.frombuffer(file.read(self.n_docs), np.uint8)
        self.names = [None if z else int(n) for n, z in zip(known, null, strict=True)]
        self.first = np.append(np.frombuffer(file.read(8 * self.n_docs), "<u8").astype(np.int64), self.n_ids)
        self.offsets = np.frombuffer(file.read(8 * blocks), "<u8").astype(np.int64)
        self.payload = 48 + 17 * self.n_docs + 8 * blocks

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start..end-1."""
        if end <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block, (end - 1) // self.block
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            self.file.seek(self.payload + int(self.offsets[k]))
            out.append(unpack_bits(self.file.read(-(-n * self.bits // 8)), n, self.bits))
        return np.concatenate(out)[start - a * self.block : end - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.first[i]), int(self.first[i + 1]))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids under ``folder`` in ascending document order; returns one row a file.

    The rows are file, part, seq, n_ids and base, the ids in all files before
    it.  A file is written under a task's own name and then renamed, so a task
    that is run again after a lost executor leaves one whole file.  A null text
    counts as empty, rows with equal or null (first) ids keep their own
    entries in the order of their texts, other columns are not read, and an
    empty table writes no file.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        tool, task = encoder(tokenizer), TaskContext.get()
        bits = max(1, (tool.size - 1).bit_length())
        end = np.array([end_id], "<u4").tobytes()
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        seq = 0

        def flush() -> pd.DataFrame:
            nonlocal seq
            name = f"part-{task.partitionId():06d}-{seq:06d}.ids"
            own = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(dump(names, parts, bits))
            try:
                store.move(own, f"{root}/{name}")
            except OSError:  # some file systems do not replace what an earlier attempt has finished: the same file
                if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                    raise
                store.delete_file(own)
            row = (name, task.partitionId(), seq, sum(map(len, parts)))
            seq += 1
            names.clear()
            parts.clear()
            return pd.DataFrame([row], columns=["file", "part", "seq", "n_ids"])

        held = 0
        for b in batches:
            known = b["doc_id"].astype("Int64").tolist()
            texts = encoded(b["text"])
            for i in range(0, len(texts), 512):
                for name, ids in zip(known[i : i + 512], tool.encode(texts[i : i + 512]), strict=True):
                    names.append(None if name is pd.NA else name)
                    parts.append(np.frombuffer(ids + end, "<u4"))
                    held += len(parts[-1])
                    if held >= file_ids:
                        yield flush()
                        held = 0
        if names:
            yield flush()

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = materialise(ordered.mapInPandas(run, "file string, part long, seq long, n_ids long"))
    up_to = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", up_to(Window.orderBy("part")).alias("before"))  # a row for each task
    return files.withColumn("inner", up_to(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select(*files.columns, (F.col("before") + F.col("inner")).alias("base"))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(folder)
        for b in batches:
            for name, base in zip(b["file"], b["base"], strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    ids = IdFile(f)
                    flat = ids.read(0, ids.n_ids).tobytes()
                lengths = np.diff(ids.first)
                sums = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(ids.first[:-1], ids.first[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(ids.names, "Int64"), "start": ids.first[:-1] + base, "n_tokens": lengths, "ids_crc32": pd.array(sums, "int64")})

    rows = materialise(files.select("file", "base"))
    n = rows.count()
    # A number of its own: these rows are so small that Spark would read all files in one task.
    spread = rows.repartition(max(1, min(n, 64), n // FILES_A_TASK))
    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession)
    return read_ids(write_ids(docs, folder, tokenizer, end_id), folder)

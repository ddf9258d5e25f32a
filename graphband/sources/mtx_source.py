"""Matrix Market as a data source: ``spark.read.format("mtx")`` and ``df.write.format("mtx")``.

The header alone is read when a frame is planned: it has the sizes, and says
where entries begin.  Readers take ranges of bytes after that place, and a line
belongs to the range that it starts in, so that one file makes as many partitions
as it is long.  Writers put entries into parts of their own; the commit writes the
header, which names the parts that count, so that what a lost task has left
behind is never read.

Options of the reader: ``path`` (a file, or a folder that the writer has made),
``partition_bytes``.  Of the writer: ``path``, ``n`` (rows of the square matrix),
``comment``.  Paths are local ones or URIs that pyarrow knows; ``mtx.read`` takes
any that Spark does.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from graphband.session import ship_package
from graphband.sources.mtx import Header

SCHEMA = "i long, j long, v double"
HEADER = "header.mtx"
PART = "%part "  # a comment of the header that names a part and its entries
PARTITION_BYTES = 32 << 20
BLOCK = 4 << 20  # bytes that a reader parses at once
ROWS = 65_536  # rows that a writer holds


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def read_header(file) -> tuple[Header, list[tuple[str, int]], int]:
    """The header, the parts that it names with their entries, and how many bytes of the open file it takes."""
    at, kind, parts, rest = 0, ["coordinate", "real", "general"], [], b""
    while True:
        end = rest.find(b"\n")
        if end < 0 and (more := file.read(1 << 16)):
            rest += more
            continue
        line, rest = (rest[: end + 1], rest[end + 1 :]) if end >= 0 else (rest, b"")
        at += len(line)
        text = line.decode("utf-8", "replace").strip()
        if text.lower().startswith("%%matrixmarket"):
            words = text.lower().split()
            kind = words[2:5] if len(words) >= 5 else kind
        elif text.startswith(PART):
            name, n = text[len(PART) :].split()
            parts.append((name, int(n)))
        elif text and not text.startswith("%"):
            try:
                rows, cols, nnz = (int(x) for x in text.split())
            except ValueError:
                raise ValueError(f"not a size line: {text[:80]!r}") from None
            return Header(rows, cols, nnz, *kind), parts, at
        elif not line:
            raise ValueError("no size line")


def entries(text: bytes, head: Header) -> Iterator:
    """A batch of whole lines, with the other half of symmetric storage."""
    import pyarrow as pa

    if b"%" in text:
        text = b"\n".join(x for x in text.split(b"\n") if not x.lstrip().startswith(b"%"))
    width = 2 if head.field == "pattern" else 3
    table = np.array(text.split(), object).reshape(-1, width)
    i, j = table[:, 0].astype(np.int64) - 1, table[:, 1].astype(np.int64) - 1
    v = table[:, 2].astype(np.float64) if width == 3 else np.ones(len(i))
    if head.symmetry != "general":
        off = i != j
        sign = -1.0 if head.symmetry == "skew-symmetric" else 1.0
        i, j, v = np.append(i, j[off]), np.append(j, i[off]), np.append(v, sign * v[off])
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v)], ["i", "j", "v"])


@dataclass
class Range(InputPartition):
    """Bytes of a file whose entries begin at ``first``."""

    path: str
    start: int
    end: int
    first: int
    head: Header


class MtxReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        folder = store.get_file_info(root).type == fs.FileType.Directory
        with store.open_input_stream(f"{root}/{HEADER}" if folder else root) as f:
            head, parts, at = read_header(f)
        if head.format != "coordinate" or head.field not in ("real", "integer", "pattern") or head.symmetry not in ("general", "symmetric", "skew-symmetric"):
            raise ValueError(f"cannot read {self.path}: {head}")
        if folder and sum(n for _, n in parts) != head.nnz:
            raise ValueError(f"{self.path}: parts and header do not agree")
        files = [(f"{root}/{name}", 0) for name, _ in parts] if folder else [(root, at)]
        out = []
        for name, first in files:
            last = store.get_file_info(name).size
            out += [Range(name, x, min(x + self.size, last), first, head) for x in range(first, last, self.size)]
        return out or [Range(root, 0, 0, 0, head)]

    def read(self, partition: Range) -> Iterator:
        store, _ = _store(self.path)
        at, left = partition.start, partition.end - partition.start
        if left <= 0:
            return
        with store.open_input_file(partition.path) as f:
            f.seek(at)
            held = b""
            if at > partition.first:  # the line that is open here belongs to the range before
                f.seek(at - 1)
                left += 1
                while (block := f.read(1 << 12)) and (cut := block.find(b"\n")) < 0:
                    left -= len(block)
                if not block:
                    return
                left -= cut + 1
                f.seek(f.tell() - len(block) + cut + 1)
            while left > 0:
                block = f.read(min(BLOCK, left))
                left -= len(block)
                if not block:
                    break
                held += block
                cut = held.rfind(b"\n") + 1
                if cut:
                    yield from entries(held[:cut], partition.head)
                    held = held[cut:]
            if held:  # a line that goes on beyond the range
                while (block := f.read(1 << 12)) and b"\n" not in block:
                    held += block
                yield from entries(held + block.split(b"\n")[0], partition.head)


@dataclass
class Written(WriterCommitMessage):
    name: str
    n: int
    least: tuple[int, int]


class MtxWriter(DataSourceWriter):
    def __init__(self, path: str, n: int, comment: str, overwrite: bool) -> None:
        self.path, self.n, self.comment, self.overwrite = path, n, comment, overwrite

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, n, least, lines = f"part-{uuid.uuid4().hex}.txt", 0, None, []
        with store.open_output_stream(f"{root}/{name}") as f:
            for r in rows:
                i, j, v = r["i"], r["j"], r["v"]
                if not (0 <= i < self.n and 0 <= j < self.n):
                    raise ValueError(f"entry ({i}, {j}) is outside a matrix of {self.n} rows")
                least = (i, j) if least is None else min(least, (i, j))
                lines.append(f"{i + 1} {j + 1} {v!r}\n")
                n += 1
                if len(lines) >= ROWS:
                    f.write("".join(lines).encode())
                    lines.clear()
            f.write("".join(lines).encode())
        return Written(name, n, least or (self.n, self.n))

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.least)
        if not self.overwrite and store.get_file_info(f"{root}/{HEADER}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{root}/{HEADER}") as f:
                parts = [Written(name, n, (0, 0)) for name, n in read_header(f)[1]] + parts
        head = ["%%MatrixMarket matrix coordinate real general", *([f"%{self.comment}"] if self.comment else []), *(f"{PART}{m.name} {m.n}" for m in parts), f"{self.n} {self.n} {sum(m.n for m in parts)}"]
        with store.open_output_stream(f"{root}/{HEADER}") as f:
            f.write(("\n".join(head) + "\n").encode())
        self._tidy(store, root, {m.name for m in parts})

    def _tidy(self, store, root: str, kept: set[str]) -> None:
        """Parts that the header does not name go."""
        from pyarrow import fs

        for x in store.get_file_info(fs.FileSelector(root)):
            if x.base_name.startswith("part-") and x.base_name not in kept:
                store.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{root}/{m.name}")


class MtxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MtxReader:
        return MtxReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite: bool) -> MtxWriter:
        return MtxWriter(self.options["path"], int(self.options["n"]), self.options.get("comment", ""), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(MtxSource)

"""Answers for tasks: each scan task asks for distinct keys, a join answers, and a later scan task reads its own answers.

Texts then need no shuffle and nothing is broadcast that grows with them, however
large the table of answers is.  A chunk is a partition of the scan, so a frame is
scanned as it is only where it comes straight from files, and is written first
where it does not (``steady``, which also keeps the splits of files from following
the number of executors).  Partitions can still change, by a setting or a file: a
roll call counts each chunk's rows and adds up marks of their ids, and every scan
is held against it, so that a scan of other chunks raises rather than take a
missing answer for a no.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphband.session import materialise, shared_dir

#: Plans of these nodes alone have the same partitions whenever and with whichever columns they run.
_STEADY = {"Project", "Filter", "LogicalRelation", "SubqueryAlias"}
_SPLITS = "spark.sql.files.minPartitionNum"
BUCKETS = 4096  # folders of published rows, at most


def steady(df: DataFrame) -> DataFrame:
    """``df``, or a copy in the shared folder where it does not come straight from files.

    Files are split by the number of cores where the session does not say how
    many partitions there should be; the present number is then made its setting,
    so that executors that come or go do not change the splits.
    """
    conf = df.sparkSession.conf
    if conf.get(_SPLITS, None) is None:
        conf.set(_SPLITS, str(df.sparkSession.sparkContext.defaultParallelism))

    def straight(node) -> bool:
        kids = node.children()
        return node.nodeName() in _STEADY and all(straight(kids.apply(i)) for i in range(kids.size()))

    return df if straight(df._jdf.queryExecution().optimizedPlan()) else materialise(df)


def chunk() -> int:
    """This task's partition."""
    return TaskContext.get().partitionId()


def release() -> None:
    """Give memory that a task has freed back to the system, as its worker waits for other stages' tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mark(name: Column) -> Column:
    """A number below 2**31 of an id."""
    return F.pmod(F.xxhash64(name.cast("long")), F.lit(1 << 31)).alias("mark")


class Here:
    """This task's rows, counted as they come; ``leave`` raises where they are not those of the roll call."""

    def __init__(self, told: tuple[int, int]) -> None:
        self.told, self.n, self.total = told, 0, 0

    def see(self, marks: np.ndarray) -> None:
        self.n += len(marks)
        self.total += int(marks.sum())

    def leave(self) -> None:
        check((self.n, self.total) == self.told)
        release()


class Roll:
    """Of each chunk how many rows it has and the sum of their marks: two numbers for each task of a scan."""

    def __init__(self, told) -> None:
        self.told = told  # broadcast: chunk, number, sum; sorted by chunk

    def here(self) -> Here:
        chunks, n, total = self.told.value
        at = int(np.searchsorted(chunks, chunk()))
        return Here((int(n[at]), int(total[at])) if at < len(chunks) and chunks[at] == chunk() else (0, 0))


def roll_call(docs: DataFrame, id_col: str) -> Roll:
    """The roll of a steady frame, of a scan of its ids alone; it has a row for each task that a scan has."""
    rows = docs.select(F.spark_partition_id().alias("chunk"), mark(docs[id_col])).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("total")).collect()
    table = np.array(sorted((r["chunk"], r["n"], r["total"]) for r in rows), np.int64).reshape(-1, 3)
    return Roll(docs.sparkSession.sparkContext.broadcast(tuple(table.T)))


def publish(rows: DataFrame) -> str:
    """Write rows to the shared folder, in order of their column ``chunk`` and in BUCKETS folders at most; returns the place."""
    folder = shared_dir(rows.sparkSession)
    apart = rows.withColumn("bucket", F.pmod("chunk", F.lit(BUCKETS)))
    apart.repartition("bucket").sortWithinPartitions("bucket", "chunk").write.partitionBy("bucket").option("parquet.block.size", 1 << 22).parquet(folder)
    return folder


def filesystem(folder: str):
    """pyarrow's view of a folder that Spark names by path or URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)


def mine(folder: str, *columns: str) -> list[np.ndarray]:
    """These columns of this task's chunk: of the row groups that may hold it."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, root = filesystem(folder)
    place = f"{root}/bucket={chunk() % BUCKETS}"
    if store.get_file_info(place).type != fs.FileType.Directory:
        return [np.empty(0, np.int64) for _ in columns]
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(place)) if x.path.endswith(".parquet"))
    found = ds.dataset(names, filesystem=store, format="parquet").to_table(columns=list(columns), filter=ds.field("chunk") == chunk())
    return [found.column(c).to_numpy() for c in columns]


def check(found: bool) -> None:
    if not found:
        raise RuntimeError("no answer: the frame's partitions changed between two scans")


def keep(docs: DataFrame, roll: Roll, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of a steady ``docs`` whose hashes (a of the id, b of the text) stand in ``kept`` (chunk, a, b) for their chunk; all columns, no shuffle of rows."""
    import pyarrow as pa

    folder, names = publish(kept.select("chunk", "a", "b")), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, here = set(zip(*(x.tolist() for x in mine(folder, "a", "b")), strict=True)), roll.here()
        for batch in batches:
            here.see(batch.column(0).to_numpy())
            keys = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            mask = pa.array([k in own for k in keys], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[3:], names=names).filter(mask)
        here.leave()

    a, b = hashes(docs, id_col, text_col)
    return docs.select(mark(docs[id_col]), a.alias("_a"), b.alias("_b"), *[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, docs.schema)


def hashes(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What ``keep`` tells rows apart by."""
    return F.xxhash64(docs[id_col].cast("long")), F.xxhash64(docs[text_col])
